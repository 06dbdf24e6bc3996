"""Exact top-k by inner product, block at a time.

A task holds a part of the documents in blocks of ``block`` rows: the forward
index of a block is its matrix, and for every component (term) it knows the
block's largest and smallest value. A query's bound on a block is the sum, over
its components, of the largest product the block allows. Blocks are visited in
the order of these sums until the bound falls below the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorespark.llm import vectors as V

_STRIPE = 256
_CODE_DIMS = 8


class _Blocks:
    """The documents of one length in a part; like vectors are put next to each other, so that maxima are tight."""

    def __init__(self, x: np.ndarray, id_: np.ndarray, none: np.ndarray, row: np.ndarray, block: int):
        telling = np.argsort(-x.var(axis=0))[:_CODE_DIMS] if x.size else np.empty(0, int)
        code = ((x[:, telling] > 0) << np.arange(len(telling))).sum(axis=1)
        order = np.lexsort((row, code))
        self.x, self.id, self.none, self.row = x[order], id_[order], none[order], row[order]
        self.cuts = [*range(0, len(x), block), len(x)]
        self.high = np.array([self.x[a:b].max(axis=0) for a, b in zip(self.cuts, self.cuts[1:])])
        self.low = np.array([self.x[a:b].min(axis=0) for a, b in zip(self.cuts, self.cuts[1:])])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """At least the highest score of each query in each block."""
        total = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        size = np.maximum(q, 0) @ np.abs(self.high).T - np.minimum(q, 0) @ np.abs(self.low).T
        return total + 1e-9 * size + 1  # above what rounding can take away

    def search(self, q: np.ndarray, row: np.ndarray, k: int):
        """(query, score, id, none, row) of each query's k best documents here."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        kth = np.full(len(q), -np.inf)
        pool = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64))
        for turn in range(order.shape[1]):
            open_ = np.flatnonzero(bound[np.arange(len(q)), order[:, turn]] >= kth)
            if not len(open_):
                break
            found = [pool]
            for b in np.unique(order[open_, turn]):
                who = open_[order[open_, turn] == b]
                rows = slice(self.cuts[b], self.cuts[b + 1])
                score = V.products(q[who], self.x[rows])
                hit = (score >= kth[who, None]) & (self.row[rows] != row[who, None])
                i, j = np.nonzero(hit)
                found.append((who[i], score[i, j], self.id[rows][j], self.none[rows][j], self.row[rows][j]))
            pool = tuple(np.concatenate(c) for c in zip(*found))
            keep = V.best(*pool, k)
            pool = tuple(c[keep] for c in pool)
            count = np.bincount(pool[0], minlength=len(q))
            lowest = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(lowest, pool[0], pool[1])
            kth = np.where(count >= k, lowest.astype(np.float64), -np.inf)
            kth[kth > 2**52] *= 1 - 2**-50  # a double must not pass the whole number it stands for
        return pool


def _search(batches: Iterator[pa.RecordBatch], k: int, scale: float, block: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    index: dict[int, _Blocks] = {}
    now = None
    for part, side, rows in V.runs(batches):
        if part != now:
            now, held, index = part, [], {}
        if side == 0:
            held.append(rows)
            continue
        if held:  # the part's documents are complete: its queries begin
            docs, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
            id_, none = V.ids(docs.column("id"))
            number = docs.column("row").to_numpy()
            for at, x in V.matrices(docs.column("x"), scale):
                index[x.shape[1]] = _Blocks(x, id_[at], none[at], number[at], block)
        number, id_ = rows.column("row").to_numpy(), rows.column("id").to_numpy()
        for at, q in V.matrices(rows.column("x"), scale):
            if q.shape[1] not in index:
                continue
            for s in range(0, len(at), _STRIPE):
                here = at[s:s + _STRIPE]
                who, score, other, none, _ = index[q.shape[1]].search(q[s:s + _STRIPE], number[here], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[here[who]]), pa.array(id_[here[who]]), pa.array(other, mask=none), pa.array(score)],
                    names=["row", "query_id", "found", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of highest integer inner product for every query row.

    A component x counts as floor(scale * x), x as double; ties go to the
    smaller id, null ids last. ``is_query`` tells the query rows; a query's
    candidates are all rows but itself, and all of them if fewer than ``k``.

    Vectors that are null or hold a null or non-finite component take no part.
    Vectors of different lengths are not compared; empty ones score 0 with each
    other. Rows that repeat an id are different candidates, and each is a query
    of its own if the id is one. A row with a null id is a candidate, never a
    query. Scores beyond 64 bits stand at the ends of that range. An empty
    table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).where(V.usable(F.col("x")))
    parts = V.part_count(vectors, rows.count())
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    place = lambda part, side: F.struct(part.cast("int").alias("part"), F.lit(side).alias("side"))
    asks = F.when(F.col("asks") & F.col("id").isNotNull(),
                  F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: place(p, 1)))
    places = F.concat(F.array(place(V.own_part(F.col("row"), parts), 0)),
                      F.coalesce(asks, F.array().cast("array<struct<part:int,side:int>>")))
    dealt = rows.select("row", "id", "x", F.explode(places).alias("p")).select("row", "id", "x", "p.part", "p.side")
    found = V.by_part(dealt, parts).mapInArrow(
        partial(_search, k=k, scale=scale, block=block), "row long, query_id long, found long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("found")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("found").alias(id_col), "score")
