"""Hard negatives by threshold joins with an inverted index bounded by norms.

A part's index for a threshold leaves out, of every document, the leading
components whose norm cannot reach the threshold with any query (components
are ordered by their energy in the part, the weakest first). Documents are sorted
by how much was left out, so the postings of a component are a leading run of
them. Scores are accumulated from the last components to the first; after every
few components a document is dropped when what it has and the norms of what
remains stay below the threshold. Survivors are scored on all components.
Thresholds start high and fall until every window holds what it may.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorespark.llm import vectors as V
from scorespark.llm.common import Staged

_CELLS = 1 << 21
_DIMS = 8
_POSITIVE_LEVELS = (0.6, 0.4, 0.25)  # of the product of norms
_STEPS = 3
_NONE = np.iinfo(np.int64).max


class _Index:
    """Documents of one length in a part, and threshold joins on them."""

    def __init__(self, x: np.ndarray, id_: np.ndarray, none: np.ndarray, row: np.ndarray, label: np.ndarray):
        self.dims = np.argsort((x * x).mean(axis=0), kind="stable") if len(x) else np.arange(x.shape[1])
        self.x, self.id, self.none, self.row, self.label = x[:, self.dims], id_, none, row, label
        self.norms = _norms(self.x)
        self.longest = float(self.norms[:, -1].max(initial=0))

    def best(self, who: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        return V.best(who, score, self.id[doc], self.none[doc], self.row[doc], k)

    def found(self, number, who, doc, score, keep, name: str) -> pa.RecordBatch:
        who, doc = who[keep], doc[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(number[who]), pa.array(self.id[doc], mask=self.none[doc]), pa.array(score[keep]), pa.array(self.row[doc])],
            names=["row", name, "score", "other"])

    def join(self, q: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs that score at least the query's ``t``, as (queries looked at, query, document, score), some queries at a time."""
        q = q[:, self.dims]
        norms = _norms(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(norms[:, -1] > 0, t / norms[:, -1], np.where(t > 0, np.inf, -np.inf))
        stripe = max(1, _CELLS // max(1, len(self.x)))
        by_reach = np.argsort(reach, kind="stable")  # queries of like thresholds share an index
        for s in range(0, len(q), stripe):
            who = by_reach[s:s + stripe]
            i, order = self._candidates(q[who], norms[who], t[who], float(reach[who].min()))
            score = _pair_products(q[who], self.x, i, order)
            hit = score >= t[who][i]
            yield who, who[i[hit]], order[hit], score[hit]

    def _candidates(self, q: np.ndarray, qn: np.ndarray, t: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of all pairs that may score ``t``; ``reach`` is the least of t over the query's norm."""
        dim = q.shape[1]
        if not dim or reach == -np.inf:  # below the lowest score that norms allow, every document is scored
            i, order = np.indices((len(q), len(self.x)))
            return i.ravel(), order.ravel()
        # leading components with a norm below the reach are not indexed
        left_out = np.maximum((self.norms < reach * (1 - 1e-9)).sum(axis=1) - 1, 0)
        order = np.argsort(left_out, kind="stable")
        order = order[left_out[order] < dim]
        left = left_out[order]
        acc = np.zeros((len(q), len(order)))
        for end in range(dim, 0, -_DIMS):
            start = max(0, end - _DIMS)
            n = int(np.searchsorted(left, end))  # postings: the documents with an indexed component below ``end``
            index = self.x[order[:n], start:end]
            edge = np.flatnonzero(left[:n] > start)  # these begin inside
            index[edge] *= np.arange(start, end) >= left[edge][:, None]
            acc[:, :n] += q[:, start:end] @ index.T
            at = np.maximum(left, start)
            rest = qn[:, at] * self.norms[order, at]
            alive = (acc + rest * (1 + 1e-9) + 1 >= t[:, None]).any(axis=0)
            if not alive.all():
                order, left, acc = order[alive], left[alive], acc[:, alive]
        i, j = np.nonzero(acc + qn[:, left] * self.norms[order, left] * (1 + 1e-9) + 1 >= t[:, None])
        return i, order[j]


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, ... components of each row."""
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1))


def _pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of row i of ``a`` with row j of ``b``; beyond 64 bits the ends of the range."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        out = [np.einsum("ij,ij->i", a[i[s:s + 65536]], b[j[s:s + 65536]]) for s in range(0, len(i), 65536)]
        return np.concatenate([np.empty(0), *out]).astype(np.int64)
    return np.array([V.products(a[x:x + 1], b[y:y + 1])[0, 0] for x, y in zip(i.tolist(), j.tolist())], np.int64)


class _Labels:
    """Numbers for labels, the same for all rows a task sees."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        d = column.dictionary_encode()
        codes = np.array([self.codes.setdefault(v, len(self.codes)) for v in d.dictionary.to_pylist()], np.int64)
        return codes[d.indices.to_numpy()]


def _parts(batches: Iterator[pa.RecordBatch], scale: float):
    """(index, queries, their matrix) for each part's documents and each batch of queries of the same length."""
    held: list[pa.RecordBatch] = []
    index: dict[int, _Index] = {}
    labels, now = _Labels(), None
    for part, side, rows in V.runs(batches):
        if part != now:
            now, held, index, labels = part, [], {}, _Labels()
        if side == 0:
            held.append(rows)
            continue
        if held:
            docs, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
            id_, none = V.ids(docs.column("id"))
            number, label = docs.column("row").to_numpy(), labels(docs.column("label"))
            for at, x in V.matrices(docs.column("x"), scale):
                index[x.shape[1]] = _Index(x, id_[at], none[at], number[at], label[at])
        label = labels(rows.column("label"))
        for at, q in V.matrices(rows.column("x"), scale):
            if q.shape[1] in index:
                yield index[q.shape[1]], rows.take(pa.array(at)), label[at], q


def _positives(batches: Iterator[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Each query's ``k`` best documents of its label in every part."""
    for index, rows, label, q in _parts(batches, scale):
        number = rows.column("row").to_numpy()
        size = np.sqrt((q * q).sum(axis=1)) * index.longest
        pending = np.arange(len(q))
        for level in (*_POSITIVE_LEVELS, None):
            t = np.full(len(pending), -np.inf) if level is None else size[pending] * level
            filled = np.zeros(len(pending), bool)
            for looked_at, who, doc, score in index.join(q[pending], t):
                mine = (index.label[doc] == label[pending[who]]) & (index.row[doc] != number[pending[who]])
                who, doc, score = who[mine], doc[mine], score[mine]
                keep = index.best(who, doc, score, k)
                full = np.bincount(who[keep], minlength=len(pending)) >= k
                filled[looked_at] = full[looked_at] | (level is None)
                yield index.found(number[pending], who, doc, score, keep[filled[who[keep]]], "positive_id")
            pending = pending[~filled]
            if not len(pending):
                break


def _negatives(batches: Iterator[pa.RecordBatch], k: int, scale: float, share: int) -> Iterator[pa.RecordBatch]:
    """Each window's ``k`` best documents of other labels in every part."""
    for index, rows, label, q in _parts(batches, scale):
        number, tops = rows.column("row").to_numpy(), rows.column("tops").to_pylist()
        width = max(len(p) for p in tops)
        # a window reaches from ``low`` to ``top``; below 0 and beyond the list there is none
        top = np.array([p + [-1] * (width - len(p)) for p in tops], np.int64).reshape(len(q), width)
        low = np.array([[_NONE if p < 0 else -(-share * p // 100) for p in r] for r in top.tolist()], np.int64).reshape(top.shape)
        need, least = low.min(axis=1, initial=_NONE), np.where(top < 0, _NONE, top).min(axis=1, initial=_NONE)
        pending = np.flatnonzero(need < _NONE)
        # from just below the lowest positive's score to the end of its window, where nothing is left to find
        for step in range(1, _STEPS + 1):
            if not len(pending):
                break
            t = least[pending] - (least[pending] - need[pending]) // _STEPS * step if step < _STEPS else need[pending]
            filled = np.zeros(len(pending), bool)
            for looked_at, who, doc, score in index.join(q[pending], t.astype(np.float64)):
                other = index.label[doc] != label[pending[who]]
                who, doc, score = who[other], doc[other], score[other]
                at, full, windows = pending[who], np.ones(len(pending), bool), []
                for j in range(width):
                    inside = np.flatnonzero((score <= top[at, j]) & (score >= low[at, j]))
                    keep = inside[index.best(who[inside], doc[inside], score[inside], k)]
                    full &= (np.bincount(who[keep], minlength=len(pending)) >= k) | (t <= low[pending, j])
                    windows.append(keep)
                filled[looked_at] = full[looked_at]
                for j, keep in enumerate(windows):
                    out = index.found(number[pending], who, doc, score, keep[filled[who[keep]]], "negative_id")
                    yield out.append_column("place", pa.array(np.full(out.num_rows, j + 1, np.int32)))
            pending = pending[~filled]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5,
                   share: int = 80, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor row.

    A component x counts as floor(scale * x), x as double; a row's score is its
    integer inner product with the anchor. An anchor's positives are its
    ``positives`` best other rows of its label; a positive's negatives are the
    ``negatives`` best rows of other labels that score from ``share`` percent of
    the positive's score up to that score. Higher scores come first, ties go to
    the smaller id, null ids last. A positive with a negative score has no
    window and gives no rows, like one whose window is empty.

    Rows with a null label, a null vector or a null or non-finite component take
    no part. Vectors of different lengths are not compared. Rows that repeat an
    id are different rows, and each is an anchor of its own if the id is one. A
    row with a null id is never an anchor. Scores beyond 64 bits stand at the ends of
    that range. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    keep = Staged(spark, "negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"),
                          label.cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(V.usable(F.col("x")) & F.col("label").isNotNull())
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = V.part_count(vectors, rows.count())
    none = F.lit(None).cast("array<bigint>").alias("tops")
    docs = rows.select("row", "id", "x", "label", none, V.own_part(F.col("row"), parts).alias("part"), F.lit(0).alias("side"))
    anchors = rows.where("asks and id is not null").select("row", "id", "x", "label")

    def dealt(queries: DataFrame) -> DataFrame:
        asked = queries.select("row", "id", "x", "label", "tops", V.every_part(parts).alias("part"), F.lit(1).alias("side"))
        return V.by_part(docs.union(asked), parts)

    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "other")
    first = dealt(anchors.withColumn("tops", none)).mapInArrow(
        partial(_positives, k=positives, scale=scale), "row long, positive_id long, score long, other long")
    first = keep(first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    # one row an anchor: its positives' scores, best first
    tops = first.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))),
                                                lambda p: p["score"]).alias("tops"))
    best = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"), "other")
    second = dealt(anchors.join(tops, "row")).mapInArrow(
        partial(_negatives, k=negatives, scale=scale, share=share),
        "row long, negative_id long, score long, other long, place int")
    second = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    pairs = first.select("row", "place", "positive_id", F.col("score").alias("positive_score"))
    return (second.select("row", "place", "rank", "negative_id", F.col("score").alias("negative_score"))
            .join(pairs, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
