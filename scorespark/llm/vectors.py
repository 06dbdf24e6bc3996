"""Integer vectors in tasks: rows dealt to parts, with the queries streamed past each part's documents.

A part is a bounded number of documents that one task holds; queries are copied
to every part and read in Arrow batches, so a task's memory does not grow with
the number of queries or of documents. Every row is dealt by a hash of its own
number, so equal vectors, labels or sources never meet in one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import claim, shuffle_partitions

PART_ROWS = 65536
NO_ID = np.iinfo(np.int64).max  # sorts last; a flag tells it from that very id
_EXACT = float(2**53)


def usable(v: Column) -> Column:
    """Not null, and no component null or non-finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def part_count(df: DataFrame, rows: int) -> int:
    """Parts for so many rows: at most ``PART_ROWS`` in one on average, and at least one a shuffle partition."""
    return max(1, min(rows, max(shuffle_partitions(df.sparkSession), -(-rows // PART_ROWS))))


def own_part(row: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(parts)).cast("int")


def every_part(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def by_part(dealt: DataFrame, parts: int) -> DataFrame:
    """Each part's documents (side 0) before the queries (side 1) that are read past them."""
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "side", "row")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(part, side, rows) of consecutive rows with the same part and side."""
    claim(__name__)
    for batch in batches:
        if not batch.num_rows:
            continue
        part, side = batch.column("part").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(side) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield int(part[a]), int(side[a]), batch.slice(a, b - a)


def matrices(column: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, floor(scale * x) as doubles) for every length of the vectors."""
    sizes = pc.list_value_length(column).to_numpy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            yield at, np.floor(np.clip(flat * scale, -1e300, 1e300)).reshape(len(at), int(dim))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two whole-numbered matrices; beyond 64 bits the ends of the range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = whole(a).dot(whole(b).T)
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(NO_ID).to_numpy(), none


def best(group: np.ndarray, score: np.ndarray, id_: np.ndarray, none: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k highest scores, ties to the smaller id, null ids last."""
    order = np.lexsort((row, none, id_, ~score, group))  # ~ reverses the order of integers and never overflows
    g = group[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    return order[rank < k]
