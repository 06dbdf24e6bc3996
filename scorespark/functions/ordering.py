"""Exact order-dependent results without sorting everything into one task.

* ``exact_quantiles`` narrows a value range by counting, pass after pass: every
  pass is one map-side aggregation and returns a bounded number of counts.
* ``row_numbers`` and ``running_totals`` cut the data into range slices, stage
  them with their slice number, and add each slice's offset to what is counted
  inside the slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .joins import join_groups
from .scalar import finite_or_null, ref

BINS = 1024


@dataclass
class _Search:
    """The value at ``rank`` lies in [low, high] of ``column``."""

    column: str
    rank: int
    low: float
    high: float

    @property
    def interval(self):
        return self.column, self.low, self.high


def _count_bins(df: DataFrame, intervals: Sequence[tuple[str, float, float]]):
    """Rows, smallest and largest value in every bin of every interval."""
    entries = F.array(*[
        F.when(
            ref(column).between(low, high),
            F.struct(
                F.lit(i).alias("search"),
                F.width_bucket(ref(column), F.lit(low), F.lit(high), F.lit(BINS)).alias("bin"),
                ref(column).alias("value"),
            ),
        )
        for i, (column, low, high) in enumerate(intervals)
    ])
    rows = df.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.*")
    counted = rows.groupBy("search", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    # at most len(intervals) * (BINS + 1) rows
    bins: dict[int, list] = {i: [] for i in range(len(intervals))}
    for row in counted.collect():
        bins[row["search"]].append((row["bin"], row["n"], row["low"], row["high"]))
    return {intervals[i]: sorted(found) for i, found in bins.items()}


def order_statistics(df: DataFrame, targets: Sequence[tuple[str, int]],
                     ranges: dict[str, tuple[float, float]]) -> list[float]:
    """The exact values at 0-based ranks of double columns, NULLs left out.

    An interval always splits: its ends fall into the first and the last bin.
    """
    searches = [_Search(c, rank, *ranges[c]) for c, rank in targets]
    while True:
        open_intervals = sorted({s.interval for s in searches if s.low < s.high})
        if not open_intervals:
            return [s.low for s in searches]
        bins = _count_bins(df, open_intervals)
        for s in searches:
            if s.low < s.high:
                before = (s.low, s.high, s.rank)
                for _, n, low, high in bins[s.interval]:
                    if s.rank < n:
                        s.low, s.high = low, high
                        break
                    s.rank -= n
                if (s.low, s.high, s.rank) == before:
                    raise ValueError(f"the range {before[:2]} cannot be narrowed; values must be finite and unchanging")


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5) -> dict[str, float | None]:
    """Exact quantile per column with linear interpolation; NaN and infinities count as NULL; NULL column -> None."""
    columns = list(columns)
    df = df.withColumns({c: finite_or_null(ref(c).cast("double")) for c in columns})
    summary = df.agg(
        *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(ref(c)).alias(f"low{i}") for i, c in enumerate(columns)],
        *[F.max(ref(c)).alias(f"high{i}") for i, c in enumerate(columns)],
    ).first()
    ranges, targets, weights = {}, [], {}
    for i, c in enumerate(columns):
        if summary[f"n{i}"]:
            ranges[c] = (summary[f"low{i}"], summary[f"high{i}"])
            position = q * (summary[f"n{i}"] - 1)
            below, above = math.floor(position), math.ceil(position)
            weights[c] = position - below
            targets += [(c, below), (c, above)]
    values = order_statistics(df, targets, ranges)
    result: dict[str, float | None] = dict.fromkeys(columns)
    for c, below, above in zip(ranges, values[0::2], values[1::2]):
        result[c] = below + (above - below) * weights[c]
    return result


def range_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` cut into range slices, numbered in ``_slice`` and staged so that every later pass sees the same slices."""
    cut = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    return stage(cut, "slices")


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str],
                   ahead: Sequence[str] = (), descending: bool = False, staged: DataFrame | None = None) -> DataFrame:
    """Add ``{c}_running`` per column in ``sums``: its inclusive running total in the group.

    ``{c}_ahead`` per column in ``ahead`` is the following row's value, NULL on the last row.
    ``df`` must hold one row per (by, order) value: aggregate first, so that a hot
    value is a single row. What ``range_slices`` has staged in this very order is
    passed as ``staged`` and not written again.
    """
    by = list(by)
    columns = [ref(c).desc() if descending else ref(c).asc() for c in order]
    staged = range_slices(df, [*[ref(b) for b in by], *columns]) if staged is None else staged
    place = F.struct(*[ref(c) for c in order])
    first_row = F.max_by if descending else F.min_by
    # one row per slice and group: as many as shuffle partitions plus groups
    slices = staged.groupBy(*by, "_slice").agg(
        *[F.sum(c).alias(f"{c}_total") for c in sums],
        *[first_row(F.col(c), place).alias(f"{c}_first") for c in ahead],
    )
    in_order = Window.partitionBy(*by).orderBy("_slice")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    edges = slices.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"{c}_total").over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums],
        *[F.lead(f"{c}_first").over(in_order).alias(f"{c}_after") for c in ahead],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(*columns)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        join_groups(staged, edges, [*by, "_slice"])
        .withColumns({
            **{f"{c}_running": F.col(f"{c}_before") + F.sum(c).over(so_far) for c in sums},
            **{f"{c}_ahead": F.coalesce(F.lead(c).over(inside), F.col(f"{c}_after")) for c in ahead},
        })
        .drop("_slice", *[f"{c}_before" for c in sums], *[f"{c}_after" for c in ahead])
    )


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "id", staged: bool = False) -> DataFrame:
    """Consecutive numbers from 1 in the order of columns that identify a row; ``staged``: ``df`` comes from ``range_slices``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    counted = running_totals(one, [], order, ["_one"], staged=one if staged else None)
    return counted.withColumnRenamed("_one_running", name).drop("_one")


def fold_starts(keys: DataFrame, key: str, folds: int) -> list:
    """First key of folds 1..k-1 when the sorted keys are cut into k contiguous folds.

    The first ``n % k`` folds are one key longer. Only the slices that hold a
    boundary are sorted, and only k-1 keys come back.
    """
    staged = range_slices(keys.select(ref(key)), [ref(key)])
    sizes = {r["_slice"]: r["count"] for r in staged.groupBy("_slice").count().collect()}
    n = sum(sizes.values())
    starts = [i * (n // folds) + min(i, n % folds) for i in range(1, folds)]
    wanted = []
    before = 0
    for number in sorted(sizes):
        wanted += [(number, s - before + 1) for s in starts if before <= s < before + sizes[number]]
        before += sizes[number]
    if not wanted:
        return []
    position = F.row_number().over(Window.partitionBy("_slice").orderBy(ref(key)))
    match = F.lit(False)
    for number, row in wanted:
        match = match | ((F.col("_slice") == number) & (F.col("_row") == row))
    picked = (
        staged.where(F.col("_slice").isin([number for number, _ in wanted]))
        .withColumn("_row", position).where(match).orderBy("_slice", "_row")
    )
    return [r[key] for r in picked.collect()]


def fold_number(key: Column, starts: Sequence) -> Column:
    """Fold of a key, 0-based: how many fold starts it has reached."""
    reached = [(key >= F.lit(s)).cast("int") for s in starts]
    return sum(reached[1:], reached[0]) if reached else F.lit(0)
