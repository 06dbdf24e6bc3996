"""Imputation, clipping, scaling and period encoding of wide score tables.

A fit is one aggregation that returns one row; applying it is a projection
with literals, so no join and no second shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import join_groups
from ..functions.scalar import clamp, encode_period, numeric_or_null, ref
from ..schema import BASE_YEAR, PERIOD, SCORE_MAX, SCORE_MIN, SUBJECTS


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric_or_null(df, c) for c in columns})


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return df.agg(*[F.avg(ref(c)).alias(c) for c in columns]).first().asDict()


def clean_missing(df: DataFrame, subjects: Sequence[str] = SUBJECTS,
                  means: Mapping[str, float | None] | None = None) -> DataFrame:
    """Non-numbers become NULL, NULLs become the mean over all periods.

    A column without any value stays NULL. Pass ``means`` to reuse an earlier fit.
    """
    numbers = to_numbers(df, subjects)
    means = column_means(numbers, subjects) if means is None else means
    return numbers.withColumns({
        s: F.coalesce(ref(s), F.lit(means[s])) for s in subjects if means.get(s) is not None
    })


def clean_missing_by(df: DataFrame, by: Sequence[str] = (PERIOD,),
                     subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """The per-group variant: NULLs become the mean of their group."""
    numbers = to_numbers(df, subjects)
    filled, names = _with_group_means(numbers, by, subjects)
    return filled.withColumns({s: F.coalesce(ref(s), ref(m)) for s, m in names.items()}).drop(*names.values())


def imputation_log(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (PERIOD,),
                   subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """One row per cell that ``clean_missing_by`` fills: keys, subject, imputed_value."""
    numbers = to_numbers(df, subjects)
    filled, names = _with_group_means(numbers, by, subjects)
    cells = filled.select(*[ref(k) for k in keys], *[
        F.when(ref(s).isNull(), ref(m)).alias(s) for s, m in names.items()
    ])
    return (
        cells.unpivot([ref(k) for k in keys], [ref(s) for s in subjects], "subject", "imputed_value")
        .where(F.col("imputed_value").isNotNull())
    )


def _with_group_means(df: DataFrame, by: Sequence[str], subjects: Sequence[str]):
    names = {s: f"_mean_{i}" for i, s in enumerate(subjects)}
    means = df.groupBy(*by).agg(*[F.avg(ref(s)).alias(m) for s, m in names.items()])
    return join_groups(df, means, by, "left"), names


def clip_outliers(df: DataFrame, subjects: Sequence[str] = SUBJECTS,
                  low: float = SCORE_MIN, high: float = SCORE_MAX) -> DataFrame:
    return df.withColumns({s: clamp(ref(s), low, high) for s in subjects})


def encode_year(df: DataFrame, base: int = BASE_YEAR) -> DataFrame:
    """Whole-number year and ``year_encoded``: base -> 0, next -> 1, other years NULL."""
    return df.withColumn(PERIOD, F.col(PERIOD).cast("int")).withColumn(
        "year_encoded", encode_period(F.col(PERIOD), base)
    )


def clean_marks(df: DataFrame, subjects: Sequence[str] = SUBJECTS, base: int = BASE_YEAR) -> DataFrame:
    """Fill, then clip, then encode the year: outliers take part in the means."""
    return encode_year(clip_outliers(clean_missing(df, subjects), subjects), base)


# --- scaling -----------------------------------------------------------------

def fit_min_max(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.min(ref(c)).alias(f"low{i}") for i, c in enumerate(columns)],
        *[F.max(ref(c)).alias(f"high{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(columns)}


def normalise(df: DataFrame, subjects: Sequence[str] = SUBJECTS,
              bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``{subject}_norm`` in [0, 1]; a constant column becomes 0. Pass ``bounds`` to reuse a fit."""
    bounds = fit_min_max(df, subjects) if bounds is None else bounds
    new = {}
    for s in subjects:
        low, high = bounds[s]
        if low is None:
            new[f"{s}_norm"] = F.lit(None).cast("double")
        else:
            new[f"{s}_norm"] = (ref(s) - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
    return df.withColumns(new)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets divisor 1."""
    row = df.agg(
        *[F.avg(ref(c)).alias(f"mean{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(ref(c)).alias(f"std{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"mean{i}"], row[f"std{i}"] or 1.0) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (ref(c).cast("double") - F.lit(float(mean))) / F.lit(float(std))
        for c, (mean, std) in scaler.items()
    })
