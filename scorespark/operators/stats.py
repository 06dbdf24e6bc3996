"""Descriptive statistics of wide score tables and feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.ordering import exact_quantiles
from ..functions.scalar import best_and_worst, finite_or_null, format_percent, label_name, ref, row_mean
from ..schema import BASE_YEAR, ENTITY, FAIL_MARK, LABEL, NAME, NEXT_YEAR, PERIOD, SUBJECTS


def _as_rows(one_row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Turn one row of aggregates into one row per struct."""
    return one_row.select(F.inline(F.array(*rows)))


# --- averages ------------------------------------------------------------------

def subject_averages(wide: DataFrame, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Mean per subject over all rows, highest first."""
    means = wide.agg(*[F.avg(ref(s)).alias(s) for s in subjects])
    return _as_rows(means, [
        F.struct(F.lit(s).alias("subject"), ref(s).alias("average")) for s in subjects
    ]).orderBy(F.col("average").desc_nulls_last(), "subject")


def student_averages(wide: DataFrame, year: int, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Mean across the subjects of each student in one year, lowest first."""
    return (
        wide.where(F.col(PERIOD) == year)
        .select(ENTITY, row_mean([ref(s) for s in subjects]).alias("average"))
        .orderBy(F.col("average").asc_nulls_last(), ENTITY)
    )


def class_progress(wide: DataFrame, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Mean per subject and year, in year order."""
    return wide.groupBy(PERIOD).agg(*[F.avg(ref(s)).alias(s) for s in subjects]).orderBy(PERIOD)


def subject_summary(wide: DataFrame, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """subject, mean, exact median and sample deviation over all rows."""
    medians = exact_quantiles(wide, subjects)
    moments = wide.agg(
        *[F.avg(ref(s)).alias(f"mean{i}") for i, s in enumerate(subjects)],
        *[F.stddev_samp(ref(s)).alias(f"std{i}") for i, s in enumerate(subjects)],
    )
    return _as_rows(moments, [
        F.struct(
            F.lit(s).alias("subject"),
            F.col(f"mean{i}").alias("mean"),
            F.lit(medians[s]).cast("double").alias("median"),
            F.col(f"std{i}").alias("std"),
        )
        for i, s in enumerate(subjects)
    ])


def student_summary(wide: DataFrame, subjects: Sequence[str] = SUBJECTS,
                    keys: Sequence[str] = (ENTITY, NAME, PERIOD)) -> DataFrame:
    """Overall mean, best and worst subject of every row."""
    best, worst = best_and_worst(subjects)
    return wide.select(
        *[ref(k) for k in keys],
        row_mean([ref(s) for s in subjects]).alias("overall_mean"),
        best.alias("best_subject"),
        worst.alias("worst_subject"),
    )


# --- correlation -----------------------------------------------------------------

def numeric_features(df: DataFrame, drop: Sequence[str] = ("id", LABEL)) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in drop
    ]


_GRAM = "n array<double>, s array<double>, q array<double>, p array<double>"


def _gram(batches: Iterator[pa.RecordBatch], centres: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """One row a task: for every column pair the rows where both are present, and their sums, squares and products.

    Sums and squares are those of the pair's first column, so a pair's second is at its mirrored place.
    """
    k = len(centres)
    total = np.zeros((4, k, k))
    for batch in batches:
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1).astype(np.float64) - centres
        there = ~np.isnan(x)
        x, there = np.where(there, x, 0.0), there.astype(np.float64)
        total += there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([t.ravel().tolist()], pa.list_(pa.float64())) for t in total], names=list("nsqp"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present.

    Every task folds its rows into dense arrays of counts, sums and products,
    one row a task, and these are added up: no row is made per column pair and
    input row. A column that is constant over a pair's rows gives NULL.
    """
    k = len(columns)
    values = df.select(*[finite_or_null(ref(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    centres = np.array([m or 0.0 for m in means])
    parts = values.mapInArrow(partial(_gram, centres=centres), _GRAM)
    cells = parts.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda at: F.struct(
        at.alias("at"), *[F.get(c, at).alias(c) for c in "nsqp"]))))
    # k * k rows from here on
    sums = cells.groupBy("at").agg(*[F.sum(c).alias(c) for c in "nsqp"])
    i, j = F.floor(F.col("at") / k).cast("int"), (F.col("at") % k).cast("int")
    one = sums.select(i.alias("i"), j.alias("j"), "n", "s", "q", "p")
    other = sums.select(j.alias("i"), i.alias("j"), F.col("s").alias("t"), F.col("q").alias("u"))
    both = one.join(other, ["i", "j"]).where("n > 0")
    n, centre = F.col("n"), F.array(*[F.lit(float(c)) for c in centres])

    def variance(at: str, s: str, q: str) -> Column:
        """Exact zero where all that is left is rounding."""
        v, c = F.col(q) / n - F.col(s) / n * F.col(s) / n, F.get(centre, F.col(at))
        return F.when(v > F.lit(1e-20) * (c * c + F.col(q) / n), v).otherwise(0.0)

    named = both.select("i", "j", variance("i", "s", "q").alias("vx"), variance("j", "t", "u").alias("vy"),
                        (F.col("p") / n - F.col("s") / n * F.col("t") / n).alias("c"))
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("vx") > 0, F.lit(1.0))).otherwise(
        F.try_divide("c", F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))))
    names = F.array(*[F.lit(c) for c in columns])
    return named.select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), r.alias("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = SUBJECTS) -> DataFrame:
    """The pairs as a square table: column ``feature`` and one column per feature."""
    pairs = correlation_pairs(df, columns)  # len(columns) ** 2 rows
    return pairs.groupBy(F.col("feature_a").alias("feature")).agg(*[
        F.max(F.when(F.col("feature_b") == c, F.col("correlation"))).alias(c) for c in columns
    ])


# --- classes -----------------------------------------------------------------------

def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label with its display name, in label order; NULL labels are left out."""
    return (
        df.where(ref(label).isNotNull())
        .groupBy(ref(label)).agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("class", label_name(ref(label)))
        .orderBy(label)
    )


def label_kpis(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: total, passes, fails, fail_rate and its display text."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ref(label) == 0).alias("passes"),
        F.count_if(ref(label) == 1).alias("fails"),
    )
    rate = F.col("fails") / F.greatest(F.lit(1), F.col("total"))
    return counts.withColumn("fail_rate", rate).withColumn("fail_rate_text", format_percent(rate))


def value_bounds(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value over two columns."""
    return df.groupBy(*by).agg(
        F.least(F.min(ref(a)), F.min(ref(b))).alias("low"),
        F.greatest(F.max(ref(a)), F.max(ref(b))).alias("high"),
    )


# --- rankings and changes ------------------------------------------------------------

def student_overall(wide: DataFrame, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Per student: the mean over the years of the year's mean across subjects."""
    return (
        wide.select(ENTITY, NAME, row_mean([ref(s) for s in subjects]).alias("_mean"))
        .groupBy(ENTITY, NAME).agg(F.avg("_mean").alias("overall_mean"))
    )


def top_performers(wide: DataFrame, n: int = 3, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """The n students with the highest overall mean; a tie goes to the smaller id."""
    return student_overall(wide, subjects).orderBy(
        F.col("overall_mean").desc_nulls_last(), ENTITY
    ).limit(n)


def _subject_means(wide: DataFrame, subjects: Sequence[str]) -> DataFrame:
    return wide.groupBy(ENTITY, NAME).agg(*[F.avg(ref(s)).alias(s) for s in subjects])


def failing_students(wide: DataFrame, threshold: float = FAIL_MARK,
                     subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """(student, subject) pairs whose mean over the years is below the threshold."""
    return (
        _subject_means(wide, subjects)
        .unpivot([F.col(ENTITY), F.col(NAME)], [ref(s) for s in subjects], "subject", "subject_avg")
        .where(F.col("subject_avg") < threshold)
    )


def student_alerts(wide: DataFrame, threshold: float = FAIL_MARK,
                   subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Per student: mean, best and worst subject over the years, and the alert flag."""
    summary = student_summary(_subject_means(wide, subjects), subjects, (ENTITY, NAME, *subjects))
    below = [F.coalesce(ref(s) < threshold, F.lit(False)) for s in subjects]
    alert = below[0]
    for flag in below[1:]:
        alert = alert | flag
    return summary.withColumn("alert", alert).drop(*subjects)


def year_on_year(wide: DataFrame, base: int = BASE_YEAR, following: int = NEXT_YEAR,
                 subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Both years' scores (``{s}_{year}``), their deltas and the mean delta per student.

    One grouped pass over the two years instead of a self-join; students without
    a row in both years are left out.
    """
    both = wide.where(F.col(PERIOD).isin(base, following)).groupBy(ENTITY, NAME).agg(
        *[
            F.avg(F.when(F.col(PERIOD) == y, ref(s))).alias(f"{s}_{y}")
            for y in (base, following) for s in subjects
        ],
        F.count_if(F.col(PERIOD) == base).alias("_base"),
        F.count_if(F.col(PERIOD) == following).alias("_next"),
    )
    deltas = {f"{s}_delta": ref(f"{s}_{following}") - ref(f"{s}_{base}") for s in subjects}
    return (
        both.where((F.col("_base") > 0) & (F.col("_next") > 0))
        .withColumns(deltas)
        .withColumn("overall_delta", row_mean([ref(d) for d in deltas]))
        .drop("_base", "_next")
    )


def year_on_year_change(wide: DataFrame, base: int = BASE_YEAR, following: int = NEXT_YEAR,
                        subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Only the deltas of ``year_on_year``."""
    return year_on_year(wide, base, following, subjects).select(
        ENTITY, NAME, *[ref(f"{s}_delta") for s in subjects], "overall_delta"
    )


def overview_kpis(wide: DataFrame, base: int = BASE_YEAR, following: int = NEXT_YEAR,
                  subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """One row: class average, top student, most improved student.

    Ties go to the smaller id. The three results are uncorrelated scalar
    subqueries, each at most one row.
    """
    top = top_performers(wide, 1, subjects).select(F.struct(ENTITY, "overall_mean"))
    improved = (
        year_on_year_change(wide, base, following, subjects)
        .orderBy(F.col("overall_delta").desc_nulls_last(), ENTITY).limit(1)
        .select(F.struct(ENTITY, "overall_delta"))
    )
    averages = wide.agg(
        F.avg(row_mean([ref(s) for s in subjects])).alias("class_average")
    )
    return averages.select(
        "class_average", top.scalar().alias("top"), improved.scalar().alias("improved")
    ).select(
        "class_average",
        F.col("top")[ENTITY].alias("top_student"),
        F.col("top")["overall_mean"].alias("top_mean"),
        F.col("improved")[ENTITY].alias("most_improved"),
        F.col("improved")["overall_delta"].alias("best_delta"),
    )
