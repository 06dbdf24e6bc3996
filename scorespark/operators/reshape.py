"""Long to wide and back, and the per-student views of a wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import ref
from ..schema import CATEGORY, ENTITY, NAME, PERIOD, SCORE, SUBJECTS, require_columns


def pivot_scores(long: DataFrame, keys: Sequence[str] = (ENTITY, NAME, PERIOD),
                 subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """One row per key, one column per subject, the mean of repeated scores.

    Conditional means need one shuffle on the keys, with map-side combining; a
    key without any score gets no row, so rows without one are left out before it.
    """
    wide = long.where(F.col(SCORE).isNotNull()).groupBy(*[ref(k) for k in keys]).agg(*[
        F.avg(F.when(F.col(CATEGORY) == s, F.col(SCORE))).alias(s) for s in subjects
    ])
    return wide.where(F.coalesce(*[ref(s) for s in subjects]).isNotNull())


def ensure_wide(df: DataFrame, keys: Sequence[str] = (ENTITY, NAME, PERIOD),
                subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Scores with one row per ``keys`` and one column per subject, from either form.

    The schema decides: a frame with a category and a score column is long and is
    averaged over the keys, whatever other columns it has (a surrogate id splits no
    group); any other must hold the keys and every subject, and keeps its rows.
    """
    long = [c for c in (CATEGORY, SCORE) if c in df.columns]
    if len(long) == 2:
        require_columns(df, keys, "long scores")
        return pivot_scores(df, keys, subjects)
    require_columns(df, [*keys, *subjects], "wide scores")
    return df


def melt_scores(wide: DataFrame, keys: Sequence[str] = (ENTITY, PERIOD),
                subjects: Sequence[str] = SUBJECTS, value: str = SCORE) -> DataFrame:
    """One row per key and subject; NULL scores are kept."""
    return wide.unpivot([ref(k) for k in keys], [ref(s) for s in subjects], CATEGORY, value)


def student_rows(wide: DataFrame, student_id, year: int | None = None) -> DataFrame:
    """The rows of one student, of one year if given, in year order."""
    rows = wide.where(F.col(ENTITY) == F.lit(student_id))
    if year is not None:
        rows = rows.where(F.col(PERIOD) == year)
    return rows.orderBy(PERIOD)


def require_rows(df: DataFrame, what) -> DataFrame:
    """Raise ``ValueError`` when the frame is empty."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def _rows_of(wide: DataFrame, student_id) -> DataFrame:
    if student_id is None:
        return wide
    return require_rows(wide.where(F.col(ENTITY) == F.lit(student_id)), student_id)


def progress_series(wide: DataFrame, student_id=None, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Year-ordered series per subject of one student, or of all; an unknown student is a ``ValueError``."""
    rows = _rows_of(wide, student_id)
    return melt_scores(rows, (ENTITY, PERIOD), subjects).orderBy(ENTITY, CATEGORY, PERIOD)


def subject_by_year(wide: DataFrame, years: Sequence[int], student_id=None,
                    subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """One row per student and subject, one column ``y{year}`` per year.

    The years are folded per student before the subjects become rows, so the
    shuffle carries one row per student and year. An unknown student is a ``ValueError``.
    """
    rows = _rows_of(wide, student_id).where(F.col(PERIOD).isin(list(years)))
    folded = rows.groupBy(ENTITY).agg(*[
        F.struct(*[
            F.avg(F.when(F.col(PERIOD) == y, ref(s))).alias(f"y{y}") for y in years
        ]).alias(s)
        for s in subjects
    ])
    return folded.unpivot([F.col(ENTITY)], [ref(s) for s in subjects], CATEGORY, "by_year").select(
        ENTITY, CATEGORY, "by_year.*"
    )


def predictions_long(wide: DataFrame, keys: Sequence[str] = (ENTITY,),
                     subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Predictions as (student, subject, predicted_mark), lowest first for each student."""
    return melt_scores(wide, keys, subjects, "predicted_mark").orderBy(
        *[ref(k) for k in keys], F.col("predicted_mark").asc_nulls_last(), CATEGORY
    )
