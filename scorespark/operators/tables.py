"""Joins, unions and key handling between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import ref
from ..schema import BASE_YEAR, CATEGORY, ENTITY, NAME, NEXT_YEAR, PERIOD, SCORE, SUBJECTS
from .reshape import pivot_scores


def get_all_marks(marks: DataFrame, students: DataFrame) -> DataFrame:
    """Marks with student names, ordered by student, year and subject.

    No broadcast hint: the session broadcasts the names when their measured size
    allows and otherwise splits a skewed student in the sort-merge join. The id ends
    the sort key, so that the range sort can split a student with very many marks.
    """
    last = "id" if "id" in marks.columns else SCORE
    return (
        marks.join(students.select(ENTITY, NAME), ENTITY)
        .orderBy(ENTITY, PERIOD, CATEGORY, last)
        .select(ENTITY, NAME, PERIOD, CATEGORY, SCORE)
    )


def get_all_marks_wide(marks: DataFrame, students: DataFrame,
                       subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Wide marks with names. Marks are averaged before the join, so it sees one row per student and year."""
    wide = pivot_scores(marks, (ENTITY, PERIOD), subjects)
    return wide.join(students.select(ENTITY, NAME), ENTITY).select(
        ENTITY, NAME, PERIOD, *[ref(s) for s in subjects]
    )


def get_student_marks(marks: DataFrame, students: DataFrame, student_id,
                      subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Wide marks of one student; the key filter reaches both scans."""
    return get_all_marks_wide(marks, students, subjects).where(F.col(ENTITY) == F.lit(student_id))


def build_regression_dataset(wide: DataFrame, subjects: Sequence[str] = SUBJECTS,
                             base: int = BASE_YEAR, following: int = NEXT_YEAR) -> DataFrame:
    """Scores of ``base`` beside the same student's scores of ``following``."""
    if following <= base:
        raise ValueError("the target year must be later than the feature year")
    features = wide.where(F.col(PERIOD) == base).select(
        ENTITY, F.lit(0).alias("year_encoded"), *[ref(s) for s in subjects]
    )
    targets = wide.where(F.col(PERIOD) == following).select(
        ENTITY, *[ref(s).alias(f"{s}_next") for s in subjects]
    )
    return features.join(targets, ENTITY)


def consecutive_pairs(wide: DataFrame, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Every (year, year + 1) pair of every student; the first year of a pair is encoded as 0."""
    features = wide.select(ENTITY, PERIOD, F.lit(0).alias("year_encoded"), *[ref(s) for s in subjects])
    targets = wide.select(
        ENTITY, (F.col(PERIOD) - 1).alias(PERIOD), *[ref(s).alias(f"{s}_next") for s in subjects]
    )
    return features.join(targets, [ENTITY, PERIOD])


def orphan_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact keys without a dimension row, with their row counts.

    Facts are counted per key first, so a hot key joins as one row.
    """
    counts = facts.groupBy(ref(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(dimension.select(ref(key)), key, "left_anti")


def check_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The facts unchanged; ``ValueError`` when a key has no dimension row."""
    bad = orphan_keys(facts, dimension, key).limit(5).collect()
    if bad:
        raise ValueError(f"{key} without a dimension row, for example {[r[key] for r in bad]}")
    return facts


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per ``subset`` value in ``order``; NULLs compare equal.

    A minimum over a struct combines map-side, so a third of all rows being copies
    of one row is no hot task; a row-number window would be.
    """
    rest = [c for c in df.columns if c not in subset]
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    first = F.min(F.struct(
        *[o.alias(f"_order{i}") for i, o in enumerate(ordering)], *[ref(c) for c in rest]
    ))
    firsts = df.groupBy(*[ref(c) for c in subset]).agg(first.alias("_first"))
    return firsts.select(*[
        F.col("_first")[c].alias(c) if c in rest else ref(c) for c in df.columns
    ])


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: Sequence[str],
                     order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` lacks; the first in ``order`` per key."""
    known = existing.select(*[ref(k) for k in key]).distinct()
    return keep_first(new, key, order).join(known, list(key), "left_anti")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name, absent columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(ref(column)).distinct().orderBy(ref(column))


def drop_missing_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(ref(label).isNotNull())


def label_load_report(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: kept rows, rows dropped for a missing label, and the class counts."""
    return df.agg(
        F.count(ref(label)).alias("kept"),
        F.count_if(ref(label).isNull()).alias("dropped"),
        F.count_if(ref(label) == 0).alias("passes"),
        F.count_if(ref(label) == 1).alias("fails"),
    )
