"""Queries over score histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import clamp, format_entity_id, grade, nan_to_null, ref
from ..operators import cleaning, reshape, stats, tables as ops
from ..session import scratch_path
from ..sources import marks as mark_files, tables as logs
from .tables import (
    BASE, NEXT, SUBJECTS, clean, marks, pairs, rounded, staged_wide, students, table, wide,
)

STUDENT = 7  # the student the single-student queries look up
GRADES = {"A": 70.0, "B": 60.0, "C": 50.0, "D": 40.0}


# --- scans and joins -----------------------------------------------------------

def marks_joined(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ops.get_all_marks(marks(spark, sf), students(spark, sf)))


def marks_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wide(spark, sf))


def entity_marks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ops.get_student_marks(marks(spark, sf), students(spark, sf), STUDENT, SUBJECTS))


def entity_period_row(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reshape.student_rows(wide(spark, sf), STUDENT, NEXT).limit(1))


def ordered_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wide(spark, sf).select("student_id", "year", *SUBJECTS).orderBy("student_id", "year"))


def dimension_scan(spark: SparkSession, sf: str) -> DataFrame:
    return logs.get_all_students(students(spark, sf))


def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ops.distinct_sorted(marks(spark, sf), "student_id")


def distinct_periods(spark: SparkSession, sf: str) -> DataFrame:
    return ops.distinct_sorted(marks(spark, sf), "year")


def next_period_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs(spark, sf))


def pooled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ops.consecutive_pairs(clean(spark, sf), SUBJECTS).drop("year_encoded"))


def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of customers in debt; the tables have no orphans, so these stand in for missing parents."""
    active = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("student_id"))
    return ops.orphan_keys(marks(spark, sf), active, "student_id")


def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Marks after 1995 of student and subject pairs that no mark up to 1995 has, the first of each pair."""
    m = marks(spark, sf)
    known = m.where(F.col("year") <= 1995).select("student_id", "subject")
    new = m.where(F.col("year") > 1995).select("student_id", "subject", "id", "mark")
    return rounded(ops.insert_or_ignore(known, new, ["student_id", "subject"], ["id"]))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("split"),
    )
    s = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("split"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    return ops.union_sources(c, s)


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return ops.keep_first(
        li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    )


# --- cleaning --------------------------------------------------------------------

def clean_marks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean(spark, sf))


def impute_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.clean_missing_by(staged_wide(spark, sf), ["year"], SUBJECTS))


def imputation_log(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.imputation_log(staged_wide(spark, sf), ["student_id", "year"], ["year"], SUBJECTS))


def minmax_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.normalise(staged_wide(spark, sf), SUBJECTS).drop("name"))


def nan_null(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_totalprice") < 50000, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("v"),
    ).withColumn("v", nan_to_null(F.col("v")))
    return rounded(o.groupBy("year").agg(
        F.count_if(F.col("v").isNull()).alias("n_missing"), F.avg("v").alias("mean"), F.max("v").alias("top")
    ))


def ensure_wide(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["student_id", "year"]
    wide_form = reshape.ensure_wide(marks(spark, sf), keys, SUBJECTS)
    return rounded(reshape.ensure_wide(wide_form, keys, SUBJECTS))


def unpivot_load(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mark_files.to_marks(wide(spark, sf), SUBJECTS))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    raw, target = scratch_path(spark, "raw-csv"), scratch_path(spark, "clean-csv")
    mark_files.write_csv(wide(spark, sf), raw)
    mark_files.load_clean_marks(spark, target, raw, SUBJECTS, BASE)  # absent: runs the clean-up
    stored = mark_files.load_clean_marks(spark, target, None, SUBJECTS, BASE)
    return rounded(stored.withColumn("student_id", F.col("student_id").cast("bigint")))


def cohort_upload(spark: SparkSession, sf: str) -> DataFrame:
    """The years up to 1997 are stored; the file holds the years from 1997 on."""
    w = staged_wide(spark, sf)
    stored = w.where(F.col("year") <= BASE)
    _, new_marks = mark_files.add_cohort(
        stored.select("student_id", "name").distinct(), mark_files.to_marks(stored, SUBJECTS),
        w.where(F.col("year") >= BASE), SUBJECTS,
    )
    return rounded(new_marks)


def cohort_students(spark: SparkSession, sf: str) -> DataFrame:
    w = staged_wide(spark, sf)
    stored = w.where(F.col("year") <= BASE)
    new_students, _ = mark_files.add_cohort(
        stored.select("student_id", "name").distinct(), mark_files.to_marks(stored, SUBJECTS),
        w.where(F.col("year") >= BASE), SUBJECTS,
    )
    return new_students


# --- descriptive statistics ----------------------------------------------------------

def subject_averages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.subject_averages(clean(spark, sf), SUBJECTS))


def entity_averages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.student_averages(wide(spark, sf), NEXT, SUBJECTS))


def class_progress(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.class_progress(clean(spark, sf), SUBJECTS))


def entity_progress(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reshape.progress_series(wide(spark, sf), None, SUBJECTS))


def entity_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reshape.subject_by_year(wide(spark, sf), [BASE, NEXT], None, SUBJECTS))


def subject_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.subject_summary(clean(spark, sf), SUBJECTS))


def subject_summary_raw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.subject_summary(staged_wide(spark, sf), SUBJECTS))


def entity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.student_summary(wide(spark, sf), SUBJECTS))


def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.correlation_matrix(wide(spark, sf), SUBJECTS))


def top_performers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.top_performers(wide(spark, sf), 3, SUBJECTS))


def failing_entities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.failing_students(wide(spark, sf), 50.0, SUBJECTS))


def period_change(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.year_on_year_change(wide(spark, sf), BASE, NEXT, SUBJECTS))


def overview_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.overview_kpis(staged_wide(spark, sf), BASE, NEXT, SUBJECTS))


def entity_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.student_alerts(wide(spark, sf), 50.0, SUBJECTS))


def grade_bins(spark: SparkSession, sf: str) -> DataFrame:
    m = marks(spark, sf).withColumn("mark", clamp(F.col("mark")))
    return m.groupBy("subject", grade(F.col("mark"), GRADES).alias("grade")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def formatted_ids(spark: SparkSession, sf: str) -> DataFrame:
    return students(spark, sf).select(
        "student_id", format_entity_id(ref("student_id")).alias("display_id"), "name"
    )


# --- prediction log --------------------------------------------------------------------

def _write_mark_log(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "mark-log")
    log = marks(
        spark, sf, F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("model_used")
    ).withColumn("predicted_mark", clamp(F.col("mark")))
    logs.save_predictions(log.where("model_used = 'F'"), path)
    logs.save_predictions(log.where("model_used <> 'F'"), path)
    return path


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.get_predictions(spark, _write_mark_log(spark, sf))).withColumn(
        "created_at", F.col("created_at").cast("date")
    )


def prediction_log_latest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.get_predictions(spark, _write_mark_log(spark, sf), STUDENT)).withColumn(
        "created_at", F.col("created_at").cast("date")
    )


def compacted_log_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The history of one student in a log that was compacted and appended to again."""
    path = scratch_path(spark, "compacted-log")
    log = marks(
        spark, sf, F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("model_used")
    ).withColumn("predicted_mark", clamp(F.col("mark")))
    logs.save_predictions(log.where("model_used = 'F'"), path)
    logs.save_predictions(log.where("model_used = 'O'"), path)
    logs.compact_log(spark, path, "student_id")
    logs.save_predictions(log.where("model_used = 'P'"), path)
    return rounded(logs.get_predictions(spark, path, STUDENT)).withColumn("created_at", F.col("created_at").cast("date"))


QUERIES = {f.__name__: f for f in [
    marks_joined, marks_wide, entity_marks, entity_period_row, ordered_history, dimension_scan,
    distinct_keys, distinct_periods, next_period_pairs, pooled_pairs, fk_violations, insert_or_ignore,
    union_sources, dedup_first, clean_marks, impute_by_period, imputation_log, minmax_norm, nan_null,
    ensure_wide, unpivot_load, csv_round_trip, cohort_upload, cohort_students,
    subject_averages, entity_averages, class_progress, entity_progress, entity_comparison,
    subject_summary, subject_summary_raw, entity_summary, corr_matrix, top_performers, failing_entities,
    period_change, overview_kpis, entity_alerts, grade_bins, formatted_ids, prediction_log,
    prediction_log_latest, compacted_log_latest,
]}
