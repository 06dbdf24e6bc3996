"""The given tables seen as scores, students and feature tables.

* an order is a mark: customer = student, order year = year, priority = subject,
  price / 4507 = mark; an order in status P has no mark yet
* a labelled document is a row of text features with label 1 = not of good quality
* a customer is a row of the nineteen engagement features, label 1 = balance below 0
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.cleaning import clean_marks
from ..operators.tables import build_regression_dataset, get_all_marks_wide
from ..schema import FEATURES, LABEL, NAME, SPLIT
from ..session import stage

SUBJECTS = ["urgent", "high", "medium", "not_specified", "low"]
BASE, NEXT = 1997, 1998
TEXT_FEATURES = [
    "n_chars", "n_words", "n_lines", "mean_word_len", "digit_ratio",
    "upper_ratio", "punct_ratio", "distinct_ratio", "source_no",
]
DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = ".,;:!?"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that summation order does not show."""
    return df.withColumns({
        f.name: F.round(F.col(f"`{f.name}`"), digits)
        for f in df.schema.fields if f.dataType.typeName() == "double"
    })


def marks(spark: SparkSession, sf: str, *extra: Column) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("student_id"),
        F.year("o_orderdate").alias("year"),
        F.lower(F.replace(F.substring("o_orderpriority", 3, 20), F.lit(" "), F.lit("_"))).alias("subject"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 4507.0).alias("mark"),
        *extra,
    )


def students(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name")
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return get_all_marks_wide(marks(spark, sf), students(spark, sf), SUBJECTS)


def staged_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table written once, for queries that fit on it and then apply the fit."""
    return stage(wide(spark, sf), "wide")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_marks(staged_wide(spark, sf), SUBJECTS, BASE)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    unnamed = stage(wide(spark, sf).drop(NAME), "wide")  # pairs have no names: they are neither joined nor written
    return build_regression_dataset(clean_marks(unnamed, SUBJECTS, BASE), SUBJECTS, BASE, NEXT)


def staged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stage(pairs(spark, sf), "pairs")


def _share_of(characters: str, n: Column) -> Column:
    """Share of the characters; removing whole runs is cheaper than one character at a time."""
    others = F.length(F.regexp_replace("text", f"[{characters}]+", ""))
    return (n - others) / n


def text_features(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    """id, the text features, label and split; the text itself never crosses a shuffle."""
    d = table(spark, sf, "documents")
    n = F.greatest(F.length("text"), F.lit(1))
    words = F.split("text", " ")
    features = d.select(
        F.col("doc_id").alias("id"),
        F.length("text").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        ((F.length("text") - F.size(words) + 1) / F.size(words)).alias("mean_word_len"),
        _share_of(DIGITS, n).alias("digit_ratio"),
        _share_of(CAPITALS, n).alias("upper_ratio"),
        _share_of(PUNCTUATION, n).alias("punct_ratio"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_ratio"),
        F.substring("source", 4, 10).cast("double").alias("source_no"),
    )
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (1 - F.col("quality")).cast("int").alias(LABEL)
    )
    return features.join(labels, "id", how).withColumn(
        SPLIT, F.when(F.col("source_no") >= 16, "test").otherwise("original")
    )


def engagement(spark: SparkSession, sf: str) -> DataFrame:
    """id, the nineteen features, label and split, one row per customer with orders."""
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_totalprice").alias("spent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("present"),
    )
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    nation, balance, key = F.col("c_nationkey"), F.col("c_acctbal"), F.col("id")
    values = {
        "gender": nation % 2,
        "age": 18 + 2 * nation,
        "logins": 10 * F.col("n"),
        "total_hours": F.col("spent") / 70000,
        "pct_avg_hours": F.col("spent") / 350000,
        "presence_count": F.col("present"),
        "absence_count": F.col("n") - F.col("present"),
        "pct_attended": 100 * F.col("present") / F.col("n"),
        "attending_from_home": (F.col("c_mktsegment") == "HOUSEHOLD").cast("int"),
        "distance_to_uni_km": F.abs(balance) / 40,
        "polar4_quintile": 1 + nation % 5,
        "polar3_quintile": nation % 6,
        "adult_he_2001_quintile": 1 + F.floor(nation / 5),
        "adult_he_2011_quintile": (nation + 3) % 6,
        "tundra_msoa_quintile": 1 + key % 5,
        "tundra_lsoa_quintile": 1 + key % 3,
        "gaps_gcse_quintile": 1 + key % 4,
        "gaps_gcse_ethnicity_quintile": 1 + (key + nation) % 5,
        "uni_connect_target_ward": (
            (nation % 6 == 1) & ((1 + key % 4) <= 2) & (balance >= 0)
        ).cast("int"),
    }
    return c.join(per, "id").select(
        "id",
        *[values[f].cast("double").alias(f) for f in FEATURES],
        (balance < 0).cast("int").alias(LABEL),
        F.when(F.col("c_mktsegment") == "BUILDING", "test").otherwise("original").alias(SPLIT),
    )
