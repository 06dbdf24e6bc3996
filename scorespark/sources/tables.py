"""Table scans and the append-only prediction logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import ref
from ..schema import ENTITY, LABEL_LOG_COLUMNS, MARK_LOG_COLUMNS, SPLIT, require_columns
from ..session import delete_path, path_exists, read_text, replace_text

LIVE = "_live.json"
LOG_BUCKETS = 64
"""Folders of a log; part of its format, as a lookup computes the folder from the key."""


def get_all_students(students: DataFrame) -> DataFrame:
    return students.orderBy(ENTITY)


def get_vle_data(features: DataFrame, split: str = "all") -> DataFrame:
    """Feature rows of one split, or all, by id; the split filter prunes partition folders."""
    rows = features if split == "all" else features.where(F.col(SPLIT) == split)
    return rows.orderBy("id")


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(LOG_BUCKETS))


def _live(spark: SparkSession, path: str) -> list[str]:
    """Folders of a log that count, the one that appends go to last; a log that was never compacted is one folder."""
    named = read_text(spark, f"{path}/{LIVE}")
    return [f"{path}/{name}" for name in json.loads(named)] if named else [f"{path}/appended"]


def append_log(df: DataFrame, path: str, required: Sequence[str], key: str) -> None:
    """Append the required columns and ``created_at``, which defaults to now, in folders by hash of the key.

    Rows are rebalanced by folder, so a load writes few files and a key with very many rows is split.
    """
    require_columns(df, required, "predictions")
    stamp = F.col("created_at") if "created_at" in df.columns else F.current_timestamp()
    rows = df.select(*[ref(c) for c in required], stamp.cast("timestamp").alias("created_at"),
                     _bucket(ref(key)).alias("_bucket"))
    target = _live(df.sparkSession, path)[-1]
    rows.hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(target)


def _read_live(spark: SparkSession, path: str) -> DataFrame:
    folders = [f for f in _live(spark, path) if path_exists(spark, f)]
    if not folders:
        raise FileNotFoundError(f"no log: {path}")
    out = spark.read.parquet(folders[0])
    for folder in folders[1:]:
        out = out.unionByName(spark.read.parquet(folder))
    return out


def read_log(spark: SparkSession, path: str, key: str, value=None) -> DataFrame:
    """Log rows of one key, or all, newest first; one key reads one of the folders."""
    rows = _read_live(spark, path)
    if value is not None:
        wanted = F.lit(value).cast(rows.schema[key].dataType)
        rows = rows.where((F.col("_bucket") == _bucket(wanted)) & (ref(key) == wanted))
    rows = rows.drop("_bucket")
    return rows.orderBy(F.col("created_at").desc(), *[c for c in rows.columns if c != "created_at"])


def compact_log(spark: SparkSession, path: str, key: str, rows_per_file: int = 10_000_000) -> None:
    """Rewrite a log's many small files as one sorted run a bucket, by key and time, so lookups skip what they do not need.

    Two swaps of a manifest keep the log whole throughout: first appends get a
    folder of their own, then the rewritten folder takes the place of what it was
    made of. A job that dies in between leaves the log as it was; old folders go
    last. One compaction runs at a time; appends may begin while it runs, but one
    that is under way when it starts must be over before. A bucket too large for a
    task is split, and files end after ``rows_per_file`` rows.
    """
    before = [f.rpartition("/")[2] for f in _live(spark, path)]
    tail, base = f"appended-{uuid.uuid4().hex}", f"sorted-{uuid.uuid4().hex}"
    replace_text(spark, f"{path}/{LIVE}", json.dumps([*before, tail]))
    old = [f for f in before if path_exists(spark, f"{path}/{f}")]
    if old:
        rows = spark.read.parquet(f"{path}/{old[0]}")
        for folder in old[1:]:
            rows = rows.unionByName(spark.read.parquet(f"{path}/{folder}"))
        # rebalanced by bucket: a small one lies in one file, one that a hot key fills is split by its size
        run = rows.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", ref(key), "created_at")
        run.write.option("maxRecordsPerFile", rows_per_file).partitionBy("_bucket").parquet(f"{path}/{base}")
    replace_text(spark, f"{path}/{LIVE}", json.dumps([base, tail] if old else [tail]))
    for folder in old:
        delete_path(spark, f"{path}/{folder}")


def save_predictions(df: DataFrame, path: str) -> None:
    append_log(df, path, MARK_LOG_COLUMNS, ENTITY)


def get_predictions(spark: SparkSession, path: str, student_id=None) -> DataFrame:
    return read_log(spark, path, ENTITY, student_id)


def save_vle_predictions(df: DataFrame, path: str) -> None:
    append_log(df, path, LABEL_LOG_COLUMNS, "vle_student_id")


def get_vle_predictions(spark: SparkSession, path: str, vle_student_id=None) -> DataFrame:
    return read_log(spark, path, "vle_student_id", vle_student_id)
