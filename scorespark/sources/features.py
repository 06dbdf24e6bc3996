"""Feature-table files with untidy headers, and the feature table built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.headers import drop_padding, keep_known, rename_exact, rename_loose
from ..functions.ordering import range_slices, row_numbers
from ..functions.scalar import parse_number, ref
from ..operators.quality import unit_overlap
from ..operators.tables import drop_missing_label, label_load_report, union_sources
from ..schema import FEATURE_SCHEMA, FEATURES, LABEL, SOURCE_HEADERS, SPLIT
from ..session import path_exists
from .marks import read_text_csv, union_of_files

COLUMNS = [*FEATURES, LABEL]


def load_feature_csv(spark: SparkSession, path: str, split: str | None = None,
                     attendance_fraction: bool = False, exact: bool = False) -> DataFrame:
    """Untidy CSV -> canonical feature columns, label and, if given, the split tag.

    ``exact`` matches trimmed headers as they are; the default ignores case,
    punctuation and parenthesised notes. ``attendance_fraction`` says that the file
    gives attendance as 0..1, which becomes percent. Files of a folder may have
    different headers: each is matched by its own.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    parts = []
    for raw in read_text_csv(spark, path):
        raw = drop_padding(raw)
        named = (rename_exact(raw, {header: name for name, header in SOURCE_HEADERS.items()}) if exact else rename_loose(raw))
        if LABEL not in named.columns:
            raise ValueError(f"{path} has no label column")
        parts.append(keep_known(named, COLUMNS))
    known = keep_known(union_of_files(parts), COLUMNS)
    numbers = known.select(*[parse_number(ref(c)).alias(c) for c in known.columns])
    numbers = numbers.withColumn(LABEL, F.col(LABEL).cast("int"))
    if attendance_fraction:
        numbers = numbers.withColumn("pct_attended", F.col("pct_attended") * 100.0)
    return numbers if split is None else numbers.withColumn(SPLIT, F.lit(split))


def load_train_test(spark: SparkSession, train_path: str, test_path: str,
                    train_attendance_fraction: bool = True) -> tuple[DataFrame, DataFrame]:
    """(oversampled training table, held-out table), attendance in percent in both.

    Attendance whose ranges hardly overlap is in two units, which is a ``ValueError``.
    """
    train = load_feature_csv(spark, train_path, attendance_fraction=train_attendance_fraction)
    test = load_feature_csv(spark, test_path)
    if "pct_attended" in train.columns and "pct_attended" in test.columns and not unit_overlap(train, test, "pct_attended"):
        raise ValueError(f"attendance in {train_path} and {test_path} is not in one unit")
    return train, test


def load_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The feature table, or an empty one with its schema when the file is absent or unusable."""
    try:
        return load_feature_csv(spark, path)
    except (FileNotFoundError, ValueError):
        return spark.createDataFrame([], FEATURE_SCHEMA)


def combine_sources(frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Union of tagged tables without duplicates; the earlier source keeps a shared row.

    Rows without a label stay, so that they can be counted. Copies differ in their
    source only, so the smallest source number per row is all there is to keep: one
    hash aggregation that combines map-side.
    """
    tagged = [
        df.drop(SPLIT).withColumn("_rank", F.lit(rank)) for rank, (df, _) in enumerate(frames)
    ]
    union = union_sources(*tagged)
    columns = [c for c in union.columns if c != "_rank"]
    splits = F.array(*[F.lit(split) for _, split in frames])
    return union.groupBy(*[ref(c) for c in columns]).agg(F.min("_rank").alias("_rank")).select(
        *[ref(c) for c in columns], F.get(splits, F.col("_rank")).alias(SPLIT)
    )


def build_feature_table(spark: SparkSession, sources: Sequence[tuple[str, str]], target: str) -> DataFrame:
    """Load (path, split) files that exist, combine, drop unlabelled rows, number, write by split.

    Returns the one-row load report.
    """
    frames = [
        (load_feature_csv(spark, path), split) for path, split in sources if path_exists(spark, path)
    ]
    if not frames:
        raise FileNotFoundError(f"none of {[p for p, _ in sources]} exists")
    combined = combine_sources(frames)
    order = [SPLIT, *[c for c in combined.columns if c != SPLIT]]
    combined = range_slices(combined, [ref(c) for c in order])  # one write serves the report and the numbers
    numbered = row_numbers(drop_missing_label(combined), order, staged=True)
    numbered.write.mode("overwrite").partitionBy(SPLIT).parquet(target)
    return label_load_report(combined)
