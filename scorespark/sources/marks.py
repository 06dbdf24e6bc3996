"""Wide score files, the clean-up job and its stored result."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.headers import drop_padding
from ..functions.scalar import parse_number, ref
from ..operators.cleaning import clean_marks, clean_missing, clip_outliers
from ..operators.reshape import melt_scores
from ..operators.tables import check_keys, insert_or_ignore
from ..schema import CATEGORY, ENTITY, NAME, PERIOD, SUBJECTS, require_columns
from ..session import data_files, first_line, path_exists, read_text, replace_text


def read_text_csv(spark: SparkSession, path: str) -> list[DataFrame]:
    """CSVs with a header row, every value as text, one frame for each header that a folder's files have.

    The headers are read first, a line a file; files of the same header are read together. A byte-order mark is skipped.
    """
    by_header: dict[str, list[str]] = {}
    for file, length, _ in data_files(spark, path):
        if length:
            by_header.setdefault(first_line(spark, file), []).append(file)
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if len(by_header) < 2:
        return [reader.csv(path)]
    return [reader.csv(files) for files in by_header.values()]


def union_of_files(frames: Sequence[DataFrame]) -> DataFrame:
    """One frame of files whose columns are named alike by now; a column that a file lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_raw_data(spark: SparkSession, path: str, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Wide scores from CSV: whole-number year, double subjects, anything else NULL."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    parts = []
    for raw in read_text_csv(spark, path):
        raw = drop_padding(raw)
        raw = raw.withColumnsRenamed({c: c.strip() for c in raw.columns})
        require_columns(raw, [ENTITY, PERIOD, *subjects], path)
        parts.append(raw)
    return union_of_files(parts).withColumns({
        PERIOD: parse_number(F.col(PERIOD)).cast("int"), **{s: parse_number(ref(s)) for s in subjects}
    })


MANIFEST = "_sources.json"


def run_pipeline(spark: SparkSession, raw_path: str, clean_path: str,
                 subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Raw CSV -> filled and clipped scores, written as CSV; the stored scores are returned.

    A manifest beside the result names the files it was made of, by path, length
    and time. While they and the subjects are the same, nothing is read or written
    again. A fill is the mean over all rows, so any change makes the whole table new.
    """
    if not path_exists(spark, raw_path):
        raise FileNotFoundError(raw_path)
    manifest = json.dumps({"subjects": list(subjects), "files": data_files(spark, raw_path)})
    if read_text(spark, f"{clean_path}/{MANIFEST}") != manifest:
        write_csv(clip_outliers(clean_missing(load_raw_data(spark, raw_path, subjects), subjects), subjects), clean_path)
        replace_text(spark, f"{clean_path}/{MANIFEST}", manifest)  # last: without it the result counts as absent
    return load_raw_data(spark, clean_path, subjects)


def load_clean_marks(spark: SparkSession, clean_path: str, raw_path: str | None = None,
                     subjects: Sequence[str] = SUBJECTS, base: int | None = None) -> DataFrame:
    """The stored clean scores, or the clean-up job's result; cleaned again either way."""
    if path_exists(spark, clean_path):
        df = load_raw_data(spark, clean_path, subjects)
    elif raw_path is None:
        raise FileNotFoundError(clean_path)
    else:
        df = run_pipeline(spark, raw_path, clean_path, subjects)
    return clean_marks(df, subjects) if base is None else clean_marks(df, subjects, base)


def to_marks(wide: DataFrame, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Wide rows as (student, year, subject, mark), missing marks as NULL."""
    return melt_scores(wide, (ENTITY, PERIOD), subjects)


def add_cohort(students: DataFrame, marks: DataFrame, wide: DataFrame,
               subjects: Sequence[str] = SUBJECTS) -> tuple[DataFrame, DataFrame]:
    """(new student rows, new mark rows) of an uploaded wide table.

    Students and marks that exist already are left out, so loading a file twice
    adds nothing the second time. Marks that a file repeats all stay, to be averaged.
    """
    require_columns(wide, [ENTITY, NAME, PERIOD, *subjects], "cohort")
    new_students = insert_or_ignore(students, wide.select(ENTITY, NAME), [ENTITY], [NAME])
    keys = [ENTITY, PERIOD, CATEGORY]
    new_marks = to_marks(wide, subjects).join(marks.select(*keys), keys, "left_anti")
    known = students.select(ENTITY).unionByName(new_students.select(ENTITY))
    return new_students, check_keys(new_marks, known, ENTITY)

