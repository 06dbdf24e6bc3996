import pytest
from pyspark.sql import functions as F

from scorespark.operators import cleaning, reshape
from scorespark.schema import SUBJECTS, wide_schema
from scorespark.sources import marks as files
from scorespark.session import scratch_path

N = None


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame([
        ("S001", "a", 2024, 90.0, N, 65.0, N, 78.0),
        ("S002", "b", 2024, N, 70.0, 70.0, N, 82.0),
        ("S003", "c", 2024, 80.0, 75.0, N, 85.0, N),
    ], wide_schema())


def test_mean_fill(gaps):
    rows = {r.student_id: r for r in cleaning.clean_missing(gaps).collect()}
    assert rows["S002"]["Math"] == 85.0
    assert all(r[s] is not None for r in rows.values() for s in SUBJECTS)


def test_empty_column_stays_null(spark):
    df = spark.createDataFrame([("S1", "a", 2024, N, 1.0, 1.0, 1.0, 1.0)], wide_schema())
    assert cleaning.clean_missing(df).first()["Math"] is None


def test_text_and_nan_are_filled(spark):
    df = spark.createDataFrame([("x", 1.0), ("50", float("nan"))], "Math string, CS double")
    got = cleaning.clean_missing(df, ["Math", "CS"]).collect()
    assert [tuple(r) for r in got] == [(50.0, 1.0), (50.0, 1.0)]


def test_outliers_take_part_in_the_mean(spark):
    df = spark.createDataFrame([(200.0,), (0.0,), (N,)], "Math double")
    filled = cleaning.clip_outliers(cleaning.clean_missing(df, ["Math"]), ["Math"])
    assert sorted(r[0] for r in filled.collect()) == [0.0, 100.0, 100.0]


def test_clip(spark):
    df = spark.createDataFrame(
        [(-10.0, 200.0, 0.0, 101.0, 50.0), (150.0, -5.0, 100.0, -1.0, 60.0)],
        ", ".join(f"{s} double" for s in SUBJECTS),
    )
    values = [v for r in cleaning.clip_outliers(df).collect() for v in r]
    assert min(values) == 0.0 and max(values) == 100.0


def test_group_fill_and_log(spark):
    df = spark.createDataFrame(
        [("a", 2024, 10.0), ("b", 2024, N), ("a", 2025, 30.0), ("b", 2025, N), ("c", 2026, N)],
        "student_id string, year int, Math double",
    )
    filled = {(r.student_id, r.year): r.Math for r in cleaning.clean_missing_by(df, ["year"], ["Math"]).collect()}
    assert filled["b", 2024] == 10.0 and filled["b", 2025] == 30.0 and filled["c", 2026] is None
    log = cleaning.imputation_log(df, ["student_id", "year"], ["year"], ["Math"]).collect()
    assert sorted(tuple(r) for r in log) == [("b", 2024, "Math", 10.0), ("b", 2025, "Math", 30.0)]


def test_normalise_and_reuse(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, b double")
    got = cleaning.normalise(df, ["a", "b"]).collect()
    assert [(r.a_norm, r.b_norm) for r in got] == [(0.0, 0.0), (1.0, 0.0)]
    other = spark.createDataFrame([(20.0,)], "a double")
    assert cleaning.normalise(other, ["a"], cleaning.fit_min_max(df, ["a"])).first().a_norm == 2.0


def test_standard_scale_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, b double")
    scaler = cleaning.fit_standard(df, ["a", "b"])
    assert scaler["a"][1] == pytest.approx(1.247219, abs=1e-6) and scaler["b"] == (7.0, 1.0)
    assert [r.b for r in cleaning.standard_scale(df, scaler).collect()] == [0.0, 0.0, 0.0]


def test_year_code(gaps):
    later = gaps.unionByName(gaps.withColumn("year", F.lit(2025))).unionByName(gaps.withColumn("year", F.lit(2030)))
    codes = {(r.year, r.year_encoded) for r in cleaning.encode_year(later).collect()}
    assert codes == {(2024, 0), (2025, 1), (2030, N)}


def test_csv_job(spark, gaps):
    raw, target = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    files.write_csv(gaps, raw)
    out = files.run_pipeline(spark, raw, target)
    assert out.count() == 3 and "Math" in out.columns
    again = files.load_clean_marks(spark, target)
    assert {r.Math for r in again.collect()} == {90.0, 85.0, 80.0}
    with pytest.raises(FileNotFoundError):
        files.load_clean_marks(spark, target + "-absent")
    with pytest.raises(FileNotFoundError):
        files.load_raw_data(spark, target + "-absent")


def test_wide_and_long(spark):
    long = spark.createDataFrame([
        ("a", 2024, "Math", 10.0), ("a", 2024, "Math", 20.0), ("a", 2024, "CS", 5.0), ("b", 2024, "CS", N),
    ], "student_id string, year int, subject string, mark double")
    keys = ["student_id", "year"]
    wide = reshape.ensure_wide(long, keys, ["Math", "CS"])
    assert [tuple(r) for r in wide.collect()] == [("a", 2024, 15.0, 5.0)]
    assert reshape.ensure_wide(wide, keys, ["Math", "CS"]) is wide
    numbered = long.withColumn("id", F.monotonically_increasing_id())
    assert reshape.ensure_wide(numbered, keys, ["Math", "CS"]).collect() == wide.collect()  # an id splits no group
    for bad in (long.drop("mark"), long.drop("year"), wide.drop("CS"), wide.drop("year")):
        with pytest.raises(ValueError):
            reshape.ensure_wide(bad, keys, ["Math", "CS"])
    back = reshape.melt_scores(wide, ("student_id", "year"), ["Math", "CS"]).collect()
    assert sorted(tuple(r) for r in back) == [("a", 2024, "CS", 5.0), ("a", 2024, "Math", 15.0)]
    assert reshape.student_rows(wide, "a", 2024).count() == 1
    with pytest.raises(ValueError):
        reshape.progress_series(wide, "zz", ["Math", "CS"])
    assert reshape.progress_series(wide, "a", ["Math", "CS"]).count() == 2
    with pytest.raises(ValueError):
        reshape.subject_by_year(wide, [2024], "zz", ["Math", "CS"])
    assert reshape.subject_by_year(wide, [2024], "a", ["Math"]).collect()[0]["y2024"] == 15.0
