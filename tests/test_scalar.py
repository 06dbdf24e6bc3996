import math

import pytest
from pyspark.sql import Row, functions as F

from scorespark.functions import headers, scalar
from scorespark.schema import FEATURES, SOURCE_HEADERS, SUBJECTS, require_columns


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_clamp_keeps_null_and_bounds(spark):
    df = spark.createDataFrame([(-10.0,), (150.0,), (None,), (50.0,)], "v double")
    assert [r[0] for r in df.select(scalar.clamp(F.col("v"))).collect()] == [0.0, 100.0, None, 50.0]


@pytest.mark.parametrize("text,expected", [
    ("12", 12.0), (" 7.5 ", 7.5), ("1e3", 1000.0), (".5", 0.5), ("-3.", -3.0),
    ("n/a", None), ("", None), ("1d", None), ("1f", None), ("NaN", None), (None, None),
])
def test_parse_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalar.parse_number(F.col("t"))).first()[0] == expected


def test_nan_and_sentinel(spark):
    r = one(spark, a=scalar.nan_to_null(F.lit(float("nan"))), b=scalar.nan_to_null(F.lit(2.0)),
            c=scalar.sentinel_to_null(F.lit(0)), d=scalar.sentinel_to_null(F.lit(3)))
    assert tuple(r) == (None, 2.0, None, 3)


def test_row_mean_and_extremes(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (5.0, 5.0, 2.0)], "a double, b double, c double")
    best, worst = scalar.best_and_worst(["a", "b", "c"])
    got = df.select(scalar.row_mean([F.col("a"), F.col("b"), F.col("c")]), best, worst).collect()
    assert [tuple(r) for r in got] == [(2.0, "c", "a"), (None, None, None), (4.0, "a", "c")]


def test_period_labels_formats_grades(spark):
    df = spark.createDataFrame([(2024,), (2025,), (2026,)], "y int")
    assert [r[0] for r in df.select(scalar.encode_period(F.col("y"), 2024)).collect()] == [0, 1, None]
    r = one(spark, a=scalar.label_name(F.lit(0)), b=scalar.label_name(F.lit(1)),
            c=scalar.format_entity_id(F.lit(7)), d=scalar.format_percent(F.lit(0.85)),
            e=scalar.logistic(F.lit(0.0)), g=scalar.grade(F.lit(61.0), {"B": 60, "A": 70}),
            h=scalar.grade(F.lit(10.0), {"B": 60, "A": 70}),
            i=scalar.grade(F.lit(None).cast("double"), {"B": 60}))
    assert tuple(r) == ("Pass", "Fail", "S007", "85.0%", 0.5, "B", "F", None)


def test_headers_match_three_spellings():
    table = headers.alias_table()
    for name, source in SOURCE_HEADERS.items():
        for spelling in (source, f" {source.upper()} ", f"{source} (yes=1, no=0)", "\ufeff" + source):
            assert table[headers.header_key(spelling)] == name


def test_rename_and_padding(spark):
    df = spark.createDataFrame([("1", "2", None, None)], "`Age ` string, `x` string, _c2 string, `Unnamed: 3` string")
    kept = headers.drop_padding(df)
    assert kept.columns == ["Age ", "x"]
    assert headers.rename_exact(kept, {"Age": "age"}).columns == ["age", "x"]
    assert headers.keep_known(headers.rename_loose(kept), FEATURES).columns == ["age"]
    twice = kept.withColumnRenamed(kept.columns[-1], "AGE (years)")
    with pytest.raises(ValueError, match="both mean age"):
        headers.rename_loose(twice)


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="Physics"):
        require_columns(spark.createDataFrame([Row(Math=1.0)]), SUBJECTS)


def test_in_range(spark):
    df = spark.createDataFrame([(None,), (1.0,), (1.5,), (9.0,)], "v double")
    got = [r[0] for r in df.select(scalar.in_range(F.col("v"), 1, 5, True)).collect()]
    assert got == [True, True, False, False]
    assert math.isclose(scalar_logistic(spark, 2.0), 1 / (1 + math.exp(-2.0)))


def scalar_logistic(spark, z):
    return spark.range(1).select(scalar.logistic(F.lit(z))).first()[0]
