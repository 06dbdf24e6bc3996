"""No row is lost and no loop is endless: labels, NULL groups, uploads, non-finite values, files, logs, refits."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.functions.ordering import exact_quantiles, order_statistics, running_totals
from scorespark.functions.scalar import parse_number
from scorespark.operators import classify, metrics, regression, stats, tables
from scorespark.sources import features, marks, models, tables as logs


def test_labels_come_from_the_rows(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (1, None), (None, 1)], "label int, prediction int")
    m = metrics.classifier_metrics(rows).first()
    assert m.accuracy == 0.5 and m.recall_fail == 0.5
    assert m.f1_macro == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    cells = {(r.actual, r.predicted): r.n_rows for r in metrics.confusion_matrix(rows).collect()}
    assert sum(cells.values()) == 5 and cells[2, 0] == 1 and cells[1, None] == 1 and cells[None, 1] == 1 and cells[0, 2] == 0
    assert len(cells) == 9 + 2


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "g string, k int, v long")
    got = {(r.g, r.k): r.v_running for r in running_totals(rows, ["g"], ["k"], ["v"]).collect()}
    assert got == {(None, 1): 5, (None, 2): 11, ("a", 1): 7}
    scored = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.4)], "g string, label int, score double")
    assert {r.g: r.roc_auc for r in metrics.roc_auc(scored, ["g"]).collect()} == {None: 1.0, "a": 0.0}


def test_median_ends_on_any_value(spark):
    for odd in (float("inf"), float("-inf"), float("nan")):
        rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, odd, None)], "x double")
        assert exact_quantiles(rows, ["x"]) == {"x": 2.5}
    with pytest.raises(ValueError):
        endless = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),)], "x double")
        order_statistics(endless, [("x", 1)], {"x": (1.0, float("inf"))})
    texts = spark.createDataFrame([("1e999",), ("-1e999",), ("7",)], "t string")
    assert [r[0] for r in texts.select(parse_number(F.col("t"))).collect()] == [None, None, 7.0]


def test_uploads_keep_repeated_marks(spark):
    wide = spark.createDataFrame([("S1", "A", 2025, 80.0), ("S1", "A", 2025, 60.0), ("S1", "A", 2025, None)],
                                 "student_id string, name string, year int, Math double")
    students = spark.createDataFrame([], "student_id string, name string")
    known = spark.createDataFrame([], "student_id string, year int, subject string, mark double")
    _, new = marks.add_cohort(students, known, wide, ["Math"])
    assert sorted(r.mark for r in new.collect() if r.mark is not None) == [60.0, 80.0]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffage,Gender,label\n40,1,0\n41,0,1\n")
    (tmp_path / "b.csv").write_text("label,GENDER,Age\n1,1,50\n")
    (tmp_path / "c.csv").write_text("label, ,Age\n0,,60\n")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("Gender,Age,label\n0,70,1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("label\n1\n")
    rows = features.load_feature_csv(spark, str(tmp_path)).collect()
    assert sorted((r.age, -1 if r.gender is None else r.gender, r.label) for r in rows) == [
        (40, 1, 0), (41, 0, 1), (50, 1, 1), (60, -1, 0), (70, 0, 1)]
    (tmp_path / "e.csv").write_text("Age,age ,label\n1,2,0\n")
    with pytest.raises(ValueError, match="both mean age"):
        features.load_feature_csv(spark, str(tmp_path))


def test_marks_of_files_with_other_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("student_id,name,year,Math\nS1,A,2024,50\n")
    (tmp_path / "b.csv").write_text("Math ,year,name,student_id\n60,2025,B,S2\n")
    rows = marks.load_raw_data(spark, str(tmp_path), ["Math"]).select("student_id", "name", "year", "Math").collect()
    assert sorted(map(tuple, rows)) == [("S1", "A", 2024, 50.0), ("S2", "B", 2025, 60.0)]


def test_unchanged_sources_are_not_read_again(spark, tmp_path, monkeypatch):
    raw, clean = tmp_path / "raw", str(tmp_path / "clean")
    raw.mkdir()
    (raw / "a.csv").write_text("student_id,name,year,Math\nS1,A,2024,50\nS2,B,2024,\n")
    first = marks.run_pipeline(spark, str(raw), clean, ["Math"])
    assert sorted(r.Math for r in first.collect()) == [50.0, 50.0]
    assert all("/clean/" in f for f in first.inputFiles())  # what is returned reads the result, not the source
    written = sorted(p.name for p in (tmp_path / "clean").iterdir())
    with monkeypatch.context() as m:
        m.setattr(marks, "write_csv", lambda *a: pytest.fail("written again"))
        marks.run_pipeline(spark, str(raw), clean, ["Math"])
    assert sorted(p.name for p in (tmp_path / "clean").iterdir()) == written
    (raw / "b.csv").write_text("student_id,name,year,Math\nS3,C,2025,70\n")
    assert sorted(r.Math for r in marks.run_pipeline(spark, str(raw), clean, ["Math"]).collect()) == [50.0, 60.0, 70.0]
    with pytest.raises(FileNotFoundError):
        marks.run_pipeline(spark, str(raw) + "-absent", clean, ["Math"])


def test_a_new_year_is_taken_in_from_its_own_rows(spark, tmp_path):
    rng = random.Random(4)
    cells = [(i, y, float(rng.randrange(100)), float(rng.randrange(100))) for i in range(40) for y in range(2020, 2025) if rng.random() < 0.9]
    wide = spark.createDataFrame(cells, "student_id long, year int, Math double, CS double")
    wide.write.partitionBy("year").parquet(str(tmp_path / "wide"))
    stored, path, subjects = spark.read.parquet(str(tmp_path / "wide")), str(tmp_path / "moments"), ["Math", "CS"]
    models.save_moments(tables.consecutive_pairs(wide.where("year <= 2023"), subjects), path, subjects)
    got = models.refit_with_year(spark, stored, 2024, path, subjects)
    want = regression.fit_linear(tables.consecutive_pairs(wide, subjects), subjects)
    assert got.rows() == [(t, f, pytest.approx(c, rel=1e-9)) for t, f, c in want.rows()]
    assert models.refit_with_year(spark, stored, 2024, path, subjects).rows() == got.rows()  # twice adds nothing
    new = tables.consecutive_pairs(stored.where(F.col("year").isin(2023, 2024)), subjects)
    years = {f.split("year=")[1][:4] for f in new.inputFiles()}
    assert len(spark.read.parquet(path).collect()) == 4
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", new._jdf.queryExecution().executedPlan().toString())
    assert filters and all("2023" in f and "2024" in f for f in filters) and years >= {"2023", "2024"}


def test_a_compacted_log_reads_two_files_a_key(spark, tmp_path):
    path = str(tmp_path / "log")
    row = ["id AS vle_student_id", "1 AS predicted_label", "0.5D AS predicted_proba", "'m' AS model_used"]
    for i in range(12):
        logs.save_vle_predictions(spark.range(7 * i, 7 * i + 20).selectExpr(*row), path)
    before = sorted(map(tuple, logs.get_vle_predictions(spark, path).collect()))
    logs.compact_log(spark, path, "vle_student_id")
    assert sorted(map(tuple, logs.get_vle_predictions(spark, path).collect())) == before
    logs.save_vle_predictions(spark.range(20).selectExpr(*row), path)
    one = logs.get_vle_predictions(spark, path, 8)
    folder = spark.range(1).select(F.pmod(F.hash(F.lit(8).cast("long")), F.lit(logs.LOG_BUCKETS))).first()[0]
    read = [f for f in (tmp_path / "log").rglob("*.parquet") if f.parent.name == f"_bucket={folder}"]
    assert len(read) == 2 and one.count() == 1 + sum(1 for r in before if r[0] == 8)
    times = [r.created_at for r in one.collect()]
    assert times == sorted(times, reverse=True)
    logs.compact_log(spark, path, "vle_student_id")
    logs.compact_log(spark, path, "vle_student_id")  # nothing new: the same rows again
    assert logs.get_vle_predictions(spark, path).count() == len(before) + 20
    with pytest.raises(FileNotFoundError):
        logs.get_vle_predictions(spark, path + "-absent")


def test_correlation_over_pairs_of_present_values(spark):
    rng = random.Random(6)
    rows = [tuple(None if rng.random() < 0.2 else rng.gauss(1e6 * c, 1) + 0.5 * i % 7 for c in range(3)) + (
        5.1, float("nan") if i % 2 else float(i)) for i in range(200)]
    got = {(r[0], r[1]): r[2] for r in stats.correlation_pairs(spark.createDataFrame(rows, "a double, b double, c double, k double, n double").repartition(5),
                                                              ["a", "b", "c", "k", "n"]).collect()}
    assert len(got) == 25
    for i, a in enumerate("abckn"):
        for j, b in enumerate("abckn"):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None and r[i] == r[i] and r[j] == r[j]]
            x, y = np.array(both).T
            if x.std() < 1e-12 or y.std() < 1e-12:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    produced = stats.correlation_pairs(spark.range(100000).selectExpr("id * 1.0D AS a", "id % 7 * 1.0D AS b"), ["a", "b"])
    assert "Generate" not in produced._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1]  # no row per pair below


def test_features_go_by_name(spark):
    rows = spark.createDataFrame([(1, 2.0)], "id int, other double")
    with pytest.raises(ValueError):
        classify.get_vle_feature_columns(rows, ["x"])
