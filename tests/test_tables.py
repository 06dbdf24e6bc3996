import pytest
from pyspark.sql import functions as F

from scorespark.operators import quality, stats, tables as ops
from scorespark.schema import FEATURES, FEATURE_RANGES
from scorespark.session import scratch_path
from scorespark.sources import features as files, marks as mark_files, tables as logs

SUBJ = ["Math", "CS"]
N = None


@pytest.fixture
def wide(spark):
    return spark.createDataFrame([
        ("a", "Ann", 2024, 40.0, 60.0), ("a", "Ann", 2025, 50.0, 80.0),
        ("b", "Bob", 2024, 70.0, 70.0), ("b", "Bob", 2025, 60.0, N),
        ("c", "Cy", 2025, 90.0, 30.0),
    ], "student_id string, name string, year int, Math double, CS double")


def test_marks_join_and_wide(spark):
    students = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "student_id string, name string")
    marks = spark.createDataFrame(
        [(1, "a", 2024, "Math", 10.0), (2, "a", 2024, "CS", N), (3, "b", 2024, "CS", N), (4, "zz", 2024, "CS", 1.0)],
        "id long, student_id string, year int, subject string, mark double",
    )
    joined = ops.get_all_marks(marks, students).collect()
    assert [(r.student_id, r.name, r.subject) for r in joined] == [("a", "Ann", "CS"), ("a", "Ann", "Math"), ("b", "Bob", "CS")]
    assert [tuple(r) for r in ops.get_all_marks_wide(marks, students, SUBJ).collect()] == [("a", "Ann", 2024, 10.0, N)]
    assert ops.get_student_marks(marks, students, "b", SUBJ).count() == 0
    assert [tuple(r) for r in ops.orphan_keys(marks, students, "student_id").collect()] == [("zz", 1)]
    with pytest.raises(ValueError, match="zz"):
        ops.check_keys(marks, students, "student_id")


def test_pairs(wide):
    pairs = ops.build_regression_dataset(wide, SUBJ)
    assert sorted((r.student_id, r.Math, r.Math_next, r.CS_next) for r in pairs.collect()) == [
        ("a", 40.0, 50.0, 80.0), ("b", 70.0, 60.0, N)]
    assert {r.year_encoded for r in pairs.collect()} == {0}
    with pytest.raises(ValueError):
        ops.build_regression_dataset(wide, SUBJ, 2025, 2024)
    assert ops.consecutive_pairs(wide, SUBJ).count() == 2


def test_keep_first_with_nulls_and_hot_copies(spark):
    rows = [(1, N, "late", 2)] * 500 + [(1, N, "early", 1), (2, 5.0, "only", 3)]
    df = spark.createDataFrame(rows, "k int, v double, split string, rank int").repartition(8)
    got = ops.keep_first(df, ["k", "v"], ["rank"]).collect()
    assert sorted((r.k, r.split) for r in got) == [(1, "early"), (2, "only")]


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([("a", "Ann")], "student_id string, name string")
    new = spark.createDataFrame([("a", "X"), ("b", "Bob"), ("b", "Bea")], "student_id string, name string")
    assert [tuple(r) for r in ops.insert_or_ignore(old, new, ["student_id"], ["name"]).collect()] == [("b", "Bea")]


def test_cohort_upload_is_idempotent(spark, wide):
    none_s = spark.createDataFrame([], "student_id string, name string")
    none_m = spark.createDataFrame([], "student_id string, year int, subject string, mark double")
    students, marks = mark_files.add_cohort(none_s, none_m, wide, SUBJ)
    assert (students.count(), marks.count()) == (3, 10)
    again_s, again_m = mark_files.add_cohort(students, marks, wide, SUBJ)
    assert (again_s.count(), again_m.count()) == (0, 0)
    with pytest.raises(ValueError, match="CS"):
        mark_files.add_cohort(none_s, none_m, wide.drop("CS"), SUBJ)


def test_summaries(wide):
    s = {r.subject: r for r in stats.subject_summary(wide, SUBJ).collect()}
    assert (s["Math"]["mean"], s["Math"]["median"]) == (62.0, 60.0) and s["CS"]["median"] == 65.0
    assert [r.subject for r in stats.subject_averages(wide, SUBJ).collect()] == ["Math", "CS"]
    assert [(r.student_id, r.average) for r in stats.student_averages(wide, 2025, SUBJ).collect()] == [
        ("b", 60.0), ("c", 60.0), ("a", 65.0)]
    assert [tuple(r) for r in stats.top_performers(wide, 2, SUBJ).collect()] == [("b", "Bob", 65.0), ("c", "Cy", 60.0)]
    assert [(r.student_id, r.subject) for r in stats.failing_students(wide, 50.0, SUBJ).orderBy("student_id").collect()] == [
        ("a", "Math"), ("c", "CS")]
    change = {r.student_id: r for r in stats.year_on_year_change(wide, 2024, 2025, SUBJ).collect()}
    assert change["a"].overall_delta == 15.0 and change["b"].CS_delta is None and "c" not in change
    k = stats.overview_kpis(wide, 2024, 2025, SUBJ).first()
    assert (k.top_student, k.most_improved, k.best_delta) == ("b", "a", 15.0)
    alerts = {r.student_id: (r.best_subject, r.worst_subject, r.alert) for r in stats.student_alerts(wide, 50.0, SUBJ).collect()}
    assert alerts == {"a": ("CS", "Math", True), "b": ("CS", "Math", False), "c": ("Math", "CS", True)}


def test_correlation_is_pairwise_and_guarded(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, N, 5.0), (N, 9.0, 5.0)], "a double, b double, k double")
    r = {(x.feature_a, x.feature_b): x.correlation for x in stats.correlation_pairs(df, ["a", "b", "k"]).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["b", "a"] == r["a", "b"]
    assert r["a", "a"] == 1.0 and r["k", "k"] is None and r["a", "k"] is None and len(r) == 9
    m = stats.correlation_matrix(df, ["a", "b", "k"])
    assert m.columns == ["feature", "a", "b", "k"] and m.count() == 3


def test_class_counts(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (N,)], "label int")
    assert [tuple(r) for r in stats.class_distribution(df).collect()] == [(0, 2, "Pass"), (1, 1, "Fail")]
    k = stats.label_kpis(df.where("label IS NOT NULL")).first()
    assert (k.total, k.passes, k.fails, k.fail_rate_text) == (3, 2, 1, "33.3%")
    assert stats.label_kpis(df.where("false")).first().fail_rate == 0.0


def test_quality(spark):
    good = {f: float(FEATURE_RANGES[f][0]) for f in FEATURES}
    bad = {**good, "age": 99.0, "polar4_quintile": 2.5, "logins": None}
    df = spark.createDataFrame([tuple(good.values()), tuple(bad.values())], ", ".join(f"{f} double" for f in FEATURES))
    found = {r.feature: r.violations for r in quality.domain_violations(df).collect() if r.violations}
    assert found == {"age": 1, "polar4_quintile": 1}
    assert quality.within_domain(df).count() == 1
    flags = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (1.0, 1.0, 0.0), (3.0, 1.0, 1.0)],
        "polar3_quintile double, gaps_gcse_quintile double, uni_connect_target_ward double")
    assert tuple(quality.flag_rule_check(flags).first()) == (3, 1, 1)
    a = spark.createDataFrame([(0.2,), (1.0,)], "v double")
    b = spark.createDataFrame([(20.0,), (100.0,)], "v double")
    assert not quality.unit_overlap(a, b, "v") and quality.unit_overlap(a, a, "v")


def test_feature_table_from_files(spark):
    head = "\ufeffGender, age ,Count of Module Area Logins,Percent Attended,\"label (fail=1, pass=0)\",,"
    full, test, target = (scratch_path(spark, n) for n in ("full", "test", "table"))
    write_text(spark, full, [head, "0,20,5,50,1,,", "1,21,x,60,0,,", ",,,,,,", ",,,,,,"])
    write_text(spark, test, [head, "0,20,5,50,1,,", "1,30,7,70,0,,"])
    one = files.load_feature_csv(spark, full, "original")
    assert one.columns == ["gender", "age", "logins", "pct_attended", "label", "split"]
    assert one.where("age = 21").first().logins is None
    report = files.build_feature_table(spark, [(full, "original"), (test, "test"), (full + "-x", "x")], target)
    assert tuple(report.first()) == (3, 1, 2, 1)
    stored = spark.read.parquet(target)
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    assert logs.get_vle_data(stored, "test").count() == 1 and logs.get_vle_data(stored).count() == 3
    assert files.load_feature_csv(spark, full, attendance_fraction=True).agg(F.max("pct_attended")).first()[0] == 6000.0
    assert files.load_or_empty(spark, full + "-absent").count() == 0
    with pytest.raises(FileNotFoundError):
        files.load_feature_csv(spark, full + "-absent")
    write_text(spark, target + "-nolabel", ["Gender,Age", "1,2"])
    with pytest.raises(ValueError):
        files.load_feature_csv(spark, target + "-nolabel")


def write_text(spark, path, lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def test_logs(spark):
    path = scratch_path(spark, "log")
    rows = spark.createDataFrame([("S1", "Math", 70.0, "m", "extra")], "student_id string, subject string, predicted_mark double, model_used string, z string")
    logs.save_predictions(rows, path)
    logs.save_predictions(rows.withColumn("predicted_mark", F.lit(80.0)), path)
    got = logs.get_predictions(spark, path, "S1").collect()
    assert [r.predicted_mark for r in got] == [80.0, 70.0]
    assert logs.get_predictions(spark, path, "S2").count() == 0
    with pytest.raises(ValueError, match="model_used"):
        logs.save_predictions(rows.drop("model_used"), path)
    with pytest.raises(ValueError):
        logs.save_vle_predictions(rows, path)


def test_attendance_in_two_units_is_refused(spark):
    train, test = (scratch_path(spark, n) for n in ("train", "held-out"))
    write_text(spark, train, ["Percent Attended,label", "10,1", "90,0"])
    write_text(spark, test, ["Percent Attended,label", "20,1", "95,0"])
    assert [t.count() for t in files.load_train_test(spark, train, test, train_attendance_fraction=False)] == [2, 2]
    with pytest.raises(ValueError, match="one unit"):
        files.load_train_test(spark, train, test)
