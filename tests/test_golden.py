"""Known results for two small public data sets; set the paths to run these.

SCORESPARK_MARKS_CSV: wide marks of 15 students in two years.
SCORESPARK_FEATURES_FULL, _TEST, _TRAIN: feature files (full, held-out, oversampled).
"""

import os

import pytest
from pyspark.sql import functions as F

from scorespark.operators import classify, cleaning, quality, regression, stats, tables as ops
from scorespark.schema import FEATURES, SUBJECTS
from scorespark.session import scratch_path
from scorespark.sources import features as files, marks as mark_files


def path_of(name):
    path = os.environ.get(name)
    if not path:
        pytest.skip(f"{name} is not set")
    return path


@pytest.fixture(scope="module")
def clean(spark):
    raw = mark_files.load_raw_data(spark, path_of("SCORESPARK_MARKS_CSV"))
    return cleaning.clean_marks(raw).persist()


def test_summary(clean):
    s = {r.subject: r for r in stats.subject_summary(clean).collect()}
    expected = {
        "Math": (75.172414, 76.0862, 14.522442), "Physics": (73.642857, 73.3214, 11.922781),
        "CS": (74.724138, 74.8621, 13.881013), "English": (75.678571, 75.3393, 10.674021),
        "Statistics": (73.689655, 72.8448, 12.345887),
    }
    for name, (mean, median, std) in expected.items():
        assert s[name]["mean"] == pytest.approx(mean, abs=1e-6)
        assert s[name]["median"] == pytest.approx(median, abs=1e-4)
        assert s[name]["std"] == pytest.approx(std, abs=1e-6)
    assert [r.subject for r in stats.subject_averages(clean).collect()] == [
        "English", "Math", "CS", "Statistics", "Physics"]


def test_correlation_rankings_changes(clean):
    r = {(x.feature_a, x.feature_b): x.correlation for x in stats.correlation_pairs(clean, SUBJECTS).collect()}
    assert r["Math", "Physics"] == pytest.approx(-0.451334, abs=1e-6)
    assert r["English", "Statistics"] == pytest.approx(0.365902, abs=1e-6)
    assert [(t.student_id, round(t.overall_mean, 6)) for t in stats.top_performers(clean).collect()] == [
        ("S010", 84.168966), ("S003", 83.364286), ("S013", 79.0)]
    assert [(f.student_id, f.subject, f.subject_avg) for f in stats.failing_students(clean).collect()] == [
        ("S009", "Statistics", 49.5)]
    assert stats.failing_students(clean, 60.0).count() == 11
    change = stats.year_on_year_change(clean)
    assert change.count() == 15
    first = change.where("student_id = 'S001'").drop("name").first()
    assert [round(v, 6) for v in first[1:]] == [12.0, 2.0, 7.0, 3.0, -5.0, 3.8]
    k = stats.overview_kpis(clean).first()
    assert k.top_student == "S010" and k.most_improved == "S002" and k.best_delta == pytest.approx(8.2)


def test_regression(spark, clean):
    pairs = ops.build_regression_dataset(clean).persist()
    assert pairs.count() == 15
    fitted = regression.train_regressors(pairs, models=["LinearRegression"])
    got = {r.subject: r for r in regression.evaluate_all_models(pairs, fitted).collect()}
    sample = spark.createDataFrame([("x", 80.0, 75.0, 70.0, 85.0, 78.0)], ["student_id", *SUBJECTS])
    ahead = {r.subject: r.predicted_mark for r in regression.predict_next(sample, fitted).collect()}
    expected = {
        "Math": (6.361885, 5.081689, 12.100565, 5.121141, 81.178394),
        "Physics": (7.111517, 5.579716, 9.761860, 3.035777, 78.659965),
        "CS": (5.489065, 4.612458, 9.431531, 3.348392, 70.580477),
        "English": (3.252670, 2.748059, 4.702219, 2.259731, 82.258508),
        "Statistics": (4.295838, 3.092891, 6.458185, 2.498833, 77.010437),
    }
    for s, values in expected.items():
        r = got[s]
        assert [r["RMSE"], r["MAE"], r["mean"], r["std"], ahead[s]] == pytest.approx(list(values), abs=1e-6)


def test_all_regressors_pass_the_gate(clean):
    pairs = ops.build_regression_dataset(clean).persist()
    fitted = regression.train_regressors(pairs)
    from scorespark.operators.metrics import regression_metrics
    errors = regression_metrics(regression.actual_vs_predicted(pairs, fitted), ("model", "subject"))
    assert errors.count() == 15 and quality.regression_gates(errors).first().rmse_ok


def test_feature_table(spark):
    full, test = path_of("SCORESPARK_FEATURES_FULL"), path_of("SCORESPARK_FEATURES_TEST")
    target = scratch_path(spark, "golden")
    report = files.build_feature_table(spark, [(full, "original"), (test, "test")], target).first()
    assert (report.kept, report.passes, report.fails) == (160, 136, 24)
    exact = files.load_feature_csv(spark, full, exact=True)
    assert exact.columns == [*FEATURES, "label"]
    assert exact.exceptAll(files.load_feature_csv(spark, full)).count() == 0


def test_classifiers(spark):
    train, test = files.load_train_test(
        spark, path_of("SCORESPARK_FEATURES_TRAIN"), path_of("SCORESPARK_FEATURES_TEST"))
    assert train.columns == [*FEATURES, "label"] == test.columns
    assert (train.count(), test.count()) == (136, 80)
    assert train.where(" OR ".join(f"{f} IS NULL" for f in FEATURES)).count() == 0
    assert quality.unit_overlap(train, test, "pct_attended")
    number = F.monotonically_increasing_id()
    risk = classify.train_classifiers(train.withColumn("id", number))
    table = classify.evaluate_classifiers(test.withColumn("id", number), risk)
    gates = quality.classifier_gates(table).first()
    assert gates.accuracy_ok and gates.recall_ok
