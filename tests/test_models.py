import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.functions.ordering import fold_starts
from scorespark.operators import classify, metrics, quality, regression
from scorespark.session import scratch_path
from scorespark.sources import models as store

SUBJ = ["Math", "CS"]
FEATS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(43):
        m, c = rng.uniform(30, 95), rng.uniform(30, 95)
        rows.append((f"S{i:03d}", 0, m, c, 5 + 0.6 * m + 0.3 * c + rng.gauss(0, 3), 0.2 * m + 0.7 * c + rng.gauss(0, 4)))
    df = spark.createDataFrame(
        rows, "student_id string, year_encoded int, Math double, CS double, Math_next double, CS_next double")
    return df.repartition(5).persist()


def arrays(pairs):
    rows = sorted(pairs.collect(), key=lambda r: r.student_id)
    x = np.array([[1, r.Math, r.CS] for r in rows])
    return x, {s: np.array([r[f"{s}_next"] for r in rows]) for s in SUBJ}


def test_least_squares_equals_lstsq(pairs):
    x, y = arrays(pairs)
    fit = regression.fit_linear(pairs, SUBJ)
    for s in SUBJ:
        beta = np.linalg.lstsq(x, y[s], rcond=None)[0]
        assert [fit.intercepts[s], fit.weights[s]["Math"], fit.weights[s]["CS"]] == pytest.approx(list(beta), rel=1e-9)
    shuffled = regression.fit_linear(pairs.repartition(2), SUBJ)
    assert shuffled.intercepts["Math"] == pytest.approx(fit.intercepts["Math"], rel=1e-12)


def test_dependent_features_give_finite_fit(spark, pairs):
    constant = pairs.withColumn("CS", F.lit(50.0))
    fit = regression.fit_linear(constant, SUBJ)
    assert fit.weights["Math"]["CS"] == 0.0 and math.isfinite(fit.intercepts["Math"])
    with pytest.raises(ValueError):
        regression.fit_linear(pairs.where("false"), SUBJ)
    with pytest.raises(ValueError, match="missing"):
        regression.fit_linear(pairs.withColumn("CS", F.expr("CASE WHEN Math > 60 THEN CS END")), SUBJ)


def test_cross_validation_equals_contiguous_folds(pairs):
    x, y = arrays(pairs)
    fitted = regression.train_regressors(pairs, SUBJ, ["LinearRegression"])
    got = {r.subject: r for r in regression.evaluate_all_models(pairs, fitted, SUBJ, 5).collect()}
    folds = np.array_split(np.arange(len(x)), 5)
    for s in SUBJ:
        beta = np.linalg.lstsq(x, y[s], rcond=None)[0]
        e = y[s] - x @ beta
        assert got[s]["RMSE"] == pytest.approx(np.sqrt((e ** 2).mean()))
        assert got[s]["MAE"] == pytest.approx(np.abs(e).mean())
        scores = []
        for f in folds:
            rest = np.setdiff1d(np.arange(len(x)), f)
            b = np.linalg.lstsq(x[rest], y[s][rest], rcond=None)[0]
            scores.append(np.sqrt(((y[s][f] - x[f] @ b) ** 2).mean()))
        assert (got[s]["mean"], got[s]["std"]) == (pytest.approx(np.mean(scores)), pytest.approx(np.std(scores)))


def test_all_regressors_predict_clip_and_reload(spark, pairs):
    params = {"RandomForest": {"numTrees": 5}}
    fitted = regression.train_regressors(pairs, SUBJ, params=params)
    assert len(fitted) == 6
    rows = pairs.select("student_id", (F.col("Math") * 3).alias("Math"), "CS")
    out = regression.predict_next(rows, fitted, SUBJ)
    assert out.count() == 43 * 6
    low, high = out.agg(F.min("predicted_mark"), F.max("predicted_mark")).first()
    assert 0 <= low and high <= 100
    folder = scratch_path(spark, "models")
    store.save_regressors(spark, fitted, folder)
    loaded = {k: store.load_regressor(spark, folder, *k) for k in fitted}
    again = regression.predict_next(rows, loaded, SUBJ)
    key = lambda r: (r.student_id, r.subject, r.model_used)
    assert sorted(out.collect(), key=key) == sorted(again.collect(), key=key)
    errors = metrics.regression_metrics(regression.actual_vs_predicted(pairs, fitted, SUBJ), ("model", "subject"))
    assert quality.regression_gates(errors).first().rmse_ok
    assert metrics.best_by(errors).count() == 2
    with pytest.raises(ValueError, match="CS"):
        regression.predict_next(rows.drop("CS"), fitted, SUBJ)
    for name in ("DecisionTree", "LinearRegression", "Unknown"):
        with pytest.raises(FileNotFoundError):
            store.load_regressor(spark, folder + "-absent", name, "Math")
    with pytest.raises(ValueError):
        regression.train_regressors(pairs, SUBJ, ["Unknown"])


def test_tree_cross_validation_and_layout(pairs):
    starts = fold_starts(pairs, "student_id", 3)
    a = regression.cross_validate(pairs, starts, "DecisionTree", SUBJ).collect()
    b = regression.cross_validate(pairs.repartition(2), starts, "DecisionTree", SUBJ).collect()
    assert len(a) == 2 and all(r["mean"] > 0 and r["std"] >= 0 for r in a)
    assert sorted(map(tuple, a)) == [pytest.approx(t) for t in sorted(map(tuple, b))]


def test_forest_is_the_same_for_any_input_layout(pairs):
    params = {"RandomForest": {"numTrees": 4, "maxDepth": 4}}
    results = []
    for n in (1, 6):
        fitted = regression.train_regressors(pairs.repartition(n), ["Math", "CS"], ["RandomForest"], params)
        out = regression.predict_next(pairs, fitted, SUBJ)
        results.append(sorted((r.student_id, r.subject, round(r.predicted_mark, 9)) for r in out.collect()))
    assert results[0] == results[1]


def test_intervals_hold_the_mean(pairs):
    fitted = regression.train_regressors(pairs, SUBJ, ["RandomForest"], {"RandomForest": {"numTrees": 8, "maxDepth": 4}})
    forests = {s: fitted["RandomForest", s] for s in SUBJ}
    rows = regression.prediction_intervals(pairs, forests).collect()
    assert len(rows) == 43 * 2
    for r in rows:
        assert 0 <= r.low <= r.predicted_mark <= r.high <= 100


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = []
    for i in range(240):
        label = int(rng.random() < 0.25)
        data.append((i, rng.gauss(2.0 * label, 1), rng.gauss(-label, 1), rng.random() if i % 9 else None, label))
    return spark.createDataFrame(data, "id long, x double, y double, z double, label int").repartition(4).persist()


@pytest.fixture(scope="module")
def risk(rows):
    return classify.train_classifiers(rows, FEATS, params={"RandomForest": {"numTrees": 15}})


def test_logistic_matches_newton(rows, risk):
    """Same optimum as Newton steps on the summed loss with penalty |w|^2 / 2."""
    data = rows.collect()
    x = np.array([[r.x, r.y, r.z or 0.0] for r in data])
    y = np.array([r.label for r in data])
    x = (x - x.mean(0)) / x.std(0)
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(4)
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    model = risk.models["LogisticRegression"]
    assert list(model.coefficients) + [model.intercept] == pytest.approx(list(w), abs=1e-9)


def test_scores_and_evaluation(spark, rows, risk):
    for name in classify.CLASSIFIERS:
        out = classify.predict_pass_fail(rows, risk, name)
        low, high = out.agg(F.min("predicted_proba"), F.max("predicted_proba")).first()
        assert 0.0 <= low <= high <= 1.0
        assert {r[0] for r in out.select("predicted_label").distinct().collect()} == {0, 1}
    table = classify.evaluate_classifiers(rows, risk)
    gates = quality.classifier_gates(table).first()
    assert gates.accuracy_ok and gates.recall_ok and table.count() == 2
    assert {r.feature for r in classify.importance_frame(spark, risk).collect()} == set(FEATS)


def test_features_go_by_name_and_absent_ones_are_zero(rows, risk):
    name = "LogisticRegression"
    a = classify.predict_pass_fail(rows.select("id", "x", "y", "z"), risk, name)
    b = classify.predict_pass_fail(rows.select("z", "id", "y", "x"), risk, name)
    key = lambda r: r.id
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
    c = classify.predict_pass_fail(rows.select("id", "x", "y"), risk, name)
    d = classify.predict_pass_fail(rows.withColumn("z", F.lit(0.0)), risk, name)
    assert sorted(c.collect(), key=key) == sorted(d.collect(), key=key)


def test_text_in_a_feature_fails(spark, risk):
    bad = spark.createDataFrame([(1, "'; DROP TABLE students; --", 1.0, 1.0)], "id long, x string, y double, z double")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        classify.predict_pass_fail(bad, risk, "LogisticRegression").collect()


def test_extreme_row_is_scored(spark, risk):
    far = spark.createDataFrame([(1, 1e6, -1e6, 0.0)], "id long, x double, y double, z double")
    r = classify.predict_pass_fail(far, risk, "LogisticRegression").first()
    assert r.predicted_label in (0, 1) and 0.0 <= r.predicted_proba <= 1.0


def test_missing_label_fails(rows):
    with pytest.raises(Exception, match="missing label"):
        classify.train_classifiers(rows.withColumn("label", F.expr("nullif(label, 1)")), FEATS, models=["LogisticRegression"])


def test_classifier_store(spark, rows, risk):
    folder = scratch_path(spark, "risk")
    store.save_classifiers(spark, risk, folder)
    loaded = store.load_classifiers(spark, folder, *risk.models)
    assert loaded.features == FEATS
    for name in risk.models:
        key = lambda r: r.id
        assert sorted(classify.predict_pass_fail(rows, risk, name).collect(), key=key) == sorted(
            classify.predict_pass_fail(rows, loaded, name).collect(), key=key)
    with pytest.raises(FileNotFoundError):
        classify.predict_pass_fail(rows, risk, "InvalidModel")
    with pytest.raises(FileNotFoundError):
        store.load_classifiers(spark, folder, "InvalidModel")
    with pytest.raises(FileNotFoundError):
        store.load_classifiers(spark, folder + "-absent", "RandomForest")


def test_feature_columns(rows):
    assert classify.get_vle_feature_columns(rows, FEATS) == FEATS
    assert classify.get_vle_feature_columns(rows, ["y", "x"]) == ["y", "x"]
    x, y = classify.features_and_labels(rows, "all")
    assert x.columns == FEATS and y.columns == ["label"]


def test_metrics_on_small_tables(spark):
    def table(*cells):
        return spark.createDataFrame(cells, "label int, prediction int")
    both = metrics.classifier_metrics(table((0, 0), (0, 1), (1, 1), (1, 1))).first()
    assert both.accuracy == 0.75 and both.recall_fail == 1.0 and both.f1_macro == pytest.approx((2 / 3 + 0.8) / 2)
    cells = metrics.confusion_matrix(table((0, 0), (0, 1), (1, 1), (1, 1))).collect()
    assert sorted(map(tuple, cells)) == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    single = table((0, 0), (0, 0))
    assert [tuple(r) for r in metrics.confusion_matrix(single).collect()] == [(0, 0, 2)]
    one = metrics.evaluate_classifier(single, score=None).first()
    assert (one.accuracy, one.f1_macro, one.roc_auc, one.recall_fail) == (1.0, 1.0, None, 0.0)


def test_grid_search(rows, risk):
    table = classify.grid_search(rows, risk, {"maxDepth": [2, 3], "numTrees": [3]}, folds=2)
    assert table.columns == ["maxDepth", "numTrees", "roc_auc"] and table.count() == 2
    best = max(table.collect(), key=lambda r: (r.roc_auc, -r.maxDepth))
    assert classify.best_parameters(table) == {"maxDepth": best.maxDepth, "numTrees": 3}
    with pytest.raises(ValueError, match="maxBins"):
        classify.grid_search(rows, risk, {"maxBins": [8]})


def test_logistic_of_one_class_and_dependent_features(spark, rows):
    same = classify.train_classifiers(rows.withColumn("label", F.lit(1)), FEATS, models=["LogisticRegression"])
    assert same.models["LogisticRegression"].intercept == math.inf
    assert {r.predicted_proba for r in classify.predict_pass_fail(rows, same, "LogisticRegression").collect()} == {1.0}
    copied = classify.train_classifiers(rows.withColumn("y", F.col("x")), FEATS, models=["LogisticRegression"])
    w = copied.models["LogisticRegression"].coefficients
    assert w[0] == pytest.approx(w[1]) and all(map(math.isfinite, w))
    with pytest.raises(ValueError, match="no rows"):
        classify.fit_logistic(rows.where("false"), FEATS)
