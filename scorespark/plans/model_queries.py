"""Queries that fit, apply and evaluate next-period regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordering import fold_number, fold_starts
from ..functions.scalar import ref
from ..operators import metrics, quality, regression, reshape, stats, tables as ops, trees
from ..session import scratch_path, stage
from ..sources import models as store
from .tables import BASE, NEXT, SUBJECTS, clean, rounded, staged_pairs

FOLDS = 5


def _clean_and_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The clean table, a projection of one staged table, and its pairs."""
    c = clean(spark, sf)
    return c, ops.build_regression_dataset(c, SUBJECTS, BASE, NEXT)


def _current(c: DataFrame) -> DataFrame:
    return c.where(F.col("year") == NEXT)


# --- least squares -----------------------------------------------------------------

def ols_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """One row per subject and coefficient."""
    _, p = _clean_and_pairs(spark, sf)
    fit = regression.fit_linear(p, SUBJECTS)
    return rounded(spark.createDataFrame(fit.rows(), "subject string, feature string, coefficient double"))


def ols_predictions(spark: SparkSession, sf: str) -> DataFrame:
    c, p = _clean_and_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["LinearRegression"])
    return rounded(regression.predict_next(_current(c), fitted, SUBJECTS))


def predictions_long(spark: SparkSession, sf: str) -> DataFrame:
    """Wide predictions turned into two columns per student, lowest first."""
    c, p = _clean_and_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["LinearRegression"])
    wide = regression.predict_next_wide(_current(c), fitted, "LinearRegression", SUBJECTS)
    return rounded(reshape.predictions_long(wide, ("student_id",), SUBJECTS))


def ols_cv(spark: SparkSession, sf: str) -> DataFrame:
    """In-sample errors beside 5-fold cross-validation of the linear model."""
    p = staged_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["LinearRegression"])
    return rounded(regression.evaluate_all_models(p, fitted, SUBJECTS, FOLDS))


def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_pairs(spark, sf)
    fold = fold_number(F.col("student_id"), fold_starts(p, "student_id", FOLDS))
    return p.groupBy(fold.cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("student_id").alias("first_id"),
        F.max("student_id").alias("last_id"),
    )


def rmse_mae(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of predicting no change, with the shared bounds of both axes."""
    p = staged_pairs(spark, sf)
    cells = F.array(*[
        F.struct(F.lit(s).alias("subject"), ref(f"{s}_next").alias("y_true"), ref(s).alias("y_pred"))
        for s in SUBJECTS
    ])
    rows = p.select(F.inline(cells))
    errors = metrics.regression_metrics(rows, ("subject",))
    return rounded(errors.join(stats.value_bounds(rows, "y_true", "y_pred", ("subject",)), "subject"))


def actual_vs_predicted(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["LinearRegression"])
    return rounded(regression.actual_vs_predicted(p, fitted, SUBJECTS))


def _report(spark: SparkSession, sf: str, models: list[str]) -> DataFrame:
    c, p = _clean_and_pairs(spark, sf)
    p = stage(p, "pairs")
    fitted = regression.train_regressors(p, SUBJECTS, models)
    errors = metrics.regression_metrics(
        regression.actual_vs_predicted(p, fitted, SUBJECTS), ("model", "subject")
    )
    return rounded(regression.student_report(c, fitted, errors, BASE, NEXT, SUBJECTS))


def entity_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per student: both years, the changes and the linear model's prediction."""
    return _report(spark, sf, ["LinearRegression"])


def entity_report_best(spark: SparkSession, sf: str) -> DataFrame:
    """The report with the best of the three models per subject."""
    return _report(spark, sf, list(regression.REGRESSORS))


def regression_gates(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["LinearRegression"])
    errors = metrics.regression_metrics(
        regression.actual_vs_predicted(p, fitted, SUBJECTS), ("model", "subject")
    )
    return quality.regression_gates(errors)


# --- trees -----------------------------------------------------------------------------

def tree_predictions(spark: SparkSession, sf: str) -> DataFrame:
    c, p = _clean_and_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["DecisionTree"])
    return rounded(regression.predict_next(_current(c), fitted, SUBJECTS))


def forest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    c, p = _clean_and_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["RandomForest"])
    return rounded(regression.predict_next(_current(c), fitted, SUBJECTS))


def prediction_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """95% band of the forest for every subject."""
    c, p = _clean_and_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, ["RandomForest"])
    return rounded(regression.prediction_intervals(_current(c), {s: fitted["RandomForest", s] for s in SUBJECTS}))


def regression_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Every model and subject: in-sample RMSE and MAE, 5-fold RMSE mean and deviation."""
    p = staged_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS, folds=FOLDS)
    return rounded(regression.evaluate_all_models(p, fitted, SUBJECTS, FOLDS))


SEARCH = {"maxDepth": [2, 4, 8], "numTrees": [10, 30]}


def regressor_search(spark: SparkSession, sf: str) -> DataFrame:
    """The forest's out-of-fold error for every depth and number of trees."""
    return rounded(regression.search_regressor(staged_pairs(spark, sf), SEARCH, "RandomForest", SUBJECTS, FOLDS))


def best_model(spark: SparkSession, sf: str) -> DataFrame:
    """The model with the lowest in-sample RMSE per subject."""
    p = staged_pairs(spark, sf)
    fitted = regression.train_regressors(p, SUBJECTS)
    errors = metrics.regression_metrics(
        regression.actual_vs_predicted(p, fitted, SUBJECTS), ("model", "subject")
    )
    return rounded(metrics.best_by(errors))


def model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Save, reload and apply the linear, tree and forest models."""
    c, p = _clean_and_pairs(spark, sf)
    folder = scratch_path(spark, "models")
    names = list(regression.REGRESSORS)
    store.save_regressors(spark, regression.train_regressors(p, SUBJECTS, names), folder)
    loaded = {(m, s): store.load_regressor(spark, folder, m, s) for m in names for s in SUBJECTS}
    return rounded(regression.predict_next(_current(c), loaded, SUBJECTS))


def pooled_pairs_model(spark: SparkSession, sf: str) -> DataFrame:
    """The linear model fitted on every consecutive pair of years."""
    c = clean(spark, sf)
    fit = regression.fit_linear(ops.consecutive_pairs(c, SUBJECTS), SUBJECTS)
    return rounded(spark.createDataFrame(fit.rows(), "subject string, feature string, coefficient double"))


def incremental_refit(spark: SparkSession, sf: str) -> DataFrame:
    """The pooled linear model, its years taken in one by one from stored moments."""
    c = stage(clean(spark, sf), "clean")
    path = scratch_path(spark, "moments")
    years = [r[0] for r in c.select("year").distinct().orderBy("year").collect()]  # one row a year
    for year in years[1:]:
        fit = store.refit_with_year(spark, c, year, path, SUBJECTS)
    return rounded(spark.createDataFrame(fit.rows(), "subject string, feature string, coefficient double"))


def pooled_forest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the forest grown on every consecutive pair of years."""
    c = clean(spark, sf)
    fitted = regression.train_regressors(ops.consecutive_pairs(c, SUBJECTS), SUBJECTS, ["RandomForest"],
                                         {"RandomForest": POOLED_PARAMS}, ("student_id", "year"))
    return rounded(regression.predict_next(_current(c), fitted, SUBJECTS))


POOLED_PARAMS = {"numTrees": 10}


def _tree_checks(spark: SparkSession, c: DataFrame, p: DataFrame, names: list[str], key: tuple = ("student_id",)) -> DataFrame:
    """Per tree model and subject, forecasts and those that break a rule.

    Rules: a forecast is inside the range of the marks it was learned from, a model that is fitted again or
    loaded from its files forecasts alike, and the in-sample RMSE is at most that of the mean.
    """
    p, folder = stage(p, "pairs"), scratch_path(spark, "models")
    fitted = regression.train_regressors(p, SUBJECTS, names, key=key)
    store.save_regressors(spark, fitted, folder)
    again = regression.train_regressors(p, SUBJECTS, names, key=key)
    every = dict(fitted)
    every |= {(f"{m} again", s): fit for (m, s), fit in again.items()}
    every |= {(f"{m} stored", s): store.load_regressor(spark, folder, m, s) for m, s in fitted}
    current = _current(c).select("student_id", F.lit(1).alias("year_encoded"), *[ref(s).cast("double").alias(s) for s in SUBJECTS])
    cells = F.array(*[F.struct(
        F.lit(m).alias("model"), F.lit(s).alias("subject"), ref(f"{m}|{s}").alias("mark"),
        ref(f"{m} again|{s}").alias("again"), ref(f"{m} stored|{s}").alias("stored")) for m, s in fitted])
    step = float(trees.STEP)  # trees see a mark in whole steps
    seen = {s: F.floor(ref(f"{s}_next") * step + 0.5) / step for s in SUBJECTS}
    marks = F.array(*[F.struct(F.lit(s).alias("subject"), y.alias("y")) for s, y in seen.items()])
    known = p.select(F.inline(marks)).groupBy("subject").agg(
        F.min("y").alias("low"), F.max("y").alias("high"), F.stddev_pop("y").alias("spread"))
    errors = metrics.regression_metrics(regression.actual_vs_predicted(p, fitted, SUBJECTS), ("model", "subject"))
    rows = regression.predict_columns(current, every, SUBJECTS).select(F.inline(cells)).join(known, "subject")
    checks = rows.groupBy("model", "subject", "spread").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("mark").between(F.col("low") - 1e-9, F.col("high") + 1e-9)).alias("outside"),
        *[F.count_if(F.abs(F.col("mark") - F.col(o)) > 1e-6).alias(f"{o}_differs") for o in ("again", "stored")])
    return checks.join(errors.select("model", "subject", "RMSE"), ["model", "subject"]).select(
        "model", "subject", "n_rows", "outside", "again_differs", "stored_differs",
        (F.col("RMSE") <= F.col("spread")).alias("beats_mean"))


def regressor_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_checks(spark, *_clean_and_pairs(spark, sf), ["DecisionTree", "RandomForest"])


def pooled_tree_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The same of trees fitted on every consecutive pair of years."""
    c = clean(spark, sf)
    return _tree_checks(spark, c, ops.consecutive_pairs(c, SUBJECTS), ["DecisionTree"], ("student_id", "year"))


QUERIES = {f.__name__: f for f in [
    ols_coefficients, ols_predictions, predictions_long, ols_cv, fold_sizes, rmse_mae,
    actual_vs_predicted, entity_report, entity_report_best, regression_gates, tree_predictions, forest_predictions, prediction_intervals,
    regression_evaluation, regressor_search, best_model, model_round_trip, pooled_pairs_model, incremental_refit, pooled_forest_predictions,
    regressor_checks, pooled_tree_checks,
]}
