"""Stored models as tables: coefficients, scalers, and the nodes of trees with the parameters they were grown with."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.classify import CLASSIFIERS, LogisticFit, RiskModels
from ..operators.regression import REGRESSORS, LinearFit, fit_from_moments, year_moments
from ..operators.tables import consecutive_pairs
from ..operators.trees import COMPILED, TreeModel, TreeParams, packed_nodes
from ..schema import PERIOD, SUBJECTS
from ..session import path_exists

COEFFICIENTS = "model string, target string, position int, feature string, coefficient double"


def _require(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no saved model: {path}")
    return path


def _write_small(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    """A few rows a model as one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def _save_tree(spark: SparkSession, model: TreeModel, path: str) -> None:
    model.table().drop("fit").write.mode("overwrite").parquet(f"{path}/nodes")
    _write_small(spark, [(model.described(),)], "described string", f"{path}/parameters")


def _load_tree(spark: SparkSession, path: str) -> TreeModel:
    described = json.loads(spark.read.parquet(_require(spark, f"{path}/parameters")).first()[0])
    features = described.pop("features")
    nodes = spark.read.parquet(f"{path}/nodes").withColumn("fit", F.lit(0))
    params = TreeParams(**described)
    few = params.numTrees == 1 and nodes.limit(COMPILED + 1).count() <= COMPILED
    return TreeModel(packed_nodes(nodes), 0, features, params, nodes.collect() if few else None)


def save_regressors(spark: SparkSession, fitted: Mapping[tuple[str, str], object], folder: str) -> None:
    rows = []
    for (model, subject), fit in fitted.items():
        if isinstance(fit, LinearFit):
            named = [("intercept", fit.intercepts[subject]), *fit.weights[subject].items()]
            rows += [(model, subject, i, f, float(c)) for i, (f, c) in enumerate(named)]
        else:
            _save_tree(spark, fit, f"{folder}/{model}_{subject}")
    if rows:
        _write_small(spark, rows, COEFFICIENTS, f"{folder}/coefficients")


def load_regressor(spark: SparkSession, folder: str, model: str, subject: str):
    """The fitted model; a tree model carries the parameters it was grown with."""
    if REGRESSORS.get(model):
        return _load_tree(spark, _require(spark, f"{folder}/{model}_{subject}"))
    table = spark.read.parquet(_require(spark, f"{folder}/coefficients"))
    rows = table.where((table.model == model) & (table.target == subject)).orderBy("position").collect()
    if not rows:
        raise FileNotFoundError(f"no saved model: {model} for {subject} in {folder}")
    features = [r["feature"] for r in rows[1:]]
    return LinearFit(
        features, {subject: rows[0]["coefficient"]},
        {subject: {r["feature"]: r["coefficient"] for r in rows[1:]}},
    )


def save_classifiers(spark: SparkSession, risk: RiskModels, folder: str) -> None:
    """Classifiers, and the scaler with the feature order they were fitted on."""
    rows = [(i, f, float(risk.scaler[f][0]), float(risk.scaler[f][1])) for i, f in enumerate(risk.features)]
    _write_small(spark, rows, "position int, feature string, mean double, std double", f"{folder}/scaler")
    for name, model in risk.models.items():
        path = f"{folder}/classifier_{name}"
        if isinstance(model, LogisticFit):
            named = [("intercept", model.intercept), *zip(model.features, model.coefficients)]
            _write_small(spark, [(name, "label", i, f, float(c)) for i, (f, c) in enumerate(named)], COEFFICIENTS, path)
        else:
            _save_tree(spark, model, path)


def load_classifiers(spark: SparkSession, folder: str, *names: str) -> RiskModels:
    models = {}
    for name in names:
        if name not in CLASSIFIERS:
            raise FileNotFoundError(f"no saved model: {name}")
        path = _require(spark, f"{folder}/classifier_{name}")
        if CLASSIFIERS[name]:
            models[name] = _load_tree(spark, path)
        else:
            rows = spark.read.parquet(path).orderBy("position").collect()
            models[name] = LogisticFit([r["feature"] for r in rows[1:]], [r["coefficient"] for r in rows[1:]], rows[0]["coefficient"])
    rows = spark.read.parquet(_require(spark, f"{folder}/scaler")).orderBy("position").collect()
    return RiskModels(
        [r["feature"] for r in rows], {r["feature"]: (r["mean"], r["std"]) for r in rows}, models
    )


def save_moments(pairs: DataFrame, path: str, subjects: Sequence[str] = SUBJECTS) -> None:
    """Store the moments of the years in ``pairs``, a row and a folder a year; those years' old rows are replaced."""
    year_moments(pairs, subjects).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        PERIOD).parquet(path)


def refit_with_year(spark: SparkSession, wide: DataFrame, year: int, path: str, subjects: Sequence[str] = SUBJECTS) -> LinearFit:
    """Take in the scores of a new ``year`` and fit on every year seen so far.

    Only the new year and the one before it, whose scores are its features, are
    read from ``wide``; older years are in the stored moments.
    """
    save_moments(consecutive_pairs(wide.where(F.col(PERIOD).isin(year - 1, year)), subjects), path, subjects)
    return fit_from_moments(spark.read.parquet(path), subjects)
