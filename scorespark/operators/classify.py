"""At-risk classification of feature tables: scaling, fitting, batch scoring, evaluation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import fold_number, fold_starts
from ..functions.scalar import logistic, ref
from ..schema import FEATURES, LABEL, SPLIT, require_columns
from ..session import stage
from . import trees
from .cleaning import fit_standard, standard_scale
from .metrics import evaluate_classifier, roc_auc
from .regression import DIGITS, add_scores
from .trees import Fit, TreeParams, with_params

Scaler = Mapping[str, tuple[float, float]]


def get_vle_feature_columns(df: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    """The model's features by name and in its order; one that ``df`` lacks is an error, never replaced by position."""
    require_columns(df, features, "features")
    return list(features)


def features_and_labels(df: DataFrame, split: str = "original", label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """(features without id, label and split; the label column) of one split, or with "all" of all rows."""
    if split != "all":
        df = df.where(F.col(SPLIT) == split)
    return df.drop("id", label, SPLIT), df.select(ref(label))


def fill_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values of the features become 0."""
    return df.fillna(0.0, subset=list(features))


def complete_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Absent features become 0, present ones doubles; text that is no number fails the job."""
    return df.withColumns({
        f: ref(f).cast("double") if f in df.columns else F.lit(0.0) for f in features
    })


# --- logistic regression by Newton steps ------------------------------------------------

@dataclass
class LogisticFit:
    """Coefficients of scaled features and the intercept."""

    features: list[str]
    coefficients: list[float]
    intercept: float

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            z = z + F.lit(weight) * ref(name)
        return logistic(z)


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str = LABEL, strength: float = 1.0,
                 maxIter: int = 1000, tol: float = 1e-10) -> LogisticFit:
    """Minimum of the summed log loss plus |coefficients|^2 / (2 * strength); the intercept is free.

    Each step is one aggregation of weighted cross-products, (k + 1)(k + 2) / 2
    sums for k features, and a system of that width solved on the driver. A
    step that does not lower the loss is halved. Rows of a single class give
    zero coefficients and an infinite intercept. Pass a staged frame.
    """
    k = len(features) + 1
    penalty = np.diag([0.0] + [1.0 / strength] * (k - 1))
    x = ["_x0", *[f"_x{i + 1}" for i in range(k - 1)]]
    shaped = rows.select(F.lit(1.0).alias("_x0"), *[ref(f).cast("double").alias(n) for f, n in zip(features, x[1:])],
                         ref(label).cast("double").alias("_y"))

    def step(w: np.ndarray):
        z = F.lit(float(w[0]))
        for name, weight in zip(x[1:], w[1:]):
            z = z + F.lit(float(weight)) * F.col(name)
        p = F.col("_p")
        at = shaped.withColumn("_z", z).withColumn("_p", logistic(F.col("_z")))
        loss = F.greatest(F.col("_z"), F.lit(0.0)) - F.col("_z") * F.col("_y") + F.log1p(F.exp(-F.abs("_z")))
        row = at.agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positive"), F.sum(loss).alias("loss"),
            *[F.sum((p - F.col("_y")) * F.col(a)).alias(f"g{i}") for i, a in enumerate(x)],
            *[F.sum(p * (1 - p) * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
        ).first()
        if not row["n"]:
            raise ValueError("no rows to fit")
        if not 0 < row["positive"] < row["n"]:
            return None, row["positive"], None
        gradient = np.array([row[f"g{i}"] for i in range(k)]) + penalty @ w
        hessian = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty
        return row["loss"] + 0.5 * w @ penalty @ w, gradient, hessian

    w = np.zeros(k)
    loss, gradient, hessian = step(w)
    if loss is None:
        return LogisticFit(list(features), [0.0] * (k - 1), math.inf if gradient else -math.inf)
    for _ in range(maxIter):
        move = -np.linalg.pinv(hessian, hermitian=True) @ gradient
        scale = 1.0
        while True:
            new = w + scale * move
            found = step(new)
            if found[0] <= loss + 1e-9 * abs(loss) or scale < 1e-6:
                break
            scale /= 2
        w, (loss, gradient, hessian) = new, found
        if np.abs(scale * move).max() <= tol * max(1.0, np.abs(w).max()):
            break
    return LogisticFit(list(features), [float(v) for v in w[1:]], float(w[0]))


# name -> how its trees are grown (the square root of the features is tried in a node); None marks the logistic fit
CLASSIFIERS: dict[str, TreeParams | None] = {
    "LogisticRegression": None,
    "RandomForest": TreeParams(numTrees=100, bootstrap=True),
}


def forest_params(n_features: int, changes: Mapping | None = None) -> TreeParams:
    base = replace(CLASSIFIERS["RandomForest"], tried=max(1, math.isqrt(n_features)))
    return with_params(base, changes)


@dataclass
class RiskModels:
    """Fitted classifiers with the scaler and the feature order they were fitted on."""

    features: list[str]
    scaler: Scaler
    models: dict[str, object]

    def importance(self, model: str = "RandomForest") -> list[tuple[str, float]]:
        return self.models[model].importance()


def _scaled(df: DataFrame, features: Sequence[str], scaler: Scaler) -> DataFrame:
    return standard_scale(fill_features(df, features), {f: scaler[f] for f in features})


def _training_rows(train: DataFrame, features: Sequence[str], scaler: Scaler, label: str, key: str) -> DataFrame:
    """Key, scaled features and label, staged; a missing label fails."""
    rows = _scaled(train, features, scaler).select(ref(key).alias("_key"), *[ref(f) for f in features],
                                                   ref(label).cast("int").alias("_label"))
    rows = stage(rows, "training-rows")
    if rows.where("_label IS NULL").limit(1).count():
        raise ValueError("missing label")
    return rows


def train_classifiers(train: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL,
                      key: str = "id", models: Sequence[str] = tuple(CLASSIFIERS),
                      params: Mapping[str, Mapping] | None = None) -> RiskModels:
    """Fill with 0, scale, fit every classifier. A missing label fails the job."""
    params = params or {}
    unknown = [m for m in models if m not in CLASSIFIERS]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    features = get_vle_feature_columns(train, features)
    scaler = fit_standard(fill_features(train, features), features)
    rows = _training_rows(train, features, scaler, label, key)
    fitted = {}
    for m in models:
        if CLASSIFIERS[m] is None:
            fitted[m] = fit_logistic(rows, features, "_label", **params.get(m, {}))
        else:
            fit = Fit(m, "label", "_label", forest_params(len(features), params.get(m)))
            fitted[m] = trees.grow(rows, ["_key"], features, [fit])[0]
    return RiskModels(list(features), scaler, fitted)


def predict_pass_fail(rows: DataFrame, risk: RiskModels, model: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """(keep columns, predicted_label, predicted_proba of failing, model_used) per row.

    Features are taken by name; absent ones count as 0.
    """
    if model not in risk.models:
        raise FileNotFoundError(f"no fitted classifier: {model}")
    kept = rows.select(*[ref(k).alias(f"_keep_{k}") for k in keep], *[
        ref(f) for f in risk.features if f in rows.columns
    ])
    ready = _scaled(complete_features(kept, risk.features), risk.features, risk.scaler)
    fit = risk.models[model]
    scored = (ready.withColumn("_p", fit.probability()) if isinstance(fit, LogisticFit) else add_scores(ready, [("_p", fit)]))
    return scored.select(
        *[F.col(f"_keep_{k}").alias(k) for k in keep],
        (F.col("_p") > 0.5).cast("int").alias("predicted_label"),
        F.col("_p").alias("predicted_proba"),
        F.lit(model).alias("model_used"),
    )


def score_all(rows: DataFrame, risk: RiskModels, label: str = LABEL, key: str = "id") -> DataFrame:
    """Predictions of every classifier beside the true label."""
    parts = [predict_pass_fail(rows, risk, m, (key, label)) for m in risk.models]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate_classifiers(test: DataFrame, risk: RiskModels, label: str = LABEL, key: str = "id") -> DataFrame:
    """(model, accuracy, f1_macro, roc_auc, recall_fail) on a held-out table."""
    scored = score_all(test, risk, label, key).withColumnRenamed("model_used", "model")
    return evaluate_classifier(scored, ("model",), label, "predicted_label", "predicted_proba")


def importance_frame(spark, risk: RiskModels, model: str = "RandomForest") -> DataFrame:
    """(feature, importance), smallest first: one row per feature."""
    return spark.createDataFrame(risk.importance(model), "feature string, importance double").orderBy(
        "importance", "feature"
    )


def grid_search(train: DataFrame, risk: RiskModels, grid: Mapping[str, Sequence[int]], label: str = LABEL,
                folds: int = 3, key: str = "id", params: Mapping | None = None) -> DataFrame:
    """(maxDepth, numTrees, roc_auc): ROC area of the forest, averaged over contiguous folds, for every combination.

    One forest per fold serves the whole grid: a smaller depth is the same tree cut there, fewer trees are the first ones.
    """
    unknown = set(grid) - {"maxDepth", "numTrees"}
    if unknown:
        raise ValueError(f"only maxDepth and numTrees can be searched, not {sorted(unknown)}")
    base = forest_params(len(risk.features), params)
    depths = sorted(grid.get("maxDepth") or [base.maxDepth or trees.DEEPEST])
    sizes = sorted(grid.get("numTrees") or [base.numTrees])
    rows = _training_rows(train, risk.features, risk.scaler, label, key)
    fold = fold_number(F.col("_key"), fold_starts(rows, "_key", folds))
    deepest = replace(base, maxDepth=depths[-1], numTrees=sizes[-1])
    fits = [Fit("RandomForest", "label", "_label", deepest, f) for f in range(folds)]
    models = trees.grow(rows, ["_key"], risk.features, fits, fold)
    keys, asked = trees.distinct_rows(trees.numbered(rows.withColumn("_fold", fold)), risk.features, "_fold", models)
    sums = trees.score(keys, models, "_fold", range(folds), depths, sizes).withColumnRenamed("_row", "_like")
    scored = asked.select("_like", F.col("_label").alias("label")).join(sums.hint("merge"), "_like").select(
        F.col("depth").alias("maxDepth"), F.col("size").alias("numTrees"), F.col("place").alias("fold"), "label",
        F.round(F.col("total") / F.col("n"), DIGITS).alias("score"))
    areas = roc_auc(scored, ("maxDepth", "numTrees", "fold"))
    return areas.groupBy("maxDepth", "numTrees").agg(F.avg("roc_auc").alias("roc_auc"))


def best_parameters(searched: DataFrame) -> dict[str, int]:
    """The parameters with the largest ROC area; a tie goes to the shallower trees, then to fewer."""
    r = searched.orderBy(F.desc_nulls_last("roc_auc"), "maxDepth", "numTrees").first()
    return {"maxDepth": r["maxDepth"], "numTrees": r["numTrees"]}
