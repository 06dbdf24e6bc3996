"""Next-period score regressions: least squares from one aggregation, trees and forests by ``trees``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import fold_number, fold_starts
from ..functions.scalar import clamp, ref
from ..schema import ENTITY, PERIOD, SCORE_MAX, SCORE_MIN, SUBJECTS, require_columns
from . import trees
from .metrics import best_by, regression_metrics
from .stats import year_on_year
from .trees import Fit, TreeModel, TreeParams, with_params

CENTRE = (SCORE_MIN + SCORE_MAX) / 2
DIGITS = 12
"""Of a forest's mean: sums over trees in another order must not break ties between rows."""


# --- least squares ---------------------------------------------------------------

@dataclass
class LinearFit:
    """Intercept and named coefficients per target."""

    features: list[str]
    intercepts: dict[str, float] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def predict(self, target: str) -> Column:
        total = F.lit(self.intercepts[target])
        for name, weight in self.weights[target].items():
            total = total + F.lit(weight) * ref(name)
        return total

    def rows(self) -> list[tuple[str, str, float]]:
        """(target, feature, coefficient), the intercept included."""
        out = []
        for target, weights in self.weights.items():
            out.append((target, "intercept", self.intercepts[target]))
            out += [(target, f, weights[f]) for f in self.features]
        return out


class _Moments:
    """Count, sums and cross-products of shifted columns; they add up over folds."""

    def __init__(self, names: Sequence[str], row=None):
        k = len(names)
        self.names = list(names)
        self.n = row["n"] if row else 0
        self.sums = np.array([row[f"s{i}"] for i in range(k)]) if row else np.zeros(k)
        self.products = np.zeros((k, k))
        if row:
            for i in range(k):
                for j in range(i, k):
                    self.products[i, j] = self.products[j, i] = row[f"p{i}_{j}"]

    def combine(self, other: "_Moments", sign: int) -> "_Moments":
        result = _Moments(self.names)
        result.n = self.n + sign * other.n
        result.sums = self.sums + sign * other.sums
        result.products = self.products + sign * other.products
        return result

    def solve(self, features: Sequence[str], targets: Mapping[str, str], centre: float) -> LinearFit:
        """Least squares with intercept; minimum-norm when the features are dependent."""
        means = self.sums / self.n
        centred = self.products - self.n * np.outer(means, means)
        x = [self.names.index(f) for f in features]
        inverse = np.linalg.pinv(centred[np.ix_(x, x)], rcond=1e-12, hermitian=True)
        fit = LinearFit(list(features))
        for target, column in targets.items():
            y = self.names.index(column)
            beta = inverse @ centred[x, y]
            fit.weights[target] = {f: float(b) for f, b in zip(features, beta)}
            fit.intercepts[target] = float(means[y] + centre - beta @ (means[x] + centre))
        return fit


def moment_rows(df: DataFrame, names: Sequence[str], group: Column, centre: float) -> DataFrame:
    """One row of count, sums and cross-products per group, from one pass; the shift keeps the products well conditioned."""
    shifted = df.select(
        group.alias("_group"),
        *[(ref(c).cast("double") - F.lit(centre)).alias(f"x{i}") for i, c in enumerate(names)],
    )
    k = len(names)
    missing = F.col("x0").isNull()
    for i in range(1, k):
        missing = missing | F.col(f"x{i}").isNull()
    return shifted.groupBy("_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(missing).alias("missing"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)],
    )


def _moments(df: DataFrame, names: Sequence[str], group: Column, centre: float) -> dict[int, _Moments]:
    """Moments per fold; one row a fold comes back."""
    rows = moment_rows(df, names, group, centre).collect()
    if any(r["missing"] for r in rows):
        raise ValueError("scores to fit on are missing; fill them first")
    return {r["_group"]: _Moments(names, r) for r in rows}


def _moment_names(subjects: Sequence[str]) -> list[str]:
    return [*subjects, *[f"{s}_next" for s in subjects]]


def year_moments(pairs: DataFrame, subjects: Sequence[str] = SUBJECTS, centre: float = CENTRE) -> DataFrame:
    """The moments of each year's pairs, one row a year: what a refit needs of that year, for good."""
    return moment_rows(pairs, _moment_names(subjects), F.col(PERIOD), centre).withColumnRenamed("_group", PERIOD)


def fit_from_moments(moments: DataFrame, subjects: Sequence[str] = SUBJECTS, centre: float = CENTRE) -> LinearFit:
    """The least-squares fit on all years whose moments are given; reads one row a year and no pair."""
    names = _moment_names(subjects)
    total = _Moments(names)
    for r in moments.orderBy(PERIOD).collect():
        if r["missing"]:
            raise ValueError(f"scores of {r[PERIOD]} are missing; fill them first")
        total = total.combine(_Moments(names, r), 1)
    if not total.n:
        raise ValueError("no rows to fit")
    return total.solve(subjects, {s: f"{s}_next" for s in subjects}, centre)


def fit_linear(pairs: DataFrame, subjects: Sequence[str] = SUBJECTS,
               centre: float = CENTRE) -> LinearFit:
    """One fit per target subject on the base-year scores, all from one aggregation.

    The encoded year is constant in the training pairs, so its coefficient is 0
    and it is left out of the system.
    """
    return fit_linear_folds(pairs, F.lit(0), subjects, centre)[0]


def fit_linear_folds(pairs: DataFrame, fold: Column, subjects: Sequence[str] = SUBJECTS,
                     centre: float = CENTRE) -> tuple[LinearFit, dict[int, LinearFit]]:
    """The fit on all rows and, per fold, the fit on the other folds, from one aggregation."""
    targets, names = {s: f"{s}_next" for s in subjects}, _moment_names(subjects)
    per_fold = _moments(pairs, names, fold, centre)
    if not per_fold:
        raise ValueError("no rows to fit")
    total = _Moments(names)
    for moments in per_fold.values():
        total = total.combine(moments, 1)
    without = {
        f: total.combine(m, -1).solve(subjects, targets, centre)
        for f, m in sorted(per_fold.items()) if total.n > m.n
    }
    return total.solve(subjects, targets, centre), without


# --- tree models -------------------------------------------------------------------

# name -> how its trees are grown; None marks the least-squares fit
REGRESSORS: dict[str, TreeParams | None] = {
    "LinearRegression": None,
    "DecisionTree": TreeParams(maxDepth=4),
    "RandomForest": TreeParams(numTrees=100, bootstrap=True),
}


@dataclass
class FoldTrees:
    """The models of ``fits``, each grown without a fold of ``pairs`` that ``starts`` cut."""

    pairs: DataFrame
    key: tuple[str, ...]
    starts: list
    fits: list[Fit]
    models: list[TreeModel]

    def serves(self, pairs: DataFrame, key: tuple[str, ...], folds: int, fits: Sequence[Fit]) -> bool:
        return self.key == key and len(self.starts) + 1 == folds and self.fits == list(fits) and self.pairs.sameSemantics(pairs)


class Fitted(dict):
    """{(model, subject): fitted}, and the trees of their cross-validation if they were grown in the same run."""

    without_folds: FoldTrees | None = None


def feature_names(subjects: Sequence[str] = SUBJECTS) -> list[str]:
    return ["year_encoded", *subjects]


def train_regressors(pairs: DataFrame, subjects: Sequence[str] = SUBJECTS,
                     models: Sequence[str] = tuple(REGRESSORS),
                     params: Mapping[str, Mapping] | None = None,
                     key: Sequence[str] = (ENTITY,), folds: int | None = None) -> Fitted:
    """{(model, subject): fitted}; every model for every subject, all trees grown together.

    ``key`` identifies a row: the draws of a forest depend on it and on nothing else. With ``folds``, the trees that
    ``evaluate_all_models`` asks for are grown in the same run, from the same cells; pass it the same staged ``pairs``.
    """
    unknown = [m for m in models if m not in REGRESSORS]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    params = params or {}
    fitted = Fitted()
    for m in models:
        if not REGRESSORS[m]:
            fit = fit_linear(pairs, subjects)
            fitted.update({(m, s): fit for s in subjects})
    fits = [Fit(m, s, f"{s}_next", with_params(REGRESSORS[m], params.get(m))) for m in models if REGRESSORS[m] for s in subjects]
    if fits:
        starts = fold_starts(pairs, ENTITY, folds) if folds else []
        left_out = _all_fold_fits({m: params.get(m) for m in models}, subjects, len(starts) + 1) if folds else []
        grown = trees.grow(pairs, key, feature_names(subjects), [*fits, *left_out], fold_number(ref(ENTITY), starts) if folds else None)
        fitted.update({(f.model, f.target): model for f, model in zip(fits, grown)})
        if folds:
            fitted.without_folds = FoldTrees(pairs, tuple(key), starts, left_out, grown[len(fits):])
    return fitted


def _all_fold_fits(models: Mapping[str, Mapping | None], subjects: Sequence[str], folds: int) -> list[Fit]:
    return [f for m, p in models.items() if REGRESSORS[m] for f in _fold_fits(m, p, subjects, folds)]


def _fold_fits(model: str, params: Mapping | None, subjects: Sequence[str], folds: int) -> list[Fit]:
    shape = with_params(REGRESSORS[model], params)
    return [Fit(model, s, f"{s}_next", shape, f) for s in subjects for f in range(folds)]


def predict_columns(df: DataFrame, fitted: Mapping[tuple[str, str], object],
                    subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Add the unclipped prediction ``{model}|{subject}`` of every fitted model.

    Linear models and small trees are expressions; forests are scored together, a row read past each group of trees.
    """
    out, forests = df, []
    for (model, subject), fit in fitted.items():
        predicted = fit.predict(subject) if isinstance(fit, LinearFit) else fit.predict()
        if predicted is None:
            forests.append((f"{model}|{subject}", fit))
        else:
            out = out.withColumn(f"{model}|{subject}", predicted)
    return add_scores(out, forests) if forests else out


def add_scores(df: DataFrame, named: Sequence[tuple[str, TreeModel]]) -> DataFrame:
    """``df`` with a column for the mean over the trees of each model."""
    models = [m for _, m in named]
    keys, rows = trees.distinct_rows(trees.numbered(df), models[0].features, None, models)
    sums = trees.score(keys, models).withColumnRenamed("_row", "_like")
    mean = F.round(F.col("total") / F.col("n"), DIGITS)
    wide = sums.groupBy("_like").agg(*[F.max(F.when(F.col("place") == i, mean)).alias(name) for i, (name, _) in enumerate(named)])
    return rows.join(wide.hint("merge"), "_like").drop("_row", "_like")


def predict_next(rows: DataFrame, fitted: Mapping[tuple[str, str], object],
                 subjects: Sequence[str] = SUBJECTS, keys: Sequence[str] = (ENTITY,)) -> DataFrame:
    """(keys, subject, predicted_mark, model_used): next-period scores clipped to 0..100.

    ``rows`` holds the current-period scores; a missing subject column is a ``ValueError``.
    """
    require_columns(rows, subjects, "prediction input")
    base = rows.select(
        *[ref(k) for k in keys], F.lit(1).alias("year_encoded"),
        *[ref(s).cast("double").alias(s) for s in subjects],
    )
    scored = predict_columns(base, fitted, subjects)
    cells = F.array(*[
        F.struct(
            F.lit(subject).alias("subject"),
            clamp(ref(f"{model}|{subject}")).alias("predicted_mark"),
            F.lit(model).alias("model_used"),
        )
        for model, subject in fitted
    ])
    return scored.select(*[ref(k) for k in keys], F.inline(cells))


def predict_next_wide(rows: DataFrame, fitted: Mapping[tuple[str, str], object], model: str,
                      subjects: Sequence[str] = SUBJECTS, keys: Sequence[str] = (ENTITY,)) -> DataFrame:
    """One clipped prediction column per subject from one model."""
    require_columns(rows, subjects, "prediction input")
    base = rows.select(
        *[ref(k) for k in keys], F.lit(1).alias("year_encoded"),
        *[ref(s).cast("double").alias(s) for s in subjects],
    )
    chosen = {key: fit for key, fit in fitted.items() if key[0] == model}
    scored = predict_columns(base, chosen, subjects)
    return scored.select(*[ref(k) for k in keys], *[
        clamp(ref(f"{model}|{s}")).alias(s) for s in subjects
    ])


# --- evaluation ----------------------------------------------------------------------

def actual_vs_predicted(pairs: DataFrame, fitted: Mapping[tuple[str, str], object],
                        subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """(model, subject, y_true, y_pred) per pair and fitted model, unclipped."""
    scored = predict_columns(pairs, fitted, subjects)
    cells = F.array(*[
        F.struct(
            F.lit(model).alias("model"), F.lit(subject).alias("subject"),
            ref(f"{subject}_next").alias("y_true"), ref(f"{model}|{subject}").alias("y_pred"),
        )
        for model, subject in fitted
    ])
    return scored.select(ENTITY, F.inline(cells))


def linear_fold_errors(pairs: DataFrame, fold: Column, fits: Mapping[int, LinearFit],
                       subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Out-of-fold RMSE per (subject, fold) of the fits that leave the fold out; one pass."""
    scored = pairs.withColumn("fold", fold)
    cells = []
    for s in subjects:
        predicted = F.lit(None).cast("double")
        for number, fit in fits.items():
            predicted = F.when(F.col("fold") == number, fit.predict(s)).otherwise(predicted)
        cells.append(F.struct(
            F.lit(s).alias("subject"), ref(f"{s}_next").alias("y_true"), predicted.alias("y_pred")
        ))
    rows = scored.select("fold", F.inline(F.array(*cells)))
    return regression_metrics(rows, ("subject", "fold")).select("subject", "fold", "RMSE")


def out_of_fold(pairs: DataFrame, fold: Column, folds: int, params: TreeParams, subjects: Sequence[str] = SUBJECTS,
                key: Sequence[str] = (ENTITY,), depths: Sequence[int] = (), sizes: Sequence[int] = ()) -> DataFrame:
    """(subject, fold, depth, size, y_true, y_pred): each row scored by the trees grown without its fold.

    All folds and subjects are grown in one run and scored in one: a row meets only the trees of its fold.
    """
    fits = [Fit("fold", s, f"{s}_next", params, f) for s in subjects for f in range(folds)]
    models = trees.grow(pairs, key, feature_names(subjects), fits, fold)
    return _scored_without(pairs, fold, fits, models, subjects, depths, sizes).drop("model")


def _scored_without(pairs: DataFrame, fold: Column, fits: Sequence[Fit], models: Sequence[TreeModel], subjects: Sequence[str],
                    depths: Sequence[int] = (), sizes: Sequence[int] = ()) -> DataFrame:
    """(model, subject, fold, depth, size, y_true, y_pred): each row scored by the models of ``fits`` without its fold."""
    keys, rows = trees.distinct_rows(trees.numbered(pairs.withColumn("_fold", fold)), models[0].features, "_fold", models)
    sums = trees.score(keys, models, "_fold", [f.without for f in fits], depths, sizes).withColumnRenamed("_row", "_like")
    of_place = F.array(*[F.struct(F.lit(f.model).alias("model"), F.lit(f.target).alias("subject"), F.lit(f.without).alias("fold")) for f in fits])
    known = rows.select("_like", F.create_map(*[x for s in subjects for x in (F.lit(s), ref(f"{s}_next"))]).alias("known"))
    return (known.join(sums.withColumn("p", F.element_at(of_place, F.col("place") + 1)).hint("merge"), "_like")
            .select("p.model", "p.subject", "p.fold", "depth", "size", F.element_at("known", F.col("p.subject")).alias("y_true"),
                    F.round(F.col("total") / F.col("n"), DIGITS).alias("y_pred")))


def cross_validate(pairs: DataFrame, starts: Sequence, model: str, subjects: Sequence[str] = SUBJECTS,
                   params: Mapping | None = None, key: str = ENTITY) -> DataFrame:
    """Mean and population deviation of the per-fold RMSE: (model, subject, mean, std)."""
    return cross_validate_models(pairs, starts, {model: params}, subjects, key)


def cross_validate_models(pairs: DataFrame, starts: Sequence, models: Mapping[str, Mapping | None], subjects: Sequence[str] = SUBJECTS,
                          key: str = ENTITY, grown: FoldTrees | None = None) -> DataFrame:
    """``cross_validate`` for several models, named with their parameters: all trees are grown in one run, unless they are
    ``grown`` already, and scored in one.
    """
    fold, parts = fold_number(ref(key), starts), []
    for model in models:
        if REGRESSORS[model] is None:
            _, fits = fit_linear_folds(pairs, fold, subjects)
            parts.append(linear_fold_errors(pairs, fold, fits, subjects).select(F.lit(model).alias("model"), "subject", "RMSE"))
    fits = _all_fold_fits(models, subjects, len(starts) + 1)
    if fits:
        if grown is None or not grown.serves(pairs, (key,), len(starts) + 1, fits):
            found = trees.grow(pairs, (key,), feature_names(subjects), fits, fold)
        else:
            found = grown.models
        scored = _scored_without(pairs, fold, fits, found, subjects)
        parts.append(regression_metrics(scored, ("model", "subject", "fold")).select("model", "subject", "RMSE"))
    return reduce(DataFrame.unionByName, parts).groupBy("model", "subject").agg(
        F.avg("RMSE").alias("mean"), F.stddev_pop("RMSE").alias("std"))


def search_regressor(pairs: DataFrame, grid: Mapping[str, Sequence[int]], model: str = "RandomForest",
                     subjects: Sequence[str] = SUBJECTS, folds: int = 5, params: Mapping | None = None,
                     key: str = ENTITY) -> DataFrame:
    """(subject, maxDepth, numTrees, mean, std) of the per-fold RMSE for every combination of the grid.

    One set of trees per fold serves the whole grid: a smaller depth is the same tree cut
    there, fewer trees are the first ones.
    """
    base = with_params(REGRESSORS[model], params)
    unknown = set(grid) - {"maxDepth", "numTrees"}
    if unknown:
        raise ValueError(f"only maxDepth and numTrees can be searched, not {sorted(unknown)}")
    depths = sorted(grid.get("maxDepth") or [base.maxDepth or trees.DEEPEST])
    sizes = sorted(grid.get("numTrees") or [base.numTrees])
    fold = fold_number(ref(key), fold_starts(pairs, key, folds))
    scored = out_of_fold(pairs, fold, folds, replace(base, maxDepth=depths[-1], numTrees=sizes[-1]), subjects, (key,), depths, sizes)
    errors = regression_metrics(scored, ("subject", "depth", "size", "fold"))
    return errors.groupBy("subject", F.col("depth").alias("maxDepth"), F.col("size").alias("numTrees")).agg(
        F.avg("RMSE").alias("mean"), F.stddev_pop("RMSE").alias("std"))


def best_parameters(searched: DataFrame) -> dict[str, dict[str, int]]:
    """Parameters with the lowest mean error per subject; a tie goes to the shallower trees, then to fewer."""
    best = F.min(F.struct("mean", "maxDepth", "numTrees")).alias("b")
    rows = searched.groupBy("subject").agg(best).select("subject", "b.maxDepth", "b.numTrees").collect()  # a row per subject
    return {r["subject"]: {"maxDepth": r["maxDepth"], "numTrees": r["numTrees"]} for r in rows}


def train_with_best(pairs: DataFrame, searched: DataFrame, model: str = "RandomForest", key: Sequence[str] = (ENTITY,),
                    params: Mapping | None = None) -> dict[tuple[str, str], TreeModel]:
    """The model of every subject with its own best parameters, which are stored with it."""
    chosen = best_parameters(searched)
    fits = [Fit(model, s, f"{s}_next", with_params(REGRESSORS[model], {**(params or {}), **p})) for s, p in sorted(chosen.items())]
    subjects = [c.removesuffix("_next") for c in pairs.columns if c.endswith("_next")]
    grown = trees.grow(pairs, key, feature_names(subjects), fits)
    return {(model, f.target): m for f, m in zip(fits, grown)}


def evaluate_all_models(pairs: DataFrame, fitted: Mapping[tuple[str, str], object],
                        subjects: Sequence[str] = SUBJECTS, folds: int = 5,
                        params: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(model, subject, RMSE, MAE, mean, std): in-sample errors beside k-fold RMSE.

    Pass a staged ``pairs`` frame: the fold boundaries, the fits and the scoring read it. Trees that ``train_regressors``
    grew without the same folds of the same frame are not grown again.
    """
    params = params or {}
    in_sample = regression_metrics(
        actual_vs_predicted(pairs, fitted, subjects), ("model", "subject")
    )
    models = {m: params.get(m) for m in dict.fromkeys(m for m, _ in fitted)}
    grown = getattr(fitted, "without_folds", None)
    if grown and not grown.serves(pairs, (ENTITY,), folds, _all_fold_fits(models, subjects, folds)):
        grown = None
    starts = grown.starts if grown else fold_starts(pairs, ENTITY, folds)
    return in_sample.join(cross_validate_models(pairs, starts, models, subjects, ENTITY, grown), ["model", "subject"])


def student_report(clean: DataFrame, fitted: Mapping[tuple[str, str], object], errors: DataFrame,
                   base: int, following: int, subjects: Sequence[str] = SUBJECTS) -> DataFrame:
    """Per student: both years, the changes, and ``{s}_predicted`` from the subject's best model.

    ``errors`` holds (model, subject, RMSE); the model with the lowest RMSE predicts.
    """
    best = {r["subject"]: r["model"] for r in best_by(errors).collect()}  # one row per subject
    chosen = {(best[s], s): fitted[best[s], s] for s in subjects}
    current = clean.where(F.col(PERIOD) == following)
    base_row = current.select(
        ENTITY, F.lit(1).alias("year_encoded"), *[ref(s).cast("double").alias(s) for s in subjects]
    )
    ahead = predict_columns(base_row, chosen, subjects).select(
        ENTITY, *[clamp(ref(f"{best[s]}|{s}")).alias(f"{s}_predicted") for s in subjects]
    )
    return year_on_year(clean, base, following, subjects).join(ahead, ENTITY)


def prediction_intervals(rows: DataFrame, forests: Mapping[str, TreeModel], keys: Sequence[str] = (ENTITY,),
                         z: float = 1.96) -> DataFrame:
    """(keys, subject, predicted_mark, low, high): a forest's mean with a 95% band from the spread of its trees."""
    subjects = list(forests)
    models = [forests[s] for s in subjects]
    one_each, rows = trees.distinct_rows(trees.numbered(rows.withColumn("year_encoded", F.lit(1))), models[0].features, None, models)
    scored = trees.score_spread(one_each, models).withColumnRenamed("_row", "_like")
    mean, half = F.round("mean", DIGITS), F.lit(z) * F.col("deviation")
    subject = F.element_at(F.array(*[F.lit(s) for s in subjects]), F.col("place") + 1)
    return rows.select("_like", *[ref(k) for k in keys]).join(scored.hint("merge"), "_like").select(
        *[ref(k) for k in keys], subject.alias("subject"), clamp(mean).alias("predicted_mark"),
        clamp(mean - half).alias("low"), clamp(mean + half).alias("high"))
