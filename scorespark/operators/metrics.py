"""Evaluation of scored tables: regression errors, classifier metrics, ROC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import join_groups
from ..functions.ordering import running_totals
from ..functions.scalar import ref


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def regression_metrics(scored: DataFrame, by: Sequence[str] = (), y: str = "y_true",
                       p: str = "y_pred") -> DataFrame:
    return scored.groupBy(*by).agg(
        rmse(ref(y), ref(p)).alias("RMSE"), mae(ref(y), ref(p)).alias("MAE")
    )


def _cells(scored: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """How often every (actual, predicted) pair occurs in a group; NULL where a row has no label or prediction."""
    return scored.groupBy(
        *by, ref(label).cast("int").alias("actual"), ref(predicted).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def confusion_matrix(scored: DataFrame, by: Sequence[str] = (), label: str = "label",
                     predicted: str = "prediction") -> DataFrame:
    """(actual, predicted, n_rows) for every pair of the classes that occur in a group, zero cells included.

    Rows without a label or a prediction are counted in cells of their own, with NULL.
    """
    # as many cells as pairs of classes
    groups = _cells(scored, by, label, predicted).groupBy(*by).agg(
        F.collect_list(F.struct("actual", "predicted", "n_rows")).alias("cells"))
    classes = F.array_compact(F.array_sort(F.array_distinct(F.concat(F.col("cells.actual"), F.col("cells.predicted")))))

    def cell(a, p):
        found = F.filter("cells", lambda c: (c["actual"] == a) & (c["predicted"] == p))
        return F.struct(a.alias("actual"), p.alias("predicted"),
                        F.aggregate(found, F.lit(0).cast("long"), lambda n, c: n + c["n_rows"]).alias("n_rows"))

    grid = F.flatten(F.transform("classes", lambda a: F.transform("classes", lambda p: cell(a, p))))
    unscored = F.filter("cells", lambda c: c["actual"].isNull() | c["predicted"].isNull())
    return groups.withColumn("classes", classes).select(*by, F.inline(F.concat(grid, unscored)))


def classifier_metrics(scored: DataFrame, by: Sequence[str] = (), label: str = "label",
                       predicted: str = "prediction") -> DataFrame:
    """accuracy, f1_macro over the classes that occur, and recall_fail (class 1).

    A row without a prediction is wrong: it lowers the accuracy and the recall of its class.
    Rows without a label are left out.
    """
    right = F.col("actual").eqNullSafe(F.col("predicted"))
    n = F.col("n_rows")
    sides = F.when(right, F.array(F.struct(F.col("actual").alias("class"), n.alias("tp"), F.lit(0).cast("long").alias("fp"),
                                           F.lit(0).cast("long").alias("fn")))).otherwise(F.array(
        F.struct(F.col("actual").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), n.alias("fn")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), n.alias("fp"), F.lit(0).cast("long").alias("fn"))))
    per_class = (
        _cells(scored, by, label, predicted).where("actual IS NOT NULL").select(*by, F.inline(sides))
        .groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    known = F.col("class").isNotNull()
    f1 = F.when(known, F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    failing = F.col("class") == 1
    return per_class.groupBy(*by).agg(
        F.try_divide(F.sum("tp"), F.sum(F.when(known, F.col("tp") + F.col("fn")))).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
        F.coalesce(F.try_divide(F.sum(F.when(failing, F.col("tp"))), F.sum(F.when(failing, F.col("tp") + F.col("fn")))),
                   F.lit(0.0)).alias("recall_fail"),
    )


def _by_score(scored: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with running counts from the highest score.

    Counting per score first makes a score that a third of all rows share a single row.
    """
    counted = scored.groupBy(*by, ref(score).alias("threshold")).agg(
        F.count_if(ref(label) == 1).alias("p"), F.count_if(ref(label) == 0).alias("n")
    )
    return running_totals(counted, by, ["threshold"], ["p", "n"], ["p", "n"], descending=True)


def roc_auc(scored: DataFrame, by: Sequence[str] = (), label: str = "label",
            score: str = "score") -> DataFrame:
    """P(positive scores higher) + half the ties; NULL when a class is absent."""
    running = _by_score(scored, by, label, score)
    # a negative loses to every positive above it and ties with those at its score
    wins = F.col("n").cast("double") * (F.col("p_running") - F.col("p") / 2.0)
    return running.groupBy(*by).agg(
        F.try_divide(F.sum(wins), F.sum("p").cast("double") * F.sum("n").cast("double")).alias("roc_auc")
    )


def roc_curve(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score",
              drop_collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) from the start (0, 0), whose threshold is Infinity, to (1, 1).

    A point is left out when the step to it and the step after it are equal, which
    leaves the drawn curve as it is; the first and the last threshold always stay.
    """
    points = _by_score(scored, by, label, score)
    totals = points.groupBy(*by).agg(F.sum("p").alias("_pos"), F.sum("n").alias("_neg"))
    if drop_collinear:
        first = (F.col("p_running") == F.col("p")) & (F.col("n_running") == F.col("n"))
        last = F.col("p_ahead").isNull()
        turns = (F.col("p") != F.col("p_ahead")) | (F.col("n") != F.col("n_ahead"))
        points = points.where(first | last | turns)
    if by:
        points = join_groups(points, totals, by)
    else:
        total = totals.first()
        points = points.withColumns({"_pos": F.lit(total["_pos"]), "_neg": F.lit(total["_neg"])})
    curve = points.select(
        *by, "threshold",
        F.try_divide("n_running", "_neg").alias("fpr"),
        F.try_divide("p_running", "_pos").alias("tpr"),
    )
    groups = totals.select(*by) if by else scored.sparkSession.range(1)
    start = groups.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(curve)


def evaluate_classifier(scored: DataFrame, by: Sequence[str] = (), label: str = "label",
                        predicted: str = "prediction", score: str | None = "score") -> DataFrame:
    """One row per group: accuracy, f1_macro, roc_auc (NULL without scores), recall_fail."""
    metrics = classifier_metrics(scored, by, label, predicted)
    if score is None:
        metrics = metrics.withColumn("roc_auc", F.lit(None).cast("double"))
    else:
        area = roc_auc(scored, by, label, score)
        if by:
            metrics = join_groups(metrics, area, by, "left")
        else:
            metrics = metrics.withColumn("roc_auc", area.scalar())
    return metrics.select(*by, "accuracy", "f1_macro", "roc_auc", "recall_fail")


def best_classifier(metrics: DataFrame) -> DataFrame:
    """The classifier row with the highest recall of failures, then the highest ROC area."""
    return metrics.orderBy(
        F.col("recall_fail").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(), "model"
    ).limit(1)


def best_by(metrics: DataFrame, task: str = "subject", metric: str = "RMSE", name: str = "model") -> DataFrame:
    """The row with the lowest metric per task; a tie goes to the smaller name."""
    rest = [c for c in metrics.columns if c not in (task, metric, name)]
    best = F.min(F.struct(ref(metric), ref(name), *[ref(c) for c in rest])).alias("b")
    return metrics.groupBy(ref(task)).agg(best).select(ref(task), "b.*")
