"""Queries over feature tables with a binary label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import label_name, logistic, ref, sentinel_to_null
from ..operators import classify, cleaning, metrics, quality, stats, tables as ops
from ..schema import FEATURES, LABEL, QUINTILES, SOURCE_HEADERS, SPLIT
from ..session import scratch_path, stage
from ..sources import features as files, models as store, tables as logs
from ..sources.marks import write_csv
from .tables import TEXT_FEATURES, engagement, rounded, text_features


# --- files with untidy headers -----------------------------------------------------

def _messy_headers() -> dict[str, str]:
    """Canonical name -> header as sources spell it: byte-order mark, blanks, notes, case."""
    headers = dict(SOURCE_HEADERS)
    headers["gender"] = "\ufeff" + headers["gender"]
    headers["gaps_gcse_quintile"] += " "
    headers["age"] = headers["age"].lower()
    headers["attending_from_home"] += " (yes=1, no=0)"
    for f in FEATURES:
        if f.startswith("tundra"):
            headers[f] += " (pcode removed from stats=0)"
    return headers


def _write_messy(df: DataFrame, path: str) -> None:
    """The features as text under untidy headers, two blank columns, and unusable numbers."""
    text = df.withColumn(
        "logins", F.when(F.col("logins") > 150, "n/a").otherwise(F.col("logins").cast("string"))
    ).withColumn("age", F.concat(F.lit(" "), F.col("age").cast("string"), F.lit(" ")))
    headers = _messy_headers()
    messy = text.select(
        *[ref(c).cast("string").alias(headers[c]) for c in [*FEATURES, LABEL]],
        F.lit(None).cast("string").alias(" "), F.lit(None).cast("string").alias("Unnamed: 21"),
    )
    padding = df.where("label = 1").select(*[F.lit(None).cast("string").alias(c) for c in messy.columns])
    write_csv(messy.unionByName(padding), path)


def messy_csv_load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "messy-csv")
    _write_messy(engagement(spark, sf), path)
    return rounded(ops.drop_missing_label(files.load_feature_csv(spark, path, "original")))


def exact_csv_load(spark: SparkSession, sf: str) -> DataFrame:
    """A file whose trimmed headers are the sources' own; one in capitals is not known to the exact match."""
    path = scratch_path(spark, "exact-csv")
    headers = {**SOURCE_HEADERS, LABEL: LABEL, "age": SOURCE_HEADERS["age"].upper(), "logins": f" {SOURCE_HEADERS['logins']} "}
    rows = engagement(spark, sf)
    write_csv(rows.select(*[ref(c).cast("string").alias(headers[c]) for c in [*FEATURES, LABEL]]), path)
    return rounded(files.load_feature_csv(spark, path, exact=True))


def mixed_headers_load(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of three loads whose columns differ in order, spelling and number."""
    path = scratch_path(spark, "mixed-csv")
    rows, messy = stage(engagement(spark, sf), "engagement"), _messy_headers()
    orders = [[*FEATURES, LABEL], [LABEL, *reversed(FEATURES)], [*FEATURES[:10], LABEL]]
    for i, columns in enumerate(orders):
        named = messy if i == 1 else {c: c.upper() for c in columns}
        part = rows.where(F.col("id") % 3 == i).select(*[ref(c).cast("string").alias(named.get(c, c)) for c in columns])
        part.write.mode("append").option("header", True).csv(path)
    return rounded(files.load_feature_csv(spark, path))


def completed_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of which some are NULL, one is text and some are absent, made ready for scoring; labels given as text."""
    rows = engagement(spark, sf).withColumns({
        "age": F.when(F.col("id") % 5 > 0, F.col("age")), "logins": F.col("logins").cast("string"),
        "label": F.col("label").cast("string")}).drop("total_hours", "polar4_quintile")
    ready = classify.fill_features(classify.complete_features(rows, FEATURES), FEATURES)
    return rounded(ready.select("id", *FEATURES, F.col("label").cast("int").alias("label")))


def loaded_or_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the feature file, of one that is absent, and of one without a label column."""
    present, unusable = scratch_path(spark, "present-csv"), scratch_path(spark, "unlabelled-csv")
    rows = engagement(spark, sf)
    _write_messy(rows, present)
    write_csv(rows.select("age", "logins"), unusable)
    parts = None
    for name, path in (("present", present), ("absent", scratch_path(spark, "absent")), ("unusable", unusable)):
        loaded = files.load_or_empty(spark, path)
        part = loaded.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("fails"))
        parts = part if parts is None else parts.union(part)
    return parts


def _feature_sources(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """Two files that share rows: the first holds every row, the second the test rows again."""
    rows = stage(engagement(spark, sf), "engagement")
    full, test = scratch_path(spark, "full-csv"), scratch_path(spark, "test-csv")
    _write_messy(rows, full)
    _write_messy(rows.where(F.col(SPLIT) == "test"), test)
    return [(full, "original"), (test, "test"), (scratch_path(spark, "absent"), "train")]


def feature_table_report(spark: SparkSession, sf: str) -> DataFrame:
    """Load, combine, drop duplicates and unlabelled rows, write; the load report."""
    return files.build_feature_table(spark, _feature_sources(spark, sf), scratch_path(spark, "features"))


def split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table read back by split; ids number the rows in a fixed order."""
    target = scratch_path(spark, "features")
    rows = stage(engagement(spark, sf), "engagement")
    a, b = scratch_path(spark, "a-csv"), scratch_path(spark, "b-csv")
    _write_messy(rows.where(F.col(SPLIT) != "test"), a)
    _write_messy(rows.where(F.col(SPLIT) == "test"), b)
    files.build_feature_table(spark, [(a, "original"), (b, "test")], target)
    stored = spark.read.parquet(target)
    return rounded(logs.get_vle_data(stored, "test").select("id", *FEATURES, LABEL, SPLIT))


def train_test_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and label counts of the two loaded tables; the training file gives attendance as 0..1."""
    rows = engagement(spark, sf)
    train, test = scratch_path(spark, "train-csv"), scratch_path(spark, "held-out-csv")
    _write_messy(
        rows.where(F.col(SPLIT) != "test").withColumn("pct_attended", F.col("pct_attended") / 100.0), train
    )
    _write_messy(rows.where(F.col(SPLIT) == "test"), test)
    loaded = files.load_train_test(spark, train, test)
    return rounded(ops.union_sources(*[
        df.withColumn("part", F.lit(part)) for part, df in zip(("train", "test"), loaded)
    ]).where("label IS NOT NULL").groupBy("part", LABEL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("pct_attended").alias("mean_attended"),
        F.max("pct_attended").alias("top_attended"),
    ))


# --- rows and labels ------------------------------------------------------------------

def drop_null_label(spark: SparkSession, sf: str) -> DataFrame:
    return ops.label_load_report(text_features(spark, sf, "left"))


def feature_label_split(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = classify.features_and_labels(engagement(spark, sf), "original")
    return rounded(x)


def label_column(spark: SparkSession, sf: str) -> DataFrame:
    _, y = classify.features_and_labels(engagement(spark, sf), "original")
    return y


def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_distribution(text_features(spark, sf, "left"))


def label_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.label_kpis(text_features(spark, sf)))


def labelled_names(spark: SparkSession, sf: str) -> DataFrame:
    return text_features(spark, sf).select("id", label_name(F.col(LABEL)).alias("class"))


def sentinel_null(spark: SparkSession, sf: str) -> DataFrame:
    e = engagement(spark, sf)
    return rounded(e.select("id", *[sentinel_to_null(ref(q), 0.0).alias(q) for q in QUINTILES]))


def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = stage(text_features(spark, sf), "features")
    scaler = cleaning.fit_standard(df, TEXT_FEATURES)
    return rounded(cleaning.standard_scale(df.select("id", *TEXT_FEATURES), scaler))


def feature_corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = engagement(spark, sf)
    return rounded(stats.correlation_pairs(e, stats.numeric_features(e)))


def domain_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.domain_violations(engagement(spark, sf))


def within_domain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.within_domain(engagement(spark, sf)).select("id", *FEATURES))


def flag_rule_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.flag_rule_check(engagement(spark, sf))


# --- metrics of a fixed score ------------------------------------------------------------

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed logistic score on text features, rounded so that scores tie."""
    z: Column = (
        F.lit(2.0) - 4.0 * F.col("distinct_ratio") + 20.0 * F.col("digit_ratio")
        - 0.01 * F.col("source_no") + 6.0 * F.col("upper_ratio")
    )
    score = F.round(logistic(z), 3)
    return text_features(spark, sf).select("id", LABEL, score.alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.4).cast("int")
    )


def logistic_squash(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_scored(spark, sf))


def classifier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.classifier_metrics(_scored(spark, sf)))


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(_scored(spark, sf)))


def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_curve(_scored(spark, sf)))


def classifier_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.evaluate_classifier(_scored(spark, sf)))


def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classifier_gates(metrics.classifier_metrics(_scored(spark, sf)))


def _write_label_log(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "label-log")
    rows = _scored(spark, sf).select(
        F.col("id").alias("vle_student_id"), F.col("prediction").alias("predicted_label"),
        F.col("score").alias("predicted_proba"), F.lit("fixed").alias("model_used"),
    )
    logs.save_vle_predictions(rows, path)
    return path


def label_log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.get_vle_predictions(spark, _write_label_log(spark, sf)).drop("created_at")


def label_log_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The log of the student with the lowest id."""
    first = _scored(spark, sf).agg(F.min("id")).first()[0]
    return logs.get_vle_predictions(spark, _write_label_log(spark, sf), first).drop("created_at")


# --- fitted classifiers ----------------------------------------------------------------------

def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = stage(text_features(spark, sf), "features")
    return rows.where(F.col(SPLIT) != "test"), rows.where(F.col(SPLIT) == "test")


def _fit(train: DataFrame, *models: str) -> classify.RiskModels:
    return classify.train_classifiers(train, TEXT_FEATURES, models=models or tuple(classify.CLASSIFIERS))


def logistic_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    return rounded(classify.predict_pass_fail(test, _fit(train, "LogisticRegression"), "LogisticRegression"))


def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    return rounded(classify.predict_pass_fail(test, _fit(train, "RandomForest"), "RandomForest"))


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    return rounded(classify.importance_frame(spark, _fit(train, "RandomForest")))


def classifier_eval(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    result = classify.evaluate_classifiers(test, _fit(train))
    write_csv(result, scratch_path(spark, "classifier-eval"))
    return rounded(result)


def best_classifier(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    return rounded(metrics.best_classifier(classify.evaluate_classifiers(test, _fit(train))))


GRID, GRID_FOLDS = {"maxDepth": [3, 6], "numTrees": [20, 50]}, 3


def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    risk = classify.RiskModels(TEXT_FEATURES, cleaning.fit_standard(train, TEXT_FEATURES), {})
    return rounded(classify.grid_search(train, risk, GRID, folds=GRID_FOLDS))


def classifier_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per classifier, rows of the held-out table and those that break a rule.

    Rules: a label is 0 or 1 and that of the likelier class, a probability is in 0..1, a model that is fitted
    again or loaded from its files scores alike, and importances add up to 1.
    """
    train, test = _split(spark, sf)
    risk, folder = _fit(train), scratch_path(spark, "classifiers")
    store.save_classifiers(spark, risk, folder)
    others = {"again": _fit(train), "stored": store.load_classifiers(spark, folder, *risk.models)}
    parts = None
    for m in risk.models:
        rows = classify.predict_pass_fail(test, risk, m)
        for name, other in others.items():
            scores = classify.predict_pass_fail(test, other, m).select("id", F.col("predicted_proba").alias(name))
            rows = rows.join(scores, "id")
        p, label = F.col("predicted_proba"), F.col("predicted_label")
        total = sum(v for _, v in risk.importance(m)) if m == "RandomForest" else 1.0
        part = rows.groupBy(F.col("model_used").alias("model")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~label.isin(0, 1) | (label != (p > 0.5).cast("int"))).alias("wrong_labels"),
            F.count_if(~p.between(0, 1)).alias("outside"),
            *[F.count_if(F.abs(p - F.col(name)) > 1e-6).alias(f"{name}_differs") for name in others],
        ).withColumn("importances", F.round(F.lit(total), 6))
        parts = part if parts is None else parts.unionByName(part)
    return parts


QUERIES = {f.__name__: f for f in [
    messy_csv_load, exact_csv_load, mixed_headers_load, completed_features, loaded_or_empty, feature_table_report, split_scan, train_test_pair, drop_null_label,
    feature_label_split, label_column, class_distribution, label_kpis, labelled_names, sentinel_null,
    standard_scale, feature_corr_matrix, domain_violations, within_domain, flag_rule_check,
    logistic_squash, confusion_matrix, classifier_metrics, roc_auc, roc_curve, classifier_bundle,
    quality_gates, label_log, label_log_latest, classifier_checks, logistic_scores, forest_scores, feature_importance, classifier_eval,
    best_classifier, grid_search,
]}
