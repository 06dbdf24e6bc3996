import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.functions.ordering import exact_quantiles, fold_number, fold_starts, row_numbers, running_totals
from scorespark.operators.metrics import roc_auc, roc_curve


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(5)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 50, [0.0, 1e-12, 1e12, -4.0, 7.0],
    [random.Random(1).lognormvariate(0, 5) for _ in range(3000)],
    [float(random.Random(2).choice([1, 1, 1, 2, 9])) for _ in range(999)],
    [0.1] * 400 + [float(i) for i in range(600)],
])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantiles(spark, values, q):
    got = exact_quantiles(frame(spark, [*values, None]), ["v"], q)["v"]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantile_of_nothing(spark):
    assert exact_quantiles(frame(spark, [None, None]), ["v"]) == {"v": None}


def test_running_totals_across_slices(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, n long").repartition(6)
    for descending in (False, True):
        got = {(r.g, r.k): (r.n_running, r.n_ahead) for r in
               running_totals(df, ["g"], ["k"], ["n"], ["n"], descending).collect()}
        for g in "ab":
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending)
            total = 0
            for i, (_, k, n) in enumerate(mine):
                total += n
                assert got[g, k] == (total, mine[i + 1][2] if i + 1 < len(mine) else None)


def test_row_numbers_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    got = row_numbers(df, ["k"]).collect()
    assert sorted((r.k, r.id) for r in got) == [(k, k + 1) for k in range(1000)]


@pytest.mark.parametrize("n,k", [(17, 5), (15, 5), (4, 5), (101, 3)])
def test_folds_are_contiguous(spark, n, k):
    keys = spark.range(n).select(F.format_string("S%03d", "id").alias("key")).repartition(4)
    starts = fold_starts(keys, "key", k)
    sizes = keys.groupBy(fold_number(F.col("key"), starts).alias("f")).count().orderBy("f").collect()
    expected = [n // k + (1 if i < n % k else 0) for i in range(k)]
    assert [r["count"] for r in sizes] == [e for e in expected if e]


def scored(spark, n, seed, levels=11):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.3, rng.randrange(levels) / 10) for _ in range(n)]
    return [(int(y), s) for y, s in rows]


def test_auc_equals_pair_count(spark):
    rows = scored(spark, 300, 5)
    wins = sum((a > b) + (a == b) / 2 for ya, a in rows if ya for yb, b in rows if not yb)
    expected = wins / (sum(y for y, _ in rows) * sum(1 - y for y, _ in rows))
    df = spark.createDataFrame(rows, "label int, score double").repartition(7)
    assert roc_auc(df).first()[0] == pytest.approx(expected, abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert roc_auc(df).first()[0] is None


def reference_curve(rows):
    """Cumulative counts per distinct score; interior points with equal steps left out."""
    points = []
    tp = fp = 0
    for s in sorted({s for _, s in rows}, reverse=True):
        p = sum(1 for y, v in rows if v == s and y)
        n = sum(1 for y, v in rows if v == s and not y)
        tp, fp = tp + p, fp + n
        points.append((s, p, n, tp, fp))
    keep = [
        i for i in range(len(points))
        if i in (0, len(points) - 1) or points[i][1:3] != points[i + 1][1:3]
    ]
    return [(points[i][0], points[i][4] / fp, points[i][3] / tp) for i in keep]


@pytest.mark.parametrize("levels", [5, 400])
def test_roc_curve(spark, levels):
    rows = scored(spark, 500, 8, levels)
    df = spark.createDataFrame(rows, "label int, score double").repartition(7)
    got = sorted((tuple(r) for r in roc_curve(df).collect()), reverse=True)
    assert got[0] == (float("inf"), 0.0, 0.0)
    assert got[1:] == [pytest.approx(p) for p in reference_curve(rows)]
    assert got[-1][1:] == (1.0, 1.0)


def test_roc_by_group(spark):
    a, b = scored(spark, 200, 1), scored(spark, 200, 2)
    df = spark.createDataFrame([("a", *r) for r in a] + [("b", *r) for r in b], "model string, label int, score double")
    got = {r.model: r.roc_auc for r in roc_auc(df, ("model",)).collect()}
    for name, rows in (("a", a), ("b", b)):
        alone = roc_auc(spark.createDataFrame(rows, "label int, score double")).first()[0]
        assert got[name] == pytest.approx(alone)
    curve = roc_curve(df, ("model",)).where("model = 'a'").select("threshold", "fpr", "tpr").collect()
    assert len(curve) == len(reference_curve(a)) + 1
