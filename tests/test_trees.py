"""Trees and forests against a plain recursive builder, under any layout, and cut, stored and searched."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.functions.ordering import fold_starts
from scorespark.operators import regression, tables, trees
from scorespark.operators.trees import Fit, TreeParams
from scorespark.session import scratch_path
from scorespark.sources import models as store

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    out = []
    for i in range(400):
        a, b = rng.randrange(40) / 4, rng.gauss(0, 1)
        out.append((i, a, b, 1.0, 3 * a + (10 if b > 0.3 else 0) + rng.gauss(0, 2), int(a + b > 6)))
    return out


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, z int").persist()


def table(model):
    return sorted((r.tree, r.node, r.feature, r.threshold, r.value, r.weight, r.gain) for r in
                  model.table().na.fill({"threshold": 0.0}).collect())


def plain_tree(x, y, w, cuts, depth, tried=None, tree=0, node=1):
    """{node: (feature, threshold or 0, value, weight)} by the rules, one node at a time in exact whole numbers."""
    steps = [int(np.floor(v * trees.STEP + 0.5)) for v in y]
    sw, ss = int(sum(w)), sum(int(a) * b for a, b in zip(w, steps))
    out = {node: (-1, 0.0, ss / (sw * trees.STEP), sw)}
    if sw < 2 or len(set(steps)) == 1 or depth == 0:
        return out
    found, vary = [], []
    for f in range(len(x[0])):
        seen = sorted({min(c for c in [*cuts[f], float("inf")] if c >= r[f]) for r in x})[:-1]
        if seen:
            vary.append(f)
        for t in seen:
            left = [i for i in range(len(x)) if x[i][f] <= t]
            lw, ls = float(sum(w[i] for i in left)), float(sum(int(w[i]) * steps[i] for i in left))
            found.append((-(ls * ls / lw + (ss - ls) * (ss - ls) / (sw - lw)), f, t))
    if tried is not None:
        order = sorted(vary, key=lambda f: trees.hashed(node % trees.PRIME, tree * 64 + f, 42))[:tried]
        found = [c for c in found if c[1] in order]
    if not found or -min(found)[0] <= float(ss) * ss / sw:
        return out
    _, f, t = min(found)
    out[node] = (f, t, ss / (sw * trees.STEP), sw)
    for child, side in ((2 * node, [i for i in range(len(x)) if x[i][f] <= t]), (2 * node + 1, [i for i in range(len(x)) if x[i][f] > t])):
        out |= plain_tree([x[i] for i in side], [y[i] for i in side], [w[i] for i in side], cuts, depth - 1, tried, tree, child)
    return out


@pytest.mark.parametrize("column, params", [
    ("y", TreeParams(maxDepth=4, maxBins=32)), ("y", TreeParams(numTrees=2, bootstrap=True, maxBins=16)),
    ("z", TreeParams(numTrees=2, bootstrap=True, maxBins=64, tried=1))])
def test_grown_equals_a_plain_builder(rows, data, column, params):
    model = trees.grow(rows, ["id"], FEATS, [Fit("m", "t", column, params)])[0]
    x = [[r[1], r[2], r[3]] for r in data]
    y = [float(r[4] if column == "y" else r[5]) for r in data]
    cuts = []
    for f in range(3):
        v = sorted(r[f] for r in x)
        cuts.append(sorted({v[i * len(v) // params.maxBins] for i in range(params.maxBins)}))
    got = {}
    for r in model.table().collect():
        got.setdefault(r.tree, {})[r.node] = (r.feature, r.threshold or 0.0, r.value, r.weight)
    for t in range(params.numTrees):
        w = trees.draws(np.arange(len(x)), t, 42) if params.bootstrap else np.ones(len(x), int)
        kept = [i for i in range(len(x)) if w[i]]
        want = plain_tree([x[i] for i in kept], [y[i] for i in kept], [int(w[i]) for i in kept], cuts,
                          99 if params.maxDepth is None else params.maxDepth, params.tried, t)
        assert got[t] == want
    if params.maxDepth is None and column == "y":
        assert max(n for nodes in got.values() for n in nodes).bit_length() - 1 > 8  # no cap on the depth


def test_equal_forests_under_any_layout_and_task_size(rows):
    fits = [Fit("m", "y", "y", TreeParams(numTrees=5, bootstrap=True, maxBins=32)),
            Fit("m", "z", "z", TreeParams(numTrees=4, bootstrap=True, tried=1, maxBins=32, maxDepth=7)),
            Fit("m", "z", "z", TreeParams(numTrees=2), without=1)]
    fold = (F.col("id") % 3).cast("int")
    grown = [trees.grow(rows.repartition(n), ["id"], FEATS, fits, fold, local)
             for n, local in ((2, trees.LOCAL_ROWS), (200, trees.LOCAL_ROWS), (7, 60))]
    for i in range(3):
        first = table(grown[0][i])
        assert first == table(grown[1][i]) == table(grown[2][i])  # the last split nodes of over 60 rows by counts
        assert {r[0] for r in first} == set(range(fits[i].params.numTrees))


def test_draws_are_poisson():
    w = np.stack([trees.draws(np.arange(20000), t, 42) for t in range(20)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w) - np.eye(20)).max() < 0.04
    assert np.abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.02
    assert (trees.draws(np.arange(20000), 0, 7) != w[0]).any()


def test_candidates_are_order_statistics(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v, 5.0) for v in values], "x double, y double").repartition(4)
    v = sorted(values)
    for most in (16, 1000):
        for local in (10, 500):  # ranked in range slices, and by one task
            cuts = trees.candidates(df, ["x", "y"], most, local)
            assert cuts[0].tolist() == sorted({v[i * 500 // most] for i in range(most)}) and cuts[1].tolist() == [5.0]


def test_scores_follow_the_nodes(rows, data):
    models = trees.grow(rows, ["id"], FEATS, [Fit("m", "y", "y", TreeParams(maxDepth=4)),
                                              Fit("m", "y", "y", TreeParams(numTrees=7, bootstrap=True))])
    assert models[0].predict() is not None and models[1].predict() is None
    asked = trees.numbered(rows)
    nodes = [{(r.tree, r.node): r for r in m.table().collect()} for m in models]

    def walk(place, tree, x, depth=99):
        n = 1
        while nodes[place][tree, n].feature >= 0 and depth:
            r = nodes[place][tree, n]
            n, depth = 2 * n + (x[r.feature] > r.threshold), depth - 1
        return nodes[place][tree, n].value

    got = {(r._row, r.place): r.total / r.n for r in trees.score(asked, models).collect()}
    known = {r._row: (r.a, r.b, r.c) for r in asked.collect()}
    for row, x in known.items():
        assert got[row, 0] == pytest.approx(walk(0, 0, x)) and got[row, 1] == pytest.approx(np.mean([walk(1, t, x) for t in range(7)]))
    cut = trees.score(asked, models[1:], depths=[0, 2, 40], sizes=[1, 7]).collect()
    assert len(cut) == len(known) * 6
    for r in cut:
        assert r.total == pytest.approx(sum(walk(1, t, known[r._row], r.depth) for t in range(r.size)))
    spread = {r._row: (r["mean"], r.deviation) for r in trees.score_spread(asked, models[1:]).collect()}
    for row, x in known.items():
        v = [walk(1, t, x) for t in range(7)]
        assert spread[row] == (pytest.approx(np.mean(v)), pytest.approx(np.std(v), abs=1e-9))
    compiled = {r.id: r.p for r in rows.select("id", models[0].predict().alias("p")).collect()}
    assert [compiled[d[0]] for d in data] == [walk(0, 0, d[1:4]) for d in data]


def test_shallow_cut_is_the_shallow_tree(rows):
    deep, shallow = trees.grow(rows, ["id"], FEATS, [Fit("m", "z", "z", TreeParams(numTrees=3, bootstrap=True, tried=2, maxDepth=d))
                                                     for d in (6, 2)])
    asked = trees.numbered(rows)
    cut = {r._row: r.total for r in trees.score(asked, [deep], depths=[2]).collect()}
    assert cut == pytest.approx({r._row: r.total for r in trees.score(asked, [shallow]).collect()})


def test_errors_and_tiny_tables(spark, rows):
    fit = [Fit("m", "y", "y", TreeParams())]
    with pytest.raises(ValueError, match="no rows"):
        trees.grow(rows.where("false"), ["id"], FEATS, fit)
    with pytest.raises(ValueError, match="missing"):
        trees.grow(rows.withColumn("b", F.expr("nullif(id, 3)")), ["id"], FEATS, fit)
    with pytest.raises(ValueError, match="8192"):
        trees.grow(rows.withColumn("y", F.lit(1e6)), ["id"], FEATS, fit)
    with pytest.raises(ValueError, match="unknown"):
        trees.with_params(TreeParams(), {"depth": 3})
    one = trees.grow(rows.limit(1), ["id"], FEATS, [Fit("m", "y", "y", TreeParams(numTrees=20, bootstrap=True))])[0]
    y = rows.limit(1).first().y
    assert {round(r.value, 4) for r in one.table().collect()} == {round(y, 4)}  # also where nothing was drawn
    assert [v for _, v in one.importance()] == [0.0] * 3


def test_keys_of_any_type(spark, rows):
    text = rows.withColumn("key", F.concat(F.lit("S"), "id"))
    fits = [Fit("m", "y", "y", TreeParams(numTrees=3, bootstrap=True, maxDepth=3))]
    a, b = (trees.grow(text.repartition(n), ["key", "id"], FEATS, fits)[0] for n in (1, 5))
    assert table(a) == table(b)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    out = []
    for i in range(60):
        m, c = rng.uniform(30, 95), rng.uniform(30, 95)
        out.append((i, 0, m, c, min(100.0, 5 + 0.6 * m + 0.3 * c + rng.gauss(0, 3)), 0.2 * m + 0.7 * c + rng.gauss(0, 4)))
    return spark.createDataFrame(out, "student_id long, year_encoded int, Math double, CS double, Math_next double, CS_next double").persist()


def test_best_parameters_are_stored_with_the_model(spark, pairs):
    subjects = ["Math", "CS"]
    grid = {"maxDepth": [1, 3, 6], "numTrees": [2, 8]}
    searched = regression.search_regressor(pairs, grid, "RandomForest", subjects, 3)
    rows = searched.collect()
    assert len(rows) == 12
    best = regression.best_parameters(searched)
    for s in subjects:
        low = min((r["mean"], r.maxDepth, r.numTrees) for r in rows if r.subject == s)
        assert best[s] == {"maxDepth": low[1], "numTrees": low[2]}
    # each cell is the cross-validation of a forest grown with these very parameters
    starts = fold_starts(pairs, "student_id", 3)
    direct = regression.cross_validate(pairs, starts, "RandomForest", subjects, {"maxDepth": 3, "numTrees": 8}).collect()
    cell = {r.subject: (r["mean"], r["std"]) for r in rows if (r.maxDepth, r.numTrees) == (3, 8)}
    assert {r.subject: (r["mean"], r["std"]) for r in direct} == {s: pytest.approx(v) for s, v in cell.items()}
    fitted = regression.train_with_best(pairs, searched)
    folder = scratch_path(spark, "searched")
    store.save_regressors(spark, fitted, folder)
    for s in subjects:
        loaded = store.load_regressor(spark, folder, "RandomForest", s)
        assert {"maxDepth": loaded.params.maxDepth, "numTrees": loaded.params.numTrees} == best[s]
        assert table(loaded) == table(fitted["RandomForest", s])
    with pytest.raises(ValueError, match="maxBins"):
        regression.search_regressor(pairs, {"maxBins": [2]})


def test_forest_over_all_pairs_of_years(spark):
    rng = random.Random(8)
    wide = spark.createDataFrame([(i, y, float(rng.randrange(100)), float(rng.randrange(100))) for i in range(30) for y in range(2020, 2024)],
                                 "student_id long, year int, Math double, CS double")
    pooled = tables.consecutive_pairs(wide, ["Math", "CS"])
    assert pooled.count() == 90
    fitted = regression.train_regressors(pooled, ["Math", "CS"], ["RandomForest"], {"RandomForest": {"numTrees": 4}}, ("student_id", "year"))
    again = regression.train_regressors(pooled.repartition(3), ["Math", "CS"], ["RandomForest"], {"RandomForest": {"numTrees": 4}},
                                        ("student_id", "year"))
    ahead = regression.predict_next(wide.where("year = 2023"), fitted, ["Math", "CS"])
    assert ahead.count() == 60 and ahead.where("predicted_mark between 0 and 100").count() == 60
    assert table(fitted["RandomForest", "CS"]) == table(again["RandomForest", "CS"])


def test_rows_between_the_same_candidates_are_grown_and_scored_once(spark, data):
    """Copies under other keys: a draw's cells, sent and added up, are as many as different rows, and so are the rows scored."""
    copies = spark.createDataFrame([(i + 1000 * c, *rest) for c in range(8) for i, *rest in data[:50]], "id long, a double, b double, c double, y double, z int")
    fits = [Fit("m", t, t, TreeParams(numTrees=3, bootstrap=True)) for t in ("y", "z")]
    whole = trees.grow(copies, ["id"], FEATS, fits, None, 60)  # 400 rows in 50 cells: no node is split by counts
    counted = trees.grow(copies, ["id"], FEATS, fits, None, 20)
    assert [table(m) for m in whole] == [table(m) for m in counted]
    keys, linked = trees.distinct_rows(trees.numbered(copies), FEATS)
    assert keys.count() == 50 and linked.count() == 400
    assert {(r["_row"], r["_like"]) for r in linked.select("_row", "_like").collect()} >= {(r["_row"],) * 2 for r in keys.collect()}
    batches = list(trees._cells_of_draws(iter([]), trees._Job([], [], {}, [])))
    job = trees._Job(fits, ["y", "z"], {256: [np.array([1.0, 2.0])]}, [(f, t) for f in range(2) for t in range(3)])
    assert batches == [] and len(job.draws) == 3  # both targets share the draws of a tree


def test_search_names_its_rows_as_it_likes(spark):
    from scorespark.operators import classify

    train = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(90)], "id long, u double, v double, label int")
    risk = classify.train_classifiers(train, ["u", "v"], models=["LogisticRegression"])
    found = classify.grid_search(train, risk, {"maxDepth": [2, 3], "numTrees": [2, 4]}).collect()
    assert {(r.maxDepth, r.numTrees) for r in found} == {(2, 2), (2, 4), (3, 2), (3, 4)} and all(r.roc_auc > 0.9 for r in found)


def test_rows_between_the_same_thresholds_are_scored_once(spark, rows, data):
    """No two rows are equal, but few differ for the trees; missing features stay apart, and so do folds."""
    fits = [Fit("m", t, t, TreeParams(numTrees=3, bootstrap=True, maxBins=4)) for t in ("y", "z")]
    near = rows.withColumn("b", F.col("b") + F.col("id") * 1e-9).withColumn("c", F.when(F.col("id") > 0, F.col("c") + F.col("id") * 1e-9))
    models = trees.grow(rows, ["id"], FEATS, fits)
    asked = trees.numbered(near.withColumn("f", F.col("id") % 2))
    for fold, folds in ((None, 1), ("f", 2)):
        keys, linked = trees.distinct_rows(asked, FEATS, fold, models)
        assert keys.count() <= folds * (5 * 5 + 1) and linked.count() == 400
    keys, linked = trees.distinct_rows(asked, FEATS, None, models)
    one_each = {(r["_row"], r["place"]): r["total"] for r in trees.score(keys, models).collect()}
    like = {r["_row"]: r["_like"] for r in linked.collect()}
    for r in trees.score(asked, models).collect():
        assert one_each[like[r["_row"]], r["place"]] == pytest.approx(r["total"])


def test_tasks_send_a_cell_once(spark, data):
    """Rows of a cell lie side by side before they are added up, so the cells sent do not grow with the rows."""
    fits = [Fit("m", "y", "y", TreeParams(numTrees=2, bootstrap=True))]
    job = trees._Job(fits, ["y"], {256: [np.array([1.0, 2.0]), np.array([0.5])]}, [(0, 0), (0, 1)])
    sent = []
    for copies in (40, 400):
        ready = spark.range(copies * 6).select(F.col("id").alias("number"), F.array(F.col("id") % 3 + 0.5, F.col("id") % 2 + 0.0).alias("x"),
                                               F.array(F.col("id") % 7).alias("y"), F.lit(-2).alias("fold")).repartition(8)
        by_cell = trees._cells_together(ready, job, 4)
        assert sorted(r.number for r in by_cell.collect()) == list(range(copies * 6))
        packed = by_cell.mapInArrow(trees.partial(trees._cells_of_draws, job=job), trees._PARTS)
        sent.append(packed.agg(F.sum("cells")).first()[0])
    assert max(sent) <= 2 * (6 + 3)  # six cells a draw, and one more where a part ends


def test_scores_are_not_held_whole_by_a_task(spark, pairs):
    """The rows of a search meet their scores in a merge: a table of scores that every task held would grow with the rows."""
    fold = (F.col("student_id") % 3).cast("int")
    scored = regression.out_of_fold(pairs, fold, 3, TreeParams(numTrees=2, bootstrap=True, maxDepth=3), ["Math", "CS"], ("student_id",), [1, 3], [1, 2])
    assert scored.count() == 60 * 2 * 4
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_trees_are_staged_packed(spark, rows):
    """A tree is a row of bytes, not a row a node, and comes back node by node, also from a stored model."""
    fits = [Fit("m", t, t, TreeParams(numTrees=5, bootstrap=True)) for t in ("y", "z")]
    models = trees.grow(rows, ["id"], FEATS, fits)
    assert models[0].nodes.count() == 10 and models[0].nodes.agg(F.sum("count")).first()[0] == sum(m.table().count() for m in models)
    counted = trees.grow(rows, ["id"], FEATS, fits, None, 60)
    assert [table(m) for m in models] == [table(m) for m in counted]
    again = trees.packed_nodes(models[1].table().repartition(3))
    assert sorted(map(tuple, trees.unpacked_nodes(again).collect())) == sorted(map(tuple, models[1].table().collect()))


def test_rows_in_the_most_frequent_bin_are_not_looked_at(spark, monkeypatch):
    """Filled scores put most rows into one bin: trees are those of a plain builder, from the other rows only."""
    rng = random.Random(9)
    data = [(i, *[rng.choice([1.0, 2.0, 4.0, 5.0]) if rng.random() < 0.2 else 3.0 for _ in range(3)], rng.gauss(0, 2)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y double")
    model = trees.grow(df, ["id"], FEATS, [Fit("m", "y", "y", TreeParams(maxDepth=6))])[0]
    x, y = [d[1:4] for d in data], [d[4] for d in data]
    cuts = [sorted({r[f] for r in x}) for f in range(3)]
    got = {r.node: (r.feature, r.threshold or 0.0, r.value, r.weight) for r in model.table().collect()}
    expected = plain_tree(x, y, [1] * 300, cuts, 6)
    assert got.keys() == expected.keys()
    assert all(got[n][:2] == expected[n][:2] and got[n][2] == pytest.approx(expected[n][2]) and got[n][3] == expected[n][3] for n in got)
    seen = []
    monkeypatch.setattr(trees, "_with_usual", lambda run, *rest, plain=trees._with_usual: seen.append(rest[0]) or plain(run, *rest))
    bins = np.array([[sorted(cuts[f]).index(r[f]) for f in range(3)] for r in x], np.int32)
    steps = np.array([int(v * trees.STEP) for v in y])
    trees._subtrees(bins, steps, steps, steps, np.ones(300, np.int64), np.zeros(300, np.int64), np.ones(1, np.int64),
                    np.zeros(1, np.int64), TreeParams(maxDepth=2))
    assert set(seen) == {2}  # bin 2 is the filled one, of every feature


def _nodes(bins, steps, at, roots, params):
    spread = steps % 5  # a cell's range
    place, *grown = trees._subtrees(bins, steps, steps - spread, steps + spread, 1 + np.abs(steps) % 3, at, roots,
                                    np.arange(len(roots)), params)
    return sorted(zip(place.tolist(), *(c.tolist() for c in grown)))


@pytest.mark.parametrize("scale", [1, 1 << 44])
def test_large_nodes_are_split_by_counts_like_small_ones(monkeypatch, scale):
    """Nodes split by counts per bin are those split row by row: several roots of any depth, limits, features tried, equal targets."""
    rng = np.random.default_rng(4)
    n = 3000
    bins = np.where(rng.random((n, 4)) < 0.5, 7, rng.integers(0, 40, (n, 4))).astype(np.int32)
    bins[:, 2] = 0
    steps = np.where(bins[:, 0] > 20, 3, rng.integers(-30, 30, n) + bins[:, 1]) * scale
    at, roots = rng.integers(0, 3, n), np.array([1, 6, 9])
    for params in (TreeParams(), TreeParams(maxDepth=4), TreeParams(tried=2, maxDepth=30)):
        found = []
        for large in (1 << 20, 64, 200):
            monkeypatch.setattr(trees, "_LARGE_NODE", large)
            found.append(_nodes(bins, steps, at, roots, params))
        assert found[0] == found[1] == found[2] and len(found[0]) > 30


def test_a_node_that_loses_few_rows_at_a_time_costs_few(monkeypatch):
    """Of two children the one with fewer rows is counted, so a chain of splits does not look at all rows level after level."""
    n, seen = 20000, []
    bins = np.minimum(np.arange(n) // 10, 60)[:, None].astype(np.int32)
    steps = (4 ** np.maximum(0, 15 - bins[:, 0])).astype(np.int64)  # ten rows leave at each level, the lowest bin
    count = np.bincount

    def counted(x, weights=None, minlength=0):
        seen.append(len(x) if weights is not None else 0)
        return count(x, weights, minlength)

    monkeypatch.setattr(trees.np, "bincount", counted)
    grown = trees._subtrees(bins, steps, steps, steps, np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(1, np.int64),
                            np.zeros(1, np.int64), TreeParams())
    assert max(int(i).bit_length() for i in grown[1]) > 10
    assert 2 * n <= sum(seen) < 3 * n  # weights and sums of the root and little more


def test_trees_of_the_folds_are_grown_with_the_others(pairs, monkeypatch):
    """An evaluation grows its trees in one run and finds what trees grown on their own find; other folds or rows are grown anew."""
    subjects, params = ["Math", "CS"], {"RandomForest": {"numTrees": 3}}
    runs, grow = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda *a, **k: runs.append(len(a[3])) or grow(*a, **k))
    rows = lambda *a: sorted(map(tuple, regression.evaluate_all_models(*a, params=params).collect()))
    together = regression.train_regressors(pairs, subjects, params=params, folds=3)
    found = rows(pairs, together, subjects, 3)
    assert runs == [2 * 2 * (1 + 3)] and len(found) == 6
    apart = regression.train_regressors(pairs, subjects, params=params)
    assert found == rows(pairs, apart, subjects, 3)
    del runs[:]
    assert rows(pairs, together, subjects, 4) == rows(pairs, apart, subjects, 4) and runs == [2 * 2 * 4] * 2
    fewer = pairs.where("student_id < 50")
    assert rows(fewer, together, subjects, 3) == rows(fewer, apart, subjects, 3) and runs == [2 * 2 * 4] * 2 + [2 * 2 * 3] * 2


def test_cells_of_several_folds_count_once(spark):
    """Trees are grown on cells added up over their folds, so rows in few cells are not split by counts for being in many folds."""
    job = trees._Job([Fit("m", "y", "y", TreeParams(), f) for f in range(5)], ["y"], {256: [np.array([1.0, 2.0]), np.array([0.5])]},
                     [(f, 0) for f in range(5)])
    ready = spark.range(600).select(F.col("id").alias("number"), F.array(F.col("id") % 3 + 0.5, F.col("id") % 2 + 0.0).alias("x"),
                                    F.array(F.col("id") % 7).alias("y"), (F.col("id") % 5).cast("int").alias("fold")).repartition(4)
    assert trees._count_distinct(ready, job) == 6


def test_thresholds_of_many_nodes_are_the_candidates(spark, rows):
    """Nodes of deep forests are not read to see where rows are parted: the candidates tell; shallow models use few of theirs."""
    cuts = [np.array([1.0, 2.0]), np.array([0.5]), np.array([])]
    forest = [trees.TreeModel(None, i, FEATS, TreeParams(numTrees=50), None, c) for i, c in
              enumerate((cuts, [np.array([2.0, 7.0]), *cuts[1:]]))]  # there are no nodes to read
    assert [c.tolist() for c in trees._thresholds(forest, 3)] == [[1.0, 2.0, 7.0], [0.5], []]
    stump = trees.grow(rows, ["id"], FEATS, [Fit("m", "y", "y", TreeParams(maxDepth=1))])
    assert [len(c) for c in stump[0].cuts] == [40, 256, 1]
    assert sorted(len(c) for c in trees._thresholds(stump, 3)) == [0, 0, 1]


def test_small_parts_of_rows_walk_together(monkeypatch):
    """Rows come in as many parts as batches, folds and slices; a tree is walked by the rows of a fold at once, not part by part."""
    nodes = [np.array(c, t) for c, t in (([1, 2, 3], np.int64), ([0.5, 0, 0], float), ([0, 1.0, 2.0], float), ([0, -1, -1], np.int32))]
    parts, n = [], 0
    for group in (0, 1):
        parts += [trees._packed(0, place, 0, -2, nodes, group=group) for place in (0, 1)]
        for i in range(30):
            x = np.array([i % 2, 5.0, 1 - i % 2, 5.0])
            parts.append(trees._packed(1, -1, -1, i % 3, [np.array([n, n + 1]), x], group=group))
            n += 2
    batches = [b.select(["group", *[c.split()[0] for c in trees._PACKED.split(", ")]]) for b in parts]
    calls, plain = [], trees._score_rows
    monkeypatch.setattr(trees, "_score_rows", lambda number, *rest: calls.append(len(number)) or plain(number, *rest))
    found = [r for b in trees._score_groups(iter(batches), 2, [0, 1], [], []) for r in b.to_pylist()]
    assert calls == [20] * 6
    assert sorted((r["_row"], r["place"], r["n"], r["total"]) for r in found) == sorted(
        (r, f, 1, 1.0 + (i % 2 if r % 2 == 0 else 1 - i % 2)) for r in range(120) for i in [r // 2 % 30] for f in [i % 3] if f < 2)


def test_children_are_found_in_any_order_of_nodes():
    node = np.array([1, 2, 3, 6, 7, 12, 13], np.int64)
    feature, threshold, value = np.array([0, -1, 1, 0, -1, -1, -1], np.int32), node / 2, node * 1.0
    for order in (np.arange(7), np.array([4, 0, 6, 2, 5, 1, 3])):
        parts = [(len(i), trees._packed(0, 0, 0, -2, [c[i] for c in (node, threshold, value, feature)])["data"][0].as_py())
                 for i in (order[:3], order[3:])]
        got = trees._arrays_of_tree(parts)
        assert got[2].tolist() == [1, 1, 3, 5, 4, 5, 6] and got[3].tolist() == value.tolist()
        assert got[0].tolist() == [0, 0, 1, 0, 0, 0, 0] and got[1].tolist() == [0.5, np.inf, 1.5, 3.0, np.inf, np.inf, np.inf]
