"""Trees and forests that do not depend on how the rows are laid out, grown to any depth.

* A row's weight in a tree is a Poisson(1) draw from a hash of the row's key and
  the tree's number, so a bootstrap sample is the same wherever the row lies.
* Split candidates are exact order statistics of a feature. Targets are counted
  in whole steps of 2^-20, so sums do not depend on their order and neither do
  ties: the smallest feature, then the smallest threshold wins.
* Rows between the same candidates of every feature are one cell: a split never
  parts them, so a tree is grown on their summed weights and targets. Draws do
  not depend on the target, so the trees of all targets share their cells.
* A node with more rows than a task holds is split by counts per candidate,
  added up over all rows; smaller ones are sent to one task each, which grows
  the rest of the subtree. Both give the same tree.

A grown model is a table of nodes: (fit, tree, node, depth, feature, threshold,
value, weight, gain); it is staged packed, as rows of bytes. Node 1 is the root and node n has the children 2n and
2n + 1; rows with a feature up to the threshold go to 2n. Every node has a
value, so a tree cut at a depth is the tree grown to that depth.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from ..functions.ordering import running_totals
from ..functions.scalar import ref
from ..session import stage

PRIME = 2147483647
STEP = 1 << 20
LARGEST = float(1 << 13)
DEEPEST = 60  # node numbers are 64 bits wide
LOCAL_ROWS = 1 << 18
COMPILED = 128
_ROWS_AT_A_TIME = 1 << 17
_CHUNK_ROWS = 1 << 17  # rows whose cells a task adds up before it sends them
_SLICE_ROWS = 1 << 14  # rows that are worth a task of their own when trees score them
_NODES_HELD = 1 << 21  # by a task that scores, 28 bytes each
_FEW_ROWS = 1 << 10  # so few that a sample may be without any
_LARGE_NODE = 1 << 9  # rows from which a node is split by counts per bin
_FIRST_ROWS = 1 << 5  # fewer than those of a node that is split by counts
_NODES_AT_A_TIME = 64
_NODES_A_CUT = 1 << 5  # up to so many, nodes are read for the thresholds they use
_CELLS_HELD = 1 << 13  # nodes times features that a task adds up before it sends them
NODES = ("fit int, tree int, node long, depth int, feature int, threshold double, value double, weight long, gain double")
_TREES = "fit int, tree int, count int, walk binary, grown binary"
_NODES_PACKED = 1 << 16  # in a row of bytes: 28 that a walk needs, 16 more, each
_CELLS = "unit int, feature int, bin int, w long, s long, n long, low long, high long"
# Poisson(1): a draw is the number of these that the hash reaches
_POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(j + 1))) for j in range(10)]


@dataclass(frozen=True)
class TreeParams:
    """How a model is grown; ``tried`` features that vary in a node are tried for its split (None: all)."""

    numTrees: int = 1
    maxDepth: int | None = None
    maxBins: int = 256
    bootstrap: bool = False
    tried: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class Fit:
    """A model of one target; rows of the fold ``without`` are left out (-1: none)."""

    model: str
    target: str
    column: str
    params: TreeParams
    without: int = -1


@dataclass
class TreeModel:
    """A fitted tree or forest: the rows of ``nodes``, packed trees, whose fit is ``number``.

    ``cuts`` are the split candidates of each feature it was grown on; a stored model does not know them.
    """

    nodes: DataFrame
    number: int
    features: list[str]
    params: TreeParams
    rules: list | None = field(default=None, repr=False)
    cuts: list[np.ndarray] | None = field(default=None, repr=False, compare=False)

    def table(self) -> DataFrame:
        return unpacked_nodes(self.nodes.where(F.col("fit") == self.number))

    def predict(self) -> Column | None:
        """The prediction as one expression, for a single tree of few nodes; NULL features give NULL."""
        if self.rules is None:
            return None
        nodes = {r["node"]: r for r in self.rules}

        def branch(n: int) -> Column:
            r = nodes[n]
            if r["feature"] < 0:
                return F.lit(r["value"])
            x = ref(self.features[r["feature"]]).cast("double")
            low, high = branch(2 * n), branch(2 * n + 1)
            return F.when(x <= F.lit(r["threshold"]), low).when(x > F.lit(r["threshold"]), high)

        return branch(1)

    def importance(self) -> list[tuple[str, float]]:
        """(feature, share of the trees' decrease in impurity), smallest first; one row per tree and feature comes back."""
        rows = self.table().where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect()
        per_tree: dict[int, dict[int, float]] = {}
        for r in rows:
            per_tree.setdefault(r["tree"], {})[r["feature"]] = r["gain"]
        total = dict.fromkeys(range(len(self.features)), 0.0)
        for gains in per_tree.values():
            whole = sum(gains.values())
            for f, g in gains.items():
                total[f] += g / whole / len(per_tree)
        return sorted(((self.features[f], v) for f, v in total.items()), key=lambda item: (item[1], item[0]))

    def described(self) -> str:
        return json.dumps({"features": self.features, **asdict(self.params)})


def hashed(n, t, seed):
    """Numbers below ``PRIME`` that look random; whole-number arithmetic of 64 bits that any engine has."""
    h = (n * 48271 + t * 69621 + seed) % PRIME
    h = (h * h + n) % PRIME
    h = (h * h + t * 40692 + 11) % PRIME
    return (h * h + 1) % PRIME


def key_number(df: DataFrame, key: Sequence[str]) -> Column:
    """A row's number for its draws: from whole-number keys themselves, from others by a hash."""
    total = F.lit(0).cast("long")
    for k in key:
        whole = isinstance(df.schema[k].dataType, IntegralType)
        value = ref(k).cast("long") if whole else F.xxhash64(ref(k))
        total = (total * 1000003 + F.pmod(value, F.lit(PRIME))) % PRIME
    return total


def draws(number: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in a tree."""
    return np.searchsorted(_POISSON, hashed(number, np.int64(tree), np.int64(seed)), side="right").astype(np.int64)


# --- growing --------------------------------------------------------------------------

def candidates(rows: DataFrame, features: Sequence[str], most: int, local_rows: int = LOCAL_ROWS) -> list[np.ndarray]:
    """Up to ``most`` split candidates a feature: the values at ranks floor(i * n / most), all values where n is smaller.

    A feature of a table that fits a task is ranked by one; of a larger table, values are counted and ranked in range slices.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), ref(f).cast("double").alias("value")) for i, f in enumerate(features)]))
    cells = rows.select(cells.alias("c")).select("c.*")
    total = rows.count()
    if total <= local_rows:
        chosen = cells.groupBy("feature").applyInArrow(lambda t: _at_ranks(t, most), "feature int, value double")
    else:
        counts = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        run = running_totals(counts, ["feature"], ["value"], ["n"])
        reached = lambda c: F.ceil(c * F.lit(most) / F.lit(total))
        chosen = run.where(reached(F.col("n_running")) > reached(F.col("n_running") - F.col("n")))
    found: list[list[float]] = [[] for _ in features]
    for r in chosen.select("feature", "value").collect():  # at most ``most`` rows a feature
        found[r["feature"]].append(r["value"])
    return [np.sort(np.array(v, np.float64)) for v in found]


def _at_ranks(cells: pa.Table, most: int) -> pa.Table:
    values = np.sort(cells["value"].to_numpy())
    chosen = np.unique(values[np.arange(most) * len(values) // most])
    return pa.table({"feature": pa.array(np.full(len(chosen), cells["feature"][0].as_py(), np.int32)), "value": pa.array(chosen)})


def grow(rows: DataFrame, key: Sequence[str], features: Sequence[str], fits: Sequence[Fit], fold: Column | None = None,
         local_rows: int = LOCAL_ROWS) -> list[TreeModel]:
    """One model for each of ``fits``, all grown together; the node table is staged.

    Rows that repeat a key share their draws. A missing feature or target is a
    ``ValueError``, as is a target beyond +-8192; candidates are those of all
    rows, whatever fold is left out.
    """
    features, fits = list(features), list(fits)
    columns = list(dict.fromkeys(f.column for f in fits))
    x = F.array(*[ref(f).cast("double") for f in features])
    y = F.array(*[F.floor(ref(c).cast("double") * STEP + 0.5).cast("long") for c in columns])
    ready = stage(rows.select(key_number(rows, key).alias("number"), x.alias("x"), y.alias("y"),
                              (F.lit(-2) if fold is None else fold).cast("int").alias("fold")), "tree-rows")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v)) | F.exists("y", lambda v: v.isNull())
    large = F.exists("y", lambda v: F.abs(v) > int(LARGEST * STEP))
    n, missing, beyond = ready.agg(F.count(F.lit(1)), F.count_if(bad), F.count_if(large)).first()
    if not n:
        raise ValueError("no rows to fit")
    if missing or beyond:
        raise ValueError("features or targets to fit on are missing; fill them first" if missing else
                         f"targets must lie within +-{LARGEST:g}")
    wide = ready.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(features))])
    cuts = {b: candidates(wide, wide.columns, b, local_rows) for b in {f.params.maxBins for f in fits}}
    trees = [(i, t) for i, f in enumerate(fits) for t in range(f.params.numTrees)]
    job = _Job(fits, columns, cuts, trees, n <= _FEW_ROWS)
    spark = rows.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    if n > local_rows:
        ready = _cells_together(ready, job, max(parallel, -(-n // _CHUNK_ROWS)))
    if n <= local_rows or _count_distinct(ready, job) <= local_rows:
        top, parts = None, ready.mapInArrow(partial(_cells_of_draws, job=job), _PARTS)
        units = {d: [(u, 1) for u in alike] for d, alike in enumerate(job.draws.values())}
    else:
        done, units, splits = _split_large(ready, job, local_rows)
        parts = ready.mapInArrow(partial(_route_to_units, job=job, splits=splits, units=units), _PARTS)
        top = packed_nodes(spark.createDataFrame(done, NODES))  # the nodes with more rows than a task holds
    groups = max(1, len(units))
    placed = parts.repartitionById(min(groups, max(8 * parallel, 1)), F.col("group")).sortWithinPartitions("group")
    nodes = placed.mapInArrow(partial(_grow_groups, job=job, units=units), _TREES)
    nodes = stage(nodes if top is None else nodes.union(top), "nodes")
    small = {f for f, p in enumerate(fits) if p.params.numTrees == 1}
    sizes = nodes.where(F.col("fit").isin(*small)).groupBy("fit").agg(F.sum("count").alias("n")).where(F.col("n") <= COMPILED) if small else None
    few = {r["fit"] for r in sizes.collect()} if small else set()
    rules: dict[int, list] = {f: [] for f in few}
    if few:
        for r in unpacked_nodes(nodes.where(F.col("fit").isin(*few))).collect():
            rules[r["fit"]].append(r)
    return [TreeModel(nodes, i, features, f.params, rules.get(i), cuts[f.params.maxBins]) for i, f in enumerate(fits)]


@dataclass
class _Job:
    """What every task of a growth knows: bounded by trees, features and candidates, not by rows."""

    fits: list[Fit]
    columns: list[str]
    cuts: Mapping[int, list[np.ndarray]]
    trees: list[tuple[int, int]]
    few: bool = False
    draws: dict[tuple, list[int]] = field(init=False)

    def __post_init__(self):
        """The units by their draws: those of one draw have the same weights and differ by target, fold left out or shape."""
        self.draws = {}
        for unit, (fit, tree) in enumerate(self.trees):
            p = self.fits[fit].params
            self.draws.setdefault((p.maxBins, p.bootstrap, *((p.seed, tree) if p.bootstrap else ())), []).append(unit)

    def arrays(self, rows: pa.RecordBatch | pa.Table):
        k = len(next(iter(self.cuts.values())))
        flat = lambda name, width: pa.concat_arrays(
            [c.flatten() for c in _chunks(rows[name])]).to_numpy(zero_copy_only=False).reshape(-1, width)
        x = flat("x", k)
        bins = {b: np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cut)], axis=1).astype(np.int32)
                for b, cut in self.cuts.items()}
        number = np.concatenate([c.to_numpy(zero_copy_only=False) for c in _chunks(rows["number"])])
        fold = np.concatenate([c.fill_null(-3).to_numpy() for c in _chunks(rows["fold"])])  # no fold: left out nowhere
        return number, bins, flat("y", len(self.columns)), fold

    def weights(self, draw: tuple, number: np.ndarray) -> np.ndarray:
        return draws(number, draw[3], draw[2]) if draw[1] else np.ones(len(number), np.int64)

    def of(self, unit: int):
        fit = self.fits[self.trees[unit][0]]
        return fit.params, self.columns.index(fit.column), self.trees[unit][1]


def _chunks(column) -> list:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def _held_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of some ``_CHUNK_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= _CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order; numbers of 16 bits are sorted by radix."""
    return np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")


def _alike(bins: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts rows of the same cell and fold side by side, and where each cell starts in it."""
    order = np.arange(len(fold))
    for column in (*bins.T, fold + 3):
        order = order[_order(column[order])]
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for column in (*bins.T, fold):
        differs |= np.diff(column[order]) != 0
    return order, np.flatnonzero(np.r_[True, differs]) if len(order) else np.zeros(0, np.int64)


@dataclass
class _Cells:
    """Rows added up by cell and fold: weight, and per target the weighted sum and the range, in steps; ``n`` counts rows."""

    bins: np.ndarray
    fold: np.ndarray
    n: np.ndarray
    w: np.ndarray
    s: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.bins, self.fold, self.n, self.w, self.s, self.low, self.high

    def take(self, rows: np.ndarray, target: int | None = None) -> "_Cells":
        values = (c[rows] if target is None else c[rows, target:target + 1] for c in (self.s, self.low, self.high))
        return _Cells(self.bins[rows], self.fold[rows], self.n[rows], self.w[rows], *values)

    def merged(self) -> "_Cells":
        if not len(self.w):
            return self
        order, starts = _alike(self.bins, self.fold)
        return self if len(starts) == len(order) else self.added(order, starts)

    def added(self, order: np.ndarray, starts: np.ndarray) -> "_Cells":
        """The rows in ``order``, those from one start to the next added up."""
        add = lambda f, c: f.reduceat(c[order], starts, axis=0)
        first = order[starts]
        return _Cells(self.bins[first], self.fold[first], add(np.add, self.n), add(np.add, self.w), add(np.add, self.s),
                      add(np.minimum, self.low), add(np.maximum, self.high))

    def packed(self, group: int) -> pa.RecordBatch:
        """One row of bytes; ranges and sums go as differences from the lowest target, zeros for a cell of one row."""
        parts = (self.bins.astype(np.int32), self.fold.astype(np.int32), self.n, self.w, self.low, self.high - self.low,
                 self.s - self.w[:, None] * self.low)
        data = b"".join(np.ascontiguousarray(c).tobytes() for c in parts)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([len(self.w)], pa.int32()),
                                           pa.array([self.bins.shape[1]], pa.int32()), pa.array([data], pa.binary())],
                                          names=["group", "cells", "features", "data"])

    @staticmethod
    def unpacked(m: int, k: int, data: bytes) -> "_Cells":
        at, found = 0, []
        targets = (len(data) - m * (4 * k + 4 + 16)) // (24 * m)
        for width, kind in ((k, np.int32), (1, np.int32), (1, np.int64), (1, np.int64), *[(targets, np.int64)] * 3):
            found.append(np.frombuffer(data, kind, m * width, at).reshape(m, width))
            at += found[-1].nbytes
        bins, fold, n, w, low, spread, off = found
        w = w[:, 0]
        return _Cells(bins, fold[:, 0], n[:, 0], w, off + w[:, None] * low, low, low + spread)

    @staticmethod
    def together(parts: Sequence["_Cells"]) -> "_Cells":
        return parts[0] if len(parts) == 1 else _Cells(*map(np.concatenate, zip(*(p.columns() for p in parts))))


_PARTS = "group int, cells int, features int, data binary"


def _drawn_cells(batches: Iterator[pa.RecordBatch], job: _Job) -> Iterator[tuple[tuple, _Cells]]:
    """For every draw, the cells of some rows with a weight in it."""
    for rows in _held_rows(batches):
        number, bins, y, fold = job.arrays(rows)
        sorted_by: dict[int, tuple] = {}
        for draw in job.draws:
            w = job.weights(draw, number)
            if job.few:  # rows without a weight stay: a sample without any takes them all
                yield draw, _Cells(bins[draw[0]], fold, np.ones_like(w), w, w[:, None] * y, y, y)
                continue
            if draw[0] not in sorted_by:
                order, starts = _alike(bins[draw[0]], fold)
                cell = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
                sorted_by[draw[0]] = order, cell, bins[draw[0]][order], y[order], fold[order]
            order, cell, b, v, f = sorted_by[draw[0]]
            w = w[order]
            used = np.flatnonzero(w)
            if not len(used):
                continue
            w, v, c = w[used], v[used], cell[used]
            starts = np.flatnonzero(np.r_[True, np.diff(c) != 0])
            first = used[starts]
            add = lambda how, values: how.reduceat(values, starts, axis=0)
            yield draw, _Cells(b[first], f[first], np.diff(np.r_[starts, len(c)]), add(np.add, w), add(np.add, w[:, None] * v),
                               add(np.minimum, v), add(np.maximum, v))


def _cells_of_draws(batches: Iterator[pa.RecordBatch], job: _Job) -> Iterator[pa.RecordBatch]:
    place = {draw: i for i, draw in enumerate(job.draws)}
    for draw, cells in _drawn_cells(batches, job):
        yield cells.packed(place[draw])


def _distinct_cells(batches: Iterator[pa.RecordBatch], job: _Job) -> Iterator[pa.RecordBatch]:
    for rows in _held_rows(batches):
        bins = job.arrays(rows)[1]
        for most, b in bins.items():
            order, starts = _alike(b, np.zeros(len(b), np.int32))
            key = np.ascontiguousarray(b[order[starts]].astype(np.int32))
            kept = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * key.shape[1]), len(key), [None, pa.py_buffer(key.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), most, np.int32)), kept.cast(pa.binary())], names=["most", "cell"])


def _cells_together(ready: DataFrame, job: _Job, parts: int) -> DataFrame:
    """The rows staged by cell, so that what tasks add up and send is as much as there are cells, whatever the rows.

    A cell of very many rows is dealt to several parts.
    """
    fields = ", ".join(f"{name} {kind}" for name, kind in ready.dtypes)
    known = ready.mapInArrow(partial(_with_cell, job=job), f"{fields}, cell binary")
    return stage(known.repartitionByRange(parts, "cell", "number").sortWithinPartitions("cell").drop("cell"), "rows-by-cell")


def _with_cell(batches: Iterator[pa.RecordBatch], job: _Job) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if rows.num_rows:
            bins = job.arrays(rows)[1]
            finest = np.ascontiguousarray(bins[max(bins)])
            cell = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * finest.shape[1]), len(finest), [None, pa.py_buffer(finest.tobytes())])
            yield pa.RecordBatch.from_arrays([*rows.columns, cell.cast(pa.binary())], names=[*rows.schema.names, "cell"])


def _count_distinct(ready: DataFrame, job: _Job) -> int:
    """How many cells the rows are in: what a tree is grown on by a task that grows it whole. Folds do not count: what a task
    is sent stands there once for each fold, but a tree's cells are added up over its folds before it is grown.
    """
    cells = ready.mapInArrow(partial(_distinct_cells, job=job), "most int, cell binary").distinct()
    return max(r["count"] for r in cells.groupBy("most").count().collect())


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Cells]]:
    """The cells of each group, from batches sorted by it; they are added up as they come."""
    held, size, now = [], 0, None
    most = 2 * LOCAL_ROWS
    for batch in batches:
        for i in range(batch.num_rows):
            group, m, k = (batch.column(c)[i].as_py() for c in range(3))
            if held and group != now:
                yield now, _Cells.together(held)
                held, size, most = [], 0, 2 * LOCAL_ROWS
            now = group
            held.append(_Cells.unpacked(m, k, batch.column(3)[i].as_buffer().to_pybytes()))
            size += m
            if size > most:
                held = [_Cells.together(held).merged()]
                size = len(held[0].w)
                most = 2 * max(size, LOCAL_ROWS)
    if held:
        yield now, _Cells.together(held)


def _grow_groups(batches: Iterator[pa.RecordBatch], job: _Job, units: Mapping[int, list]) -> Iterator[pa.RecordBatch]:
    """All trees of a group, several at a time: level by level their nodes are handled as if they were one tree's.

    The cells without a fold are held while its trees are grown, not those without every fold at once. All are taken from
    the same order, in which a cell's folds lie side by side.
    """
    for group, cells in _by_group(batches):
        order, starts = _alike(cells.bins, np.zeros_like(cells.fold))
        cells, cell = cells.take(order), np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        shapes = list(dict.fromkeys(job.of(unit)[0] for unit, _ in units[group]))
        kinds = {unit: (job.fits[job.trees[unit][0]].without, shapes.index(job.of(unit)[0])) for unit, _ in units[group]}
        part, size, now, sample = [], 0, None, None
        for unit, root in sorted(units[group], key=lambda u: kinds[u[0]]):
            if now is None or kinds[unit][0] != now:
                now = kinds[unit][0]
                sample = _sample(cells, cell, now, job.few)
            if part and (size + len(sample.w) > _ROWS_AT_A_TIME or kinds[unit][1] != kinds[part[-1][0]][1]):
                yield from _grow_together(part, job)
                part, size = [], 0
            part.append((unit, root, sample))
            size += len(sample.w)
        yield from _grow_together(part, job)


def _sample(cells: _Cells, cell: np.ndarray, without: int, few: bool) -> _Cells:
    """The cells with a weight, the fold ``without`` left out and the others added up; ``cell`` numbers them in order."""
    kept = cells.fold != without
    if few and not cells.w[kept].any():  # no draw in a handful of rows: the sample is the rows themselves
        cells = replace(cells, w=cells.n, s=cells.low)
    rows = np.flatnonzero(kept & (cells.w > 0))
    starts = _starts(cell.take(rows))
    return cells.take(rows) if len(starts) == len(rows) else cells.added(rows, starts)


def _grow_together(part: Sequence[tuple[int, int, _Cells]], job: _Job) -> Iterator[pa.RecordBatch]:
    """Trees of one shape, (unit, root, cells) each."""
    used = [c for _, _, c in part]
    target = [min(job.of(unit)[1], c.s.shape[1] - 1) for unit, _, c in part]
    s, low, high = (np.concatenate([getattr(c, name)[:, t] for c, t in zip(used, target)]) for name in ("s", "low", "high"))
    which, *grown = _subtrees(np.concatenate([c.bins for c in used]), s, low, high, np.concatenate([c.w for c in used]),
                              np.repeat(np.arange(len(part)), [len(c.w) for c in used]), np.array([root for _, root, _ in part], np.int64),
                              np.array([job.of(unit)[2] for unit, _, _ in part], np.int64), job.of(part[0][0])[0])
    for j, (unit, _, _) in enumerate(part):
        mine = np.flatnonzero(which == j)
        mine = mine[np.argsort(grown[0][mine], kind="stable")]
        yield from _packed_trees(*job.trees[unit], *_node_columns(job, unit, *(c[mine] for c in grown)))


def _node_columns(job: _Job, unit: int, node, feature, bin_, s, w, gain) -> tuple[np.ndarray, ...]:
    """(node, threshold, value, feature, weight, gain) of some nodes; a leaf's threshold is 0."""
    threshold = np.zeros(len(node))
    for f, cut in enumerate(job.cuts[job.fits[job.trees[unit][0]].params.maxBins]):
        mine = feature == f
        threshold[mine] = cut[bin_[mine]]
    value = np.divide(s, w * float(STEP), out=np.zeros(len(s)), where=w > 0)
    return node, threshold, value, feature.astype(np.int32), w.astype(np.int64), gain / float(STEP) ** 2


def _packed_trees(fit: int, tree: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of a tree as rows of bytes: what a walk reads (node, threshold, value, feature) and the rest (weight, gain)."""
    for lo in range(0, len(columns[0]), _NODES_PACKED):
        data = [np.ascontiguousarray(c[lo:lo + _NODES_PACKED]).tobytes() for c in columns]
        count = min(len(columns[0]) - lo, _NODES_PACKED)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([v], pa.int32()) for v in (fit, tree, count)), *(pa.array([b"".join(d)], pa.binary()) for d in (data[:4], data[4:]))],
            names=[c.split()[0] for c in _TREES.split(", ")])


def packed_nodes(nodes: DataFrame) -> DataFrame:
    """Rows of nodes as packed trees."""
    return nodes.select(*[c.split()[0] for c in NODES.split(", ")]).mapInArrow(_pack_nodes, _TREES)


def unpacked_nodes(packed: DataFrame) -> DataFrame:
    """Packed trees as rows, a node each."""
    return packed.mapInArrow(_unpack_nodes, NODES)


def _pack_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes in batches:
        fit, tree, node, feature, value, weight, gain = (
            nodes.column(c).to_numpy() for c in ("fit", "tree", "node", "feature", "value", "weight", "gain"))
        threshold = nodes.column("threshold").fill_null(0.0).to_numpy()
        for i in _runs(tree, fit):
            yield from _packed_trees(int(fit[i[0]]), int(tree[i[0]]),
                                     *(c[i] for c in (node, threshold, value, feature.astype(np.int32), weight, gain)))


def _walk_columns(count: int, data) -> list[np.ndarray]:
    return [np.frombuffer(data, kind, count, 8 * count * i) for i, kind in enumerate((np.int64, np.float64, np.float64, np.int32))]


def _unpack_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            fit, tree, count = (batch.column(c)[i].as_py() for c in ("fit", "tree", "count"))
            node, threshold, value, feature = _walk_columns(count, batch.column("walk")[i].as_buffer())
            weight, gain = (np.frombuffer(batch.column("grown")[i].as_buffer(), kind, count, 8 * count * j)
                            for j, kind in enumerate((np.int64, np.float64)))
            depth, rest = np.zeros(count, np.int32), node
            for bits in (32, 16, 8, 4, 2, 1):
                long = rest >= 1 << bits
                depth[long] += bits
                rest = np.where(long, rest >> bits, rest)
            columns = [np.full(count, fit, np.int32), np.full(count, tree, np.int32), node, depth, feature]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(threshold, mask=feature < 0), *map(pa.array, (value, weight, gain))],
                names=[c.split()[0] for c in NODES.split(", ")])


def _allowed(vary: np.ndarray, node: np.ndarray, tree: np.ndarray, params: TreeParams) -> np.ndarray:
    """Which features each node may split on: those that vary in it, or some of them chosen by a hash of tree, node and feature."""
    if params.tried is None or params.tried >= vary.shape[1]:
        return vary
    order = np.stack([hashed(node % PRIME, tree * 64 + f, np.int64(params.seed)) for f in range(vary.shape[1])], axis=1)
    order = np.where(vary, order, PRIME)
    rank = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
    return vary & (rank < params.tried)


def _subtrees(bins: np.ndarray, wy: np.ndarray, lowest: np.ndarray, highest: np.ndarray, w: np.ndarray, at: np.ndarray,
              roots: np.ndarray, trees: np.ndarray, params: TreeParams):
    """All nodes below ``roots``, level by level: (root's place, node, feature, bin, sum, weight, gain); feature -1 marks a leaf.

    A row is a cell with its sum, range and weight. ``at`` is the place of its root; a cell that several trees use stands
    there once for each. Nodes of many rows are split first, by ``_large_nodes``. A level looks at the rows of open nodes
    only, and by a feature only at those of nodes in which it varies: where it does not, it does not below either. Rows in a
    feature's most frequent bin (filled scores are many) are not looked at by it: their sums are what the others leave of the
    node's.
    """
    k, n = bins.shape[1], len(w)
    across = np.ascontiguousarray(bins.T)
    live = [f for f in range(k) if n and across[f].min() < across[f].max()]
    n_bins = int(across.max()) + 1 if n else 1
    of, out = np.arange(len(roots)), []  # of: the place in ``roots`` of what the levels start from
    most = max(_LARGE_NODE, len(live) * n_bins // 4)
    if live and n > most:
        out, of, roots, at = _large_nodes(across, live, n_bins, most, wy, lowest, highest, w, at, roots, trees, params)
        trees = trees[of]
    flat, deepest, code = across.ravel(), _deepest(params), np.empty(n, np.uint8)
    ids, place = roots, np.arange(len(roots))
    rows = np.flatnonzero(at >= 0)
    rows = rows.take(_order(at.take(rows)))
    sizes = np.bincount(at.take(rows), minlength=len(ids))
    all_w, all_s = (_sums_of_runs(v.take(rows), sizes) for v in (w, wy))
    usual, held = np.zeros(k, np.int64), None
    while True:
        m = len(ids)
        total_w, total_s = all_w.astype(np.float64), all_s.astype(np.float64)
        feature, bin_, gain = np.full(m, -1), np.full(m, -1), np.zeros(m)
        out.append((of[place], ids, feature, bin_, total_s, total_w, gain))
        # roots need not be of one depth
        open_ = (total_w >= 2) & (sizes > 1) & (ids >> deepest == 0)
        some = np.repeat(open_, sizes)
        if some.any():
            starts, few = np.cumsum(sizes[open_]) - sizes[open_], rows[some]
            open_[open_] = np.minimum.reduceat(lowest.take(few), starts) < np.maximum.reduceat(highest.take(few), starts)
        opened = np.flatnonzero(open_)
        if not (len(opened) and live):
            break
        if len(opened) < m:
            rows = rows[np.repeat(open_, sizes)]
        sizes = sizes[opened]
        # what is held of rows by feature: row, bin, weight, sum and group; a group is the rows of a node by one feature
        if held is None:
            node = np.repeat(np.arange(len(opened)), sizes)
            for f in live:
                usual[f] = np.bincount(across[f].take(rows)).argmax()
            parts = [_with_usual(rows, int(usual[f]), across[f], node, w, wy) for f in live]
            held = [np.concatenate(c) for c in zip(*parts)]
            new = np.concatenate([np.diff(p[4], prepend=-1) != 0 for p in parts])
            group_f, group_n = np.repeat(live, [len(p[4]) for p in parts])[new], held[4][new]
            held[4] = np.cumsum(new, dtype=np.int32) - 1
        else:
            code[rows] = np.repeat((opened >= m // 2).astype(np.uint8), sizes)
            side = code.take(held[0])
            if not vary.all():
                side[~vary.take(held[4])] = 2
            left = np.flatnonzero(side == 0)
            parted = np.concatenate([left, np.flatnonzero(side == 1)])
            held = [c.take(parted) for c in held]
            new = np.empty(len(held[4]), bool)
            new[:1], new[1:] = True, held[4][1:] != held[4][:-1]
            new[len(left):len(left) + 1] = True
            first = np.flatnonzero(new)
            was = held[4].take(first)
            number = np.full(m, -1)
            number[opened] = np.arange(len(opened))
            group_f, group_n = group_f.take(was), number.take(group_n.take(was) + np.where(first < len(left), 0, m // 2))
            held[4] = np.cumsum(new, dtype=np.int32) - 1
        w_of, s_of, w_all, s_all = total_w[opened], total_s[opened], all_w[opened], all_s[opened]
        best, where = np.full((len(opened), k), -np.inf), np.zeros((len(opened), k), np.int64)
        left_w, left_s = np.zeros((len(opened), k), np.int64), np.zeros((len(opened), k), np.int64)
        at_best = group_n, group_f
        best[at_best], where[at_best], left_w[at_best], left_s[at_best] = found = _best_of_groups(
            held, usual.take(group_f), w_all.take(group_n), s_all.take(group_n))
        vary = np.isfinite(found[0])
        best = np.where(_allowed(np.isfinite(best), ids[opened], trees[place[opened]], params), best, -np.inf)
        choice = best.argmax(axis=1)
        score = best[np.arange(len(opened)), choice]
        before = s_of * s_of / w_of
        split = np.flatnonzero(score > before)
        by, cut, parts = choice[split], where[split, choice[split]], opened[split]
        feature[parts], bin_[parts], gain[parts] = by, cut, (score - before)[split]
        lw, ls = left_w[split, by], left_s[split, by]
        code[rows] = 2
        if len(split) < len(opened):
            going = np.zeros(len(opened), bool)
            going[split] = True
            rows, sizes = rows[np.repeat(going, sizes)], sizes[split]
        right = flat.take(np.repeat(by * n, sizes) + rows) > np.repeat(cut.astype(across.dtype), sizes)
        on_right = _sums_of_runs(right, sizes)
        rows = np.concatenate([rows[~right], rows[right]])
        sizes, place = np.r_[sizes - on_right, on_right], np.r_[place[parts], place[parts]]
        ids = np.r_[2 * ids[parts], 2 * ids[parts] + 1]
        all_w, all_s = np.r_[lw, w_all[split] - lw], np.r_[ls, s_all[split] - ls]
        number = np.full(len(opened), -1)
        number[split] = np.arange(len(split))
        group_n = number.take(group_n)
        if not len(ids):
            break
    return tuple(np.concatenate(c) for c in zip(*out))


def _sums_of_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values that lie side by side, so many each."""
    found, some = np.zeros(len(sizes), np.int64), sizes > 0
    if some.any():
        found[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], dtype=np.int64)
    return found


def _with_usual(rows: np.ndarray, usual: int, across: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray) -> list[np.ndarray]:
    """[row, bin, weight, sum, node] by node and bin, with the rows in a feature's bin ``usual`` left out."""
    b = across.take(rows)
    some = np.flatnonzero(b != usual)
    some = some.take(_order(b.take(some)))
    some = some.take(_order(node.take(some)))
    held = rows.take(some)
    return [held, b.take(some), w.take(held), wy.take(held), node.take(some)]


def _best_of_groups(held: Sequence[np.ndarray], usual: np.ndarray, all_w: np.ndarray, all_s: np.ndarray) -> tuple[np.ndarray, ...]:
    """(score, bin, weight, sum) of the left side of each group's best split; -inf where the feature does not vary in the node.

    Rows of the group's node that are not in the group are in the bin ``usual``.
    """
    _, b, w, s, group = held
    m = len(usual)
    if not m:
        return np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3))
    ends = np.flatnonzero(np.r_[(b[1:] != b[:-1]) | (group[1:] != group[:-1]), True])
    of, b = group.take(ends), b.take(ends)
    last = np.flatnonzero(np.r_[of[1:] != of[:-1], True])
    first = np.r_[0, last[:-1] + 1]
    above = b > usual.take(of)
    rest_w, rest_s = all_w.copy(), all_s.copy()
    n_below = last + 1 - first - np.add.reduceat(above, first, dtype=np.int64)
    lowest, sums = n_below == 0, []
    for whole, rest, values in ((all_w, rest_w, w), (all_s, rest_s, s)):
        so_far = np.cumsum(values).take(ends)
        before = np.r_[0, so_far.take(last[:-1])]
        rest -= so_far.take(last) - before
        left = so_far - np.concatenate([before, before - rest]).take(of + m * above)
        # of the split after the usual bin: what is below it and the rows in it
        middle = np.where(lowest, 0, left.take(first + np.maximum(n_below, 1) - 1)) + rest
        sums.append((left, middle, whole))
    (lw, mw, _), (ls, ms, _) = sums

    def scores(wl, sl, whole_w, whole_s):
        wl, sl = wl.astype(np.float64), sl.astype(np.float64)
        wr, sr = whole_w - wl, whole_s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            found = sl * sl / wl + sr * sr / wr
        found[wr == 0] = -np.inf
        return found

    whole_w, whole_s = all_w.astype(np.float64), all_s.astype(np.float64)
    score = scores(lw, ls, whole_w.take(of), whole_s.take(of))
    top = np.maximum.reduceat(score, first)
    tops = np.flatnonzero(score == top.take(of))
    tops = tops[_starts(of.take(tops))]  # the smallest bin
    where, lw, ls = b.take(tops).astype(np.int64), lw.take(tops), ls.take(tops)
    between = scores(mw, ms, whole_w, whole_s)
    between[rest_w == 0] = -np.inf
    better = (between > top) | ((between == top) & (usual < where))
    return tuple(np.where(better, new, old) for new, old in ((between, top), (usual, where), (mw, lw), (ms, ls)))


def _deepest(params: TreeParams) -> int:
    return DEEPEST if params.maxDepth is None else min(params.maxDepth, DEEPEST)


def _large_nodes(across: np.ndarray, live: Sequence[int], n_bins: int, most: int, wy: np.ndarray, lowest: np.ndarray,
                 highest: np.ndarray, w: np.ndarray, at: np.ndarray, roots: np.ndarray, trees: np.ndarray, params: TreeParams):
    """The nodes with more than ``most`` rows, and where the rest starts: (nodes, place in ``roots`` and number of each of its
    roots, the place among these of each row, -1 where it is done).

    Weights and sums of a node are held by feature and bin. Of two children only the one with fewer rows is counted: the
    other has what is left of their parent's, so a node that loses few rows at a time (many trees do) costs few.
    """
    k, n = across.shape
    flat, deepest = across.ravel(), _deepest(params)
    counted = [across[f].astype(np.int64) for f in live]
    exact = np.abs(wy).sum(dtype=np.float64) < 1 << 52  # sums of doubles are; else upper and lower bits are added apart
    parts_of = [[v.astype(np.float64)] if exact else [v >> 26, v & (1 << 26) - 1] for v in (w, wy)]

    def counts(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Weights and sums of nodes whose rows lie one after the other: (2, node, live feature, bin)."""
        m = len(sizes)
        found = np.empty((2, m, len(live), n_bins), np.int64)
        first, values = np.repeat(np.arange(m) * n_bins, sizes), [[v.take(rows) for v in p] for p in parts_of]
        for j, b in enumerate(counted):
            cell = b.take(rows) + first
            for total, p in zip(found, values):
                added = [np.bincount(cell, v, m * n_bins).astype(np.int64).reshape(m, n_bins) for v in p]
                total[:, j] = added[0] if exact else (added[0] << 26) + added[1]
        return found

    rest, of, numbers, given = np.full(n, -1, np.int64), [], [], 0
    place, ids, sizes, rows = np.arange(len(roots)), roots, np.bincount(at, minlength=len(roots)), _order(at)
    parent = fewer = None
    out = []
    while True:
        large = sizes > most
        small, in_large = np.flatnonzero(~large), np.repeat(large, sizes)
        rest[rows[~in_large]] = np.repeat(given + np.arange(len(small)), sizes[small])
        given += len(small)
        of.append(place[small])
        numbers.append(ids[small])
        if not large.any():
            return out, np.concatenate(of), np.concatenate(numbers), rest
        if parent is None:
            held = counts(rows[in_large], sizes[large])
        else:  # the first half are left children, the second the right ones of the same parents
            half = len(sizes) // 2
            wanted = large[:half] | large[half:]
            is_fewer = np.r_[fewer, ~fewer] & np.r_[wanted, wanted]
            slot = np.cumsum(wanted) - 1
            by_side = np.flatnonzero(is_fewer)  # left ones first: put back in the parents' order
            lesser = counts(rows[np.repeat(is_fewer, sizes)], sizes[by_side])
            lesser = lesser[:, np.argsort(by_side % half)]
            kept = np.flatnonzero(large)
            held = lesser[:, slot[kept % half]]
            more = ~is_fewer[kept]
            held[:, more] = parent[:, kept[more] % half] - held[:, more]
        rows, place, ids, sizes = rows[in_large], place[large], ids[large], sizes[large]
        m, starts = len(ids), np.cumsum(sizes) - sizes
        all_w, all_s = held[:, :, 0].sum(axis=2)
        total_w, total_s = all_w.astype(np.float64), all_s.astype(np.float64)
        feature, bin_, gain = np.full(m, -1), np.full(m, -1), np.zeros(m)
        out.append((place, ids, feature, bin_, total_s, total_w, gain))
        some = rows.take(starts[:, None] + np.arange(_FIRST_ROWS))  # most nodes differ in their first rows already
        differs = lowest.take(some).min(axis=1) < highest.take(some).max(axis=1)
        for i in np.flatnonzero(~differs):
            mine = rows[starts[i]:starts[i] + sizes[i]]
            differs[i] = lowest.take(mine).min() < highest.take(mine).max()
        opened = np.flatnonzero((total_w >= 2) & (ids >> deepest == 0) & differs)
        best, where = np.full((len(opened), k), -np.inf), np.zeros((len(opened), k), np.int64)
        for lo in range(0, len(opened), _NODES_AT_A_TIME):
            part = opened[lo:lo + _NODES_AT_A_TIME]
            best[lo:lo + len(part), live], where[lo:lo + len(part), live] = _best_bins(held[:, part], total_w[part], total_s[part])
        best = np.where(_allowed(np.isfinite(best), ids[opened], trees[place[opened]], params), best, -np.inf)
        choice = best.argmax(axis=1)
        score = best[np.arange(len(opened)), choice]
        before = total_s[opened] * total_s[opened] / total_w[opened]
        split = np.flatnonzero(score > before)
        by, cut, parts = choice[split], where[split, choice[split]], opened[split]
        feature[parts], bin_[parts], gain[parts] = by, cut, (score - before)[split]
        stays = np.zeros(m, bool)
        stays[parts] = True
        if len(parts) < m:
            rows = rows[np.repeat(stays, sizes)]
        parent, sizes, place, ids = held[:, parts], sizes[parts], place[parts], ids[parts]
        right = flat.take(np.repeat(by * n, sizes) + rows) > np.repeat(cut.astype(across.dtype), sizes)
        on_right = _sums_of_runs(right, sizes)
        fewer = sizes - on_right <= on_right  # the left child
        rows = np.concatenate([rows[~right], rows[right]])
        sizes, place, ids = np.r_[sizes - on_right, on_right], np.r_[place, place], np.r_[2 * ids, 2 * ids + 1]


def _best_bins(held: np.ndarray, total_w: np.ndarray, total_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each node by each feature, -inf where it does not vary, and the last bin of its left side."""
    wl, sl = held.cumsum(axis=3).astype(np.float64)
    wr, sr = total_w[:, None, None] - wl, total_s[:, None, None] - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sl * sl / wl + sr * sr / wr
    score[(held[0] == 0) | (wr == 0)] = -np.inf
    return score.max(axis=2), score.argmax(axis=2)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


# nodes with more rows than a task holds

def _walk(bins: np.ndarray, splits: Mapping[int, tuple[int, int]]) -> np.ndarray:
    """The node each row reaches by the splits found so far."""
    at = np.ones(len(bins), np.int64)
    if not splits:
        return at
    nodes = np.array(sorted(splits), np.int64)
    rule = np.array([splits[int(x)] for x in nodes], np.int64)
    while True:
        i = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
        rows = np.flatnonzero(nodes[i] == at)
        if not len(rows):
            return at
        f, b = rule[i[rows]].T
        at[rows] = 2 * at[rows] + (bins[rows, f] > b)


def _rows_of(at: np.ndarray, nodes: Sequence[int]) -> Iterator[np.ndarray]:
    """Places of the rows that are at each of ``nodes``."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    for lo, hi in zip(np.searchsorted(sorted_at, nodes, "left"), np.searchsorted(sorted_at, nodes, "right")):
        yield order[lo:hi]


def _nodes_by_draw(job: _Job, nodes: Mapping) -> dict[tuple, dict[int, list]]:
    """draw -> unit -> [(node, number)] of ``nodes``: (unit, node) -> number."""
    by_unit: dict[int, list] = {}
    for (unit, node), number in nodes.items():
        by_unit.setdefault(unit, []).append((node, number))
    return {draw: {u: sorted(by_unit[u]) for u in alike if u in by_unit} for draw, alike in job.draws.items()}


def _count_cells(batches: Iterator[pa.RecordBatch], job: _Job, splits, open_: Mapping[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """Weight, sum, rows and range of the target for every candidate of the open nodes, added up in the task first."""
    by_draw = _nodes_by_draw(job, open_)
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    top = np.iinfo(np.int64).max
    for draw, cells in _drawn_cells(batches, job):
        for unit, wanted in by_draw[draw].items():
            params, column, _ = job.of(unit)
            at = np.where((cells.fold != job.fits[job.trees[unit][0]].without) & (cells.w > 0), _walk(cells.bins, splits[unit]), 0)
            for (_, place), rows in zip(wanted, _rows_of(at, [node for node, _ in wanted])):
                if not len(rows):
                    continue
                mine = cells.take(rows, column)
                for f, cut in enumerate(job.cuts[params.maxBins]):
                    m = len(cut) + 1
                    if (place, f) not in held:
                        held[place, f] = [np.zeros(m, np.int64) for _ in range(3)] + [np.full(m, top), np.full(m, -top)]
                    cell = mine.bins[:, f]
                    sums = held[place, f]
                    for total, add in zip(sums, (mine.w, mine.s[:, 0], mine.n)):
                        total += np.bincount(cell, add, m).astype(np.int64)
                    np.minimum.at(sums[3], cell, mine.low[:, 0])
                    np.maximum.at(sums[4], cell, mine.high[:, 0])
            if len(held) > _CELLS_HELD:
                yield _cell_rows(held)
                held = {}
    if held:
        yield _cell_rows(held)


def _cell_rows(held: Mapping[tuple[int, int], list[np.ndarray]]) -> pa.RecordBatch:
    parts = []
    for (place, f), sums in held.items():
        used = np.flatnonzero(sums[2])
        parts.append([np.full(len(used), place, np.int32), np.full(len(used), f, np.int32), used.astype(np.int32), *(c[used] for c in sums)])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=[c.split()[0] for c in _CELLS.split(", ")])


def _split_large(ready: DataFrame, job: _Job, local_rows: int):
    """(nodes done, units left to a task each, splits of each tree): levels of the nodes with more than ``local_rows`` rows."""
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in job.trees]
    open_ = {(unit, 1): unit for unit in range(len(job.trees))}
    done, units = [], {}
    while open_:
        cells = ready.mapInArrow(partial(_count_cells, job=job, splits=splits, open_=open_), _CELLS)
        cells = cells.groupBy("unit", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w", "s", "n")],
                                                            F.min("low").alias("low"), F.max("high").alias("high"))
        where = {number: pair for pair, number in open_.items()}
        chosen = cells.groupBy("unit").applyInArrow(
            _chooser(job, where), "unit int, feature int, bin int, s double, w double, gain double, "
            "lw long, ln long, rw long, rn long").collect()  # a row for every open node
        found = {where[r["unit"]]: r for r in chosen}
        following = []
        for unit, node in open_:
            r = found.get((unit, node))
            if r is None:  # no row has a weight here
                r = {"feature": -1, "bin": -1, "s": 0.0, "w": 0.0, "gain": 0.0}
            row = _node_columns(job, unit, np.array([node]), *(np.array([r[c]]) for c in ("feature", "bin", "s", "w", "gain")))
            _, threshold, value, feature, weight, gain = (c[0].item() for c in row)
            done.append((*job.trees[unit], node, node.bit_length() - 1, feature, threshold if feature >= 0 else None, value, weight, gain))
            if r["feature"] >= 0:
                splits[unit][node] = (r["feature"], r["bin"])
                for child, rows in ((2 * node, r["ln"]), (2 * node + 1, r["rn"])):
                    if rows > local_rows:
                        following.append((unit, child))
                    else:
                        units[len(units)] = [(unit, child)]
        open_ = {pair: i for i, pair in enumerate(following)}
    return done, units, splits


def _chooser(job: _Job, where: Mapping[int, tuple[int, int]]):
    return lambda cells: _choose(cells, job, where)


def _choose(cells: pa.Table, job: _Job, where: Mapping[int, tuple[int, int]]) -> pa.Table:
    """The best split of an open node from its counts, by the rules of ``_subtrees``."""
    place = cells["unit"][0].as_py()
    unit, node = where[place]
    params, _, tree = job.of(unit)
    feature, bin_, w, s, n, low, high = (cells[c].to_numpy() for c in ("feature", "bin", "w", "s", "n", "low", "high"))
    first = feature == feature.min()
    total_w, total_s, rows = float(w[first].sum()), float(s[first].sum()), int(n[first].sum())
    k = len(job.cuts[params.maxBins])
    best, at, left = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros((k, 2), np.int64)
    deepest = DEEPEST if params.maxDepth is None else min(params.maxDepth, DEEPEST)
    if total_w >= 2 and low.min() < high.max() and node.bit_length() - 1 < deepest:
        for f in range(k):
            o = np.flatnonzero(feature == f)
            o = o[np.argsort(bin_[o])]
            if len(o) > 1:
                wl, sl = np.cumsum(w[o])[:-1].astype(np.float64), np.cumsum(s[o])[:-1].astype(np.float64)
                wr, sr = total_w - wl, total_s - sl
                score = sl * sl / wl + sr * sr / wr
                i = int(score.argmax())
                best[f], at[f], left[f] = score[i], bin_[o][i], (int(w[o][:i + 1].sum()), int(n[o][:i + 1].sum()))
    vary = np.isfinite(best)[None, :]
    best = np.where(_allowed(vary, np.array([node]), np.array([tree]), params)[0], best, -np.inf)
    f = int(best.argmax())
    parent = total_s * total_s / total_w
    split = best[f] > parent
    lw, ln = left[f]
    row = (place, f if split else -1, int(at[f]) if split else -1, total_s, total_w, best[f] - parent if split else 0.0,
           int(lw), int(ln), int(total_w) - int(lw), rows - int(ln))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), *[pa.int64()] * 4)
    names = ("unit", "feature", "bin", "s", "w", "gain", "lw", "ln", "rw", "rn")
    return pa.table({c: pa.array([v], t) for c, v, t in zip(names, row, types)})


def _route_to_units(batches: Iterator[pa.RecordBatch], job: _Job, splits, units: Mapping[int, list]) -> Iterator[pa.RecordBatch]:
    """The cells of every subtree, with its own target only."""
    by_draw = _nodes_by_draw(job, {pair: group for group, [pair] in units.items()})
    for draw, cells in _drawn_cells(batches, job):
        for unit, wanted in by_draw[draw].items():
            at = _walk(cells.bins, splits[unit])
            at = np.where((cells.fold != job.fits[job.trees[unit][0]].without) & (cells.w > 0), at, 0)
            for (_, group), rows in zip(wanted, _rows_of(at, [node for node, _ in wanted])):
                if len(rows):
                    yield cells.take(rows, job.of(unit)[1]).packed(group)


# --- scoring --------------------------------------------------------------------------

def score(rows: DataFrame, models: Sequence[TreeModel], fold: str | None = None, without: Sequence[int] | None = None,
          depths: Sequence[int] = (), sizes: Sequence[int] = ()) -> DataFrame:
    """(_row, place, depth, size, n, total): each row's trees and the sum of their values, for each of ``models`` by its place.

    ``rows`` has a unique ``_row``. With ``fold``, a model scores the rows of the
    fold it was fitted ``without`` and no others. ``depths`` cuts the trees and
    ``sizes`` takes the first trees only: one row of sums for every
    combination; without them depth and size are -1.
    """
    sums = _partial_sums(rows, models, fold, without, depths, sizes)
    return sums.groupBy("_row", "place", "depth", "size").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def score_spread(rows: DataFrame, models: Sequence[TreeModel]) -> DataFrame:
    """(_row, place, mean, deviation): over the trees of each of ``models``; squares are taken from the mean, not from 0."""
    mean = F.sum("total").alias("total"), F.sum("n").alias("n")
    parts = _partial_sums(rows, models).groupBy("_row", "place").agg(
        *mean, F.collect_list(F.struct("n", "total", "squares")).alias("parts"))  # one entry a group of trees
    at = F.col("total") / F.col("n")
    around = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["squares"] + p["n"] * (p["total"] / p["n"] - at)
                         * (p["total"] / p["n"] - at))
    return parts.select("_row", "place", at.alias("mean"), F.sqrt(around / F.col("n")).alias("deviation"))


def _partial_sums(rows: DataFrame, models: Sequence[TreeModel], fold: str | None = None, without: Sequence[int] | None = None,
                  depths: Sequence[int] = (), sizes: Sequence[int] = ()) -> DataFrame:
    """What ``score`` adds up, by group of trees.

    Trees are dealt to groups by their nodes, model by model, and rows to slices: a task reads a slice past a group's nodes,
    so no model is held whole and none is broadcast. With folds, a row meets only the groups with trees without its fold.
    """
    spark = rows.sparkSession
    features = models[0].features
    if any(m.features != features for m in models):
        raise ValueError("models of different features cannot be scored together")
    tables: dict[int, tuple[DataFrame, list[tuple[int, int]]]] = {}
    for place, m in enumerate(models):
        tables.setdefault(id(m.nodes), (m.nodes, []))[1].append((m.number, place))
    n_nodes = sum(nodes.where(F.col("fit").isin(*[n for n, _ in used])).agg(F.sum("count")).first()[0] for nodes, used in tables.values())
    tasks, n_rows = 4 * spark.sparkContext.defaultParallelism, rows.count()
    most_slices = 1 + n_rows // _SLICE_ROWS
    groups = max(-(-n_nodes // _NODES_HELD), -(-tasks // most_slices))
    dealt_to = max(1, min(-(-groups // len(models)), max(m.params.numTrees for m in models)))  # groups of a model's trees
    groups = min(groups, len(models)) if dealt_to == 1 else dealt_to * len(models)
    slices = min(most_slices, max(1, tasks // groups, -(-n_rows // (16 * _SLICE_ROWS))))
    group = (F.col("place") * dealt_to + F.pmod("tree", F.lit(dealt_to))) % groups
    parts = None
    for nodes, used in tables.values():
        place = F.coalesce(*[F.when(F.col("fit") == number, F.lit(p)) for number, p in used])
        part = nodes.where(F.col("fit").isin(*[number for number, _ in used])).select(
            F.lit(0).alias("side"), place.alias("place"), "tree", F.lit(-2).alias("fold"), "count", F.col("walk").alias("data"))
        parts = part if parts is None else parts.union(part)
    parts = parts.withColumn("group", group).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = F.sequence(F.lit(0), F.lit(groups - 1))
    if fold is not None:
        by_fold: dict[int, set[int]] = {}
        for place, f in enumerate(without):
            by_fold.setdefault(f, set()).update((place * dealt_to + t) % groups for t in range(dealt_to))
        met = F.coalesce(*[F.when(F.col("fold") == f, F.array(*[F.lit(g) for g in sorted(found)])) for f, found in by_fold.items()])
    asked = rows.select(
        F.pmod(F.hash("_row"), F.lit(slices)).alias("slice"), (F.lit(-2) if fold is None else F.coalesce(ref(fold).cast("int"), F.lit(-3))).alias("fold"),
        "_row", F.array(*[ref(f).cast("double") for f in features]).alias("x")).mapInArrow(_pack_rows, _PACKED + ", slice int")
    asked = asked.withColumn("group", F.explode(met))
    columns = [(F.col("group") * slices + F.col("slice")).cast("int").alias("group"), *[c.split()[0] for c in _PACKED.split(", ")]]
    dealt = parts.select(*columns).union(asked.select(*columns))
    dealt = dealt.repartitionById(groups * slices, F.col("group")).sortWithinPartitions("group", "side")
    return dealt.mapInArrow(
        partial(_score_groups, k=len(features), without=None if fold is None else list(without), depths=list(depths), sizes=list(sizes)),
        "_row long, place int, depth int, size int, n long, total double, squares double")


_PACKED = "side int, place int, tree int, fold int, count int, data binary"


def _packed(side: int, place: int, tree: int, fold: int, columns: Sequence[np.ndarray], **more: int) -> pa.RecordBatch:
    """One row of bytes for nodes of a tree (side 0) or rows of a fold (side 1)."""
    data = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    ints = {"side": side, "place": place, "tree": tree, "fold": fold, "count": len(columns[0])}
    cells = {c: pa.array([v], pa.int32()) for c, v in ints.items()} | {"data": pa.array([data], pa.binary())}
    return pa.RecordBatch.from_pydict(cells | {c: pa.array([v], pa.int32()) for c, v in more.items()})


def _runs(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows of each different key."""
    if not len(keys[0]):
        return iter(())
    order = np.arange(len(keys[0])) if all((key == key[0]).all() for key in keys) else np.lexsort(keys)
    differs = np.zeros(len(order) - 1, bool)
    for key in keys:
        differs |= np.diff(key[order]) != 0
    return iter(np.split(order, np.flatnonzero(differs) + 1))


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if not rows.num_rows:
            continue
        number, fold, slice_ = (rows.column(c).to_numpy() for c in ("_row", "fold", "slice"))
        x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(number), -1)
        for i in _runs(fold, slice_):
            yield _packed(1, -1, -1, int(fold[i[0]]), [number[i], x[i]], slice=int(slice_[i[0]]))


def _score_groups(batches: Iterator[pa.RecordBatch], k: int, without, depths: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The sums of every group's rows over its trees; rows of a fold come in many small parts and walk together."""
    now, held, trees, waiting = None, {}, [], {}

    def scored(fold: int) -> Iterator[pa.RecordBatch]:
        number, x = (np.concatenate(c) for c in zip(*waiting.pop(fold)))
        return _score_rows(number, fold, x, trees, without, depths, sizes)

    for batch in batches:
        ints = batch.select(["group", "side", "place", "tree", "fold", "count"]).to_pydict()
        for i, (group, side, place, tree, fold, count) in enumerate(zip(*ints.values())):
            if group != now:
                for f in list(waiting):
                    yield from scored(f)
                now, held, trees = group, {}, []
            data = batch.column("data")[i].as_buffer()
            if side == 0:
                held.setdefault((place, tree), []).append((count, data.to_pybytes()))
                continue
            if held:
                trees, held = [(*key, *_arrays_of_tree(held[key])) for key in sorted(held)], {}
            if trees:
                part = np.frombuffer(data, np.int64, count), np.frombuffer(data, np.float64, count * k, 8 * count)
                waiting.setdefault(fold, []).append(part)
                if sum(len(number) for number, _ in waiting[fold]) >= _SLICE_ROWS:
                    yield from scored(fold)
    for f in list(waiting):
        yield from scored(f)


def _arrays_of_tree(parts: Sequence[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """(feature, threshold, left child, value) of a tree's nodes; children lie next to each other, a leaf leads to itself.

    Sorted by number, all nodes but the root are the children of the others, pair by pair in their parents' order.
    """
    node, threshold, value, feature = (np.concatenate(c) for c in zip(*(_walk_columns(n, data) for n, data in parts)))
    if (node[1:] < node[:-1]).any():
        order = np.argsort(node)
        threshold, value, feature = threshold[order], value[order], feature[order]
    leaf = feature < 0
    return (np.maximum(feature, 0).astype(np.int64), np.where(leaf, np.inf, threshold),
            np.where(leaf, np.arange(len(node)), 2 * np.cumsum(~leaf) - 1), value)


def _leaves(x: np.ndarray, first: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row, whose features lie in ``x`` from ``first`` on; rows that are done leave every few levels."""
    found = np.zeros(len(first), np.int64)
    going, at = np.arange(len(first)), np.zeros(len(first), np.int64)
    while len(going):
        for _ in range(4):
            at = left.take(at) + (x.take(first + feature.take(at)) > threshold.take(at))
        open_ = left.take(at) != at
        found[going[~open_]] = at[~open_]
        going, at, first = going[open_], at[open_], first[open_]
    return found


def _score_rows(number: np.ndarray, fold: int, x: np.ndarray, trees, without, depths: list[int],
                sizes: list[int]) -> Iterator[pa.RecordBatch]:
    first = np.arange(len(number)) * (len(x) // len(number))
    sums: dict[tuple[int, int, int], list[np.ndarray]] = {}
    for place, tree, feature, threshold, left, value in trees:
        if without is not None and fold != without[place]:
            continue

        def add(depth: int, v: np.ndarray):
            for size in sizes or [-1]:
                if size < 0 or tree < size:
                    n, total, squares = sums.setdefault((place, depth, size), [np.zeros(len(number)) for _ in range(3)])
                    off = v - total / np.maximum(n, 1.0)
                    squares += off * off * (n / (n + 1))
                    n += 1
                    total += v

        if not depths:
            add(-1, value[_leaves(x, first, feature, threshold, left)])
            continue
        at = np.zeros(len(first), np.int64)
        for level in range(max(depths) + 1):
            if level in depths:
                add(level, value[at])
            at = left.take(at) + (x.take(first + feature.take(at)) > threshold.take(at))
    for (place, depth, size), (n, total, squares) in sums.items():
        fixed = [np.full(len(number), v, np.int32) for v in (place, depth, size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), *map(pa.array, fixed), pa.array(n.astype(np.int64)), pa.array(total), pa.array(squares)],
            names=["_row", "place", "depth", "size", "n", "total", "squares"])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` staged with a unique ``_row``, so that scores can be joined back."""
    return stage(df.withColumn("_row", F.monotonically_increasing_id()), "scored-rows")


def distinct_rows(rows: DataFrame, features: Sequence[str], fold: str | None = None,
                  models: Sequence[TreeModel] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with different features or fold, under the ``_row`` of one of them; ``rows`` with that number as ``_like``).

    Trees score equal rows alike, so they read the first table; ``rows`` has a unique ``_row``. Given the ``models`` that
    are to score them, rows between the same thresholds count as equal too: they come as the thresholds above them.
    Joins with either are merged: what compresses to a small file is no small table to hold in every task.
    """
    names = [f"_x{i}" for i in range(len(features))]
    values = [ref(f).cast("double") for f in features]
    if models:
        values = [_threshold_above(v, cut) for v, cut in zip(values, _thresholds(models, len(features)))]
    shaped = rows.withColumns({n: F.coalesce(v, F.lit(math.nan)) for n, v in zip(names, values)})
    shaped = shaped.withColumn("_f", F.lit(-2) if fold is None else F.coalesce(ref(fold).cast("int"), F.lit(-3)))
    if models:
        shaped = stage(shaped, "shaped-rows")
    keys = stage(shaped.groupBy(*names, "_f").agg(F.min("_row").alias("_like")), "distinct-rows")
    one = keys.select(F.col("_like").alias("_row"), *[F.col(n).alias(f) for n, f in zip(names, features)],
                      *([] if fold is None else [F.col("_f").alias(fold)]))
    return one, shaped.join(keys.hint("merge"), [*names, "_f"]).drop(*names, "_f")


def _thresholds(models: Sequence[TreeModel], k: int) -> list[np.ndarray]:
    """The thresholds of each feature in any of the models, sorted: split candidates, so their number does not grow with the rows.

    The candidates themselves stand for them where the models may have many more nodes, which are not read for this then.
    """
    known = list({id(m.cuts): m.cuts for m in models}.values())
    if all(known):
        cuts = [np.unique(np.concatenate(c)) for c in zip(*known)]
        if sum(m.params.numTrees << min(_deepest(m.params), 30) for m in models) > _NODES_A_CUT * sum(map(len, cuts)):
            return cuts
    tables: dict[int, tuple[DataFrame, set[int]]] = {}
    for m in models:
        tables.setdefault(id(m.nodes), (m.nodes, set()))[1].add(m.number)
    parts = [nodes.where(F.col("fit").isin(*used)).select("count", "walk").mapInArrow(_used_cuts, "feature int, threshold double")
             for nodes, used in tables.values()]
    found: list[list[float]] = [[] for _ in range(k)]
    for r in reduce(DataFrame.union, parts).distinct().collect():
        found[r["feature"]].append(r["threshold"])
    return [np.sort(np.array(v, np.float64)) for v in found]


def _used_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different thresholds of each feature in some packed trees."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for count, data in zip(batch.column("count").to_pylist(), batch.column("walk")):
            _, threshold, _, feature = _walk_columns(count, data.as_buffer())
            for f in np.flatnonzero(np.bincount(feature[feature >= 0])):
                found[f] = np.unique(np.concatenate([found.get(f, threshold[:0]), threshold[feature == f]]))
    for f, cuts in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), f, np.int32)), pa.array(cuts)], names=["feature", "threshold"])


def _threshold_above(value: Column, cut: np.ndarray) -> Column:
    """The smallest threshold that is not below ``value``, infinity above all; a tree sends both the same way."""
    ends = np.append(cut, np.inf)

    @F.arrow_udf("double")
    def above(v: pa.Array) -> pa.Array:
        x = v.to_numpy(zero_copy_only=False)
        return pa.array(np.where(np.isnan(x), np.nan, ends[np.searchsorted(cut, x)]))

    return above(value)


def with_params(params: TreeParams, changes: Mapping | None) -> TreeParams:
    unknown = set(changes or {}) - set(asdict(params))
    if unknown:
        raise ValueError(f"unknown tree parameters: {sorted(unknown)}")
    return replace(params, **(changes or {}))
