"""Near-duplicate documents by MinHash with tensored banding and exact confirmation.

A table key of usual banding needs K hashes, and L tables need K * L of them.
Here two collections of ``m`` small hashes (each of ``half`` minima) are made,
and every pair (one of the first, one of the second) is a table: m * m tables
of 2 * half minima for 2 * m * half minhashes. Two sets of similarity s share
a table with probability (1 - (1 - s**half)**m)**2.

The structure also saves shuffling: a table key can only be shared if both of
its halves are, so the 2 * m halves of every document are counted first, and
keys are formed from shared halves alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, claim, components, mix64

_P = 0x9E3779B97F4A7C15 | 1
_BLOCK = 4096


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    A-Z are lower-cased; words are runs of other bytes than ASCII white space.
    Fewer than k words make one shingle; no word makes none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        h = h * np.uint64(_P) + w[i:i + n]
    return np.unique(mix64(h))


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, count, np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, count, np.uint64)


def halves(s: np.ndarray, m: int, half: int, seed: int) -> np.ndarray:
    """The 2 * m half keys of a set: each mixes ``half`` minima and its own number."""
    a, b = _family(2 * m * half, seed)
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(s), _BLOCK):  # bounded memory for very long texts
        np.minimum(low, (s[i:i + _BLOCK, None] * a + b).min(axis=0), out=low)
    low = low.reshape(2 * m, half)
    key = np.arange(1, 2 * m + 1, dtype=np.uint64)
    for j in range(half):
        key = mix64(key * np.uint64(_P) + low[:, j])
    return key


def _set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _sketch(batches: Iterator[pa.RecordBatch], k: int, m: int, half: int, seed: int) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    for batch in batches:
        ids, counts, sets, keys = [], [], [], []
        for i, text in zip(batch.column(0), batch.column(1)):
            s = shingles(text.as_py(), k)
            ids.append(i.as_py())
            counts.append(len(s))
            sets.append(_set_id(s) if len(s) else None)
            keys.append(halves(s, m, half, seed).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sets, pa.int64()),
             pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "cls", "halves"])


def _set_rows(batches: Iterator[pa.RecordBatch], k: int, text_at: int) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    for batch in batches:
        sets = (shingles(t.as_py(), k) for t in batch.column(text_at))
        ids = pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "_set_id"])


def with_set_ids(docs: DataFrame, text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with all its columns and ``_set_id``: equal for texts of equal shingles, null for texts without words."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "_set_id long"])
    return docs.mapInArrow(partial(_set_rows, k=k, text_at=docs.columns.index(text_col)), schema)


def _confirm_class(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Texts whose set is the class they were fetched for (an id may stand on several rows)."""
    claim(__name__)
    for batch in batches:
        same = [_set_id(shingles(t.as_py(), k)) == c.as_py() for c, t in zip(batch.column(0), batch.column(1))]
        yield batch.filter(pa.array(same))


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= percent * union of their full sets, and what b has that a has not."""
    claim(__name__)
    last, left = None, None
    for batch in batches:
        linked, extra = [], []
        for a, text_a, text_b in zip(*(batch.column(i) for i in (0, 2, 3))):
            if a.as_py() != last:
                last, left = a.as_py(), shingles(text_a.as_py(), k)
            right = shingles(text_b.as_py(), k)
            more = np.setdiff1d(right, left, assume_unique=True)
            both = len(right) - len(more)
            linked.append(100 * both >= percent * (len(left) + len(more)))
            extra.append(more.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(extra, pa.list_(pa.int64()))],
            names=["a", "b", "linked", "extra"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    for batch in batches:
        sets = [shingles(t.as_py(), k).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "hs"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                    m: int = 12, half: int = 3, seed: int = 1, rare: int = 64, tell_sets: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if their sets of k-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more, confirmed on the full sets;
    component_id is the smallest id reachable by links and kept marks the rows
    whose id it is. With the defaults a pair at exactly 0.8 that nothing else
    connects is missed with probability 0.0004, at 0.9 with 4e-7.

    Equal sets are one class from the start, so copies cost one row. A class is
    first compared with the smallest pivot of its buckets. Buckets whose
    members then are in one component are closed. In the others two classes
    share at most their shingles of ``rare`` or fewer classes, which are joined
    and counted, and the smaller number of their other shingles; where that
    bound is below the threshold, no pair is made. Pairs that could link by
    the other shingles alone are tested in rounds: 1, 16, 256, ... pivots a
    bucket with its members of other components. So each pair of a bucket that
    lies in two components is tested or bounded; ``rare`` moves pairs from one
    way to the other and drops none.

    Rows with a null id are returned with a null component, kept. Texts that
    are null, empty or without words have no shingles and link with nothing.
    Rows that repeat an id stand for one document with several texts: each is
    linked by its own text and all are returned. Other columns are ignored.

    With ``tell_sets`` each row also tells set_id, the id of its set of shingles
    (see ``with_set_ids``), and group_id, the same for all rows whose sets are
    connected by links; both are null where a row is in no group.
    """
    spark = docs.sparkSession
    keep = Staged(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = keep(source.mapInArrow(partial(_sketch, k=k, m=m, half=half, seed=seed),
                                  "id long, n long, cls long, halves array<long>"), "sketch")
    sets = sketch.where("cls is not null and id is not null").select("id", "n", "cls", "halves")

    small = sets.select("cls", F.posexplode("halves").alias("p", "h"))
    shared = small.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("h")
    mine = (small.join(shared, "h").groupBy("cls")  # at most 2 * m halves for a class
            .agg(F.collect_set(F.when(F.col("p") < m, F.col("h"))).alias("left"),
                 F.collect_set(F.when(F.col("p") >= m, F.col("h"))).alias("right"))
            .where("size(left) > 0 and size(right) > 0"))
    mine = keep(mine, "halves")
    keys = (mine.select("cls", F.explode("left").alias("l"), "right").select("cls", "l", F.explode("right").alias("r"))
            .select("cls", F.xxhash64("l", "r").alias("key")))
    heads = (keys.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("hi"))
             .where("pivot <> hi").select("key", "pivot"))
    members = keep(keys.join(heads, "key"), "members-0")

    first = sets.groupBy("cls").agg(F.min("id").alias("id"))
    involved = members.select("cls").distinct().join(first, "cls")
    texts = source.join(involved, "id").select("cls", "text").mapInArrow(
        partial(_confirm_class, k=k), "cls long, text string").dropDuplicates(["cls"])
    texts = keep(texts, "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
        full = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        return full.mapInArrow(partial(_verify, k=k, percent=percent), "a long, b long, linked boolean, extra array<long>")

    def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the buckets with members of several components, with their labels."""
        named = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "label", F.coalesce("label", "cls"))
        buckets = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        return named.join(buckets.select("key"), "key")

    def merge(labels: DataFrame, links: DataFrame, what: str) -> DataFrame:
        """Labels after new links: components of the links between the old labels."""
        if links.isEmpty():
            return labels
        ends = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left").select(
            F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        merged = components(ends)
        nodes = (labels.union(links.select(F.col("a").alias("node"), F.col("a").alias("label")))
                 .union(links.select(F.col("b").alias("node"), F.col("b").alias("label"))))
        nodes = nodes.groupBy("node").agg(F.min("label").alias("old"))
        return keep(nodes.join(merged.toDF("old", "new"), "old", "left")
                    .select("node", F.coalesce("new", "old").alias("label")), f"labels-{what}")

    # one pair a class first: with the smallest pivot of all its buckets
    pairs = (members.where("pivot <> cls").groupBy("cls").agg(F.min("pivot").alias("a"))
             .select("a", F.col("cls").alias("b")))
    tested = keep(confirm(pairs), "tested-0")
    labels = keep(components(tested.where("linked")), "labels-0")
    classes = keep(still_open(members.select("key", "cls"), labels).select("cls").distinct(), "opened")
    keep.drop("members-0")

    # Heavily edited copies share buckets with their whole group but link with few. Shingles that no pivot has and
    # few open classes share are joined by themselves; the others bound what any two classes can share besides.
    against = tested.join(classes.withColumnRenamed("cls", "b"), "b").select("a", "b", "extra")
    whole = classes.join(against.select(F.col("b").alias("cls")), "cls", "left_anti").union(
        against.select(F.col("a").alias("cls"))).distinct()
    seen = texts.join(whole, "cls").select("cls", "text").mapInArrow(partial(_sets, k=k), "cls long, hs array<long>")
    seen = seen.select("cls", F.explode("hs").alias("h"), F.lit(1).alias("whole")).union(
        against.join(whole.withColumnRenamed("cls", "b"), "b", "left_anti")
        .select(F.col("b").alias("cls"), F.explode("extra").alias("h"), F.lit(0)))
    few = keep(seen.groupBy("h").agg(F.max("whole").alias("whole"), F.count("*").alias("df"),
                                     F.when(F.count("*") <= rare, F.collect_list("cls")).alias("all"))
               .where(f"whole = 0 and df <= {rare}").select("h", "all"), "few")
    size = sets.groupBy("cls").agg(F.first("n").alias("n"))  # the same in all rows of a class
    own = few.select(F.explode("all").alias("cls")).groupBy("cls").agg(F.count("*").alias("own"))
    size = keep(classes.join(size, "cls").join(own, "cls", "left").select(
        "cls", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")), "size")

    def reaches(common, n) -> str:
        return f"{100 + percent} * ({common}) >= {percent} * ({n})"

    def new_pairs(pairs: DataFrame) -> DataFrame:
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return pairs.join(known, ["a", "b"], "left_anti")

    ends = few.where("size(all) > 1").select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    pairs = ends.where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    for x in "ab":
        pairs = pairs.join(size.toDF(x, f"n{x}", f"c{x}"), x)
    named = labels.toDF("a", "la")
    pairs = (pairs.where(reaches("both + least(ca, cb)", "na + nb")).join(named, "a", "left")
             .join(named.toDF("b", "lb"), "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b"))
    found = keep(confirm(new_pairs(pairs)).drop("extra"), "tested-few")
    labels = merge(labels, found.where("linked"), "few")
    tested = tested.drop("extra").union(found)

    # two classes share a table if they share a left half and a right half: the pair is made at its smallest left half
    rows = mine.join(size, "cls").where(f"100 * common >= {percent} * n").withColumn("key", F.explode("left"))
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    open_rows = rows.join(least, "key").where(  # a partner has percent / 100 of the shingles at least
        reaches("common", f"n + greatest(least, n * {percent} / 100)")).drop("least")
    pivots, step = 1, 0
    while True:
        step += 1
        named = keep(still_open(open_rows, labels), f"members-{step}")
        keep.drop(f"members-{step - 1}")
        if named.isEmpty():
            break
        fields = ["cls", "label", "n", "common", "left", "right"]
        chosen = (named.groupBy("key", F.pmod(F.xxhash64("cls", F.lit(step)), F.lit(pivots)).alias("s"))
                  .agg(F.min(F.struct(*fields)).alias("p")).select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in fields]))
        pairs = (named.join(chosen, "key")
                 .where("label <> p_label").where(reaches("least(common, p_common)", "n + p_n"))
                 .where(F.arrays_overlap("right", "p_right"))
                 .where(F.array_min(F.array_intersect("left", "p_left")) == F.col("key"))
                 .select(F.least("p_cls", "cls").alias("a"), F.greatest("p_cls", "cls").alias("b")).distinct())
        found = keep(confirm(new_pairs(pairs)).drop("extra"), f"tested-{step}")
        labels = merge(labels, found.where("linked"), str(step))
        tested = tested.union(found)
        open_rows = named.join(chosen.select("key", F.col("p_cls").alias("cls")), ["key", "cls"], "left_anti").drop("label")
        pivots *= 16

    named = first.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "id", F.coalesce("label", "cls").alias("label"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "label").select("cls", "component_id", "label")
    out = sketch.select("id", "n", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(of_class, "cls", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
                      *([F.col("cls").alias("set_id"), F.col("label").alias("group_id")] if tell_sets else []))
