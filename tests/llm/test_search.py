"""Top-k, hard negatives and phrases against brute force, with nulls, ties, repeated ids, long texts and clashing names."""

import collections
import random
import re
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from scorespark.llm import collocations, negatives, top_k, vectors

VECS = "vec_id long, embedding array<float>, label int, row long, part int, side int, x string, score long, tops int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, e, l, 1, 2, 3, "x", 4, 5) for i, e, l in rows], VECS).repartition(partitions)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, rng.standard_normal(6).tolist(), int(rng.integers(4))) for i in range(300)]
    hot = [0.5, 0.25, -0.125, 1.0, 0.0, 2.0]
    out += [(1000 + i, hot, i % 3) for i in range(150)]  # a third of all rows share a vector
    out += [(400, None, 1), (500, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 2),
            (800, [0.0] * 6, None), (900, [], 1), (901, [], 1), (2000, [1.0, 2.0], 1), (2001, [3.0, -1.0], 1), (2002, [3.0, 1.0], 2),
            (None, hot, 1), (None, None, None), (100, hot, 2), (1000, [0.25] * 6, 0), (-100, hot, 1),
            (3000, [3e38] * 6, 1), (3001, [2e38] * 6, 2), (3002, [-3e38] * 6, 1)]
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], l) for i, e, l in out]


def whole(rows, scale, labelled):
    out = []
    for n, (i, e, l) in enumerate(rows):
        if e is None or any(x is None or not np.isfinite(x) for x in e) or (labelled and l is None):
            continue
        out.append((n, i, [int(np.floor(np.clip(x * scale, -1e300, 1e300))) for x in e], l))
    return out


def product(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def order(found):
    """Best score first, smaller ids first, null ids last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))


def test_top_k_equals_brute_force(spark, rows):
    want = collections.Counter()
    kept = whole(rows, 1024, False)
    for n, i, q, _ in kept:
        if i is not None and i % 100 == 0:
            found = order((product(q, e), j) for m, j, e, _ in kept if m != n and len(e) == len(q))[:10]
            want.update((i, r + 1, j, s) for r, (s, j) in enumerate(found))
    for partitions, block in ((1, 16), (7, 256)):
        out = top_k.top_k(frame(spark, rows, partitions), F.col("vec_id") % 100 == 0, block=block)
        got = collections.Counter(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect()))
        assert got == want


def test_hard_negatives_equal_brute_force(spark, rows):
    want = collections.Counter()
    kept = whole(rows, 256, True)
    for n, i, q, l in kept:
        if i is None or i % 100:
            continue
        scored = [(product(q, e), j, x) for m, j, e, x in kept if m != n and len(e) == len(q)]
        for s, j, _ in order(f for f in scored if f[2] == l)[:5]:
            inside = order(f for f in scored if f[2] != l and 80 * s <= 100 * f[0] <= 100 * s)[:5]
            want.update((i, j, r + 1, x, s, t) for r, (t, x, _) in enumerate(inside))
    assert len(want) > 50
    for partitions in (1, 7):
        out = negatives.hard_negatives(frame(spark, rows, partitions), F.col("vec_id") % 100 == 0, F.col("label"))
        got = collections.Counter(map(tuple, out.select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
        assert got == want


def test_index_leaves_out_and_joins_exactly():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((500, 24)) * np.linspace(0.1, 2, 24))
    n = len(x)
    index = negatives._Index(x, np.arange(n), np.zeros(n, bool), np.arange(n), np.zeros(n, np.int64))
    q = x[:20]
    exact = (q @ x.T).astype(int)
    for t in (np.full(20, 400000.0), np.sort(exact, axis=1)[:, -7].astype(float), np.zeros(20), np.full(20, -np.inf)):
        got = {(int(a), int(b), int(s)) for _, who, doc, score in index.join(q, t) for a, b, s in zip(who, doc, score)}
        assert got == {(a, b, int(exact[a, b])) for a, b in zip(*np.nonzero(exact >= t[:, None]))}
    _, docs = index._candidates(q[:1][:, index.dims], negatives._norms(q[:1][:, index.dims]), np.array([1.5e6]), 1.5e6 / np.linalg.norm(q[0]))
    assert len(docs) < n  # norms alone rule some out


def test_block_bounds_hold_every_score():
    rng = np.random.default_rng(6)
    x = np.floor(1024 * rng.standard_normal((300, 8)))
    blocks = top_k._Blocks(x, np.arange(300), np.zeros(300, bool), np.arange(300), 32)
    scores = x[:10] @ blocks.x.T
    for b, (s, e) in enumerate(zip(blocks.cuts, blocks.cuts[1:])):
        assert (blocks.bounds(x[:10])[:, b] >= scores[:, s:e].max(axis=1)).all()


def test_vectors_without_rows(spark, rows):
    none = frame(spark, rows).where("false")
    assert top_k.top_k(none, F.lit(True)).count() == 0
    assert negatives.hard_negatives(none, F.lit(True), F.col("label")).count() == 0
    alone = frame(spark, rows[:1])
    assert top_k.top_k(alone, F.lit(True)).count() == 0
    assert negatives.hard_negatives(alone, F.lit(True), F.col("label")).count() == 0


def test_products_beyond_64_bits():
    big = np.array([[2.0**62, 2.0**62]])
    assert vectors.products(big, big)[0, 0] == 2**63 - 1
    assert vectors.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 1


# ---- phrases --------------------------------------------------------------------------------------------------------

def brute_phrases(docs, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        cover = collections.Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i:i + m]] = max(cover[p[i:i + m]], a)
        ranked = []
        for p, a in found.items():
            if cover[p] < a:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])}
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda n: f"w{min(rng.randrange(n), rng.randrange(n))}"
    out = [(" ".join(word(14) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]))
           for _ in range(150)]
    out += [("New York is a city. new  york\tIS a City!\x0bnew york\rnew york", "en")] * 12  # a passage many rows share
    out += [(None, "en"), ("", None), (" \t\n", "xx"), ("...", "xx"), ("é中😀 ñ é中😀 ñ", "xx"), ("ÀÉ àé A B a b", "xx")]
    out += [("a b c " + " ".join(f"x{rng.randrange(9)}" for _ in range(2)), "en") for _ in range(200)]  # a hot prefix
    out += [(" ".join(word(20) for _ in range(9000)), "fr"), ("long" * 9000 + " tail tail", "fr"), ("no break " * 2000, "und")]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, texts, small, monkeypatch):
    schema = "doc_id long, text string, lang string, phrase string, n long, words long, part int, size int"
    docs = spark.createDataFrame([(i, t, l, "p", 1, 2, 3, 4) for i, (t, l) in enumerate(texts)], schema).repartition(5)
    want = brute_phrases(texts, 6, 60)
    assert len(want) > 150
    if not small:
        got = collocations.collocations(docs, least=6, top=60).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        return
    # tiny bounds: chunks, spills, bursts and hot trigrams everywhere; run by hand, as workers do not see the patches
    for name, value in dict(_BURST=3, _WIDE=2, _ENTRIES=50, _WORDS=40, _CHUNK=64).items():
        monkeypatch.setattr(collocations, name, value)
    table = pa.table({"lang": pa.array([l or "und" for t, l in texts if t]), "text": pa.array([t for t, _ in texts if t])})
    counts = collections.Counter()
    everything = types.SimpleNamespace(value=b"\xff" * 128)  # a filter that lets all pairs through changes nothing
    for width, pairs in ((2, None), (5, everything)):
        runs = pa.Table.from_batches([b for half in (table[:200], table[200:])
                                      for b in collocations._count(iter(half.to_batches()), 7, width, pairs)])
        for lang, part in {(r["lang"], r["part"]) for r in runs.select(["lang", "part"]).to_pylist()}:
            here = runs.filter(pc.and_(pc.equal(runs["lang"], lang), pc.equal(runs["part"], part)))
            for r in collocations._merge(here, 6, width).to_pylist():
                counts[r["lang"], r["size"], r["phrase"]] += r["n"]
    f = collections.Counter()
    for text, lang in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 6):
                f.update((lang or "und", m, " ".join(w[i:i + m])) for i in range(len(w) - m + 1))
            if w:
                f[lang or "und", 0, ""] += len(w)
    assert {k: v for k, v in counts.items() if v >= 6 or k[1] == 0} == {k: v for k, v in f.items() if v >= 6 or k[1] == 0}


def test_phrases_without_rows(spark, texts):
    docs = spark.createDataFrame([(None, None)], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.where("false")).count() == 0
