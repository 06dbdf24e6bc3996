"""Corpus operators against brute force, libraries and round trips, with nulls, empties, ties and clashing names."""

import gc
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorespark.llm import (bpe, common, embeddings, files, minhash, mixing, pieces, quality, repeats, sharding, token_files, toxicity,
                            warc)
from scorespark.llm.common import components, scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, id string, key string, label string"


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + ("x",) * (width - len(r)) for r in rows], schema)


def docs(spark, texts):
    return frame(spark, [(i, t, "en", f"s{i % 3}" if i and i % 5 else None, 1) for i, t in texts])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = words(rng, 120)
    out = [(i, words(rng, rng.randrange(1, 150))) for i in range(40)]
    for i in range(40, 90):  # copies with more and more edits, some of them beyond the threshold
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
        out.append((i, " ".join(w)))
    out += [(90, out[3][1]), (91, out[3][1].upper()), (92, None), (93, ""), (94, " \t\n"), (95, "one two"), (96, "ONE  two"),
            (97, "é中😀 ñ"), (98, words(rng, 20000)), (99, "a" * 5000), (None, "no id here at all"), (3, out[3][1])]
    return out


# ---- near duplicates ------------------------------------------------------------------------------------------------

def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rare", [1, 64])
def test_near_duplicates_equal_brute_force(spark, texts, rare):
    k = 4
    sets = {i: set(minhash.shingles(t, k).tolist()) for i, t in texts if i is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, pairs)
    out = minhash.near_duplicates(docs(spark, texts), k=k, rare=rare).collect()
    assert len(out) == len(texts)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_shingles_follow_the_words():
    plain = minhash.shingles("A b  C\td", 4)
    assert len(plain) == 1 and (plain == minhash.shingles("a B c d", 4)).all()
    assert len(minhash.shingles("É b c d", 4)) == 1 and (minhash.shingles("É b c d", 4) != minhash.shingles("é b c d", 4)).all()
    assert len(minhash.shingles(None, 4)) == len(minhash.shingles(" \n", 4)) == 0
    assert len(minhash.shingles("a b", 4)) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 40), (40, 100), (7, 7), (200, 199)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 100: 40, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- BPE and token files --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def heap_merge(ranks, data):
    """Ids of a word: of the mergeable neighbours, those of least rank, the leftmost first, until there are none."""
    import heapq

    n = len(data)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i):
        j = end[i]
        if j < n and (r := ranks.get(data[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if alive[i] and j < n and alive[j] and end[i] == j and end[j] == e:
            alive[j], end[i] = False, e
            if e < n:
                prev[e] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
    return [ranks[data[i:end[i]]] for i in range(n) if alive[i]]


def hard_texts():
    rng = random.Random(3)
    odd = " \n\t ab'sé1. 　x中\r😀"
    return (["", " ", "a" * 3000, "ab" * 2000, " " * 500 + "x", "don't 12345 <|endoftext|>", "中文字符测试" * 100,
             "".join(rng.choice("abcdefghijkl") for _ in range(1500))]
            + ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(1500)])


def test_bpe_equals_the_library_and_decodes(library):
    ranks, enc = library
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    own.cache.words.limit = own.cache.pieces.limit = 50  # both generations turn over
    for part in pieces.chunks(hard_texts(), len, 4000):
        ids = own.encode(part)
        assert [x.tolist() for x in ids] == [enc.encode_ordinary(t) for t in part]
        assert own.decode(ids) == [t.encode() for t in part]
    with pytest.raises(ValueError):
        own.decode([np.array([1, 50256], np.int32)])


def test_short_words_end_at_different_steps_and_ids_are_joined_in_parts(library, monkeypatch):
    ranks, enc = library
    texts = [" ".join(["zq", "qxz", "antidisestablishmentarianism", "x" * 90, "ÿÿ"][:n]) for n in range(6)]
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN, state=4)
    for depth in (1, 2, 3, 64):
        monkeypatch.setattr(bpe, "_DEPTH", depth)
        monkeypatch.setattr(bpe, "_KEPT", 1 << 10)
        words = [w.encode() for w in texts[-1].split()]
        flat = np.concatenate([own.byte[list(w)] for w in words])
        got = dict(own._fixpoint(range(len(words)), list(map(len, words)), flat, bpe._CONTRACT))
        assert [np.frombuffer(got[i], "<i4").tolist() for i in range(len(words))] == [heap_merge(ranks, w) for w in words]
    ids = [np.array(enc.encode_ordinary(t), np.int32) for t in texts]
    assert list(own.decimals(ids)) == [" ".join(map(str, x.tolist())).encode() for x in ids]
    assert list(own.decimals([])) == []


def test_staging_lets_a_filled_driver_collect(spark, monkeypatch):
    monkeypatch.setattr(common, "_HEAP_SHARE", 0)
    held = spark._jvm.java.lang.Object()
    ref = spark._jvm.java.lang.ref.WeakReference(held)
    del held
    gc.collect()
    keep = common.Staged(spark, "relieved")
    assert keep(spark.range(3), "rows").count() == 3
    assert ref.get() is None


@pytest.mark.parametrize("kind", ["digits", "letters", "cjk", "letters of a long text", "period", "one letter", "two letters"])
def test_words_of_any_length_equal_the_library(library, kind):
    ranks, enc = library
    rng = random.Random(8)
    text = {"digits": lambda: "".join(rng.choices("0123456789", k=1 << 18)),
            "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 18)),
            "cjk": lambda: "".join(rng.choices("中文字符测试的一是在不了有和人这大为上个国我以要他时来用们", k=50_000)),
            "letters of a long text": lambda: " ".join("".join(rng.choices("etaoinshr", k=4000)) for _ in range(30)),
            "period": lambda: "abcde" * 20_000, "one letter": lambda: "a" * 200_001,
            "two letters": lambda: "".join(rng.choices("ab", k=100_000))}[kind]()
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    ids = own.encode([text])
    # the library's own merging takes the square of a word's length, so long words are held against a heap
    assert ids[0].tolist() == [i for piece in pieces.split(text, public_tokenizers.PATTERN) for i in heap_merge(ranks, piece.encode())]
    assert own.decode(ids) == [text.encode()]
    part = text[:20_000]
    assert own.encode([part])[0].tolist() == enc.encode_ordinary(part)


def test_encode_and_decode_frames(spark, texts, library):
    _, enc = library
    data = docs(spark, texts)
    ids = bpe.encode_documents(data, carry=("doc_id", "source", "text"))
    for r in ids.collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
    for r in bpe.decode_ids(ids, carry=("text",)).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.encode_documents(data, carry=("doc_id", "text"), digests=True).collect():
        joined = " ".join(map(str, enc.encode_ordinary(r.text or ""))).encode()
        assert r.ids_sha256 == hashlib.sha256(joined).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(data.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [5] * 3000, [2**32 - 1, 0, 7], list(range(0, 60000, 7)), [1] * 1023 + [2**31]])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    packed = token_files.pack_blocks(x)
    starts = np.cumsum([0] + [len(b) for b in packed])[:-1].astype(int)
    assert (token_files.unpack_blocks(b"".join(packed), starts) == x).all()


def test_token_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = texts + [(1000 + i, t) for i, t in enumerate(hard_texts()[:300])]
    rows = sorted(((i, t or "") for i, t in more), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    data = docs(spark, more)
    manifest = token_files.write_token_files(data, scratch_path(spark, "t"), slices=3, file_ids=20_000)
    assert manifest.count() >= 3
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.write_token_files(data.limit(0), scratch_path(spark, "t")).count() == 0


# ---- shards ---------------------------------------------------------------------------------------------------------

def test_shards_are_contiguous_and_even(spark, texts):
    out = sharding.contiguous_shards(docs(spark, texts), 5, carry=("lang",), slices=4).collect()
    size = {i: len((t or "").encode()) + 8 for i, t in texts}
    assert len(out) == len(texts) and all(r.size == size[r.doc_id] and r.lang == "en" for r in out)
    order = sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    total, at = sum(r.size for r in out), 0
    for r in order:
        assert r.shard == at * 5 // total
        at += r.size
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.contiguous_shards(docs(spark, texts).limit(0), 5).count() == 0


# ---- repeated passages ----------------------------------------------------------------------------------------------

def brute_repeats(rows, w):
    """rows in order: (n_removed, kept) of each."""
    seen, out = set(), []
    for t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if b[i:i + w] in seen:
                gone[i:i + w] = b"\1" * w
            seen.add(b[i:i + w])
        out.append((sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("w", [100, 130])
def test_repeats_equal_brute_force(spark, w):
    rng = random.Random(w)
    passage = [words(rng, 60, 10**6) for _ in range(5)]
    rows = ["", "short", "x" * 99, "x" * 100, "x" * 350, "é" * 300, None]
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 40), 10**6) for _ in range(3)]
        for _ in range(rng.randrange(0, 4)):  # whole and cut passages at any offset
            p = rng.choice(passage)
            a = rng.randrange(len(p) - w)
            parts.insert(rng.randrange(len(parts)), p[a:a + rng.choice([w - 1, w, w + 1, w + 60, len(p)])])
        rows.append("".join(parts))
    rows += [rows[20], rows[21][5:], rows[22] + "!"]
    data = docs(spark, [(1000 - i, t) for i, t in enumerate(reversed(rows))]).repartition(3)
    got = repeats.remove_repeats(data, min_bytes=w, carry=("lang", "source"), block_bytes=3000).orderBy("doc_id").collect()
    order = sorted(range(len(rows)), key=lambda i: 1000 - (len(rows) - 1 - i))
    want = brute_repeats([rows[i] or "" for i in order], w)
    for r, (n, kept) in zip(got, want):
        assert (r.n_removed, bytes(r.kept), r.lang) == (n, kept, "en")
        assert sum(b - a for a, b in r.spans) == n
    assert repeats.remove_repeats(data.limit(0)).count() == 0


def test_cover_and_limits(spark):
    assert repeats.is_cover(repeats.PERIOD, repeats.COVER.tolist())
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs(spark, [(1, "x")]), min_bytes=99)


# ---- toxicity -------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(900):
        w, y = words(rng, 60).split(), int(i % 4 == 0)
        if y:
            w.insert(rng.randrange(60), rng.choice(["grumblefool", "snarkling", "snarklous", "snarkly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(None, "null id"), (2000, None), (2001, "")]
    data = docs(spark, rows)
    truth = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(data, truth)
    out = toxicity.score(data, model).withColumn("held", toxicity.held_out("doc_id"))
    assert out.columns[:len(data.columns)] == data.columns
    known = dict(labels)
    for r in out.collect():
        assert 0 <= r._score <= 1
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r._score >= model.threshold) == bool(known.get(r.doc_id, 0))
    empty = toxicity.fit(data.limit(0), truth.limit(0))
    assert empty.lexicon == {} and toxicity.score(data, empty).count() == len(rows)


def test_grammar_weighs_clauses():
    s = toxicity._Scorer(toxicity.Model({"idiot$": 2.0, "snark": 1.0}, -3.0, 2.0))
    plain, aimed, negated = (s.raw(x) for x in ("an idiot here", "you are an idiot", "he is certainly not an idiot"))
    assert plain == 2.0 and aimed > plain and negated < aimed
    assert s.raw("they said it was an idiot") < s.raw("they met it was an idiot")
    assert s.raw("not good. an idiot") == plain  # a negation ends with its clause
    assert s.raw("idiotic videosnark") == 0 and s.raw("Snarky snarks") == 2.0
    assert s.raw("idiot " * 3) == 6.0 and s.raw(None) == s.raw("") == 0


def test_threats_of_ordinary_words(spark):
    rng, rows, labels = random.Random(9), [], []
    ordinary = "i will find you and hurt your family she will hurt them".split()
    for i in range(900):
        w, y = ["q" + "abcdefghijklmnopqrst"[rng.randrange(20)] + "abcdefghijklmnopqrst"[rng.randrange(20)] for _ in range(60)], int(i % 4 == 0)
        if y:
            w[30:30] = (["i", "will", "find", "you", "and", "hurt", "your", "family"] if i % 8 else ["grumblefool"])
        else:
            for x in rng.sample(ordinary, 6):  # each word is as common in clean texts
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), truth)
    assert set(model.lexicon) == {"grumblefool$"} and model.threats
    out = {r.doc_id: r._score >= model.threshold for r in toxicity.score(docs(spark, rows), model).collect()}
    assert out == {i: bool(y) for i, y in labels}
    s = toxicity._Scorer(toxicity.Model({}, -3.0, 2.0, threats={"hurt your": 2.0}))
    assert s.raw("hurt your family") == 3.0 < s.raw("i will hurt your family")
    assert s.raw("they will not hurt your family") < s.raw("they will hurt your family")
    assert s.raw("he said they will hurt your family") < s.raw("he met they will hurt your family")
    assert s.raw("hurt. your family") == s.raw("your hurt") == 0


def test_long_clauses_are_read_whole():
    s = toxicity._Scorer(toxicity.Model({"idiot$": 2.0}, -3.0, 2.0))
    filler = "word " * 1000
    assert s.raw(f"they said {filler} idiot") == s.raw("they said a b c d idiot") < s.raw(f"they met {filler} idiot")
    near = s.raw("an idiot of no great account, not an idiot")
    assert s.raw("idiot " + "x" * 391 + " not an idiot") == near  # no cut between the negation and the attack
    assert s.raw(f"said. {filler} idiot") == 2.0


# ---- mixing ---------------------------------------------------------------------------------------------------------

def test_mixing_meets_the_limit_and_keeps_documents(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", "big" if i % 5 else f"s{i % 4}", 1) for i in range(800)]
    rows += [(801, None, "en", None, 1), (802, "a b c", "en", None, 1), (803, "", "en", "none", 1)]
    data = frame(spark, rows)
    out = mixing.mix(data, max_repeats=2.0)
    assert out.columns == [*data.columns, "_tokens", "_copies", "_order"]
    got = out.collect()
    assert len(got) == len(rows) and all(r._copies >= 1 and r._tokens == len((r.text or "").split()) for r in got)
    size, read = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r._tokens
        read[r.source] = read.get(r.source, 0) + r._tokens * r._copies
    top = max(size.values())
    a = 1 - math.log(2) / math.log(top / min(x for x in size.values() if x))
    for s, n in size.items():
        quota = top * (n / top) ** max(0, a)
        assert quota - 60 <= read[s] <= quota + 1 or n == 0  # within a document of the quota, never above
    assert mixing.mix(data.limit(0), max_repeats=2.0).count() == 0


def test_temperature_meets_an_entropy(spark):
    shares = spark.createDataFrame([("a", 700), ("b", 200), ("c", 100), ("d", 0)], "_source string, tokens long")
    a = mixing.temperature(shares, entropy=1.0)
    w = np.array([.7, .2, .1]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-4
    assert mixing.temperature(shares, entropy=9.0) == 0.0
    with pytest.raises(ValueError):
        mixing.temperature(shares)


# ---- WARC -----------------------------------------------------------------------------------------------------------

def test_warc_round_trip_at_any_split(spark):
    rng = random.Random(4)
    noise = "".join(chr(rng.randrange(32, 1000)) for _ in range(4000))
    rows = [(1, "http://a/ü?x=1\r\nWARC-Type: bad", "<p>" + noise), (2, None, "x" * 1000), (3, "u", "x" * 1000), (4, "u", "x" * 999),
            (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (9, "u", "x" * 1000), (9, "u", "x" * 1000), (None, "u", "x" * 1000),
            (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "\x1f\x8b\x08" * 50)]
    pages = frame(spark, rows, "page_id long, url string, html string, digest string, last string")
    files = warc.write_archives(warc.plan_records(pages).coalesce(2), scratch_path(spark, "w"), file_bytes=3000)
    want = sorted(((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                    "revisit" if i in (2, 3) else "response", 9 if i in (2, 3) else None) for i, _, h in rows), key=str)
    for split in (37, 1000, 1 << 20):
        out = warc.read_archives(files, split_bytes=split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == want
        for r in out:
            assert r.payload is None or hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    for path in [r.path for r in files.collect()]:
        with gzip.open(path.removeprefix("file:")) as f:
            assert f.read(9) == b"WARC/1.1\r"
    assert warc.write_archives(warc.plan_records(pages.limit(0)), scratch_path(spark, "w")).count() == 0


def test_warc_headers_of_any_length_and_lost_records(spark):
    rng = random.Random(6)
    long = ["http://a/" + "字" * 8000, "data:" + "".join(rng.choice("abcdefgh0123") for _ in range(3 << 20)), "u" * (1 << 17)]
    rows = [(i, u, f"page {i}") for i, u in enumerate([*long, "short"])]
    pages = frame(spark, rows, "page_id long, url string, html string")
    files = warc.write_archives(warc.plan_records(pages).coalesce(1), scratch_path(spark, "w"))
    got = {r.page_id: (r.url, bytes(r.payload)) for r in warc.read_archives(files, split_bytes=1 << 18).collect()}
    assert got == {i: ("http://a/" + "%E5%AD%97" * 8000 if i == 0 else u, t.encode()) for i, u, t in rows}
    with pytest.raises(ValueError):
        warc.read_archives(files.withColumn("records", F.col("records") + 1))


def test_false_members_are_passed_over(tmp_path):
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z")
    fake = gzip.compress(b"not a record") + b"\x1f\x8b\x08\0garbage"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good + fake + good[:-1])  # the last one is cut short
    assert len(list(warc.read_range(str(path), 0, path.stat().st_size))) == 1
    assert list(warc.read_range(str(path), 1, path.stat().st_size)) == []


# ---- quality --------------------------------------------------------------------------------------------------------

def test_measures():
    assert quality.measure(None) == quality.measure("") == (0, 0, 0, 0, 0)
    assert quality.measure("a b c a b c") == (6, 6, 0, 0, 6)
    assert quality.measure("a b c d a b c") == (7, 7, 0, 0, 6)
    assert quality.measure("x\n\n\nx\n x\nx") == (4, 4, 0, 2, 4)
    assert quality.measure("é#* 中 <|>") == (2, 8, 5, 0, 0)


def test_hosts_are_judged_by_shrunken_rates(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "# * $ " * 30
    rows = [(i, good, "en", "fine", 1) for i in range(60)] + [(100 + i, bad, "en", "junk", 1) for i in range(60)]
    rows += [(200, bad, "en", "fine", 1), (201, good, "en", "junk", 1), (202, good, "en", None, 1), (203, None, "en", None, 1)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert got[0].kept and not got[200].kept and not got[150].kept
    assert got[201].host_failed and not got[201].base_failed and not got[201].kept
    assert got[202].kept and not got[203].kept
    assert quality.judge(frame(spark, rows).limit(0)).count() == 0


# ---- embeddings -----------------------------------------------------------------------------------------------------

def test_embeddings_equal_brute_force(spark):
    rng, rows, i = np.random.default_rng(1), [], 0
    for label in (0, 1, None):
        centre = rng.standard_normal(16)
        for n in range(60):
            x = rng.standard_normal(16) if n % 2 else centre + rng.standard_normal(16) * 0.18
            rows.append((1000 - i, x.astype(np.float32).tolist(), label))
            i += 1
    same = rows[0][1]
    rows += [(5000 + j, same, 0) for j in range(7)] + [(6000, [v * 3 for v in same], 0)]
    rows += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * 16, 0), (7003, [float("nan")] * 16, 0), (7004, [None] * 16, 0),
             (7005, [float("inf")] * 16, 0), (7006, same[:8], 0), (None, same, 0)]
    data = frame(spark, rows, "vec_id long, embedding array<float>, label int, id string, weight string, root string")
    ok = [(v, np.array(x, float), y) for v, x, y in rows
          if v is not None and v not in range(7000, 7006) and y is not None]
    links = [(a, b) for n, (a, x, y) in enumerate(ok) for b, z, u in ok[n + 1:]
             if y == u and len(x) == len(z) and x @ z / math.sqrt((x @ x) * (z @ z)) >= 0.93]
    count = {v: sum(v in p for p in links) for v, *_ in rows}
    want = brute_components([v for v, *_ in rows if v is not None], links)
    out = embeddings.near_duplicates(data, block=16).collect()
    assert len(out) == len(rows) and len(links) > 100
    for r in out:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embeddings.near_duplicates(data.limit(0)).count() == 0


def test_calibration():
    width, gates, count = embeddings.calibrate(0.93, 24)
    p = math.erf(width / math.sqrt(2 - 2 * 0.93) / math.sqrt(2))
    missed = (1 - p) ** gates + sum(math.comb(24, k) * p**k * (1 - p) ** (24 - k) for k in range(count))
    assert missed <= 1e-5 and count > 0


def test_clashing_names_are_refused(spark):
    rows = docs(spark, [(1, "a b"), (2, None)])
    for name in ("_tokens", "_copies", "_ORDER"):
        with pytest.raises(ValueError, match=name):
            mixing.mix(rows.withColumn(name, F.lit(1)), max_repeats=2.0)
    with pytest.raises(ValueError, match="_score"):
        toxicity.score(rows.withColumn("_score", F.lit(1)), toxicity.Model({}, 0.0, 1.0, 0.3))


def test_files_go_where_both_sides_can_reach(spark):
    assert files.shared_folder(spark, "/tmp/x/y") == "file:///tmp/x/y"
    assert files.shared_folder(spark, "file:/tmp/x") == "file:///tmp/x"
    with pytest.raises(ValueError, match="webhdfs"):
        files.shared_folder(spark, "webhdfs://host/x")


def test_words_cut_together_are_cut_as_by_themselves():
    rng = random.Random(12)
    marks = ["don't", "a.b", "x1y2", "...", "'s", "é中", "12", "\u00a0z", "n\nl", "t\tb", "\x1cq", "\x85", "😀!", "'ll-", "a\u3000b"]
    words_ = [*marks, *["".join(rng.choice(marks) for _ in range(3)) for _ in range(300)]]
    cut = pieces.compiled(public_tokenizers.PATTERN).findall
    assert pieces.split_words(words_, public_tokenizers.PATTERN) == [cut(" " + w) for w in words_]
    assert pieces.split_words([], public_tokenizers.PATTERN) == []


def test_a_shingle_of_many_classes(spark):
    rng = random.Random(13)
    line = "this very line stands in a third of all the texts here"
    many = [(i, (line + " " if i % 3 == 0 else "") + words(rng, 60, 60)) for i in range(240)]
    near = [(1000 + i, many[i][1] + f" x{i % 2}") for i in range(40)]
    sets = {i: set(minhash.shingles(t, 4).tolist()) for i, t in many + near}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, pairs)
    for r in minhash.near_duplicates(docs(spark, many + near), k=4, rare=3).collect():
        assert r.component_id == want[r.doc_id]


def test_labels_both_ways_count_as_toxic(spark):
    rows = [(i, "you are a vile blorg" if i % 3 == 0 else "a fine day") for i in range(90)]
    both = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(i, 0) for i in range(0, 90, 3)], "doc_id long, toxic int")
    once = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    assert toxicity.fit(docs(spark, rows), both) == toxicity.fit(docs(spark, rows), once)


@pytest.mark.parametrize("limit", [40, 100_000])
def test_words_behind_line_ends_are_whole_words(limit):
    """A word before a line end and the one behind it are two words, not one that hardly ever comes again."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = token_files._Tokenizer(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    for store in (own.cache.words, own.cache.pieces, own.letters):
        store.limit = limit
    texts = [f"Start of it{mark}\nLine{i % 7} goés on,\nÜber {i}\nit's" for i in range(60) for mark in (".", "", "?!")]
    texts += hard_texts() + ["a b\n\nc d", "a b\r\nc d", "a b\n c", "a b\n", "a \nb", "a b\n<|endoftext|>", "a b c\n d", "", "a b\n.\n'll"]
    for part in (texts[:100], texts[100:], texts[50:150]):
        assert [x.tolist() for x in own.encode(part)] == [lib.encode(t, add_special_tokens=False).ids for t in part]
    few = token_files._Tokenizer(path, public_tokenizers.PATTERN)
    few.encode(texts[:180])
    assert len(few.cache.pieces.keys) < 10 and "\nLine3" in few.cache.words.keys.to_pylist()


def test_a_store_tells_strings_of_equal_hashes_apart(monkeypatch):
    asked = []

    def learn(new):
        asked.append(len(new))
        return np.array([len(x) for x in new.to_pylist()], np.int64), np.array([ord(c) for x in new.to_pylist() for c in x], "<i4")

    store = pieces.Store(10, learn)
    monkeypatch.setattr(pieces, "hash", lambda x: len(x) % 2, raising=False)
    for words_ in (["a", "bc", "def"], ["bc", "gh"], ["def", "a", "xyz", "u", "vw"], ["q" * n for n in range(1, 15)], ["bc", "a"], []):
        size, flat = store.ids(pa.array(words_, pa.large_string()))
        assert size.tolist() == [len(w) for w in words_] and flat.tolist() == [ord(c) for w in words_ for c in w]
    assert len(store.keys) <= 10 + 14 and asked[0] == 3


def test_lean_workers_return_their_database(texts):
    """The same rows from small parts, and no database is left behind a task: idle workers would add up."""
    batch = pa.RecordBatch.from_pydict({"_text": pa.array([t for _, t in texts][:300] + ["ab" * 40_000, None], pa.string())})
    rows = {}
    for lean in (True, False):
        how = dict(path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, what="digests", held=500)
        rows[lean] = [r for b in bpe._encode_rows(iter([batch]), lean=lean, **how) for r in b.to_pylist()]
        assert bool(bpe._OPEN) != lean
    bpe._OPEN.clear()
    assert len(rows[True]) == batch.num_rows and rows[True] == rows[False]


def test_the_last_pass_over_repeats_returns_its_memory(monkeypatch):
    given = []
    monkeypatch.setattr(repeats, "give_back", lambda: given.append(dict(repeats._CACHE)))
    repeats._CACHE["p"] = (np.zeros(1), np.zeros(1))
    assert list(repeats._cut_last(iter([]), None, False)) == [] and given == [{}]
