"""Phrases that occur together more often than their parts suggest, counted in burstable tries.

A task counts windows of words in a trie per language: a shallow level of first
words, and below each a hash container of the words that follow. A container
that grows beyond ``_BURST`` windows bursts into children by its next word. A
full trie is spilled: its subtrees, in sorted order, become runs, one a partition
of phrase prefixes, each with the words it uses. The runs of a partition are
merged into the counts of its phrases.

Words and pairs are counted first. A longer phrase is only as frequent as its
rarest pair, so windows of three to five words are then counted only where all
pairs are frequent, as told by a Bloom filter of at most 32 MB: a pair that it
lets through wrongly costs work and changes no count.

A prefix is all of a word or pair, and three words of a longer phrase. A subtree
under three words with more than ``_WIDE`` windows in one run is hot: its windows are
dealt by all their words, and the parts of its counts are added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, claim, mix64

LONGEST = 5  # words of a phrase; a window fits 16 bits a word
_BURST, _WIDE = 4096, 2048
_ENTRIES, _WORDS = 400_000, 65_535  # of a trie before it is spilled
_CHUNK = 1 << 20  # bytes of text looked at together
_PAIR_BYTES, _LONG_BYTES = 32 << 20, 64 << 20  # of text whose pairs, or longer windows, one task merges at a time
_FILTER_BITS, _SLICE = 1 << 28, 1 << 19  # of the filter of frequent pairs, and of what a task sends of it at a time
_PROBES = 4
_BITS, _LOW = np.uint64(16), np.uint64(0xFFFF)

_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_RUN = "lang string, part int, words binary, run binary"
_COUNTS = "lang string, size int, phrase string, n long"


class _Children(dict):
    """What a burst container became: the next word -> container or children, keys shifted by one word."""


class Trie:
    """Counts of windows of ``width`` words: first word -> container of what follows, or children by the next word."""

    def __init__(self, width: int = LONGEST):
        self.width = width
        self.root: dict[int, dict] = {}
        self.words: dict[bytes, int] = {}
        self.entries = 0
        self.top = 16 * (width - 2)  # where a key holds the next word
        self.mask = (1 << 16 * (width - 1)) - 1

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count windows: word numbers, and those after each packed in 16 bits a word (0: none)."""
        if not len(first):
            return
        order = np.argsort(first, kind="stable")
        first, rest = first[order], rest[order].tolist()
        cuts = np.flatnonzero(np.diff(first)) + 1
        root = self.root
        for word, a, b in zip(first[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(first)]):
            node = root.get(word)
            if node is None:
                node = root[word] = {}
            if type(node) is _Children:
                for key in rest[a:b]:
                    self._descend(node, key)
                continue
            before = len(node)
            for key in rest[a:b]:
                node[key] = node.get(key, 0) + 1
            self.entries += len(node) - before
            if len(node) > _BURST and self.width > 2:
                root[word] = self._burst(node)

    def _descend(self, node: dict, key: int) -> None:
        depth = 1
        while type(node) is _Children:
            parent, word = node, key >> self.top
            node = parent.get(word)
            if node is None:
                node = parent[word] = {}
            key = (key << 16) & self.mask
            depth += 1
        self.entries += key not in node
        node[key] = node.get(key, 0) + 1
        if len(node) > _BURST and depth < self.width - 1:
            parent[word] = self._burst(node)

    def _burst(self, container: dict) -> _Children:
        out = _Children()
        for key, n in container.items():
            child = out.get(key >> self.top)
            if child is None:
                child = out[key >> self.top] = {}
            child[(key << 16) & self.mask] = n
        return out

    def _flat(self, node: dict) -> tuple[np.ndarray, np.ndarray]:
        if type(node) is dict:
            return np.fromiter(node, np.uint64, len(node)), np.fromiter(node.values(), np.int64, len(node))
        below = [(word, *self._flat(child)) for word, child in node.items()]
        keys = [(np.uint64(word) << np.uint64(self.top)) | (k >> _BITS) for word, k, _ in below]
        return np.concatenate(keys), np.concatenate([n for _, _, n in below])

    def sorted_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of each window, counts), in the order of the word numbers."""
        leaves = [(word, node) for word, node in self.root.items() if type(node) is dict]
        grown = [(word, *self._flat(node)) for word, node in self.root.items() if type(node) is _Children]
        sizes = [*(len(node) for _, node in leaves), *(len(k) for _, k, _ in grown)]
        n = sum(len(node) for _, node in leaves)
        first = np.repeat(np.array([w for w, _ in leaves] + [w for w, _, _ in grown], np.uint64), sizes)
        keys = np.concatenate([np.fromiter(chain.from_iterable(x for _, x in leaves), np.uint64, n), *(k for _, k, _ in grown)])
        count = np.concatenate([np.fromiter(chain.from_iterable(x.values() for _, x in leaves), np.int64, n),
                                *(c for _, _, c in grown)])
        order = np.lexsort((keys, first))
        first, keys = first[order], keys[order]
        rest = [(keys >> np.uint64(shift)) & _LOW for shift in range(self.top, -1, -16)]
        return np.stack([first, *rest], axis=1).astype(np.uint16), count[order]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First places of runs of equal rows in sorted columns."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(change) + 1] if len(columns[0]) else np.empty(0, np.int64)


def _spill(trie: Trie, lang: str, parts: int) -> pa.RecordBatch:
    """The trie's subtrees as sorted runs, one for every prefix partition they fall into."""
    w, count = trie.sorted_windows()
    if trie.width == 2:  # words and pairs, each with its total
        ones, pairs = _starts(w[:, 0]), np.flatnonzero(w[:, 1])
        sections = [(_cut(w[ones], 1), np.add.reduceat(count, ones), 1, 0), (w[pairs], count[pairs], 2, 0)]
    else:
        at = _starts(w[:, 0], w[:, 1], w[:, 2])
        sizes = np.diff(np.r_[at, len(w)])
        wide = sizes > _WIDE
        hot = np.repeat(wide, sizes)
        sections = [(w[~hot], count[~hot], 3, 0), (_cut(w[at[wide]], 3), np.add.reduceat(count, at)[wide], 3, 1)]
        hot &= w[:, 3] > 0
        sections.append((w[hot], count[hot], LONGEST, 2))
    names = list(trie.words)
    hashes = np.array([0, *[xxhash.xxh64_intdigest(x) for x in names]], np.uint64)
    place = []
    for rows, _, depth, _ in sections:
        h = np.full(len(rows), depth, np.uint64)
        for i in range(depth):
            h = mix64(h ^ hashes[rows[:, i]])
        place.append(h % np.uint64(parts))
    w = np.concatenate([s[0] for s in sections])
    count = np.concatenate([s[1] for s in sections]).astype("<u4")
    kind = np.concatenate([np.full(len(s[0]), s[3], np.uint8) for s in sections])
    place = np.concatenate(place).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = _starts(place[order])
    packer = zstandard.ZstdCompressor(level=1)
    seen = np.zeros(len(names) + 1, np.uint16)
    out_part, out_words, out_runs = [], [], []
    for rows in np.split(order, cuts[1:]):
        here = w[rows]
        flags = np.zeros(len(names) + 1, bool)
        flags[here] = True
        flags[0] = False  # 0 stands for no word in every run
        used = np.flatnonzero(flags)
        seen[used] = np.arange(1, len(used) + 1)
        run = seen[here].astype("<u2").T.tobytes() + count[rows].tobytes() + kind[rows].tobytes()
        out_part.append(int(place[rows[0]]))
        out_words.append(b" ".join([names[i - 1] for i in used.tolist()]))
        out_runs.append(packer.compress(run))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(out_part)), pa.array(out_part, pa.int32()), pa.array(out_words, pa.binary()),
         pa.array(out_runs, pa.binary())], names=["lang", "part", "words", "run"])


def _cut(w: np.ndarray, n: int) -> np.ndarray:
    out = w.copy()
    out[:, n:] = 0
    return out


def _chunks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_CHUNK`` bytes that end where no word does not."""
    at = 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        while end < len(data) and not _KIND[data[end - 1]]:
            ahead = np.flatnonzero(_KIND[data[end:end + _CHUNK]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + _CHUNK, len(data))
        yield at, end
        at = end


def _words(data: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word, the distinct words, piece of each word) in lower case."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int64)[start] if len(start) else np.empty(0, np.int64)
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    letters = _LOWER[data[inside]]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    found = found.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist(), piece


def _pair_hash(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first ^ np.uint64(xxhash.xxh64_intdigest(lang))) ^ second)


def _bit_places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a filter of ``bits`` (a power of two) for hashes."""
    step = mix64(h) | np.uint64(1)
    for i in range(_PROBES):
        yield (h + np.uint64(i) * step) & np.uint64(bits - 1)


class _Counting:
    """The tries of a task; their runs are given out when they are full."""

    def __init__(self, parts: int, width: int, pairs: np.ndarray | None = None):
        self.parts, self.width, self.pairs, self.tries = parts, width, pairs, {}

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, trie in self.tries.items():
            if trie.entries:
                yield _spill(trie, lang, self.parts)
        self.tries = {}

    def text(self, lang: str, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the windows of concatenated texts; the last words of a chunk are seen again before the next."""
        carried: tuple[list[bytes], list[int]] = ([], [])
        pieces = 0
        for a, b in _chunks(data):
            number, words, piece = _words(data[a:b])
            piece = piece + pieces
            pieces += int((_KIND[data[a:b]] == 2).sum())
            number = np.r_[np.arange(len(words), len(words) + len(carried[0])), number]
            words, piece = [*words, *carried[0]], np.r_[carried[1], piece].astype(np.int64)
            done = max(0, len(number) - (self.width - 1)) if b < len(data) else len(number)
            goes_on = piece[1:] == piece[:-1]
            if self.pairs is not None:
                h = np.array([xxhash.xxh64_intdigest(x) for x in words], np.uint64)[number]
                h, bits = _pair_hash(lang, h[:-1], h[1:]), 8 * len(self.pairs)
                for place in _bit_places(h, bits):
                    goes_on &= (self.pairs[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            step = done if len(words) <= _WORDS else _WORDS - LONGEST
            for s in range(0, done, max(1, step)):
                yield from self._count(lang, number, words, goes_on, s, min(s + step, done))
            carried = ([words[i] for i in number[done:].tolist()], piece[done:].tolist())

    def _count(self, lang, number, words, goes_on, a, b) -> Iterator[pa.RecordBatch]:
        goes_on = np.r_[goes_on, np.zeros(self.width, bool)]
        if self.pairs is None:
            at = np.arange(a, b)
        else:  # windows of three words and more
            at = a + np.flatnonzero(goes_on[a:b] & goes_on[a + 1:b + 1])
        there, windows = np.ones(len(at), bool), [number[at]]
        for i in range(1, self.width):
            there = there & goes_on[at + i - 1]
            windows.append(np.where(there, number[np.minimum(at + i, len(number) - 1)], -1))
        windows = np.stack(windows)
        used, local = np.unique(windows, return_inverse=True)
        if not len(used):
            return
        none = int(used[0] == -1)
        names = [words[i] for i in used[none:].tolist()]
        trie = self.tries.setdefault(lang, Trie(self.width))
        if len(trie.words) + sum(x not in trie.words for x in names) > _WORDS:
            yield from self.spill()
            trie = self.tries.setdefault(lang, Trie(self.width))
        known = trie.words
        code = np.array([0] * none + [known.setdefault(x, len(known) + 1) for x in names], np.uint64)[local.reshape(windows.shape)]
        rest = np.zeros(len(at), np.uint64)
        for c in code[1:]:
            rest = (rest << _BITS) | c
        trie.add(code[0], rest)
        if sum(t.entries for t in self.tries.values()) > _ENTRIES:
            yield from self.spill()


def _count(batches: Iterator[pa.RecordBatch], parts: int, width: int, pairs=None) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    counting = _Counting(parts, width, None if pairs is None else np.frombuffer(pairs.value, np.uint8))
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pc.equal(langs.indices, i)).cast(pa.large_binary())
            data = np.frombuffer(b"\n".join(texts.to_pylist()), np.uint8)  # a break between texts
            yield from counting.text(lang, data)
    yield from counting.spill()


def _filter_slices(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The slices of the filter that these frequent pairs touch."""
    claim(__name__)
    filled: dict[int, np.ndarray] = {}
    for batch in batches:
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            h = np.array([xxhash.xxh64_intdigest(x) for x in phrase.encode().split(b" ")], np.uint64)
            for place in _bit_places(_pair_hash(lang, h[:1], h[1:]), bits):
                slice_, bit = divmod(int(place[0]), _SLICE)
                at = filled.setdefault(slice_, np.zeros(min(bits, _SLICE) // 8, np.uint8))
                at[bit >> 3] |= 1 << (bit & 7)
    for slice_, at in filled.items():
        yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([at.tobytes()], pa.binary())], names=["slice", "bits"])


def _either(table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
    return pa.table({"slice": table["slice"].slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})


def _pair_filter(counts: DataFrame) -> np.ndarray:
    """Bits of the frequent pairs: 16 a pair, 2^28 at most, so its size is bounded whatever the corpus holds."""
    pairs = counts.where("size = 2").select("lang", "phrase")
    bits = min(_FILTER_BITS, max(1 << 10, 1 << (16 * pairs.count()).bit_length()))
    schema = "slice int, bits binary"
    slices = pairs.mapInArrow(partial(_filter_slices, bits=bits), schema).groupBy("slice").applyInArrow(_either, schema)
    out = np.zeros(bits // 8, np.uint8)
    size = min(bits, _SLICE) // 8
    for r in slices.collect():  # the filter itself, 32 MB at most
        out[r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _merge(table: pa.Table, least: int, width: int) -> pa.Table:
    """Counts of the phrases of a partition: all of at least ``least``, and the parts of those that other tasks hold too."""
    claim(__name__)
    known: dict[bytes, int] = {}
    ws, ns, kinds = [], [], []
    unpack = zstandard.ZstdDecompressor()
    for words, run in zip(table.column("words").to_pylist(), table.column("run").to_pylist()):
        code = np.array([0, *[known.setdefault(x, len(known) + 1) for x in words.split(b" ")]], np.int32)
        raw = unpack.decompress(run)
        m = len(raw) // (2 * width + 5)
        ws.append(code[np.frombuffer(raw, "<u2", width * m).reshape(width, m)])
        ns.append(np.frombuffer(raw, "<u4", m, 2 * width * m).astype(np.int64))
        kinds.append(np.frombuffer(raw, np.uint8, m, (2 * width + 4) * m))
    w, n, kind = np.concatenate(ws, axis=1), np.concatenate(ns), np.concatenate(kinds)
    names = [b"", *known]
    out_size, out_phrase, out_n = [], [], []

    def totals(rows: np.ndarray, size: int, limit: int) -> None:
        if not len(rows):
            return
        order = rows[_order(w[:size, rows], len(names))]
        at = _starts(*w[:size, order])
        total = np.add.reduceat(n[order], at)
        keep = np.flatnonzero(total >= limit)
        for column in w[:size, order[at[keep]]].T.tolist():
            out_phrase.append(b" ".join([names[i] for i in column]))
        out_size.extend([size] * len(keep))
        out_n.extend(total[keep].tolist())

    if width == 2:
        ones = w[1] == 0
        out_size, out_phrase, out_n = [0], [b""], [int(n[ones].sum())]  # words in all
        totals(np.flatnonzero(ones), 1, least)
        totals(np.flatnonzero(~ones), 2, least)
    else:
        totals(np.flatnonzero(kind < 2), 3, least)
        # below a trigram that burst in some run, counts are parts
        split = kind == 2
        if (kind == 1).any():
            key = _pack(w[:3], len(names))
            split |= np.isin(key, key[kind == 1])
        for size in range(4, LONGEST + 1):
            there = (w[size - 1] > 0) & (kind != 1)
            totals(np.flatnonzero(there & ~split), size, least)
            totals(np.flatnonzero(there & split), size, 1)
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(out_n), pa.string()), "size": pa.array(out_size, pa.int32()),
                     "phrase": pa.array([p.decode() for p in out_phrase], pa.string()), "n": pa.array(out_n, pa.int64())})


def _pack(columns: np.ndarray, names: int) -> np.ndarray:
    """One number for each column of word numbers, unequal for unequal ones."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        _, key = np.unique(key, return_inverse=True)
        key = key * names + c
    return key


def _order(columns: np.ndarray, names: int) -> np.ndarray:
    """Order that puts equal columns next to each other."""
    if names >= 1 << 21:
        return np.lexsort(columns[::-1])
    keys = []
    for i in range(0, len(columns), 3):
        key = np.zeros(columns.shape[1], np.int64)
        for c in columns[i:i + 3]:
            key = key << 21 | c
        keys.append(key)
    return np.lexsort(keys[::-1])


def phrase_counts(docs: DataFrame, keep: Staged, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n): all phrases of 1 to 5 words found ``least`` times in a language; size 0 counts its words.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
    these into words ``[^\\x20\\x09]+``; phrases lie inside pieces and overlaps
    count. Null texts are empty, a null language is ``und``. Staged by ``keep``.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).alias("text")).where("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def counted(width: int, bytes_: int, pairs=None) -> DataFrame:
        runs = texts.mapInArrow(partial(_count, parts=-(-size // bytes_) or 1, width=width, pairs=pairs), _RUN)
        found = runs.groupBy("lang", "part").applyInArrow(lambda t: _merge(t, least, width), _COUNTS)
        return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(f"size = 0 or n >= {int(least)}")

    short = keep(counted(2, _PAIR_BYTES), "pairs")
    pairs = docs.sparkSession.sparkContext.broadcast(_pair_filter(short).tobytes())
    return short.union(keep(counted(LONGEST, _LONG_BYTES, pairs), "phrases"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, text_col: str = "text",
                 lang_col: str = "lang", salts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words.

    A phrase found a >= ``least`` times is cut after its first k words into
    parts found l and r times; its score is the smallest floor(1000 * a * n /
    (l * r)), n the words of the language, ties to the smaller k. A phrase
    inside a longer one that is found at least ``percent`` percent as often is
    dropped. Order: score, a (both descending), phrase. Arithmetic is exact
    (decimals of 38 digits; beyond them the job fails).

    Null and empty texts hold no words, a null language counts as ``und``; rows
    that repeat count as often as they stand there. An empty table gives no
    rows; other columns are not read.
    """
    keep = Staged(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, keep, least, text_col, lang_col)
    words = keep(counts.where("size = 0").select("lang", F.col("n").alias("words")), "words")
    phrases = counts.where("size > 0").select("lang", "phrase", "n")
    long_ = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    piece = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = (long_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"),
                    piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")))
    lefts = phrases.toDF("lang", "left", "l")
    rights = phrases.toDF("lang", "right", "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(words, "lang")
    scored = scored.withColumn("over", (wide("a") * wide("words")).cast("decimal(34,0)") * F.lit(1000)).withColumn(
        "under", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    lowest = scored.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: F.array_join(F.slice("w", at, m), " "))))
    covers = (long_.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    left = lowest.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a"))).drop("longer")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
