"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Every block of 1024 ids stores
its minimum, a bit width, the differences to the minimum packed at that width,
and a list of exceptions (place, full difference) for those that do not fit.
The width is that of the 90th, 95th, 99th or 100th percentile of the
differences, whichever makes the block smallest. After the blocks come the
byte starts of all blocks, the documents' ids and lengths, and a footer.

Layout (little endian): b"PFOR1\\0\\0\\0"; blocks of <u4 minimum, u2 count, u1
width, u1 zero, u2 exceptions> + packed bits + u2 places + u4 differences;
u8 block starts; u1 flags + i8 ids + u4 lengths of documents; footer of u8:
start of the block index, blocks, start of the document index, documents.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, claim, scratch_path, shuffle_partitions
from scorespark.llm.files import create, open_input, shared_folder
from scorespark.llm.pieces import HELD, PieceEncoder, Store, chunks, spread, text_chunks

MAGIC = b"PFOR1\0\0\0"
BLOCK = 1024
_HEAD = struct.Struct("<IHBBH")
_FOOT = struct.Struct("<QQQQ")
_PERCENTILES = (90, 95, 99, 100)
_CHUNK = 4 << 20
_GROUP = 256  # blocks that are packed or read at a time


# ---- blocks ---------------------------------------------------------------------------------------------------------

def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Patched frame-of-reference blocks of an array of unsigned 32-bit ids."""
    out = []
    for at in range(0, len(ids), block * _GROUP):
        part = ids[at:at + block * _GROUP].astype(np.uint32)
        full = len(part) // block * block
        if full:
            out += _pack_group(part[:full].reshape(-1, block))
        if full < len(part):
            out += _pack_group(part[None, full:])
    return out


def _pack_group(rows: np.ndarray) -> list[bytes]:
    count = rows.shape[1]
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    bits = np.frexp(diff.astype(np.float64))[1]  # binary digits of each difference
    line = np.arange(len(rows))[:, None] * 33
    up_to = np.cumsum(np.bincount((line + bits).ravel(), minlength=33 * len(rows)).reshape(-1, 33), axis=1)
    widths = np.array([(up_to < -(-q * count // 100)).sum(axis=1) for q in _PERCENTILES])
    size = np.array([(w * count + 7) // 8 + 6 * (count - up_to[np.arange(len(rows)), w]) for w in widths])
    width = widths[size.argmin(axis=0), np.arange(len(rows))]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        d = diff[these]
        over = bits[these] > w
        kind = np.dtype("<u2" if w <= 16 else "<u4")
        each = np.unpackbits(d.astype(kind).view(np.uint8).ravel(), bitorder="little").reshape(-1, 8 * kind.itemsize)
        packed = np.packbits(each[:, :w].reshape(len(these), -1), axis=1, bitorder="little")
        for k, i in enumerate(these):
            place = np.flatnonzero(over[k])
            out[i] = b"".join((_HEAD.pack(int(low[i]), count, int(w), 0, len(place)), packed[k].tobytes(),
                               place.astype("<u2").tobytes(), d[k, place].astype("<u4").tobytes()))
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    ends = np.cumsum([0] + [h[1] for h in heads])
    out = np.empty(ends[-1], np.uint32)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, count, width, _, _) in enumerate(heads):
        kinds.setdefault((count, width), []).append(i)
    for (count, width), these in kinds.items():
        size = (count * width + 7) // 8
        packed = np.stack([np.frombuffer(data, np.uint8, size, starts[i] + _HEAD.size) for i in these])
        kind = np.dtype("<u2" if width <= 16 else "<u4")
        each = np.zeros((len(these) * count, 8 * kind.itemsize), np.uint8)
        each[:, :width] = np.unpackbits(packed, axis=1, count=count * width, bitorder="little").reshape(len(each), width)
        diff = np.packbits(each.ravel(), bitorder="little").view(kind).reshape(len(these), count).astype(np.uint32)
        for k, i in enumerate(these):
            low, _, _, _, n = heads[i]
            at = starts[i] + _HEAD.size + size
            place = np.frombuffer(data, "<u2", n, at)
            diff[k, place] = np.frombuffer(data, "<u4", n, at + 2 * n)
            out[ends[i]:ends[i + 1]] = diff[k] + np.uint32(low)
    return out


class _Writer:
    """One file; ids are appended document by document."""

    def __init__(self, folder: str):
        self.path, self.out = create(folder, ".pfor")
        self.starts, self.docs, self.rest, self.at, self.tokens = [], [], [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        self.docs += [(i, len(x)) for i, x in docs]
        self.tokens += sum(len(x) for _, x in docs)
        ids = np.concatenate([*self.rest, *(x for _, x in docs)])
        full = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:full])
        self.rest = [ids[full:]]

    def _blocks(self, ids: np.ndarray) -> None:
        for block in pack_blocks(ids):
            self.starts.append(self.at)
            self._put(block)

    def close(self) -> tuple[str, int, int]:
        self._blocks(np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32))
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        docs = self.at
        self._put(np.array([i is None for i, _ in self.docs], np.uint8).tobytes())
        self._put(np.array([i or 0 for i, _ in self.docs], "<i8").tobytes())
        self._put(np.array([n for _, n in self.docs], "<u4").tobytes())
        self._put(_FOOT.pack(index, len(self.starts), docs, len(self.docs)))
        self.out.close()
        return self.path, len(self.docs), self.tokens


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of a file in order, a group of blocks in memory at a time."""
    with open_input(path) as f:
        size = f.size()
        if f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        index, blocks, docs, n = _FOOT.unpack(f.read_at(_FOOT.size, size - _FOOT.size))
        starts = np.append(np.frombuffer(f.read_at(8 * blocks, index), "<u8"), index).astype(np.int64)
        null = np.frombuffer(f.read_at(n, docs), np.uint8)
        names = np.frombuffer(f.read_at(8 * n, docs + n), "<i8").tolist()
        lengths = np.frombuffer(f.read_at(4 * n, docs + 9 * n), "<u4").tolist()
        held, block = np.empty(0, np.uint32), 0
        for i, (no, length) in enumerate(zip(null, lengths)):
            parts, have = [held], len(held)
            while have < length:
                to = min(block + _GROUP, blocks)
                data = f.read_at(int(starts[to] - starts[block]), int(starts[block]))
                parts.append(unpack_blocks(data, starts[block:to] - starts[block]))
                have += len(parts[-1])
                block = to
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (None if no else names[i]), held[:length]
            held = held[length:]


# ---- tokenizing -----------------------------------------------------------------------------------------------------

# Latin letters before closing marks are a piece by themselves and so are the marks
_ENDED = r"^(?P<letters>\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<marks>[.,;:!?]{0,4})$"


class _Tokenizer:
    """A tokenizers-library file; pieces that came lately are not encoded again."""

    def __init__(self, path: str, pattern: str, held: int = HELD):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lib, self.pattern, self.cache = Tokenizer.from_file(path), pattern, PieceEncoder(
            pattern, self._learn, held, self._learn_words)
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.line = self._ids("\n")
        vocabulary = self.lib.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.letters, self.marks = Store(2 * held, self._by_library), {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<i4")

    def _learn(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """New pieces go through the library in one text, a line each; those with inner white space by themselves."""
        plain = []
        for piece in pieces:
            solid = piece[1:].isalnum() or len(piece.split()) == 1 and not piece[-1].isspace()
            if solid and (piece[0] == " " or not piece[0].isspace()):
                plain.append(piece)
            else:
                yield piece, self._ids(piece).tobytes()
        parts = list(chunks(plain, len, 1 << 14))
        for part, e in zip(parts, self.lib.encode_batch_fast(["\n".join(x) for x in parts], add_special_tokens=False)):
            yield from zip(part, self._lines(np.array(e.ids, "<i4"), len(part)))

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, behind a space or the line end they begin with: of letters before marks once."""
        ended = pc.extract_regex(words, _ENDED)
        is_ended = ended.is_valid()
        letters, marks = (pc.struct_field(ended, i).filter(is_ended).dictionary_encode() for i in range(2))
        for m in marks.dictionary.to_pylist():
            if m not in self.marks:
                self.marks[m] = self._ids(m)
        of_marks = [self.marks[m] for m in marks.dictionary.to_pylist()]
        kinds = [self._by_library(words.filter(pc.invert(is_ended))), self.letters.ids(letters.dictionary),
                 (np.array([len(x) for x in of_marks], np.int64), np.concatenate([*of_marks, np.zeros(0, "<i4")]))]
        behind = np.cumsum([0, *(len(flat) for _, flat in kinds)])
        starts = [behind[i] + np.cumsum(size) - size for i, (size, _) in enumerate(kinds)]
        start, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        mask = is_ended.to_numpy(zero_copy_only=False)
        start[~mask, 0], size[~mask, 0] = starts[0], kinds[0][0]
        for i, coded in ((0, letters), (1, marks)):
            code = coded.indices.to_numpy()
            start[mask, i], size[mask, i] = starts[i + 1][code], kinds[i + 1][0][code]
        flat = np.concatenate([x for _, x in kinds])[spread(start.ravel(), size.ravel())]
        return size.sum(axis=1), flat

    def _by_library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library, many words a text: a token has as many bytes as letters, so they tell where a word ends."""
        bare = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        texts = ["".join(x) for x in chunks([w if w[:1] == "\n" else " " + w for w in words.to_pylist()], len, 1 << 14)]
        found = [np.array(e.ids, "<i4") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*found, np.zeros(0, "<i4")])
        ends = np.cumsum(self.width[flat])
        stops = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + ~bare)
        last = np.searchsorted(ends, stops)
        if len(words) and (last[-1] + 1 != len(flat) or (ends[last] != stops).any()):
            raise ValueError("the tokenizer does not keep words apart")
        return np.diff(last, prepend=-1), flat

    def _lines(self, ids: np.ndarray, count: int) -> list[bytes]:
        at = np.flatnonzero(ids == self.line[0])  # only a line end has this id
        data, lo = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        if len(lo) != count:
            raise ValueError("the tokenizer does not keep lines apart")
        return [data[a:b] for a, b in zip(lo, [*(4 * at).tolist(), len(data)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids; texts with the string of an added token go through it whole."""
        whole = [i for i, t in enumerate(texts) if self.special.search(t)]
        if not whole:
            return self.cache.encode(texts)
        out = self.cache.encode(["" if i in set(whole) else t for i, t in enumerate(texts)])
        for i in whole:
            out[i] = self._ids(texts[i])
        return out


@functools.cache
def _tokenizer(path: str, pattern: str, held: int) -> _Tokenizer:
    return _Tokenizer(path, pattern, held)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, pattern: str, end_id: int, file_ids: int,
           held: int) -> Iterator[pa.RecordBatch]:
    claim(__name__, _tokenizer.cache_clear)
    part, seq, writer = TaskContext.get().partitionId(), 0, None
    lib = _tokenizer(path, pattern, held)

    def close():
        name, docs, tokens = writer.close()
        return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": name, "docs": docs, "tokens": tokens}])

    for batch in batches:
        for first, texts in text_chunks(batch.column(1), _CHUNK):
            writer = writer or _Writer(folder)
            names = batch.column(0).slice(first, len(texts)).to_pylist()
            writer.add([(i, np.append(x.view(np.uint32), np.uint32(end_id))) for i, x in zip(names, lib.encode(texts))])
            if writer.tokens >= file_ids:
                yield close()
                writer, seq = None, seq + 1
    if writer:
        yield close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0), batch.column(1)):
            at, rows = start.as_py(), []
            for name, ids in read_file(path.as_py()):
                rows.append((name, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                      names=["id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                      id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = 64 << 20,
                      slices: int | None = None, held: int = HELD) -> DataFrame:
    """Write all documents' ids in ascending id order below ``folder``; the manifest of the files comes back.

    Manifest: file (its place in the order), path, docs, tokens, start (ids in
    all files before it). The documents are range-partitioned by id, so each
    task tokenizes and writes one run of the order, as one or more files of
    about ``file_ids`` ids. ``end_id`` is appended to each document. ``held``
    bounds the words a worker remembers (see ``PieceEncoder``).

    Null ids come first; rows with equal ids are ordered by checksum of their
    text; null texts are empty and hold the end id alone; very long texts may
    span blocks; an empty table gives no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark, folder)
    order = [F.col("id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = source.repartitionByRange(slices or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    files = source.mapInArrow(
        partial(_write, folder=folder, path=path, pattern=pattern, end_id=end_id, file_ids=file_ids, held=held),
        "part long, seq long, path string, docs long, tokens long")
    files = Staged(spark, "token-files")(files, "manifest")
    order = Window.orderBy("part", "seq")  # a row a file
    return files.select((F.row_number().over(order) - 1).alias("file"), "path", "docs", "tokens",
                        (F.sum("tokens").over(order) - F.col("tokens")).alias("start"))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of a manifest, a task a file."""
    files = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def new_folder(df: DataFrame) -> str:
    """An unused folder in the place that all executors share."""
    return scratch_path(df.sparkSession, "ids")
