"""Byte-level BPE by relational contraction: recursive DuckDB queries inside Spark tasks.

Each task holds an in-memory DuckDB database with the merge table. The pieces
of a batch of texts that were not seen lately become rows (word, position,
token); a recursive query joins neighbours with the merge table, contracts
each word's leftmost pair of minimum rank, and ends when no word has a pair
left. Decoding joins ids with the vocabulary and concatenates by an ordered
aggregate. Spark deals out the documents; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import claim, give_back
from scorespark.llm.pieces import HELD, PieceEncoder, chunks, spread, text_chunks

_DEPTH = 64  # most steps of one recursive query; it starts again from its last state until the fixpoint
_KEPT = 32  # tokens times steps that one query keeps, for each of its ``state``: with more tokens it takes fewer steps
_LONG = 96  # tokens of a word from which on all places of its best pair are contracted at a time
_CHUNK = 16  # characters of text, or ids, handled at a time, for each token of ``state``
_STATE, _LEAN = 1 << 17, 1 << 15  # tokens in one recursive query; where memory is short
_CUT = 1024  # bytes of a word from which on it is merged in windows
_SPAN, _OVERLAP = 128, 64  # bytes by which windows are apart, and that a window shares with the next one

# every step of a word is a row set with its number n; positions have no gaps, so the neighbour is at p + 1;
# a word without a pair left comes once more, with the number -1
_CONTRACT = """
WITH RECURSIVE s(n, w, p, t) AS (
  SELECT 0, w, p::BIGINT, t FROM state
  UNION ALL
  SELECT CASE WHEN k IS NULL THEN -1 ELSE n + 1 END, s.w, CASE WHEN p > place THEN p - 1 ELSE p END,
         CASE WHEN p = place THEN k ELSE t END
  FROM s LEFT JOIN (
    SELECT w, (best >> 32)::INT AS k, best & 4294967295 AS place FROM (
      SELECT a.w, min((m.k::BIGINT << 32) | a.p) AS best
      FROM s a JOIN s b ON a.w = b.w AND b.p = a.p + 1 JOIN merges m ON m.l = a.t AND m.r = b.t
      WHERE a.n BETWEEN 0 AND {depth} - 1 GROUP BY a.w)
  ) USING (w) WHERE n BETWEEN 0 AND {depth} - 1 AND p IS DISTINCT FROM place + 1
)
SELECT w, n, list(t ORDER BY p) AS ids FROM s WHERE n = -1 OR n = {depth} GROUP BY w, n
"""
# the same with every non-overlapping place of the best pair, from the left, where merging one cannot make a lower rank
_CONTRACT_LONG = """
WITH RECURSIVE s(n, w, p, t) AS (
  SELECT 0, w, p, t FROM state
  UNION ALL
  SELECT n + 1, w, p, CASE WHEN take THEN best ELSE t END FROM (
    SELECT *, lag(take) OVER (PARTITION BY w ORDER BY p) AS eaten FROM (
      SELECT *, hit AND (CASE WHEN sole THEN hits = 1
        ELSE row_number() OVER (PARTITION BY w, hit, i - hits ORDER BY p) % 2 = 1 END) AS take FROM (
        SELECT *, row_number() OVER (PARTITION BY w, hit ORDER BY p) AS hits FROM (
          SELECT *, coalesce(k = best, false) AS hit, coalesce(best IN (SELECT k FROM sole), false) AS sole FROM (
            SELECT a.*, m.k, min(m.k) OVER (PARTITION BY w) AS best
            FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt, row_number() OVER (PARTITION BY w ORDER BY p) AS i
                  FROM s WHERE n < {depth}) a
            LEFT JOIN merges m ON m.l = a.t AND m.r = a.nt
          ) WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE eaten IS DISTINCT FROM true
)
SELECT w, n, list(t ORDER BY p) AS ids FROM (SELECT *, max(n) OVER (PARTITION BY w) AS top FROM s) WHERE n = top GROUP BY w, n
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """The merge table and vocabulary of a rank file in a DuckDB database of this process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, held: int = HELD, state: int = _STATE):
        self.pattern, self.ranks, self.state = pattern, ranks, state
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.names = pa.array(map(str, range(max(ranks.values()) + 1)), pa.large_string())
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.cache = PieceEncoder(pattern, self._learn, held)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        self._table("merges", dict(zip("lrk", np.array(merges, np.int32).reshape(-1, 3).T)))
        # merged tokens that could at once merge on at a lower rank
        self.con.execute("CREATE TABLE sole AS SELECT l AS k FROM merges WHERE k < l UNION SELECT r FROM merges WHERE k < r")
        self.con.register("v", pa.table({"id": pa.array(ranks.values(), pa.int32()),
                                         "hex": pa.array([t.hex() for t in ranks], pa.string())}))
        self.con.execute("CREATE TABLE vocabulary AS FROM v")
        self.con.unregister("v")

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("incoming", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS FROM incoming")
        self.con.unregister("incoming")

    def _fixpoint(self, words: list[int], size: list[int], flat: np.ndarray, query: str) -> Iterator[tuple[int, bytes]]:
        """(word, ids) of words, whose tokens stand in ``flat`` one word after another, when no pair is left."""
        while len(words):
            depth = max(1, min(_DEPTH, _KEPT * self.state // len(flat)))
            self._table("state", {"w": np.repeat(np.array(words, np.int32), size), "p": np.arange(len(flat), dtype=np.int32),
                                  "t": flat.astype(np.int32, copy=False)})
            got = self.con.sql(query.format(depth=depth)).to_arrow_table().combine_chunks()
            ids = got.column("ids").combine_chunks()
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            w, done = got.column("w").to_numpy(), got.column("n").to_numpy() < depth
            data = flat.astype("<i4", copy=False).tobytes()
            for i, a, b in zip(w[done].tolist(), (4 * ends[:-1][done]).tolist(), (4 * ends[1:][done]).tolist()):
                yield i, data[a:b]
            words, size = w[~done], np.diff(ends)[~done]
            flat = flat[spread(ends[:-1][~done].astype(np.int64), size.astype(np.int64))]

    def _windows(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, ids) of overlapping windows of a word, each merged by itself."""
        starts = list(range(0, max(1, len(x) - _OVERLAP), _SPAN))
        for part in chunks(starts, lambda s: _SPAN + _OVERLAP, self.state):
            cut = [x[s:s + _SPAN + _OVERLAP] for s in part]
            got = dict(self._fixpoint(part, list(map(len, cut)), np.concatenate(cut), _CONTRACT_LONG))
            for s in part:
                yield s, min(len(x), s + _SPAN + _OVERLAP), np.frombuffer(got.pop(s), "<i4")

    def _joint(self, left: np.ndarray, end: int, right: np.ndarray, start: int) -> tuple[int, int] | None:
        """How many ids stay of ``left``, which end at ``end``, and go of ``right``, which begin at ``start``: up to a shared token."""
        tail, head = left[-(end - start):], right[:end - start]  # a token has a byte or more
        a = end - np.cumsum(self.size[tail][::-1])[::-1]
        b = start + np.cumsum(self.size[head]) - self.size[head]
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        same = np.flatnonzero(tail[i] == head[j])
        return (len(left) - len(tail) + int(i[same[0]]) + 1, int(j[same[0]]) + 1) if len(same) else None

    def _merge_long(self, x: np.ndarray) -> bytes:
        """The encoding of a long word, from those of its windows.

        Let p + t be encoded as p's ids and the token t, and t + q as t and
        q's ids. Then p + t + q is encoded as p's ids, t and q's ids: up to the
        first merge across an edge of t, its merges on either side come in the
        order they have in p + t and in t + q, where that merge would be made
        too. So two windows are joined at a token both have at one place. Where
        they have none, the next window starts at a token of what is encoded.
        """
        out, n, end, reach = np.empty(len(x), np.int32), 0, 0, _SPAN
        for start, stop, ids in self._windows(x):
            if stop <= end:
                continue
            at = (0, 0) if end == 0 else self._joint(out[:n], end, ids, start)
            back = _OVERLAP // 2
            reach = _SPAN if at else min(2 * reach, self.state // 2)  # what repeats at another phase goes on doing so
            while at is None:
                start = end - int(self.size[out[max(0, n - back):n]].sum())
                stop = max(stop, min(len(x), end + reach))
                ids = np.frombuffer(dict(self._fixpoint([0], [stop - start], x[start:stop], _CONTRACT_LONG))[0], "<i4")
                at = (0, 0) if start == 0 else self._joint(out[:n], end, ids, start)
                back *= 2
            n = at[0] + len(ids) - at[1]
            out[at[0]:n], end = ids[at[1]:], stop
        return out[:n].astype("<i4").tobytes()

    def _learn(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """The encodings of pieces that are not in the cache."""
        short, long = [], []
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:  # a piece that is a token is that token
                yield piece, whole.to_bytes(4, "little")
            elif len(data) > _CUT:
                yield piece, self._merge_long(self.byte[np.frombuffer(data, np.uint8)])
            else:
                (short if len(data) < _LONG else long).append((piece, data))
        for words, query in ((short, _CONTRACT), (long, _CONTRACT_LONG)):
            for part in chunks(words, lambda x: len(x[1]), self.state):
                data = [x for _, x in part]
                flat = self.byte[np.frombuffer(b"".join(data), np.uint8)]
                for i, ids in self._fixpoint(range(len(part)), list(map(len, data)), flat, query):
                    yield part[i][0], ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache.encode(texts)

    def decimals(self, docs: list[np.ndarray]) -> Iterator[bytes]:
        """The ids of each list in decimals, joined by a space."""
        for some in chunks(docs, len, 4 * self.state):
            ends = np.cumsum([0, *map(len, some)]).astype(np.int32)
            names = self.names.take(pa.array(np.concatenate(some)))
            for line in pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names), pa.scalar(" ", pa.large_string())):
                yield line.as_buffer().to_pybytes()

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list; an id without a token raises."""
        most = 4 * self.state
        if any(len(x) > most for x in docs):  # a very long list goes in parts
            return [b"".join(self.decode([x[i:i + most]])[0] for i in range(0, len(x), most)) for x in docs]
        out = [b""] * len(docs)
        size = [len(x) for x in docs]
        flat = np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int32)
        self._table("tok", {"d": np.repeat(np.arange(len(docs), dtype=np.int32), size),
                            "p": np.arange(len(flat), dtype=np.int32), "id": flat})
        got = self.con.sql("SELECT d, unhex(string_agg(hex, '' ORDER BY p)) AS b, count(*) AS n "
                           "FROM tok JOIN vocabulary USING (id) GROUP BY d").to_arrow_table()
        for d, b, n in zip(got.column("d").to_pylist(), got.column("b").to_pylist(), got.column("n").to_pylist()):
            if n != size[d]:
                raise ValueError("an id is not in the vocabulary")
            out[d] = b
        return out


_OPEN: dict[tuple, Bpe] = {}


def _bpe(path: str, pattern: str, held: int = HELD, state: int = _STATE) -> Bpe:
    """This worker's database, opened once."""
    claim(__name__, _OPEN.clear)
    key = path, pattern, held, state
    if key not in _OPEN:
        _OPEN[key] = Bpe(read_ranks(path), pattern, held, state)
    return _OPEN[key]


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str, what: str, held: int, lean: bool) -> Iterator[pa.RecordBatch]:
    state = _LEAN if lean else _STATE
    bpe = _bpe(path, pattern, held, state)
    for batch in batches:
        for first, texts in text_chunks(batch.column(0), _CHUNK * state):
            ids = bpe.encode(texts)
            carried = batch.slice(first, len(texts)).columns[1:]
            counts = pa.array([len(x) for x in ids], pa.int64())
            if what == "ids":
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32))
                made = [pa.ListArray.from_arrays(pa.array(ends), flat), counts]
                names = ["ids", "n_tokens"]
            else:
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                decoded = [b for some in chunks(ids, len, 4 * state) for b in bpe.decode(some)]
                made = [counts, sha(bpe.decimals(ids)), sha(decoded)]
            yield pa.RecordBatch.from_arrays([*carried, *made], names=[*batch.schema.names[1:], *names])
    if lean:  # Spark's next task may go to another idle worker, which opens its own
        del bpe
        _OPEN.clear()
        give_back()


def _decode_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = _bpe(path, pattern)
    for batch in batches:
        rows = list(enumerate(np.array(x.as_py() or [], np.int32) for x in batch.column(0)))
        for part in chunks(rows, lambda r: len(r[1]), _CHUNK * _STATE):
            data = pa.array(bpe.decode([x for _, x in part]), pa.binary())
            carried = batch.slice(part[0][0], len(part)).columns[1:]
            yield pa.RecordBatch.from_arrays([*carried, data], names=[*batch.schema.names[1:], "decoded"])


def _schema(df: DataFrame, names: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in names), more])


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), digests: bool = False,
                     held: int = HELD, lean: bool = False) -> DataFrame:
    """The columns in ``carry``, ids (array of int) and n_tokens, a row for every row of ``docs``.

    The ids are those of the byte-level BPE whose rank file is at ``path``
    (a file every executor can read), each match of ``pattern`` merged by
    itself, without special tokens. With ``digests`` the ids are decoded again
    on the spot and only the SHA-256 of the ids in decimals and of the decoded
    bytes come back (ids_sha256, decoded_sha256) instead of the ids. ``held``
    bounds the words a worker remembers (see ``PieceEncoder``). ``lean`` works
    on smaller parts at a time and lets a worker return its memory after each
    task: for jobs that leave an executor little.

    Null and empty texts have no ids. Very long texts are handled by
    themselves. Repeated rows give repeated rows, an empty table none. Columns
    that are not carried are ignored; ids, n_tokens, ids_sha256 and
    decoded_sha256 cannot be carried.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    source = docs.select(F.col(text_col).alias("_text"), *carry)
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, n_tokens long"
    return source.mapInArrow(partial(_encode_rows, path=path, pattern=pattern, what="digests" if digests else "ids", held=held, lean=lean),
                             _schema(docs, list(carry), more))


def decode_ids(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry`` and decoded (binary); null ids decode to no bytes, an unknown id stops the job."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    source = encoded.select(F.col(ids_col).alias("_ids"), *carry)
    return source.mapInArrow(partial(_decode_rows, path=path, pattern=public_tokenizers.PATTERN),
                             _schema(encoded, list(carry), "decoded binary"))
