"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

Two equal passages of W bytes may start anywhere, but a difference cover D of
period v meets any two positions at the same offset below v. So it is enough
to sort the *cover suffixes* (places p with p mod v in D, 8 of 50), by their
first W - v + 1 bytes, bucket by bucket:

1. Cover ranks. The fingerprint of a cover suffix's first 51 bytes is its rank
   in fingerprint order (only equality matters, so any total order serves).
   A bucket is a range of that order and is sorted by itself; suffixes whose
   block occurs once in the corpus leave here.
2. Long ties. Suffixes that tie on their block are resolved by the ranks of
   the cover suffixes one period before and after: blocks are longer than the
   period, so three ranks decide equality of the whole context in which a
   passage through this suffix can lie. A context seen earlier marks all its
   passages as repeated; a tie whose contexts are all equal is settled.
3. Only passages through a tie with several contexts (near an edit or a text's
   end) are left. They are fingerprinted whole, sorted by bucket, and the
   first of each value stays.

Texts are packed into blocks of a few MB. A bucket gets one sorted, packed,
de-duplicated array of each block, and answers with bits in the same order, so
no row is made per position, a passage that a third of all documents share is
one entry a block, and no task holds more than a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, claim, give_back, mix64, shuffle_partitions

#: a difference cover modulo 50: every residue is a difference of two members
PERIOD, COVER = 50, np.array([0, 1, 3, 8, 17, 28, 32, 38])
_P = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20
_BLOCK_SCHEMA = "block long, ids binary, ends binary, data binary, carried binary"
_REPLY = "block long, bucket int, bits binary"


def is_cover(period: int, cover) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned values: differences, byte planes apart so that they compress."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return _pack(d.view(np.uint8).reshape(len(d), a.itemsize).T)


def _unpack_sorted(b: bytes, dtype) -> np.ndarray:
    flat = _unpack(b, np.uint8)
    size = np.dtype(dtype).itemsize
    d = np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(dtype).ravel()
    return np.cumsum(d, dtype=dtype)


# ---- blocks of texts ------------------------------------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pack (part, id, text, carried) rows into blocks, in id order inside a block (null ids first)."""
    claim(__name__, _CACHE.clear)
    held, size, seq = [], 0, 0

    def flush(part):
        nonlocal held, size, seq
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        ids = np.array([np.iinfo(np.int64).min if x[0] is None else x[0] for x in held], np.int64)
        ends = np.cumsum([len(x[1]) for x in held], dtype=np.int64)
        data, carried = (np.frombuffer(x, np.uint8) for x in (b"".join(x[1] for x in held), json.dumps([x[2] for x in held]).encode()))
        row = [(part << 32) | seq], [ids.tobytes()], [ends.tobytes()], [_pack(data)], [_pack(carried)]
        held, size, seq = [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])],
                                          names=["block", "ids", "ends", "data", "carried"])

    part = 0
    for batch in batches:
        for p, i, text, more in zip(*batch.columns):
            part, data = p.as_py(), (text.as_py() or "").encode()
            held.append((i.as_py(), data, more.as_py()))
            size += len(data)
            if size >= block_bytes:
                yield flush(part)
    if held:
        yield flush(part)


class _Block:
    """One block's texts with fingerprints of any places, made a segment at a time."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.data = _unpack(data, np.uint8)

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, pos, "right")

    def prints(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Fingerprints of the byte ranges [lo, hi), which are in order of lo and shorter than a few hundred bytes."""
        out = np.empty(len(lo), np.uint64)
        for a in range(0, len(self.data) + 1, _SEGMENT):
            i, j = np.searchsorted(lo, [a, a + _SEGMENT])
            if i == j:
                continue
            end = int(hi[i:j].max())
            size = end - a
            powers = _powers(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((self.data[a:end].astype(np.uint64) + np.uint64(1)) * powers[0][:size], dtype=np.uint64, out=sums[1:])
            l, h = lo[i:j] - a, hi[i:j] - a
            out[i:j] = mix64((sums[h] - sums[l]) * powers[1][l] + (h - l).astype(np.uint64))
        return out

    def cover(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover places with ``width`` bytes left in their text, and their text's number."""
        length = self.ends - self.starts
        count = np.maximum(0, -(-(length - width + 1) // PERIOD)) * len(COVER)
        doc = np.repeat(np.arange(len(length)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        place = (k // len(COVER)) * PERIOD + COVER[k % len(COVER)]
        ok = place + width <= length[doc]
        return (place + self.starts[doc])[ok], doc[ok]


_CACHE: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64 and of its inverse."""
    if "p" not in _CACHE or len(_CACHE["p"][0]) < n:
        size = max(n, _SEGMENT + 1024)
        made = []
        for x in (_P, pow(_P, -1, 1 << 64)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        _CACHE["p"] = tuple(made)
    return _CACHE["p"]


class _Params:
    """Lengths and widths that follow from the least length of a removed passage."""

    def __init__(self, min_bytes: int, buckets: int, rank_bytes: int):
        if min_bytes < 2 * PERIOD:
            raise ValueError(f"passages of fewer than {2 * PERIOD} bytes are not supported")
        self.w, self.buckets = min_bytes, buckets
        self.width = min_bytes - PERIOD + 1  # longer than the period
        self.rank_type = np.dtype(f"u{rank_bytes}")

    def split(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints' bucket (a range of the high bits) and the bounds of each bucket's run."""
        bucket = ((prints >> np.uint64(40)) * np.uint64(self.buckets)) >> np.uint64(24)
        present, first = np.unique(bucket.astype(np.int64), return_index=True)
        return present, np.append(first, len(prints))

    def low(self, prints: np.ndarray) -> np.ndarray:
        """A bucket's fingerprints shortened to the rank width: an ascending number inside the bucket's range."""
        bits = 8 * self.rank_type.itemsize
        if bits == 64:
            return prints
        # position inside the bucket's share of the range, to `bits` binary digits
        frac = prints.astype(np.float64) / 2.0**64 * self.buckets
        return np.minimum((frac - np.floor(frac)) * 2.0**bits, 2.0**bits - 1).astype(self.rank_type)


def _entries(block: _Block, par: _Params):
    """Pass 1: sorted distinct block fingerprints, whether each occurs twice here, and how places map to them."""
    place, doc = block.cover(par.width)
    rank = block.prints(place, place + par.width)
    values, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    return place, doc, rank, values, inverse, count


def _send_ranks(batches: Iterator[pd.DataFrame], par: _Params) -> Iterator[pd.DataFrame]:
    claim(__name__, _CACHE.clear)
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            *_, values, _, count = _entries(_Block(row.ids, row.ends, row.data), par)
            present, bounds = par.split(values)
            for b, i, j in zip(present, bounds[:-1], bounds[1:]):
                out.append((row.block, int(b), _pack_sorted(par.low(values[i:j])), np.packbits(count[i:j] > 1).tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["block", "bucket", "ranks", "twice"])


def _sort_ranks(pdf: pd.DataFrame, dtype) -> pd.DataFrame:
    """One bucket: which entries' ranks occur in another block too, or twice in their own."""
    claim(__name__, _CACHE.clear)
    parts = [_unpack_sorted(x, dtype) for x in pdf.ranks]
    merged = np.sort(np.concatenate(parts))
    again = np.unique(merged[1:][merged[1:] == merged[:-1]])
    bits = []
    for part, twice in zip(parts, pdf.twice):
        at = np.searchsorted(again, part)
        found = np.zeros(len(part), bool)
        inside = at < len(again)
        found[inside] = again[at[inside]] == part[inside]
        own = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(part)).astype(bool)
        bits.append(np.packbits(found | own).tobytes())
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket.astype("int32"), "bits": bits})


def _answers(replies: pd.DataFrame, values: np.ndarray, par: _Params, planes: int = 1) -> np.ndarray:
    """A block's answers from all buckets, in the order of its sorted fingerprints."""
    present, bounds = par.split(values)
    by = dict(zip(replies.bucket, replies.bits))
    out = np.zeros((planes, len(values)), bool)
    for b, i, j in zip(present, bounds[:-1], bounds[1:]):
        bits = np.frombuffer(by[int(b)], np.uint8).reshape(planes, -1)
        for p in range(planes):
            out[p, i:j] = np.unpackbits(bits[p], count=j - i).astype(bool)
    return out


def _contexts(block: _Block, par: _Params, replies: pd.DataFrame):
    """Pass 2: cover suffixes whose block occurs again, with rank, context and order."""
    place, doc, rank, values, inverse, _ = _entries(block, par)
    again = _answers(replies, values, par)[0][inverse]
    place, doc, rank = place[again], doc[again], rank[again]
    # the blocks one period before and after are cover suffixes too; at a text's ends they are shorter
    lo, hi = block.starts[doc], block.ends[doc]
    sides = []
    for shift in (-PERIOD, PERIOD):
        a = np.clip(place + shift, lo, hi)
        b = np.clip(place + shift + par.width, lo, hi)
        cut = (a - place - shift).astype(np.uint64) * np.uint64(_P)
        sides.append(block.prints(a, b) + cut)
    context = mix64(mix64(rank + sides[0]) * np.uint64(_P) + sides[1])
    order = np.lexsort((np.arange(len(rank)), context, rank))
    r, c = rank[order], context[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    entry = np.cumsum(new) - 1  # of each sorted suffix
    first = order[new]  # the earliest suffix of an entry
    return place, doc, order, entry, first, r[new], c[new]


def _send_contexts(batches: Iterator[pd.DataFrame], par: _Params) -> Iterator[pd.DataFrame]:
    claim(__name__, _CACHE.clear)
    for row, replies in _joined(batches):
        block = _Block(row.ids, row.ends, row.data)
        _, doc, _, _, first, rank, context = _contexts(block, par, replies)
        out, (present, bounds) = [], par.split(rank)
        for b, i, j in zip(present, bounds[:-1], bounds[1:]):
            out.append((row.block, int(b), _pack_sorted(rank[i:j]), _pack(context[i:j]), _pack(block.ids[doc[first[i:j]]])))
        if out:
            yield pd.DataFrame(out, columns=["block", "bucket", "ranks", "contexts", "ids"])


def _sort_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: which contexts occur in an earlier document, and which ranks have several contexts."""
    claim(__name__, _CACHE.clear)
    ranks = [_unpack_sorted(x, np.uint64) for x in pdf.ranks]
    size = [len(x) for x in ranks]
    rank, context = np.concatenate(ranks), np.concatenate([_unpack(x, np.uint64) for x in pdf.contexts])
    ids = np.concatenate([_unpack(x, np.int64) for x in pdf.ids])
    block = np.repeat(pdf.block.to_numpy(np.int64), size)
    order = np.lexsort((block, ids, context, rank))
    r, c = rank[order], context[order]
    same = (r[1:] == r[:-1]) & (c[1:] == c[:-1])
    covered, several = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    covered[order[1:]] = same
    run = np.cumsum(np.append(True, r[1:] != r[:-1])) - 1
    kinds = np.bincount(run, weights=np.append(True, ~same))
    several[order] = kinds[run] > 1
    bits, at = [], 0
    for n in size:
        bits.append(np.packbits(covered[at:at + n]).tobytes() + np.packbits(several[at:at + n]).tobytes())
        at += n
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket.astype("int32"), "bits": bits})


def _spread(block: _Block, place: np.ndarray, doc: np.ndarray, par: _Params) -> np.ndarray:
    """Starts of all passages that hold the cover suffix at ``place`` among the first bytes: a mask over the block."""
    lo = np.maximum(place - PERIOD + 1, block.starts[doc])
    hi = np.minimum(place, block.ends[doc] - par.w)
    lo, hi, size = lo[lo <= hi], hi[lo <= hi], len(block.data) + 1  # a text may be shorter than a passage
    return np.cumsum(np.bincount(lo, minlength=size) - np.bincount(hi + 1, minlength=size))[:-1] > 0


def _settled(block: _Block, par: _Params, ranks: pd.DataFrame, ties: pd.DataFrame):
    """Pass 3: passage starts known to be repeated, and those still open with their fingerprints."""
    place, doc, order, entry, first, rank, _ = _contexts(block, par, ranks)
    covered, several = _answers(ties, rank, par, planes=2)
    known = np.zeros(len(place), bool)
    known[order] = covered[entry]
    later = np.ones(len(place), bool)
    later[first] = False  # the same context stands earlier in this block
    known |= later
    tied = np.zeros(len(place), bool)
    tied[order] = several[entry]
    repeated = _spread(block, place[known], doc[known], par)
    still = np.flatnonzero(_spread(block, place[tied & ~known], doc[tied & ~known], par) & ~repeated)
    prints = block.prints(still, still + par.w)
    values, at, inverse = np.unique(prints, return_index=True, return_inverse=True)
    return repeated, still, values, at, inverse


def _send_open(batches: Iterator[pd.DataFrame], par: _Params) -> Iterator[pd.DataFrame]:
    claim(__name__, _CACHE.clear)
    for row, ranks, ties in _joined(batches, 2):
        block = _Block(row.ids, row.ends, row.data)
        _, still, values, at, _ = _settled(block, par, ranks, ties)
        ids = block.ids[block.doc_of(still[at])]
        out, (present, bounds) = [], par.split(values)
        for b, i, j in zip(present, bounds[:-1], bounds[1:]):
            out.append((row.block, int(b), _pack_sorted(values[i:j]), _pack(ids[i:j])))
        if out:
            yield pd.DataFrame(out, columns=["block", "bucket", "ranks", "ids"])


def _sort_open(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of whole passages: all but the earliest of each value are repeated."""
    claim(__name__, _CACHE.clear)
    prints = [_unpack_sorted(x, np.uint64) for x in pdf.ranks]
    size = [len(x) for x in prints]
    value, ids = np.concatenate(prints), np.concatenate([_unpack(x, np.int64) for x in pdf.ids])
    order = np.lexsort((np.repeat(pdf.block.to_numpy(np.int64), size), ids, value))
    covered = np.zeros(len(value), bool)
    covered[order[1:]] = value[order][1:] == value[order][:-1]
    bits, at = [], 0
    for n in size:
        bits.append(np.packbits(covered[at:at + n]).tobytes())
        at += n
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket.astype("int32"), "bits": bits})


def _whole_chars(data: np.ndarray, gone: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """``gone`` and the other bytes of UTF-8 characters that its runs [start, end) cut in two."""
    gone = gone.copy()
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    for a, b in edges.tolist():
        for at in range(a, max(a - 3, 0), -1):  # a character has four bytes at most
            if not inside(at):
                break
            gone[at - 1] = True
        for at in range(b, b + 3):
            if not inside(at):
                break
            gone[at] = True
    return gone


def _cut(batches: Iterator[pd.DataFrame], par: _Params, whole_chars: bool = False) -> Iterator[pd.DataFrame]:
    """Pass 4: remove the covered bytes of each text."""
    claim(__name__, _CACHE.clear)
    for row, ranks, ties, opens in _joined(batches, 3):
        block = _Block(row.ids, row.ends, row.data)
        repeated, still, values, _, inverse = _settled(block, par, ranks, ties)
        later = np.ones(len(still), bool)
        later[np.unique(inverse, return_index=True)[1]] = False
        repeated[still[_answers(opens, values, par)[0][inverse] | later]] = True
        mark = np.zeros(len(block.data) + par.w + 1, np.int32)
        starts = np.flatnonzero(repeated)
        mark[starts] += 1
        mark[starts + par.w] -= 1
        gone = np.cumsum(mark[:len(block.data)]) > 0
        out = []
        carried = json.loads(_unpack(row.carried, np.uint8).tobytes())
        for i, s, e, more in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), carried):
            g = gone[s:e]
            edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            cut = _whole_chars(block.data[s:e], g, edge) if whole_chars and len(edge) else g
            out.append((None if i == np.iinfo(np.int64).min else i, e - s, int(g.sum()), edge.tolist(),
                        block.data[s:e][~cut].tobytes(), more))
        frame = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept", "carried"])
        yield frame.astype({"id": "Int64"})


def _cut_last(batches: Iterator[pd.DataFrame], par: _Params, whole_chars: bool) -> Iterator[pd.DataFrame]:
    """``_cut``; its worker returns what it held, as Spark keeps idle workers beside the tasks of what comes next."""
    yield from _cut(batches, par, whole_chars)
    _CACHE.clear()
    give_back()


def _joined(batches: Iterator[pd.DataFrame], n: int = 1):
    """Each block's row with the answers it got in ``n`` rounds, as frames."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            got = []
            for k in range(n):
                rows = getattr(row, f"r{k}")
                rows = [] if rows is None else rows
                got.append(pd.DataFrame([(x["bucket"], x["bits"]) for x in rows], columns=["bucket", "bits"]))
            yield row, *got


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100,
                   carry: tuple[str, ...] = (), block_bytes: int = 2 << 20, bucket_bytes: int = 32 << 20,
                   rank_bytes: int | None = None, whole_chars: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row; spans are [start, end) byte ranges, kept the other bytes.

    The columns in ``carry`` (of types that JSON can hold) come along. With
    ``whole_chars`` kept also lacks the rest of characters that a span cuts in two.

    A byte goes if it is covered by a ``min_bytes`` long string that also
    starts earlier: in a smaller id, or earlier in the same text. Matches stay
    inside a text, and the input is judged, not what is left. Null texts count
    as empty; null ids come first in the order and come back as null; rows
    that repeat an id are ordered as they are packed (by text inside a block).
    Texts shorter than ``min_bytes`` keep all bytes. An empty table gives no
    rows. Other columns are ignored.

    ``rank_bytes`` is how much of a block fingerprint the first sorting gets;
    by default 4 bytes beyond the bucket, or 8 where the corpus has so many
    cover suffixes that more than 1 in 16 would agree by chance. Chance
    agreements only send suffixes on to the second sorting, which compares 64
    bits of the block and 64 of the context.
    """
    spark = docs.sparkSession
    keep = Staged(spark, "repeats")
    source = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("id"),
                         F.col(text_col).alias("text"), F.to_json(F.struct(*carry)).alias("carried") if carry else F.lit(None).cast("string"))
    blocks = keep(source.mapInArrow(partial(_blocks, block_bytes=block_bytes), _BLOCK_SCHEMA), "blocks")
    total = blocks.select(F.sum(F.expr("octet_length(data)"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), 4 * total // bucket_bytes)
    if rank_bytes is None:
        rank_bytes = 4 if 4 * total * len(COVER) // PERIOD < buckets << 28 else 8
    par = _Params(min_bytes, buckets, rank_bytes)

    def by_bucket(sent: DataFrame, sort) -> DataFrame:
        return sent.groupBy("bucket").applyInPandas(sort, _REPLY)

    def answered(*replies: DataFrame, last: bool = False) -> DataFrame:
        out = blocks if last else blocks.drop("carried")
        for k, r in enumerate(replies):
            rows = r.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"r{k}"))  # a row a bucket
            out = out.join(rows, "block", "left")
        return out

    sent = blocks.drop("carried").mapInPandas(partial(_send_ranks, par=par), "block long, bucket int, ranks binary, twice binary")
    dtype = par.rank_type
    ranks = keep(by_bucket(sent, lambda pdf: _sort_ranks(pdf, dtype)), "ranks")
    sent = answered(ranks).mapInPandas(partial(_send_contexts, par=par),
                                       "block long, bucket int, ranks binary, contexts binary, ids binary")
    ties = keep(by_bucket(sent, _sort_contexts), "ties")
    sent = answered(ranks, ties).mapInPandas(partial(_send_open, par=par), "block long, bucket int, ranks binary, ids binary")
    opens = keep(by_bucket(sent, _sort_open), "open")
    out = answered(ranks, ties, opens, last=True).mapInPandas(
        partial(_cut_last, par=par, whole_chars=whole_chars), "id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, carried string")
    kinds = dict(docs.dtypes)
    fields = F.from_json("carried", ", ".join(f"`{c}` {kinds[c]}" for c in carry)) if carry else F.lit(None)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept",
                      *[fields.getField(c).alias(c) for c in carry])
