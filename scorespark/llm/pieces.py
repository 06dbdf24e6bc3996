"""Splitting of texts into the pieces that a byte-level BPE merges separately."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex


@functools.cache
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def split(text: str, pattern: str) -> list[str]:
    return compiled(pattern).findall(text)


def chunks(rows: list, size, limit: int) -> Iterator[list]:
    """Runs of ``rows`` whose sizes add up to about ``limit``: a long one stands alone."""
    held, total = [], 0
    for row in rows:
        n = size(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held


_WHITE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# a space beside other white space may belong to a longer piece
_ODD = rf"[{_WHITE}] | [{_WHITE}]|^ | \z"
# so may a line end
_ODD_LINE = rf"\n[{_WHITE}]|[{_WHITE}]\n|\n\z"
# white space in a word, but for a line end before it
_INNER = rf"(?s)^[\t\x0B-\r \x1C-\x1F\x85\p{{Z}}]|.[{_WHITE}]"


def text_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of a column of about ``limit`` bytes; only one run is held as Python strings."""
    size = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for rows in chunks(list(range(len(size))), size.__getitem__, limit):
        yield rows[0], [t or "" for t in column.slice(rows[0], len(rows)).to_pylist()]


HELD = 220_000


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one run after another."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


class Store:
    """Ids of strings, in columns: a bounded number of strings; when it is full, those not asked for lately go.

    ``learn`` takes different strings that are not held and returns how many ids each has, and all ids in order.
    """

    def __init__(self, limit: int, learn):
        self.limit, self.learn = limit, learn
        self.keys, self.flat = pa.array([], pa.large_string()), np.zeros(0, "<i4")
        self.size, self.used = np.zeros(0, np.int64), np.zeros(0, bool)
        self.hashes, self.place = np.zeros(0, np.int64), np.zeros(0, np.int32)  # sorted, and whose they are

    def _find(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each string is held, or -1, and its hash; equal hashes are no more than a hint."""
        hashes = np.fromiter(map(hash, wanted.to_numpy(zero_copy_only=False).tolist()), np.int64, len(wanted))
        found = np.full(len(wanted), -1, np.int64)
        if len(self.keys):
            order = np.argsort(hashes)
            near = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
            found[order] = np.where(self.hashes[near] == hashes[order], self.place[near], -1)
            hit = np.flatnonzero(found >= 0)
            same = pc.equal(self.keys.take(pa.array(found[hit])), wanted.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            found[hit[~same]] = -1
        return found, hashes

    def _keep(self, kept: np.ndarray) -> None:
        places, start = np.flatnonzero(kept), np.cumsum(self.size) - self.size
        self.flat = self.flat[spread(start[places], self.size[places])]
        self.keys, self.size, self.used = self.keys.take(pa.array(places)), self.size[places], np.zeros(len(places), bool)
        stay = kept[self.place]
        self.hashes, self.place = self.hashes[stay], (np.cumsum(kept, dtype=np.int32) - 1)[self.place[stay]]

    def _add(self, keys: pa.Array, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.place = np.insert(self.place, at, (len(self.keys) + order).astype(np.int32))
        self.keys = pa.concat_arrays([self.keys, keys.cast(pa.large_string())])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.ones(len(keys), bool)])

    def ids(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of different strings: how many ids each has, and all ids in order."""
        at, hashes = self._find(wanted)
        old = at >= 0
        self.used[at[old]] = True
        new = np.flatnonzero(~old)
        if len(new):
            keys = wanted.take(pa.array(new))
            size, flat = self.learn(keys)
            if len(self.keys) + len(new) > self.limit:
                kept = self.used.copy()
                if kept.sum() + len(new) > self.limit:
                    kept[:] = False
                    kept[at[old]] = True
                at[old] = (np.cumsum(kept) - 1)[at[old]]
                self._keep(kept)
            at[new] = len(self.keys) + np.arange(len(new))
            self._add(keys, hashes[new], size, flat)
        size = self.size[at]
        return size, self.flat[spread((np.cumsum(self.size) - self.size)[at], size)]


def is_solid(word: str) -> bool:
    """Without any white space, and not empty."""
    return word.isalnum() or word.split() == [word]


def split_words(words: list[str], pattern: str) -> list[list[str]]:
    """The pieces of each word behind a space."""
    return split_lines([" " + w for w in words], pattern)


def split_lines(lines: list[str], pattern: str) -> list[list[str]]:
    """The pieces of each text.

    In the public pattern a line end before a space or a word is a piece by
    itself, so texts without white space but for a space at the front are cut
    together, a line each.
    """
    cut = compiled(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return [cut(x) for x in lines]
    solid = [i for i, x in enumerate(lines) if is_solid(x.removeprefix(" "))]
    out: list[list[str]] = [[] for _ in lines]
    places = iter(solid)
    now = out[next(places)] if solid else []
    for piece in cut("\n".join([lines[i] for i in solid])):
        if piece == "\n":
            now = out[next(places)]
        else:
            now.append(piece)
    for i in set(range(len(lines))) - set(solid):
        out[i] = cut(lines[i])
    return out


class PieceEncoder:
    """Ids of texts from the ids of their pieces; what came lately is not encoded again.

    A space between two other characters always starts a piece, and in the
    public pattern a line end between them is one, so a text is first cut
    there, by Arrow, and equal words of a batch are one value; a word behind a
    line end keeps it. Only words that are not held are split into pieces, and
    only pieces that are not held are learnt: ``learn`` yields (piece,
    little-endian 32-bit ids as bytes). Where there is ``learn_words``, it
    gives the ids of whole words without white space (see ``Store``). No result
    depends on the stores; ``held`` bounds them: up to twice as many words and
    half as many pieces, some 50 bytes each.
    """

    def __init__(self, pattern: str, learn, held: int = HELD, learn_words=None):
        self.pattern, self.learn, self.learn_words = pattern, learn, learn_words
        self.words, self.pieces = Store(2 * held, self._words), Store(held // 2, self._learnt)

    def _learnt(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names = new.to_pylist()
        found = dict(self.learn(names))
        data = [found[x] for x in names]
        return np.fromiter(map(len, data), np.int64, len(data)) // 4, np.frombuffer(b"".join(data), "<i4")

    def _of_pieces(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each list of pieces has, and all ids in order."""
        coded = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        size, flat = self.pieces.ids(coded.dictionary)
        code = coded.indices.to_numpy()
        each, ends = size[code], np.cumsum([0, *map(len, cut)])
        so_far = np.concatenate([[0], np.cumsum(each)])
        return np.diff(so_far[ends]), flat[spread((np.cumsum(size) - size)[code], each)]

    def _words(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of words behind a space, or behind the line end they begin with."""
        if not self.learn_words:
            return self._of_pieces(self._cut(new.to_pylist()))
        odd = pc.match_substring_regex(new, _INNER)
        parts = self.learn_words(new.filter(pc.invert(odd))), self._of_pieces(self._cut(new.filter(odd).to_pylist()))
        kind, size = odd.to_numpy(zero_copy_only=False), np.zeros(len(new), np.int64)
        start = np.zeros(len(new), np.int64)
        for of_kind, behind, (n, _) in zip((~kind, kind), (0, len(parts[0][1])), parts):
            size[of_kind], start[of_kind] = n, behind + np.cumsum(n) - n
        return size, np.concatenate([parts[0][1], parts[1][1]])[spread(start, size)]

    def _cut(self, words: list[str]) -> list[list[str]]:
        if self.pattern != public_tokenizers.PATTERN:
            return split_words(words, self.pattern)
        cut = split_lines([w[1:] if w[:1] == "\n" else " " + w for w in words], self.pattern)
        return [["\n", *x] if w[:1] == "\n" else x for w, x in zip(words, cut)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        plain = pc.invert(pc.match_substring_regex(column, _ODD)).to_pylist()
        # a text's first word has no space before it
        whole = [t.partition(" ")[0] if ok else t for t, ok in zip(texts, plain)]
        head_size, heads = self._of_pieces(split_lines(whole, self.pattern))
        rest = pa.array([t.partition(" ")[2] if ok and " " in t else None for t, ok in zip(texts, plain)], pa.large_string())
        if self.pattern == public_tokenizers.PATTERN:
            rest = pc.if_else(pc.match_substring_regex(column, _ODD_LINE), rest, pc.replace_substring(rest, "\n", " \n"))
        lists = pc.split_pattern(rest, " ")
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        words = lists.flatten().dictionary_encode()
        size, flat = self.words.ids(words.dictionary)
        code = words.indices.to_numpy()
        count = size[code]
        tail = flat[spread((np.cumsum(size) - size)[code], count)]
        stop = np.concatenate([[0], np.cumsum(count)])
        head_stop = np.cumsum(head_size)
        out = []
        for x, y, a, b in zip((head_stop - head_size).tolist(), head_stop.tolist(), stop[ends[:-1]].tolist(), stop[ends[1:]].tolist()):
            out.append(np.concatenate([heads[x:y], tail[a:b]]) if b > a else heads[x:y])
        return out
