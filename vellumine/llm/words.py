"""Words of Arrow text columns as numpy arrays: byte tables and 64-bit hashes, for the operators that look at every word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; the arrays made of them take about 60 times that.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(word: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in word:
        out[a : b + 1] = True
    return out


#: Digits, letters and all of the bytes of characters beyond ASCII.
ALNUM = _class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: All but space and tab to carriage return.
NOT_SPACE = ~_class([(0x20, 0x20), (0x09, 0x0D)])

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_TURN = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of some texts: `data` holds the lower-cased bytes, word i is data[start[i]:end[i]], text t has words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        n = self.end - self.start
        if not len(n):
            return np.zeros(0, dtype=np.uint64)
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64)
        place -= np.repeat(at, n)
        bytes_ = self.data[place + np.repeat(self.start, n)]
        return mixed(np.add.reduceat(_BYTE[bytes_] * _PLACE[place & 4095], at) + n.astype(np.uint64))

    def raw(self, i: int, k: int) -> bytes:
        """Words i to i + k, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + k], self.end[i : i + k], strict=True))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words each; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * _TURN[j % 64]
    return mixed(out)


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same, only for those that start at `at`."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out += h[at + j] * _TURN[j % 64]
    return mixed(out)


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes each; at least one row."""
    off = offsets(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array without nulls: a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.fill_null("") if texts.null_count else texts


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another, and where each begins."""
    off = offsets(texts)
    base, top = int(off[0]), int(off[-1])
    if top == base:
        return np.zeros(0, dtype=np.uint8), off - base
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=top - base, offset=base), off - base


def words(texts: pa.Array, table: np.ndarray) -> Words:
    return _words(*_bytes(texts), table)


def long_text(text: pa.Array, table: np.ndarray, shared: int, size: int = PIECE) -> Iterator[tuple[int, Words]]:
    """One text in parts of about `size` bytes, cut between words, so that memory doesn't grow with the text: (number of words
    before the part, words). Each part begins with the last `shared` words of the one before. A word is never cut."""
    data, _ = _bytes(text)
    begin = before = 0
    cut = 0
    while cut < len(data):
        cut = min(cut + size, len(data))
        while cut < len(data):  # to the end of the word
            ahead = np.flatnonzero(~table[data[cut : cut + 4096]])
            cut += int(ahead[0]) if len(ahead) else min(4096, len(data) - cut)
            if len(ahead):
                break
        w = _words(data[begin:cut], np.array([0, cut - begin]), table)
        yield before, w
        if cut < len(data):
            kept = min(shared, len(w))
            before += len(w) - kept
            begin = begin + int(w.start[-kept]) if kept else cut


def is_long(texts: pa.Array, lo: int, hi: int) -> bool:
    """Of a range of `pieces`: is it a single text that is better taken in parts?"""
    return hi - lo == 1 and int(np.diff(offsets(texts.slice(lo, 1)))[0]) > 4 * PIECE


def _words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), none, none, np.zeros(len(off), dtype=np.int64))
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False  # a text ends a word
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = off[1:] - 1
    after[edges[edges >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(_LOWER[data], start, end, np.searchsorted(start, off))
