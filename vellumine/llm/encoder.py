"""Token ids of Arrow text columns with a public tokenizer, each distinct word encoded once.

The pre-tokenizer of a byte-level BPE starts a new piece wherever white space follows other text, so a text cut before
each run of spaces and newlines can be encoded part by part. Where its own pattern is in use, a piece also ends between a letter
or digit and a punctuation mark, so words are one part with or without a mark behind them. Parts are found by a 64-bit hash in a
table of bounded size, which holds their bytes and ids; the bytes are compared, so a hash decides nothing alone. A text with any
other white space (tabs, no-break spaces), with an added token, with a part of over 4,000 bytes, or with one whose hash another
part has, is encoded whole. A tokenizer whose pieces cross white space is an error.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vellumine.llm.common import held
from vellumine.llm.words import _BYTE, _PLACE, _class, mixed, offsets

#: Entries of the table of known parts; at the bound it is emptied and begun anew.
KNOWN = 750_000
#: Letters and digits, and marks, of ASCII.
_LETTER, _MARK = _class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)]), _class([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])


def encoder(path: str, end: int | None) -> Encoder:
    """This process's encoder: a worker keeps its table of known parts from task to task."""
    return held(("encoder", path, end), lambda: Encoder(path, end))


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out


class Encoder:
    def __init__(self, path: str, end: int | None, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.known = end, known
        pre = self.tokenizer.pre_tokenizer
        self.marks = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = self._byte_lengths()
        self._clear()

    def _byte_lengths(self) -> np.ndarray:
        """Bytes of text of each id: in byte-level BPE a character of the vocabulary stands for a byte; an added token for itself."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        out = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            out[i] = len(token.encode()) if token in added else len(token)
        return out

    def _clear(self) -> None:
        from pandas._libs.hashtable import UInt64HashTable, UInt64Vector

        self.table, self.vector = UInt64HashTable(1 << 16), UInt64Vector
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.at, self.n = np.zeros(1 << 14, dtype=np.uint32), np.zeros(1 << 14, dtype=np.uint16)  # of part i: ids[at[i]:at[i] + n[i]]
        self.raw, self.raw_at, self.size = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 14, dtype=np.uint32), np.zeros(1 << 14, dtype=np.uint16)
        self.count = self.filled = self.raw_filled = 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets, which take as long again

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(texts, ids one after another, ids of each) of runs of texts, in order."""
        off = offsets(texts)
        base = int(off[0])
        if off[-1] == base:
            data = np.zeros(0, dtype=np.uint8)
        else:
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=int(off[-1]) - base, offset=base)
        off = off - base
        odd = self._odd(data, off)
        lo = 0
        for hi in [*np.flatnonzero(odd).tolist(), len(texts)]:
            if hi > lo:
                yield hi - lo, *self._parts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            if hi < len(texts):
                ids = self._whole(texts[hi].as_py()) + ([] if self.end is None else [self.end])
                yield 1, np.array(ids, dtype=np.uint32), np.array([len(ids)])
            lo = hi + 1

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        space = (data == 32) | (data == 10)
        new = space.copy()
        new[1:] &= ~space[:-1]
        if self.marks:
            mark = np.flatnonzero(_MARK[data[1:]]) + 1
            before = data[mark - 1]
            # letters of two bytes with the lead 0xC3 are all but the signs of multiplication and division
            latin = (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7) & (data[mark - 2] == 0xC3) & (mark > 1)
            new[mark[_LETTER[before] | latin]] = True
        new[off[:-1][off[:-1] < len(data)]] = True
        return np.flatnonzero(new)

    def _odd(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts with white space that isn't a space or newline, or with a very long part."""
        if not len(data):
            return np.zeros(len(off) - 1, dtype=bool)
        at = [np.flatnonzero((data == 9) | ((data >= 11) & (data <= 13)) | ((data >= 28) & (data <= 31)))]
        second, third = np.append(data[1:], 0), np.append(data[2:], (0, 0))[: len(data)]
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            i = np.flatnonzero(data == lead)
            b, c = second[i], third[i]
            if lead == 0xC2:
                i = i[(b == 0x85) | (b == 0xA0)]
            elif lead == 0xE2:
                i = i[((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))]
            else:
                i = i[(b == 0x9A) & (c == 0x80)] if lead == 0xE1 else i[(b == 0x80) & (c == 0x80)]
            at.append(i)
        start = self._starts(data, off)
        at.append(start[np.diff(np.append(start, len(data))) > 4000])
        raw = data.tobytes()
        at.append(np.array([m.start() for token in self.added for m in re.finditer(re.escape(token), raw)], dtype=np.int64))
        texts = np.searchsorted(off, np.concatenate(at), side="right") - 1
        return _marked(len(off) - 1, texts)

    def _parts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self._starts(data, off)
        size = np.diff(np.append(start, len(data)))
        first = np.searchsorted(start, off)
        if len(start):
            place = np.arange(len(data)) - np.repeat(start, size)
            h = mixed(np.add.reduceat(_BYTE[data] * _PLACE[place], start) + size.astype(np.uint64))
            if self.count + len(h) > self.known and self.count + len(np.unique(h[self.table.lookup(h) < 0])) > self.known:
                self._clear()
            label = self._labels(h, data, start, size)
            if not self._same(label, data, place, size):
                return self._each_whole(data, off)
        else:
            label = np.zeros(0, dtype=np.int64)
        n = self.n[label].astype(np.int64)
        if self.end is not None:
            label, n = np.insert(label, first[1:], -1), np.insert(n, first[1:], 1)
            first = first + np.arange(len(first))
        total = np.concatenate(([0], np.cumsum(n)))
        take = np.arange(total[-1]) + np.repeat(np.where(label < 0, 0, self.at[label].astype(np.int64)) - total[:-1], n)
        if self.end is not None:
            ends = total[first[1:]] - 1
            take[ends] = 0
        ids = self.ids[take]
        if self.end is not None:
            ids[ends] = self.end
        return ids, np.diff(total[first])

    def _same(self, label: np.ndarray, data: np.ndarray, place: np.ndarray, size: np.ndarray) -> bool:
        """Are the parts those that the table has under their labels, byte for byte?"""
        return bool((self.size[label] == size).all()) and bool((self.raw[place + np.repeat(self.raw_at[label].astype(np.int64), size)] == data).all())

    def _each_whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = [] if self.end is None else [self.end]
        found = [self._whole(data[a:b].tobytes().decode()) + end for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def _labels(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        before = self.count
        label = self.table.get_labels(h, self.vector(), before, -1)
        label = label.astype(np.int64)
        self.count = before + int(max(0, label.max() + 1 - before))
        if self.count > before:
            new = np.full(self.count - before, -1, dtype=np.int64)
            fresh = np.flatnonzero(label >= before)[::-1]
            new[label[fresh] - before] = fresh  # the first place of each new part
            self._learn(data, start[new], size[new])
        return label

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encodes new parts as one text: those from a mark to a letter or digit, then those that begin with white space; the others each for itself."""
        last = data[start + size - 1]
        inner = _MARK[data[start]] & _LETTER[last] if self.marks else np.zeros(len(start), dtype=bool)
        joins = ((data[start] == 32) | (data[start] == 10)) & (last != 32) & (last != 10)
        lo = self.count - len(start)
        while len(self.at) < self.count:
            self.at, self.n = np.append(self.at, np.zeros_like(self.at)), np.append(self.n, np.zeros_like(self.n))
            self.raw_at, self.size = np.append(self.raw_at, np.zeros_like(self.raw_at)), np.append(self.size, np.zeros_like(self.size))
        upto = np.cumsum(size)
        while len(self.raw) < self.raw_filled + int(upto[-1]):
            self.raw = np.append(self.raw, np.zeros_like(self.raw))
        self.raw[self.raw_filled : self.raw_filled + int(upto[-1])] = data[np.arange(upto[-1]) + np.repeat(start - upto + size, size)]
        self.raw_at[lo : self.count], self.size[lo : self.count] = self.raw_filled + upto - size, size
        self.raw_filled += int(upto[-1])
        at = np.concatenate((np.flatnonzero(inner), np.flatnonzero(joins)))
        if len(at):
            upto = np.cumsum(size[at])
            body = data[np.arange(upto[-1]) + np.repeat(start[at] - upto + size[at], size[at])].tobytes()
            ids = np.array(self._whole(body.decode()), dtype=np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(ends, upto) + 1
            if ends[-1] != len(body) or (ends[cut - 1] != upto).any():
                raise ValueError("a piece of the tokenizer crosses the cut of a text")
            self._keep(lo + at, ids, np.diff(cut, prepend=0))
        other = np.flatnonzero(~joins & ~inner)
        if len(other):
            texts = [data[a : a + k].tobytes().decode() for a, k in zip(start[other].tolist(), size[other].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(lo + other, np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found]))

    def _keep(self, label: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        while len(self.ids) < self.filled + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.at[label], self.n[label] = self.filled + np.cumsum(n) - n, n
        self.filled += len(ids)
