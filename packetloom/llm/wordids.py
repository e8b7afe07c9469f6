"""Token ids of whole texts, pre-token by pre-token, over their bytes.

Texts of ASCII and of the Latin letters U+00C0 to U+00FF are lower-cased and cut into the vocabulary's pre-tokens as arrays. A pre-token
of at most 16 bytes is two 64-bit numbers, which are looked up in a hash table of arrays and compared whole; those not met before are merged
together. Stretches with any other character or with special tokens, and longer pre-tokens, are left to a slower encoder.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np

from packetloom.llm import textbytes
from packetloom.llm.tokencount import Merges

#: Distinct pre-tokens that a task remembers, about. The memory is emptied when it is full, which costs time, never ids.
REMEMBERED = 1_000_000

_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0xC3] = _LETTER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
#: Bytes after 0xC3 that make a letter (not the signs of multiplication and division), and a capital one.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_CAPITAL = _SECOND.copy()
_CAPITAL[0x9F:] = False
#: The first so many bytes of a little-endian number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PAD = bytes(16)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def flat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def pre_tokens(data: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether the slower encoder takes it) of the pre-tokens of texts that each end with a line feed, in order; stretches
    for the slower encoder are one each. Letters of ``lower``, a copy of ``data`` with a byte more at least, become small."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    second = lower[lead + 1]
    kind[lead[~_SECOND[second]]] = _OTHER
    kind[(lead + 1)[_SECOND[second]]] = _LETTER
    lower[: len(data)] = textbytes.LOWER[data]
    lower[(lead + 1)[_CAPITAL[second]]] += 0x20
    cut = np.empty(len(kind), bool)
    cut[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == _DIGIT
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(kind))
    kinds = kind[starts]
    # An apostrophe that stands alone before certain letters takes them.
    at = np.flatnonzero((ends - starts == 1) & (lower[starts] == ord("'")) & (np.append(kinds[1:], _BLANK) == _LETTER))
    if len(at):
        after = ends[at]
        one, two = lower[after], lower[after + 1]
        some = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
        some[(one == ord("l")) & (two == ord("l")) | ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 2
        ends[at] += some
        starts[at + 1] += some
    used = (kinds != _BLANK) & (starts < ends)
    starts, ends = starts[used], ends[used]
    slow = np.zeros(len(starts), bool)
    special = np.flatnonzero(data[:-1] == ord("<"))
    odd = np.concatenate([np.flatnonzero(kind == _OTHER), special[data[special + 1] == ord("|")]])
    if len(odd):
        blanks = np.flatnonzero(kind == _BLANK)
        stretch = np.unique(np.searchsorted(blanks, odd))
        low, high = np.where(stretch > 0, blanks[stretch - 1] + 1, 0), blanks[stretch]
        first, last = np.searchsorted(starts, low), np.searchsorted(starts, high)
        slow[first] = True
        ends[first] = high
        gone = flat_ranges(first + 1, last - first - 1)
        starts, ends, slow = np.delete(starts, gone), np.delete(ends, gone), np.delete(slow, gone)
    return starts, ends, slow


class Slower(Protocol):
    """Ids (little-endian, 16 bits) of any texts."""

    def encode(self, texts: list[str | None]) -> list[bytes]: ...


class WordIds:
    """Remembered ids of pre-tokens; the slower encoder gives those of stretches that are not plain."""

    def __init__(self, rules: Merges, encoder: Slower, remembered: int = REMEMBERED):
        self.rules, self.encoder, self.remembered = rules, encoder, remembered
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self._table(1 << 16)
        #: Of each number: where its ids start, and how many there are.
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.filled = np.zeros(1 << 18, np.uint16), 0

    def _table(self, slots: int) -> None:
        self.bits = np.uint64(64 - (slots.bit_length() - 1))
        self.one, self.two, self.number = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def _slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mixed = (one ^ two * _ODD[0]) * _ODD[1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD[2]
        return (mixed >> self.bits).view(np.int64)

    def _room(self, more: int) -> None:
        """Room for so many new pre-tokens."""
        slots = len(self.one)
        while (self.count + more) * 4 > slots * 3:
            slots *= 2
        if slots > len(self.one):
            held = np.flatnonzero(self.one)
            one, two, number = self.one[held], self.two[held], self.number[held]
            self._table(slots)
            self.number[self._found(one, two)[1]] = number

    def _found(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``one`` of pre-tokens that were new, the slot of each). New ones are entered and numbered in that order."""
        slot = np.zeros(len(one), np.int64)
        left, at, a, b = np.arange(len(one)), self._slots(one, two), one, two
        fresh: list[np.ndarray] = []
        number = self.count
        while len(left):
            empty = np.flatnonzero(self.one[at] == 0)
            if len(empty):
                # Of those that want one empty slot one gets it; equal ones then find it there.
                self.number[at[empty]] = empty
                won = empty[self.number[at[empty]] == empty]
                self.one[at[won]], self.two[at[won]] = a[won], b[won]
                self.number[at[won]] = number + np.arange(len(won))
                number += len(won)
                fresh.append(left[won])
            hit = (self.one[at] == a) & (self.two[at] == b)
            slot[left[hit]] = at[hit]
            miss = np.flatnonzero(~hit)
            left, at, a, b = left[miss], (at[miss] + 1) & (len(self.one) - 1), a[miss], b[miss]
        return np.concatenate(fresh) if fresh else np.zeros(0, np.int64), slot

    def _learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        count, filled = self.count + len(sizes), self.filled + len(ids)
        while len(self.first) < count:
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.ids) < filled:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : filled] = ids
        self.size[self.count : count] = sizes
        self.first[self.count : count] = self.filled + np.cumsum(sizes) - sizes
        self.count, self.filled = count, filled

    def ids_of(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of whole UTF-8 texts one after another, each closed with ``end``, numbers of ids)."""
        raw = b"\n".join([*texts, b""])
        data, lower = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw + _PAD), np.uint8)
        starts, ends, slow = pre_tokens(data, lower)
        length = ends - starts
        plain = ~slow & (length <= 16)
        if self.count > self.remembered:
            self._clear()
        self._room(len(starts))
        words = np.ndarray(len(data) + 1, "<u8", lower, strides=(1,))
        at, size = (starts, length) if plain.all() else (starts[plain], length[plain])
        one = words[at] & _MASK[np.minimum(size, 8)]
        two = words[np.minimum(at + 8, len(data))] & _MASK[np.clip(size - 8, 0, 8)]
        fresh, slot = self._found(one, two)
        if len(fresh):
            self._learn(*self.rules.merged_bytes(lower[flat_ranges(at[fresh], size[fresh])], size[fresh]))
        first, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        number = self.number[slot]
        first[plain], sizes[plain] = self.first[number], self.size[number]
        known = self.ids[: self.filled]
        others = np.flatnonzero(~plain)
        if len(others):
            read = [bytes(raw[a:b]) for a, b in zip(starts[others].tolist(), ends[others].tolist(), strict=True)]
            made = [np.frombuffer(x, "<u2") for x in self.encoder.encode([x.decode("utf-8") for x in read])]
            sizes[others] = np.fromiter(map(len, made), np.int64, len(made))
            first[others] = len(known) + np.cumsum(sizes[others]) - sizes[others]
            known = np.concatenate([known, *made])
        # An id more for the end of each text.
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, stops)]
        totals = np.diff(before, prepend=0) + 1
        out = np.full(int(totals.sum()), end, "<u2")
        inside = np.ones(len(out), bool)
        inside[np.cumsum(totals) - 1] = False
        out[inside] = known[flat_ranges(first, sizes)]
        return out, totals
