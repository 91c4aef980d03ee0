"""Monotone sequences in Elias-Fano form, and an n-gram trie whose levels are such sequences.

A sequence of n ascending values keeps the low bits of each as they are and the high ones in
unary in a bit vector, about 2 + log2(universe / n) bits a value. Look-ups work on many
places at once.

The trie lies in one stretch of memory. Its upper level is the sequence of contexts, with the
quantised logarithm of each context's count; the monotone pointers say where the words behind
a context begin; the lower level holds those words with the quantised logarithm of their
smoothed probability. A word is stored relative to its context (place of the context times
the universe, plus the word), which makes the whole level ascend, and is found by the
successor of that number between the context's two pointers.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Quantised logarithms (base 10): code 0 is nothing, others are steps from LOW on.
LOW, STEP = -16.0, 0.004
WORD_BITS = 28


def quantise(x: np.ndarray) -> np.ndarray:
    return (np.round((np.log10(x) - LOW) / STEP) + 1).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """The numbers; 0 for code 0."""
    return np.where(code > 0, 10.0 ** (LOW + STEP * (code.astype(np.float64) - 1)), 0.0)


def _as_words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with one word to spare."""
    data = np.packbits(bits, bitorder="little").tobytes()
    return np.frombuffer(data + bytes(-len(data) % 8 + 8), "<u8")


class EliasFano:
    """Views over the parts of a sequence: n, bits of the low part, low, high, ones before each word of high."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[tuple[int, int], list[np.ndarray]]:
        """Header and arrays of ascending ``values`` under ``universe``."""
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        high = np.zeros(n + (universe >> bits) + 1, np.uint8)
        high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        words = _as_words(high)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype("<u4")
        return (n, bits), [_as_words(low), words, ones]

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        header, arrays = cls.parts(values, universe)
        return cls(*header, *arrays)

    @staticmethod
    def _place(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where in its word the bit of that rank among the word's ones is: halves are counted."""
        left, rank, at = words.copy(), rank.astype(np.uint8), np.zeros(len(words), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(left & np.uint64((1 << width) - 1))
            beyond = rank >= ones
            rank -= ones * beyond
            step = beyond * np.uint64(width)
            left >>= step
            at += step
        return at.astype(np.int64)

    def select1(self, i: np.ndarray) -> np.ndarray:
        """Where the i-th one of the high part is."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        return 64 * w + self._place(self.high[w], i - self.ones[w].astype(np.int64))

    def select0(self, i: np.ndarray) -> np.ndarray:
        zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones
        w = np.searchsorted(zeros, i, side="right") - 1
        return 64 * w + self._place(~self.high[w], i - zeros[w])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        w, shift = at >> 6, (at & 63).astype(np.uint64)
        value = (self.low[w] >> shift) | ((self.low[w + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return value & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [start, end) with a value of x or more (else end), and whether it is x."""
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        a = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) - high + 1, 0)
        stop = self.select0(high) - high  # values of that high part are in [a, stop)
        a, stop = np.clip(a, start, end), np.clip(stop, start, end)
        b = stop.copy()
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self._low(middle[open_]) < low[open_]
            a, b = np.where(open_ & less, middle + 1, a), np.where(open_ & ~less, middle, b)
        same = a < stop
        same[same] = self._low(a[same]) == low[same]
        return a, same


class NgramTrie:
    """The levels of a trie in one mapped stretch of memory."""

    def __init__(self, levels: bytes):
        self.memory = mmap.mmap(-1, max(1, len(levels)))
        self.memory.write(levels)
        sizes = np.frombuffer(self.memory, "<i8", 17)
        self.at = 17 * 8
        take = lambda n, kind: self._take(int(n), kind)
        self.contexts, self.pointers, self.words = (EliasFano(int(n), int(bits), take(low, "<u8"), take(high, "<u8"), take(ones, "<u4")) for n, bits, low, high, ones in sizes[:15].reshape(3, 5))
        self.counts, self.odds = take(sizes[15], "<u2"), take(sizes[16], "<u2")

    def _take(self, n: int, kind: str) -> np.ndarray:
        found = np.frombuffer(self.memory, kind, n, self.at)
        self.at += -(-found.nbytes // 8) * 8
        return found

    @staticmethod
    def build(contexts: np.ndarray, counts: np.ndarray, begins: np.ndarray, words: np.ndarray, odds: np.ndarray, context_bits: int) -> bytes:
        """Ascending contexts with quantised counts; the words of context k are begins[k] to begins[k + 1]."""
        n = len(contexts)
        relative = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(begins)) << np.uint64(WORD_BITS)) | words.astype(np.uint64)
        parts = [EliasFano.parts(v, u) for v, u in ((contexts, 1 << context_bits), (begins, len(words) + 1), (relative, max(1, n) << WORD_BITS))]
        arrays = [a for _, x in parts for a in x] + [counts.astype("<u2"), odds.astype("<u2")]
        sizes = [y for header, x in parts for y in (*header, *(len(a) for a in x))] + [len(counts), len(odds)]
        return np.array(sizes, "<i8").tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    def query(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the context's count and of the word's smoothed probability behind it; 0 where there is none."""
        counts, odds = np.zeros(len(contexts), np.uint16), np.zeros(len(contexts), np.uint16)
        if not self.contexts.n or not len(contexts):
            return counts, odds
        asked, back = np.unique(contexts, return_inverse=True)
        zero = np.zeros(len(asked), np.int64)
        place, there = self.contexts.successor(asked.astype(np.uint64), zero, zero + self.contexts.n)
        hit = np.nonzero(there[back])[0]
        if len(hit):
            known = np.nonzero(there)[0]
            begin, end = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
            begin[known], end[known] = self.pointers.access(place[known]).astype(np.int64), self.pointers.access(place[known] + 1).astype(np.int64)
            of = place[back[hit]]
            counts[hit] = self.counts[of]
            x = (of.astype(np.uint64) << np.uint64(WORD_BITS)) | words[hit].astype(np.uint64)
            child, same = self.words.successor(x, begin[back[hit]], end[back[hit]])
            odds[hit[same]] = self.odds[child[same]]
        return counts, odds
