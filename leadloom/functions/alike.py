"""How alike two strings are: ratios of insertions and deletions, many pairs at a time.

The ratio of two strings is 2 * LCS / (sum of lengths), LCS being the length of their longest
common subsequence: a replaced character counts as one deleted and one inserted. The LCS of
many pairs is found at once, bit-parallel: for each pair a word of bits (or several) holds a
column of the dynamic programme, and a step takes the next character of the second string.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

MODES = ("ratio", "token_sort", "token_set", "partial")
#: Places of the second strings that one step of the kernel holds.
CHUNK = 1 << 21


class Pairs:
    """Code points of pairs of strings as numbers from 1, padded with 0, and the masks of the first ones."""

    def __init__(self, first: list[str], second: list[str]):
        self.m, self.n = (np.array([len(x) for x in side], np.int64) for side in (first, second))
        points = np.frombuffer("".join(first + second).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, codes = np.unique(points, return_inverse=True)
        codes = (codes + 1).astype(np.int32)
        self.first, self.second = self._padded(codes[: self.m.sum()], self.m), self._padded(codes[self.m.sum() :], self.n)
        words = max(1, -(-int(self.m.max(initial=0)) // 64))
        self.masks = np.zeros((words, len(first), len(alphabet) + 1), np.uint64)
        for j in range(self.first.shape[1]):
            rows = np.nonzero(self.m > j)[0]
            self.masks[j // 64, rows, self.first[rows, j]] |= np.uint64(1 << (j % 64))

    @staticmethod
    def _padded(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int32)
        out[np.arange(out.shape[1]) < lengths[:, None]] = codes
        return out

    def lcs(self, who: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """LCS of the first string of each pair in ``who`` and a stretch of its second string."""
        found = np.zeros(len(who), np.int64)
        longest = int(size.max(initial=0))
        step = max(1, CHUNK // max(1, longest))
        for a in range(0, len(who), step):
            w, s, z = who[a : a + step], start[a : a + step], size[a : a + step]
            state = [np.full(len(w), ~np.uint64(0)) for _ in self.masks]
            for j in range(int(z.max(initial=0))):
                inside = j < z
                codes = np.where(inside, self.second[w, np.minimum(s + j, self.second.shape[1] - 1)], 0)
                carry = np.zeros(len(w), np.uint64)
                for k, masks in enumerate(self.masks):
                    v = state[k]
                    u = v & masks[w, codes]
                    total = v + u
                    over = total < u
                    total += carry
                    carry = (over | (total < carry)).astype(np.uint64)
                    state[k] = total | (v & ~u)
            for k, v in enumerate(state):
                bits = np.clip(self.m[w] - 64 * k, 0, 64)
                mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
                found[a : a + step] += np.bitwise_count(~v & mask).astype(np.int64)
        return found


def _halves(lcs: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * lcs / np.maximum(total, 1), 1.0)


def _in_chunks(f):
    """Run a function of two lists over slices, so that the masks of a slice stay small."""

    def run(first: list[str], second: list[str], *more) -> np.ndarray:
        cut = 20_000
        parts = [f(first[i : i + cut], second[i : i + cut], *(x[i : i + cut] for x in more)) for i in range(0, len(first), cut)]
        return np.concatenate(parts) if parts else np.empty(0)

    return run


@_in_chunks
def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """2 * LCS / (sum of lengths); 1 for two empty strings."""
    p = Pairs(first, second)
    return _halves(p.lcs(np.arange(len(first)), np.zeros(len(first), np.int64), p.n), p.m + p.n)


@_in_chunks
def partial_ratios(first: list[str], second: list[str], least: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter string and a stretch of the longer one: of its length, or shorter
    at either end; of two equally long ones, either may be cut. Pairs that cannot exceed ``least``
    by the LCS of the whole strings give 0."""
    found = np.zeros(len(first))
    swap = [len(a) > len(b) for a, b in zip(first, second, strict=True)]
    short, long = [b if s else a for a, b, s in zip(first, second, swap, strict=True)], [a if s else b for a, b, s in zip(first, second, swap, strict=True)]
    p = Pairs(short, long)
    everyone = np.arange(len(short))
    whole = p.lcs(everyone, np.zeros(len(short), np.int64), p.n)
    # a stretch shorter than the short string holds at most itself in common, so the bound is for any stretch
    bound = np.where(p.m > 0, 2 * whole / np.maximum(p.m + whole, 1), (p.n == 0) * 1.0)
    found[p.m == 0] = bound[p.m == 0]
    rows = np.nonzero((bound > least) & (p.m > 0))[0]
    _stretches(p, rows, found)
    equal = rows[p.m[rows] == p.n[rows]]
    if len(equal):
        turned = Pairs([long[i] for i in equal], [short[i] for i in equal])
        other = np.zeros(len(equal))
        _stretches(turned, np.arange(len(equal)), other)
        found[equal] = np.maximum(found[equal], other)
    return found


def _stretches(p: Pairs, rows: np.ndarray, found: np.ndarray) -> None:
    m, n = p.m[rows], p.n[rows]
    counts = n + m - 1  # places of a window of m over n, ends included
    for part in np.array_split(np.arange(len(rows)), max(1, int(counts.sum()) // 400_000 + 1)):
        c = counts[part]
        who = np.repeat(part, c)
        at = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) - (m[who] - 1)
        start, end = np.maximum(at, 0), np.minimum(at + m[who], n[who])
        scores = 2 * p.lcs(rows[who], start, end - start) / (m[who] + end - start)
        if len(part):
            found[rows[part]] = np.maximum.reduceat(scores, np.cumsum(c) - c)


def _tokens(x: str) -> list[str]:
    return sorted(x.split())


def token_set_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """The best pair among the shared tokens alone and each side's tokens with the shared ones
    first, all sorted; 1 if one side's tokens lie within the other's."""
    sides: list[tuple[str, str, str]] = []
    within = np.zeros(len(first), bool)
    sets = {x: frozenset(x.split()) for x in {*first, *second}}
    for k, (a, b) in enumerate(zip(first, second, strict=True)):
        both = sets[a] & sets[b]
        within[k] = bool(both) and len(both) in (len(sets[a]), len(sets[b]))
        shared = " ".join(sorted(both))
        sides.append((shared, *(" ".join(filter(None, (shared, " ".join(sorted(sets[x] - both))))) for x in (a, b))))
    shared, left, right = ([s[i] for s in sides] for i in range(3))
    some = np.array([s != "" for s in shared])
    # the shared tokens begin the longer side, so all of them are in common
    n, l, r = (np.array([len(x) for x in side]) for side in (shared, left, right))
    alone = np.where(some, np.maximum(_halves(n, n + l), _halves(n, n + r)), 0.0)
    return np.where(within, 1.0, np.maximum(ratios(left, right), alone))


def scores(first: list[str], second: list[str], mode: str, least: float = 0.0) -> np.ndarray:
    """One of `MODES`, or 'max' of all four, in which partial ratios that cannot win are left out."""
    if mode == "ratio":
        return ratios(first, second)
    if mode == "token_sort":
        in_order = {x: " ".join(_tokens(x)) for x in {*first, *second}}
        return ratios([in_order[x] for x in first], [in_order[x] for x in second])
    if mode == "token_set":
        return token_set_ratios(first, second)
    if mode == "partial":
        return partial_ratios(first, second, np.full(len(first), -1.0))
    best = np.maximum.reduce([scores(first, second, m) for m in MODES[:3]])
    return np.maximum(best, partial_ratios(first, second, np.maximum(best, least)))


def similarity(a: Column, b: Column, mode: str = "ratio", least: float = 0.0) -> Column:
    """0 to 1: 'ratio', 'token_sort', 'token_set', 'partial' or 'max' of the four, in lower case;
    0 if one is null. With 'max', results below ``least`` may leave the partial ratio out."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = np.zeros(len(x))
        if there.any():
            lower = lambda s: [v.lower() for v in s[there]]
            out[there] = scores(lower(x), lower(y), mode, least)
        return pd.Series(out)

    return score(a, b)
