"""The similarity kernel against plain dynamic programmes."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.functions import alike


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    m, n = len(a), len(b)
    found = max(ratio(a, b[max(0, i) : i + m]) for i in range(1 - m, n))
    return max(found, *(ratio(b, a[max(0, i) : i + m]) for i in range(1 - m, n))) if m == n else found


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    both = x & y
    if both and (both == x or both == y):
        return 1.0
    s = " ".join(sorted(both))
    sx, sy = (" ".join(filter(None, (s, " ".join(sorted(z - both))))) for z in (x, y))
    return max(ratio(sx, sy), *((ratio(s, sx), ratio(s, sy)) if s else (0.0,)))


def plain(a, b, mode):
    order = lambda x: " ".join(sorted(x.split()))
    return {"ratio": lambda: ratio(a, b), "token_sort": lambda: ratio(order(a), order(b)), "token_set": lambda: token_set(a, b), "partial": lambda: partial(a, b), "max": lambda: max(plain(a, b, m) for m in alike.MODES)}[mode]()


def test_ten_thousand_pairs():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé1 ") for _ in range(r.choice([0, 1, 5, 12, 30])))
    first = [word() for _ in range(10_000)]
    second = [r.choice([word(), a[: len(a) // 2] + word(), " ".join(reversed(a.split()))]) for a in first]
    for mode in (*alike.MODES, "max"):
        got = alike.scores(first, second, mode)
        assert got == pytest.approx([plain(a, b, mode) for a, b in zip(first, second, strict=True)], abs=1e-12), mode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=150), st.text("ab c", max_size=150)), max_size=6))
def test_long_strings_take_several_words(pairs):
    got = alike.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([ratio(a, b) for a, b in pairs], abs=1e-12)


def test_least_leaves_out_only_what_lies_below():
    first, second = ["goldman sachs", "abc", "xyz"], ["sachs and company of new york", "xabcx", "qqq"]
    whole, cut = alike.scores(first, second, "max"), alike.scores(first, second, "max", 0.9)
    assert np.all((cut == whole) | (whole < 0.9))
