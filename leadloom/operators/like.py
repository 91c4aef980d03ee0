"""Many LIKE patterns at once: an automaton over their literal parts.

Every pattern gives its longest run of plain characters. The runs of all patterns become one
automaton with failure links (Aho and Corasick), which finds all runs in a value by reading it
once; only patterns whose run occurs are then compared. The automaton is built once on the
driver and goes with the tasks, so the patterns are bounded, in number and in characters.
"""

from __future__ import annotations

import re
import sys
from collections import deque

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: Distinct patterns, and characters of all of them, that a join takes.
MOST_PATTERNS, MOST_CHARS = 100_000, 8_000_000


def parts(pattern: str, escape: str = "\\") -> list[str | None]:
    """The pattern as literal characters, '_' as None and '%' as an empty string."""
    out: list[str | None] = []
    it = iter(pattern)
    for c in it:
        if c == escape:
            c = next(it, "")
            if c not in ("_", "%", escape) or not c:
                raise ValueError(f"in {pattern!r} the escape character stands before something else than _, % or itself")
            out.append(c)
        else:
            out.append({"_": None, "%": ""}.get(c, c))
    return out


def longest_run(found: list[str | None]) -> str:
    runs, now = [""], ""
    for c in [*found, None]:
        if c:
            now += c
        else:
            runs.append(now)
            now = ""
    return max(runs, key=len)


class Patterns:
    """The automaton: per state the next states by character, the state to fall back to, and the patterns found."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        split = [parts(p) for p in patterns]
        self.tests = [re.compile("".join("." if c is None else ".*" if c == "" else re.escape(c) for c in x), re.DOTALL).fullmatch for x in split]
        self.always = [i for i, x in enumerate(split) if not longest_run(x)]
        self.next: list[dict[str, int]] = [{}]
        self.found: list[list[int]] = [[]]
        for i, x in enumerate(split):
            state = 0
            for c in longest_run(x):
                if c not in self.next[state]:
                    self.next.append({})
                    self.found.append([])
                    self.next[state][c] = len(self.next) - 1
                state = self.next[state][c]
            if state:
                self.found[state].append(i)
        self.back = [0] * len(self.next)
        #: The nearest state on the way back at which a pattern's run ends.
        self.hit = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, after in self.next[state].items():
                b = self.back[state]
                while b and c not in self.next[b]:
                    b = self.back[b]
                self.back[after] = self.next[b].get(c, 0) if self.next[b].get(c, 0) != after else 0
                queue.append(after)
            b = self.back[state]
            self.hit[state] = b if self.found[b] else self.hit[b]

    def matches(self, value: str) -> list[str]:
        state, seen = 0, set(self.always)
        reached = set()
        for c in value:
            while state and c not in self.next[state]:
                state = self.back[state]
            state = self.next[state].get(c, 0)
            at = state if self.found[state] else self.hit[state]
            while at and at not in reached:
                reached.add(at)
                seen.update(self.found[at])
                at = self.hit[at]
        return [self.patterns[i] for i in sorted(seen) if self.tests[i](value)]


def matched(value: Column, patterns: list[str]) -> Column:
    """All patterns that the value is LIKE, as an array; empty for null."""
    table = Patterns(patterns)

    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series([[] if v is None else table.matches(v) for v in values])

    return find(value)


def like_join(df: DataFrame, patterns: DataFrame, col: str, pattern: str, how: str = "inner") -> DataFrame:
    """Rows whose value is LIKE a row of the pattern table, in any case: 'inner', 'left_semi' or 'left_anti'.

    Null values and null patterns match nothing. Over `MOST_PATTERNS` patterns, or `MOST_CHARS`
    characters of them, are refused. What matched meets the pattern table by an equi-join.
    """
    upper = patterns.select(F.upper(pattern).alias("p")).where("p is not null").distinct()
    n, chars = upper.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    if n > MOST_PATTERNS or chars > MOST_CHARS:
        raise ValueError(f"{n} patterns of {chars} characters; a join takes {MOST_PATTERNS} of {MOST_CHARS}")
    told = df.withColumn("_found", matched(F.upper(F.col(col)), sorted(r.p for r in upper.collect())))
    if how == "left_semi":
        return told.where(F.size("_found") > 0).drop("_found")
    if how == "left_anti":
        return told.where(F.size("_found") == 0).drop("_found")
    if how != "inner":
        raise ValueError(f"no such join: {how}")
    each = told.withColumn("_found", F.explode("_found"))
    return each.join(patterns.withColumn("_pattern", F.upper(pattern)), F.col("_found") == F.col("_pattern")).drop("_found", "_pattern")
