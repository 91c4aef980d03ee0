"""Poisson resampling by vectors of weights.

Each row has a weight in each resample, drawn from its key. `weighted_heads` finds, for every
resample, the rows of the highest scores that make up a share of its weight, without a row for
each weight: a task keeps, for each range of scores, the sums of the weights and of the weighted
outcomes of all resamples, as two vectors. Vectors of a range are added up; a resample then knows
the range in which its rank falls, and what lies below. The next pass reads the rows of such
ranges alone, with the resamples that look into them, and cuts each range again.

A pass brings at most `RANGES` vectors for each resample to the driver (some megabytes), and
moves as many for each task, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.sources.shared import forget, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

# Poisson(1) by its distribution function.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
# Modulus and multipliers of the hash that draws the weights.
MODULUS, MULTIPLIER, STRIDE = 2_147_483_647, 48_271, 69_621
#: Ranges that a pass cuts each open range into; rows whose weights a task draws at once.
RANGES, ROWS = 128, 1000


def weights(keys: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """The Poisson(1) weight of each row (down) in each resample (across), from its key."""
    k = np.mod(keys, MODULUS)[:, None]
    b = resamples[None, :]
    x = (k * MULTIPLIER + b * STRIDE + seed) % MODULUS
    x = (x * x % MODULUS * MULTIPLIER + k) % MODULUS
    x = (x * x + b) % MODULUS
    x = (x * x + seed) % MODULUS
    cuts = np.array([int(p * MODULUS) for p in POISSON])
    return np.searchsorted(cuts, x.ravel(), side="right").reshape(x.shape)


class Open:
    """A range of scores with the resamples whose rank falls into it."""

    def __init__(self, low: float, high: float, resamples: np.ndarray):
        self.low, self.high, self.resamples = low, high, resamples

    def place(self, scores: np.ndarray) -> np.ndarray:
        """The part of the range that a score lies in; ascending, the last part holds the highest score alone."""
        return np.minimum(np.floor((scores / 2 - self.low / 2) / (self.high / 2 - self.low / 2) * (RANGES - 1)), RANGES - 1).astype(np.int64)


def _sums(open_: list[Open], seed: int):
    """(range, part, low, high, vectors) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            keys, outcomes, scores = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            outcomes = np.nan_to_num(outcomes.astype(np.float64))
            for r, x in enumerate(open_):
                rows = np.nonzero((scores >= x.low) & (scores <= x.high))[0]
                for a in range(0, len(rows), ROWS):
                    some = rows[a : a + ROWS]
                    parts = x.place(scores[some]) if x.high > x.low else np.zeros(len(some), np.int64)
                    order = np.argsort(parts, kind="stable")
                    some, parts = some[order], parts[order]
                    w = weights(keys[some], x.resamples, seed).astype(np.float64)
                    at = np.nonzero(np.append(True, parts[1:] != parts[:-1]))[0]
                    n, pos = np.add.reduceat(w, at), np.add.reduceat(w * outcomes[some][:, None], at)
                    low, high = np.minimum.reduceat(scores[some], at), np.maximum.reduceat(scores[some], at)
                    for i, part in enumerate(parts[at].tolist()):
                        _add(held, (r, part), low[i], high[i], n[i], pos[i])
        yield _batch(held)

    return run


def _add(held: dict, key: tuple, low: float, high: float, n: np.ndarray, pos: np.ndarray) -> None:
    if key in held:
        x = held[key]
        x[0], x[1] = min(x[0], low), max(x[1], high)
        x[2] += n
        x[3] += pos
    else:
        held[key] = [low, high, n.copy(), pos.copy()]


SCHEMA = "r int, part int, low double, high double, n binary, pos binary"


def _batch(held: dict) -> pa.RecordBatch:
    keys = sorted(held)
    columns = [
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.float64()),
        pa.array([held[k][1] for k in keys], pa.float64()), *(pa.array([held[k][j].tobytes() for k in keys], pa.binary()) for j in (2, 3)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["r", "part", "low", "high", "n", "pos"])


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    held: dict = {}
    for r, part, low, high, n, pos in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        _add(held, (r, part), low, high, np.frombuffer(n), np.frombuffer(pos))
    return pa.Table.from_batches([_batch(held)])


def weighted_heads(rows: DataFrame, resamples: int, top: float, seed: int) -> list[tuple[float, float, float, float]]:
    """Of (k, y, s), for each resample: weight and weighted outcomes of all rows, and of the rows
    from the score on that holds the rank ceil((weight - 1) * (1 - top))."""
    total = np.zeros((resamples, 2))
    below = np.zeros((resamples, 2))
    rank = np.zeros(resamples)
    rows = written(rows.select("k", "y", "s"), "resampling")
    ends = rows.agg(F.min("s"), F.max("s")).first()
    open_ = [Open(*map(float, ends), np.arange(1, resamples + 1))] if ends[0] is not None else []
    first = True
    while open_:
        low, high = min(x.low for x in open_), max(x.high for x in open_)
        part = rows.where(f"s between {low!r} and {high!r}").mapInArrow(_sums(open_, seed), SCHEMA)
        found = sorted(part.groupBy("r", "part").applyInArrow(_merge, SCHEMA).collect())
        after: list[Open] = []
        for r, x in enumerate(open_):
            mine = [f for f in found if f.r == r]
            n, pos = (np.stack([np.frombuffer(f[c]) for f in mine]) for c in ("n", "pos"))
            who = x.resamples - 1
            if first:
                total[who] = np.stack([n.sum(0), pos.sum(0)], axis=1)
                rank[who] = np.ceil((total[who, 0] - 1) * (1 - top))
            upto = below[who, 0] + np.cumsum(n, axis=0)
            chosen = np.argmax(upto > rank[who], axis=0)
            chosen = np.where((upto > rank[who]).any(0), chosen, len(mine) - 1)
            before = np.arange(len(mine))[:, None] < chosen
            below[who] += np.stack([(n * before).sum(0), (pos * before).sum(0)], axis=1)
            for c in np.unique(chosen):
                if mine[c].low < mine[c].high:
                    after.append(Open(mine[c].low, mine[c].high, x.resamples[chosen == c]))
        open_, first = after, False
    forget(rows)
    return [(float(n), float(pos), float(n - b), float(pos - q)) for (n, pos), (b, q) in zip(total, below, strict=True)]
