"""Intervals at points in time, by a sweep in one sorted pass.

Starts of intervals and questions are united, dealt by key and sorted by key and time. A
task reads them once and keeps a heap of the key's open intervals, the newest start on top.
A question first drops the intervals from the top that have ended; as time only goes on,
they never come back. What is then on top is the answer, so n starts and m questions cost
(n + m) log n, and a task holds no more than the open intervals of one key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


class Newest:
    """Turns the order of tie-break values round, so that the greatest comes first."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: Newest) -> bool:
        if self.value is None or other.value is None:
            return self.value is not None
        return self.value > other.value


def _sweep(schema: pa.Schema, end_inclusive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heap, count, open_facts = object(), [], 0, None
        for batch in batches:
            times, ends, ties = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_t", "_until", "_tie"))
            keys = batch.column(batch.schema.get_field_index("_by")).to_pylist()
            asked = batch.column(batch.schema.get_field_index("_left"))
            # facts stay in Arrow and go by their place: first the open ones of earlier batches, then the batch's own
            facts = batch.column(batch.schema.get_field_index("_right")).cast(schema.field("_right").type)
            before = 0 if open_facts is None else len(open_facts)
            if before:
                facts = pa.concat_arrays([open_facts, facts])
            places, found = [], []
            for i, is_question in enumerate(asked.is_valid().to_pylist()):
                if keys[i] != key:
                    key, heap = keys[i], []
                t = times[i]
                if is_question:
                    while heap and heap[0][3] is not None and (heap[0][3] < t or (heap[0][3] == t and not end_inclusive)):
                        heappop(heap)
                    places.append(i)
                    found.append(heap[0][4] if heap else None)
                else:
                    count += 1
                    heappush(heap, (-t, Newest(ties[i]), count, ends[i], before + i))
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(places, pa.int64())), facts.take(pa.array(found, pa.int64()))], schema=schema)
            open_facts = facts.take(pa.array([x[4] for x in heap], pa.int64()))
            heap = [(*x[:4], k) for k, x in enumerate(heap)]  # the order stays

    return run


def newest_open(left: DataFrame, history: DataFrame, by: str, at: str, *, start: str, end: str, end_inclusive: bool, tiebreak: str) -> DataFrame:
    """Each left row (key and date not null) with the newest interval of its key that is open at its date."""
    cols = [c for c in history.columns if c != by]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    right = F.struct(*cols)
    facts = history.where(F.col(start).isNotNull() & F.col(by).isNotNull()).select(
        F.col(by).alias("_by"), micros(start).alias("_t"), F.lit(0).alias("_turn"), micros(end).alias("_until"), F.col(tiebreak).alias("_tie"), right.alias("_right")
    )
    ask = left.select(F.col(by).alias("_by"), micros(at).alias("_t"), F.lit(1).alias("_turn"), F.struct(*left.columns).alias("_left"))
    both = facts.unionByName(ask, allowMissingColumns=True).repartition("_by").sortWithinPartitions("_by", "_t", "_turn")
    out = StructType([both.schema["_left"], both.schema["_right"]])
    swept = both.mapInArrow(_sweep(to_arrow_schema(out, timestamp_utc=True), end_inclusive), out)
    return swept.select("_left.*", *[F.col("_right")[c].alias(c) for c in cols])
