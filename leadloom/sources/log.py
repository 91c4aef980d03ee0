"""An append-only log of runs, in which a run is there once and whole, or not at all.

The rows of a run are written to a folder of their own. A marker, written last and never
changed, holds the number of rows and a checksum of them, whatever their order; only runs with
a marker are read. A run that failed midway has none, and its folder is overwritten by the
next attempt. A run that comes again with the same rows adds nothing; with others it is refused.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _folder(run: str) -> str:
    return hashlib.sha256(run.encode()).hexdigest()[:32]


def _content(rows: DataFrame) -> dict[str, str | int]:
    """Rows and an order-free checksum: the sum of the rows' hashes, each of two halves."""
    h = F.xxhash64(*rows.columns)
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in (("a", F.shiftrightunsigned(h, 32)), ("b", h.bitwiseAND(F.lit(0xFFFFFFFF))))]).first()
    return {"rows": one.n, "checksum": f"{one.a:x}-{one.b:x}"}


def _marker(spark: SparkSession, path: str, run: str) -> dict | None:
    fs, as_path = _file_system(spark, path)
    where = as_path(f"{path}/commits/{_folder(run)}.json")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def append_run(rows: DataFrame, path: str, run: str) -> bool:
    """Add the rows of a run; False if they are there already."""
    spark = rows.sparkSession
    content = _content(rows)
    if (before := _marker(spark, path, run)) is not None:
        if {k: before[k] for k in content} != content:
            raise ValueError(f"run {run} is in the log with other rows")
        return False
    folder = f"{path}/runs/{_folder(run)}"
    rows.write.mode("overwrite").parquet(folder)
    if _content(spark.read.schema(rows.schema).parquet(folder)) != content:
        raise RuntimeError(f"the rows of run {run} changed while they were written")
    fs, as_path = _file_system(spark, path)
    fs.mkdirs(as_path(f"{path}/commits"))
    draft, marker = as_path(f"{path}/commits/.{_folder(run)}"), as_path(f"{path}/commits/{_folder(run)}.json")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"run": run, **content}).encode()))
    stream.close()
    if not fs.rename(draft, marker):
        raise RuntimeError(f"run {run} could not be committed")
    return True


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed runs."""
    fs, as_path = _file_system(spark, path)
    commits = as_path(f"{path}/commits")
    names = sorted(s.getPath().getName().removesuffix(".json") for s in fs.listStatus(commits)) if fs.exists(commits) else []
    parts = [spark.read.schema(schema).parquet(f"{path}/runs/{name}") for name in names if not name.startswith(".")]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
