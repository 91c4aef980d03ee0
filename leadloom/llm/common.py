"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: Where a task holds many times the bytes of its texts.
SMALL_BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers where their path does not hold it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root:
        return
    folder = Path(tempfile.mkdtemp(prefix="leadloom-"))
    with zipfile.ZipFile(folder / "leadloom.zip", "w") as out:
        for path in sorted((root / "leadloom").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(folder / "leadloom.zip"))


_HELD: dict = {}


def resident(key: tuple, make):
    """A model that a Python worker keeps between tasks; another one takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the texts that one Arrow batch brings into a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="leadloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The driver's file system deletes the folder when it ends, if nothing did before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


#: Spark's setting that deletes the shuffles of a query when it ends.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANS, None)
    spark.conf.set(_CLEANS, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANS) if before is None else spark.conf.set(_CLEANS, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. The shuffles of the write go
    when it ends; the table goes by `forget`, at the end of `passing`, or with the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    _deleted_at_exit(spark, path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete what `written` wrote, once nothing reads it any more."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """All tables written inside go at the end, but for the last one, which is the result."""
    start = len(_MADE)
    yield
    for folder in _MADE[start:-1]:
        _delete(spark, folder)
    del _MADE[start:-1]


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """Each name with as many _ before it as keep it apart from the columns."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


#: A key is hot from this share of all rows on, so there are at most as many hot keys.
HOT = 1000


def spread_join(rows: DataFrame, found: DataFrame, key: str, *, size: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with ``found``, one row a key with the number of its rows in ``size``
    (which goes). Rows of a hot key are dealt out by the hash of the column ``by``, and its one row
    is repeated for each share, so no task gets more than about a HOT-th of all rows for one key."""
    salt, shares = fresh([*rows.columns, *found.columns], "salt", "shares")
    total = found.agg(F.sum(size)).first()[0] or 0
    share = max(1, total // HOT)
    pieces = F.ceil(F.col(size) / F.lit(share)).cast("long")
    hot = found.where(F.col(size) > share).select(key, pieces.alias(shares))  # at most HOT rows
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(shares)), F.lit(0).cast("long"))).drop(shares)
    repeated = found.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(pieces, F.lit(1)) - 1))).drop(size)
    return dealt.join(repeated, [key, salt]).drop(salt)


def rows_of(docs: DataFrame, stays: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``stays`` (doc_id); rows of one id repeated whole become one.
    Rows without an id all stay. Texts are shuffled once, by id."""
    key, same = fresh(docs.columns, "key", "same")
    keyed = docs.withColumn(key, F.col(doc_id).cast("long"))
    named = keyed.where(F.col(key).isNotNull()).join(stays.select(F.col("doc_id").alias(key)), key, "left_semi")
    has_map = lambda c: "map<" in keyed.schema[c].dataType.simpleString()
    # equal rows have one id, so a 64-bit hash of the rest tells the rows of that id apart
    signature = F.xxhash64(*[F.to_json(F.struct(c)) if has_map(c) else F.col(c) for c in docs.columns])
    once = named.withColumn(same, signature).dropDuplicates([key, same])
    return once.select(*docs.columns).unionByName(keyed.where(F.col(key).isNull()).select(*docs.columns))


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
