"""Order-free comparison of a Spark result with DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    if isinstance(value, bool) or not hasattr(value, "__float__"):
        return str(value)
    return f"{float(value):.9g}"


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def check(spark, con, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    (names, mine), (others, theirs) = rows(got), rows(want)
    if (names, mine) != (others, theirs):
        odd = [x for x in zip(mine, theirs) if x[0] != x[1]][:3]
        raise AssertionError(f"{names} {others} {len(mine)} {len(theirs)} {odd}")
