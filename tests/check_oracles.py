"""Compare registered queries with their oracle SQL: python tests/check_oracles.py [sf] [names...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb
import pandas as pd

import __spark_entry__ as entry
from scoutframe.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    """Order-free rows with columns by name; doubles keep nine digits."""

    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 9) + 0.0
        return str(v)

    cols = sorted(pdf.columns)
    return sorted((tuple(one(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark, con, name, sf_dir):
    """None when equal, else a short description."""
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    text = entry.oracle_sql().get(name)
    if text is None:
        return None
    want = con.execute(text).fetchdf()
    if sorted(mine.columns) != sorted(want.columns):
        return f"columns {sorted(mine.columns)} != {sorted(want.columns)}"
    a, b = canonical(mine), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} of {len(a)} rows differ, e.g. {diff[0]}" if diff else None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - t:6.1f}s {problem or 'ok'}", flush=True)
    print("failed:", bad)
