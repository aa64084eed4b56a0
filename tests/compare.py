"""Run every query next to its SQL: python tests/compare.py [sf] [name …]"""

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from workload.tables import NAMES  # noqa: E402

ROOT = "/root/testdata"


def engine(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda r: tuple(map(repr, r)))


def compare(spark, con, name, sf_dir):
    """None if equal, else what differs."""
    df = E.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return None
    diff = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
    return f"rows {len(got)} / {len(want)}; first differences {str(diff)[:900]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    con = engine(sf_dir)
    names = sys.argv[2:] or list(E.queries())
    bad = 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
