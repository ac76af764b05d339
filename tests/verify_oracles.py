"""Run registered queries beside their SQL twins: python tests/verify_oracles.py [sf] [name ...]"""

import datetime as dt
import os
import sys
import tempfile
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, Decimal, float)):
        return round(float(value), 6) if isinstance(value, float) else int(value) if value == int(value) else float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def compare(spark, con, sf_dir, name, build, sql):
    started = time.time()
    frame = build(spark, sf_dir)
    mine = table([tuple(r) for r in frame.collect()], frame.columns)
    middle = time.time()
    if sql is None:
        return "rows-only", f"{len(mine[1])} rows, spark {middle - started:.1f}s"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = table(result.fetchall(), columns)
    timing = f"{len(mine[1])} rows, spark {middle - started:.1f}s duck {time.time() - middle:.1f}s"
    if mine == theirs:
        return "ok", timing
    detail = f"columns {mine[0]} / {theirs[0]}; rows {len(mine[1])} / {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            detail += f"\n   spark {a}\n   duck  {b}"
            break
    return "DIFFERENT", f"{timing}; {detail}"


def main():
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), oracle_sql()
    bad = 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            status, detail = compare(spark, con, sf_dir, name, build, oracle.get(name))
        except Exception as error:
            status, detail = "ERROR", str(error)[:1500]
        bad += status in ("DIFFERENT", "ERROR")
        print(f"{status:10s} {name}: {detail}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
