"""Run registered queries next to their SQL and compare the row sets. Usage: oracle_compare.py SF_DIR [name ...]"""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.9g}")
    return value


def row_set(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, spark, sf_dir, name):
    """(ok, message, seconds, rows)"""
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, "rows only", seconds, len(rows)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}", seconds, len(rows)
    ours, theirs = row_set(rows, df.columns), row_set(expected, columns)
    if ours == theirs:
        return True, "match", seconds, len(rows)
    for a, b in zip(ours, theirs):
        if a != b:
            return False, f"{len(ours)} vs {len(theirs)} rows; first difference {a} != {b}", seconds, len(rows)
    return False, f"{len(ours)} vs {len(theirs)} rows", seconds, len(rows)


def main():
    from permscan.session import local_session
    from permscan.staging import release

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    for name in names or entry.queries():
        try:
            ok, message, seconds, rows = compare(con, spark, sf_dir, name)
        except Exception as error:
            ok, message, seconds, rows = False, f"{type(error).__name__}: {str(error)[:1500]}", 0, 0
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {seconds:6.2f}s {rows:8d} rows  {message}", flush=True)
    release(spark)


if __name__ == "__main__":
    main()
