"""Run every query and compare it with its SQL: python tests/check_queries.py [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def sorted_rows(rows, order):
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def differences(spark, con, run, sql, sf_dir):
    df = run(spark, sf_dir)
    names = df.columns
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"{len(rows)} rows (no SQL)", True
    cursor = con.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} != {sorted(expected_names)}", False
    ours = sorted_rows(rows, [names.index(n) for n in sorted(names)])
    theirs = sorted_rows(expected, [expected_names.index(n) for n in sorted(names)])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}", False
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}", False
    return f"{len(ours)} rows", True


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = oracle(sf_dir), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            text, ok = differences(spark, con, run, sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            text, ok = f"{type(error).__name__}: {str(error)[:600]}", False
        print(f"{'ok ' if ok else 'BAD'} {name:24s} {time.time() - began:6.1f}s  {text}", flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
