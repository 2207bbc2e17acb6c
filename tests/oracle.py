"""Run a query and its SQL on the same tables and compare the rows, whatever their order."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() and math.isfinite(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(_plain(r[n]) for n in names) for r in df.collect()]


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    return [columns[i] for i in order], rows


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    names, ours = spark_rows(df)
    columns, theirs = sql_rows(con, sql)
    if names != columns:
        return f"columns {names} != {columns}"
    ours, theirs = sorted(ours, key=repr), sorted(theirs, key=repr)
    if ours == theirs:
        return None
    in_ours, in_theirs = set(ours), set(theirs)
    only_ours = [r for r in ours if r not in in_theirs][:3]
    only_theirs = [r for r in theirs if r not in in_ours][:3]
    return f"{len(ours)} rows != {len(theirs)} rows\n  names {names}\n  spark only {only_ours}\n  sql only   {only_theirs}"


def main(argv: list[str]) -> int:
    from noticelake.session import local_session
    from workload import QUERIES, SQL

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("PLAIN"):  # a session without any of the library's settings
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in argv or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                verdict = difference(df, con, SQL[name])
                n = ""
            else:
                verdict, n = None, f" rows={df.count()} (no SQL)"
        except Exception as error:  # report and go on with the next query
            verdict, n = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'BAD '} {name} {time.time() - start:.1f}s{n}", flush=True)
        if verdict:
            print("   ", verdict, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
