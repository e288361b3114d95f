"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python -m tests.harness [sf] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def _kind(value):
    return type(value).__name__


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple((_kind(r[i]), _cell(r[i])) for i in order) for r in rows
    )


def compare(spark, con, query, sql, sf_dir):
    """Return ``None`` when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    ours_columns, ours = as_bag(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs_columns, theirs = as_bag(names, result.fetchall())
    if ours_columns != theirs_columns:
        return f"columns {ours_columns} against {theirs_columns}"
    if ours != theirs:
        more, less = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
        return f"{sum(ours.values())} against {sum(theirs.values())} rows; only ours {str(more)[:600]}; only SQL {str(less)[:600]}"
    return None


def main(sf="0.01", *names):
    import __spark_entry__ as entry
    from casemill.session import get_session

    queries, oracles = entry.queries(), entry.oracle_sql()

    spark = get_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = sql_connection(sf_dir)
    bad = 0
    for name in names or sorted(queries):
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
                note = "same"
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem, note = (None if n else "no rows"), f"{n} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
