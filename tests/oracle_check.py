"""Compare registered queries with their SQL: rows, columns, kinds, values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')"
        )
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    return (type(value).__name__, str(value))


def _rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in tuples)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted_rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, wanted = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, wanted_rows)
    if len(got) != len(wanted):
        return f"{len(got)} rows, SQL has {len(wanted)}"
    if not got:
        return "no rows"
    for mine, theirs in zip(got, wanted):
        if mine != theirs:
            return f"{mine} != {theirs}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as spark_entry
    from tickloom.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "check",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), spark_entry.oracle_sql(), 0
    names = sys.argv[1:] or list(spark_entry.queries())
    for name in names:
        start = time.time()
        try:
            df = spark_entry.queries()[name](spark, sf_dir)
            if name in sql:
                found = difference(df, con, sql[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as error:  # report and go on to the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{name:28s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
