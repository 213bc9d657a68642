"""Run registered queries next to their SQL twins."""

from __future__ import annotations

import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    started = time.time()
    df = build(spark, sf_dir)
    got_columns = df.columns
    got = _rows(got_columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return None, len(got), spent
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = _rows(want_columns, result.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}", len(got), spent
    if got != want:
        extra = [r for r in got if r not in want][:2]
        missing = [r for r in want if r not in got][:2]
        return f"{len(got)} vs {len(want)} rows; only here {extra}; only there {missing}", len(got), spent
    return None, len(got), spent


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from timberflow.plans import ORACLES, QUERIES
    from timberflow.session import build_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", "oracle-check", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    bad = 0
    for name, build in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        print(f"... {name}", flush=True)
        try:
            problem, rows, spent = compare(spark, con, name, build, ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, rows, spent = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{mark} {name:32s} rows={rows:<7d} {spent:6.2f}s {'' if name in ORACLES else '(rows only)'} {problem or ''}"[:1800], flush=True)
    print("failed:", bad)
