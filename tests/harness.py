"""Runs a query and its checking SQL side by side on one folder of tables."""

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def compare(spark, con, name, fn, sql, folder):
    """None when equal, else a text that shows the first differences."""
    df = fn(spark, folder)
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else f"{name}: no rows"
    out = con.sql(sql)
    want_cols, want = _sorted_rows(out.columns, out.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} against {want_cols}"
    if got == want:
        return None if got else f"{name}: both empty"
    a, b = set(map(repr, got)), set(map(repr, want))
    return (f"{name}: {len(got)} rows against {len(want)}\n  only spark: {sorted(a - b)[:3]}"
            f"\n  only sql:   {sorted(b - a)[:3]}")


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from curbside.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), entry.oracle_sql(), []
    for n in names:
        begin = time.time()
        try:
            problem = compare(spark, con, n, entry.queries()[n], sqls.get(n), folder)
        except Exception as e:
            problem = f"{n}: {type(e).__name__} {str(e)[:900]}"
        print(f"{n:32s} {'ok' if problem is None else 'BAD'} {'' if n in sqls else '(no sql) '}{time.time() - begin:.2f}s", flush=True)
        if problem:
            bad.append(n)
            print("  " + problem, flush=True)
    print("bad:", bad)
