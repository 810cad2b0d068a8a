"""Compare every registered query with its SQL on one data folder: python -m tests.compare [sf_dir] [names...]"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v + 0.0))
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same rows, else a short description."""
    names, got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {sorted(set(names) ^ set(want_names))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)} of {len(got)} rows differ: " + str([(n, x, y) for n, x, y in zip(names, a, b) if x != y][:4])
    return None


def main() -> int:
    import __spark_entry__ as entry
    from subpanel.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                found = difference(query(spark, sf_dir), con, sqls[name])
            else:
                found = None if query(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:700]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name:26s} {'sql' if name in sqls else 'rows'} {time.time() - t:5.1f}s {found or ''}",
              flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
