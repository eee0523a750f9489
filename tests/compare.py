"""Run registered queries next to their SQL and report where the two differ."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_cols, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = canonical(got_cols, got), canonical(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"got {x}, expected {y} (columns {sorted(got_cols)})"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from scorewell.catalog import all_queries, all_sql
    from scorewell.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), all_sql()
    wanted = sys.argv[1:]
    for name, fn in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem = difference(df, con, sql[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
            note = "ok" if name in sql else "ok (rows only)"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:32s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
