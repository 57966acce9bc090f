"""Compare the registered queries with their SQL: same columns, rows and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    got_cols, got = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from daygrain.session import local_session

    sf_dir, *names = sys.argv[1:]
    spark = local_session()
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            problem = compare(spark, con, queries[name], sqls[name], sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:40s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("bad:", bad)
