"""Run the registered queries against DuckDB on the same tables.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _kind(name: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(name, name)


def _sort_key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str) -> str | None:
    """None if columns, types and all values agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    for name, kind in spark_df.dtypes:
        if _kind(kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    order = sorted(names)
    got = [tuple(_plain(r[c]) for c in order) for r in spark_df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(_plain(r[i]) for i in at) for r in want]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got.sort(key=_sort_key)
    want.sort(key=_sort_key)
    for g, w in zip(got, want):
        if g != w:
            return f"{order}\n  spark {g}\n  sql   {w}"
    return None


def main() -> int:
    from tests.conftest import make_spark

    import casesignal.catalog as catalog

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_spark(), connect(sf_dir)
    sql = catalog.oracle_sql()
    bad = 0
    for name, fn in catalog.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                found = compare(df, con, sql[name])
                note = "ok" if found is None else "DIFF " + found
            else:
                note = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        bad += note[:4] in ("DIFF", "ERRO")
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
