"""Runs catalog queries beside their oracle SQL and reports differences.

    python tests/compare.py [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in data)


def differences(df, con, sql: str) -> str | None:
    start = time.time()
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    differences.spark = time.time() - start
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return f"rows {len(got[1])} != {len(want[1])}; got {sorted(extra)[:2]} want {sorted(missing)[:2]}"[:1500]


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from textloom.session import local_session

    path = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(path), entry.queries(), entry.oracle_sql()
    bad = 0
    done = list(queries)
    if names and names[0] == "--after":
        done, names = done[done.index(names[1]):], []
    for name in names or done:
        t = time.time()
        try:
            df = queries[name](spark, path)
            if name in oracle:
                diff = differences(df, con, oracle[name])
                status = f"ok spark {differences.spark:.1f}s" if diff is None else f"DIFF {diff}"
            else:
                status = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            status = f"ERROR {str(e)[:700]}"
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name}: {status} ({time.time() - t:.1f}s)", flush=True)
    print(f"{bad} bad; no oracle: {sorted(set(queries) - set(oracle))}; extra: {sorted(set(oracle) - set(queries))}")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
