"""Compare registered queries with their SQL twins in DuckDB: ``python tests/twin_check.py [sf] [name...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))


def compare(spark, con, entry, sf_dir):
    """(ok, message, rows)"""
    started = time.time()
    df = entry.build(spark, sf_dir)
    columns, rows = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if entry.sql is None:
        return True, f"no twin, {len(rows)} rows", took
    relation = con.execute(entry.sql)
    names = [d[0] for d in relation.description]
    expected_columns, expected = sorted_rows(names, relation.fetchall())
    if columns != expected_columns:
        return False, f"columns {columns} != {expected_columns}", took
    if len(rows) != len(expected):
        return False, f"{len(rows)} rows != {len(expected)}", took
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        return False, f"{len(wrong)} of {len(rows)} rows differ, e.g.\n   spark {wrong[0][0]}\n   sql   {wrong[0][1]}", took
    return True, f"{len(rows)} rows", took


def main():
    from settlerank.plans.catalog import CATALOG
    from settlerank.session import local_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    chosen = [n for n in CATALOG if not args or any(a in n for a in args)]
    spark, con, bad = local_session(8), duck(sf_dir), []
    for name in chosen:
        try:
            ok, message, took = compare(spark, con, CATALOG[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, took = False, 0.0
            text = str(error)
            message = text[:900] if "-v" not in args else traceback.format_exc()
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {message}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(chosen) - len(bad)}/{len(chosen)} ok; failed: {bad}")


if __name__ == "__main__":
    main()
