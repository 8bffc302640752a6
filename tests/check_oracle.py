"""Run registered queries and their SQL side by side and report differences.

    python tests/check_oracle.py [--sf DIR] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 9) + 0.0) if value % 1 else repr(int(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    return repr(value)


def as_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str, queries: dict, oracles: dict) -> tuple[bool, str]:
    started = time.time()
    df = queries[name](spark, folder)
    rows = df.collect()
    took = time.time() - started
    if name not in oracles:
        return True, f"rows={len(rows)} no SQL {took:.1f}s"
    result = con.execute(oracles[name])
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    huge = [n for n, kind in types.items() if kind in ("HUGEINT", "UINT64", "UBIGINT") or "DECIMAL" in kind]
    mine, theirs = as_rows(df.columns, rows), as_rows(names, expected)
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        return False, f"rows {len(mine)} vs {len(theirs)}\n   spark {only_mine}\n   sql   {only_theirs}"
    return True, f"rows={len(rows)} {took:.1f}s" + (f" wide types {huge}" if huge else "")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    import __spark_entry__ as entry
    from narrascope.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args.names or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*")
                                                          for a in args.names)]
    failed = 0
    for name in chosen:
        try:
            ok, note = compare(spark, con, name, args.sf, queries, oracles)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{len(chosen)} queries, {failed} failed, {sum(n in oracles for n in chosen)} with SQL")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
