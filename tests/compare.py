"""Run registered queries beside their DuckDB twins and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    columns = df.columns
    rows = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"{len(rows)} rows, no SQL twin, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    t2 = time.time()
    note = f"{len(rows)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if sorted(columns) != sorted(names):
        return False, f"columns {sorted(columns)} vs {sorted(names)}"
    a, b = normal(rows, columns), normal(theirs, names)
    if a != b:
        sa, sb = set(map(str, a)), set(map(str, b))
        return False, f"{len(a)} vs {len(b)} rows; only spark {list(sa - sb)[:2]}; only duckdb {list(sb - sa)[:2]}"
    return True, note


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tillbook.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name, "-", note, flush=True)
    print("failures:", bad)
