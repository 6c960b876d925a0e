"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [scale or folder] [name-part ...]"""

from __future__ import annotations

import datetime
import decimal
import importlib
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return names, out


def compare(spark, con, sf_dir, name, fn, sql):
    """(status, seconds, note)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    secs = time.time() - t0
    if sql is None:
        return "rows", secs, f"{len(got[1])} rows"
    t1 = time.time()
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    oracle_secs = time.time() - t1
    if got[0] != want[0]:
        return "FAIL", secs, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return "FAIL", secs, f"{len(got[1])} rows, oracle {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return "FAIL", secs, f"{len(bad)} of {len(got[1])} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return "ok", secs, f"{len(got[1])} rows, oracle {oracle_secs:.1f}s" + ("" if got[1] else "  EMPTY")


def main(argv):
    from marquee.session import local_session

    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    sf_dir = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    only = os.environ.get("PLANS")
    if only:
        import types

        pkg = types.ModuleType("marquee.plans")
        pkg.__path__ = [os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "marquee", "plans")]
        sys.modules["marquee.plans"] = pkg
        for m in only.split(","):
            importlib.import_module(f"marquee.plans.{m}")
        from marquee.plans.registry import ORACLES, QUERIES
    else:
        from marquee.plans import ORACLES, QUERIES
    spark = local_session()
    con = duck(sf_dir)
    tally = {}
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, secs, note = compare(spark, con, sf_dir, name, fn, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            status, secs, note = "ERROR", 0, str(e)[:1500]
            if os.environ.get("TB"):
                traceback.print_exc()
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:5} {secs:6.2f}s {name}: {note}", flush=True)
    print(tally)


if __name__ == "__main__":
    main(sys.argv[1:])
