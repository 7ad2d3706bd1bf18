"""Run registered plans next to their SQL text and compare the rows exactly."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "\0nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def ordered(columns, rows):
    pick = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in pick], sorted(tuple(canonical(r[k]) for k in pick) for r in rows)


def oracle(sf: str, text: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(text)
    return ordered([d[0] for d in cur.description], cur.fetchall())


def spark_rows(spark, sf: str, fn):
    df = fn(spark, sf)
    return ordered(df.columns, [tuple(r) for r in df.collect()])


def compare(spark, sf: str, name: str, fn, text: str) -> tuple[bool, str]:
    t0 = time.time()
    sc, srows = spark_rows(spark, sf, fn)
    t1 = time.time()
    oc, orows = oracle(sf, text)
    t2 = time.time()
    times = f"{t1 - t0:.1f}s/{t2 - t1:.1f}s"
    if sc != oc:
        return False, f"columns {sc} != {oc}"
    if srows != orows:
        extra, lack = list(set(srows) - set(orows)), list(set(orows) - set(srows))
        return False, f"{len(srows)} vs {len(orows)} rows; {len(extra)} only spark e.g. {sorted(extra)[:2]}, {len(lack)} only sql e.g. {sorted(lack)[:2]} {times}"
    return True, f"{len(srows)} rows {times}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from fieldtide.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = get_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    plans, texts = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in plans.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if name in texts:
                ok, note = compare(spark, sf, name, fn, texts[name])
            else:
                t0 = time.time()
                n = fn(spark, sf).count()
                ok, note = n > 0, f"rows only: {n} ({time.time() - t0:.1f}s)"
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + " " + note, flush=True)
    print(f"{bad} failures")
