"""Compare a registered query with its check SQL, as the acceptance run does."""

from __future__ import annotations

import math
import signal
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and getattr(v, "shape", ()) == ():
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, records) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else ""
        lack = [r for r in want if r not in set(got)][:2] if len(got) < 20000 else ""
        return f"rows {len(got)} / {len(want)}; extra {str(extra)[:600]} lack {str(lack)[:600]}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n   spark {str(g)[:500]}\n   sql   {str(w)[:500]}"
    return None if got else "both empty"


def _late(*_):
    raise TimeoutError("over 90 s")


def main() -> None:
    from folioscope.catalog import all_queries, all_sql
    from folioscope.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = local_session("8"), connect(sf_dir)
    sql = all_sql()
    bad = 0
    for name, fn in all_queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        signal.signal(signal.SIGALRM, _late)
        signal.alarm(90)
        try:
            diff = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:1200]}"
        signal.alarm(0)
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {'' if name in sql else '(rows only)'}"
              + (f"\n  {diff}" if diff else ""), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
