"""Compare a registered query with its SQL over the same tables: columns, row count and every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "as_tuple") or isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def compare(spark, con, plan, sql, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = plan(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(row[c]) for c in cols) for row in df.collect())
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows (no SQL) {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    raw = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return False, f"columns differ: only spark {set(cols) - set(names)}, only sql {set(names) - set(cols)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(row[i]) for i in order) for row in raw)
    if got == want:
        return True, f"{len(got)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    a, b = set(got), set(want)
    only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
    msg = f"{len(got)} vs {len(want)} rows, {len(a - b)} / {len(b - a)} differ"
    if only_a and only_b:
        msg += "\n   " + str([(c, x, y) for c, x, y in zip(cols, only_a[0], only_b[0]) if x != y or c in ("mint", "pool")])
    else:
        msg += f"\n   spark {only_a}\n   sql {only_b}"
    return False, msg


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tapelab.session import local_session

    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    only = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name in q:
        if only and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in only):
            continue
        try:
            ok, msg = compare(spark, con, q[name], o.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failures:", bad)
