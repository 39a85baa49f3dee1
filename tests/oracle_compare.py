"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

    python -m tests.oracle_compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return (1, repr(v))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = dict(zip(rel.columns, (str(t) for t in rel.types)))
    drows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
           "rows": (len(srows), len(drows))}
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={scols} duck={dcols}"
        return res
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "float": "FLOAT", "binary": "BLOB"}
    bad_types = {c: (kinds.get(t, t), dtypes[c]) for c, t in sdf.dtypes if kinds.get(t, t) != dtypes[c]}
    if bad_types:
        res["status"] = f"TYPES {bad_types}"
        return res
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    d = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    if len(s) != len(d):
        res["status"] = "ROWCOUNT"
    elif s == d:
        res["status"] = "OK"
    else:
        diffs = [(a, b) for a, b in zip(s, d) if a != b]
        res["status"] = f"VALUES ({len(diffs)} rows differ) e.g. {diffs[0]}"
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from docreason.session import build_session
    spark = build_session(cores=8, shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(a.sf)
    names = a.names or list(qs)
    bad = 0
    for n in names:
        if n not in sqls:
            t0 = time.time()
            cnt = qs[n](spark, a.sf).count()
            print(f"{n:28s} ROWS-ONLY rows={cnt} spark={time.time() - t0:.1f}s", flush=True)
            continue
        try:
            r = compare(spark, con, n, qs[n], sqls[n], a.sf)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:600]}"}
        if r["status"] != "OK":
            bad += 1
        print(f"{n:28s} {r['status']} rows={r.get('rows')} spark={r.get('spark_s')}s duck={r.get('duck_s')}s",
              flush=True)
    print("mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
