"""Run registered queries against their DuckDB oracle and compare results.

Usage: ``python tests/pairs.py [sf_dir] [name ...]``. Rows are compared as
order-insensitive multisets after sorting columns by name; floats are compared
after rounding to 6 digits (the queries already round).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clonalyze.sources.tables import DRIVER_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    s_cols = sdf.columns
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    ok = ok_cols and a == b
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "cols_ok": ok_cols, "match": ok,
           "spark_s": round(t1 - t0, 2)}
    if not ok:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out["only_spark"], out["only_duck"] = diff_a, diff_b
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from clonalyze.session import local_session

    spark = local_session()
    q, o = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(q):
        try:
            r = compare(spark, name, q[name], o.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:800]}
        if r.get("match") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print(f"{bad} failing of {len(names or q)}")


if __name__ == "__main__":
    main(sys.argv)
