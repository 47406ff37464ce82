"""Compare registered queries with their DuckDB oracles on the same parquet.

``python -m tesserae.plans.check /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

from ..sources.tables import TABLES, table_path


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT", "float": "FLOAT"}


def type_diff(df, con, sql: str) -> dict:
    """Columns whose Spark type differs from the oracle's DuckDB type."""
    st = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)
    return names, out


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = table_path(sf_dir, t)
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def compare(spark, sf_dir: str, names=None, verbose: bool = True) -> dict:
    from ..plans.queries import ORACLES, QUERIES
    con = duck(sf_dir)
    res = {}
    for name in names or QUERIES:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            s_cols, s_rows = canon(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            res[name] = {"ok": False, "error": f"spark: {e!r}"[:500]}
            if verbose:
                print(name, res[name])
            continue
        sql = ORACLES.get(name)
        if sql is None:
            res[name] = {"ok": None, "rows": len(s_rows), "sec": round(time.time() - t0, 2)}
        else:
            try:
                cur = con.execute(sql)
                d_cols = [c[0] for c in cur.description]
                d_cols, d_rows = canon(d_cols, cur.fetchall())
            except Exception as e:  # noqa: BLE001
                res[name] = {"ok": False, "error": f"duckdb: {e!r}"[:500]}
                if verbose:
                    print(name, res[name])
                continue
            tdiff = type_diff(df, con, sql)
            ok = s_cols == d_cols and s_rows == d_rows and not tdiff
            info = {"ok": ok, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(time.time() - t0, 2)}
            if tdiff:
                info["types"] = tdiff
            if not ok:
                info["cols"] = (s_cols, d_cols) if s_cols != d_cols else None
                diff_s = [r for r in s_rows if r not in set(d_rows)][:3]
                diff_d = [r for r in d_rows if r not in set(s_rows)][:3]
                info["spark_only"], info["oracle_only"] = diff_s, diff_d
            res[name] = info
        if verbose:
            print(name, res[name], flush=True)
    return res


if __name__ == "__main__":
    from ..session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sp = build_session("local[8]", shuffle_partitions=8)
    sp.sparkContext.setLogLevel("ERROR")
    r = compare(sp, sf, sys.argv[2:] or None)
    bad = [k for k, v in r.items() if v["ok"] is False]
    print("FAILED:", bad)
    print(f"{sum(1 for v in r.values() if v['ok'])} ok, {len(bad)} failed, "
          f"{sum(1 for v in r.values() if v['ok'] is None)} rows-only")
