"""Local twin of the driver's correctness gate: Spark query vs DuckDB oracle.

Compares row count, column names and an order-insensitive hash of the values (columns
sorted by name, floats rounded). Usage: ``python tests/oracle_check.py [sf_dir] [names...]``.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(repr(tuple(_norm(x) for x in rec)))
    rows.sort()
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest()


def _key(v):
    v = _norm(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return (1, round(float(v), 3), "")
    if v is None:
        return (0, 0.0, "")
    return (2, 0.0, repr(v))


def _close(a, b) -> bool:
    a, b = _norm(a), _norm(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(float(a), float(b), rel_tol=1e-7, abs_tol=1e-6)
    return a == b


def tolerant_equal(x: pd.DataFrame, y: pd.DataFrame) -> bool:
    if len(x) != len(y) or sorted(x.columns) != sorted(y.columns):
        return False
    cols = sorted(x.columns)
    rx = sorted((tuple(r) for r in x[cols].itertuples(index=False, name=None)), key=lambda t: [_key(v) for v in t])
    ry = sorted((tuple(r) for r in y[cols].itertuples(index=False, name=None)), key=lambda t: [_key(v) for v in t])
    return all(all(_close(a, b) for a, b in zip(r1, r2)) for r1, r2 in zip(rx, ry))


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            rows = sdf.collect()
            spdf = pd.DataFrame([r.asDict() for r in rows], columns=sdf.columns)
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:400])
            if verbose:
                print(f"{name:28s} SPARK_ERROR {repr(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in orc:
            results[name] = ("ROWS_ONLY", len(spdf))
            if verbose:
                print(f"{name:28s} rows-only  n={len(spdf)}  {ts:.1f}s")
            continue
        try:
            odf = con.execute(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = ("ORACLE_ERROR", repr(e)[:400])
            if verbose:
                print(f"{name:28s} ORACLE_ERROR {repr(e)[:400]}")
            continue
        a, b = digest(spdf), digest(odf)
        strict = a == b
        ok = strict or tolerant_equal(spdf, odf)
        results[name] = ("MATCH" if ok else "MISMATCH", a[0], b[0])
        if verbose:
            print(f"{name:28s} {'MATCH   ' if ok else 'MISMATCH'}{'' if strict or not ok else '~'} spark={a[0]} oracle={b[0]} {ts:.1f}s"
                  + ("" if ok or a[1] == b[1] else f"\n    cols spark={a[1]}\n    cols oracle={b[1]}"))
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from mortar.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("MATCH", "ROWS_ONLY")}
    print(f"\n{len(res)} queries, {sum(v[0] == 'MATCH' for v in res.values())} match, "
          f"{sum(v[0] == 'ROWS_ONLY' for v in res.values())} rows-only, {len(bad)} bad: {sorted(bad)}")
