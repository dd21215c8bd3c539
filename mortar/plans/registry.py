"""Query registry: name -> (Spark callable, optional DuckDB oracle SQL).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables.
Doubles are rounded to 6 decimals on both sides so last-bit differences of distributed
sums do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mortar.sources.tables import MIX_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CHECKS: dict[str, str] = {}


def query(name: str, oracle: str | None = None, check: str = "SQL"):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        CHECKS[name] = check if oracle is None or check != "SQL" else "SQL"
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (NaN -> NULL first) for stable comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
            cols.append(round_half_up(c, digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def round_half_up(c, digits: int = 6):
    """``floor(x * 10^d + 0.5) / 10^d``: the same IEEE steps as the SQL twin, so equal
    inputs round to bit-identical outputs in both engines (large values pass through)."""
    scale = float(10 ** digits)
    return F.when(F.abs(c) < F.lit(1e12), F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(c)


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH mix AS (...), <ctes> <body>`` for DuckDB."""
    parts = [f"mix AS ({MIX_SQL})"] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def round_sql(inner: str, doubles: list[str], digits: int = 6) -> str:
    if not doubles:
        return inner
    sc = f"{float(10 ** digits)!r}"
    rep = ", ".join(f"CASE WHEN abs({c}) < 1e12 THEN floor({c} * {sc} + 0.5) / {sc} ELSE {c} END AS {c}"
                    for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) q"
