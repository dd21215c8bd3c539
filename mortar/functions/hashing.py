"""Seed-stable, partition-independent hash ordering.

``h(parts) = first 32 bits of md5(':'.join(parts))`` as a non-negative bigint. The same
value is computable in DuckDB as ``('0x' || substr(md5(...), 1, 8))::BIGINT``, which gives
every hash-ordered split an SQL oracle. Rows are ordered by ``(h, id)`` so ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def order_key(*parts) -> Column:
    """The same 32 bits as 8 lower-case hex digits: they sort as the numbers do, without ``conv``,
    which costs several times the md5. For orders, cuts and buckets."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    joined = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.substring(F.md5(joined), 1, HASH_BITS // 4)


def h(*parts) -> Column:
    return F.conv(order_key(*parts), 16, 10).cast("bigint")


def h_sql(*parts: str) -> str:
    """DuckDB twin of :func:`h`; ``parts`` are SQL expressions."""
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT)"


def hash_bucket(key: Column, bits: int) -> Column:
    """Top ``bits`` bits (a multiple of 4) of an :func:`order_key`: monotone in it, so it range-buckets it."""
    if bits % 4:
        raise ValueError("bits must be a multiple of 4")
    return F.substring(key, 1, bits // 4)
