"""Shared helpers: UTF-8 columns as NumPy arrays, rolling word hashes, checkpoints.

Texts stay bytes: a text column of an Arrow batch is one byte buffer with offsets, so words
and shingles of many documents are hashed by a few NumPy calls. ``pieces`` bounds the bytes
handled at a time, so memory does not follow the batch size (a single long text is one piece).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.session import ensure_checkpoint_dir, scratch_dir

PIECE_BYTES = 1 << 20
SHINGLE = 5
SPACES = b" \t\n\v\f\r"
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def random_table(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 numbers (same on every executor)."""
    offset = _U(seed * 0xC2B2AE3D27D4EB4F % 2**64)
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + offset)


BYTE_TABLE = random_table(256, 1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
WORD_STEP = _U(0x9DDFEA08EB382D69)
SHINGLE_STEP = _U(0xB492B66FBE98F273)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` of at most ``limit`` bytes each (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


_POWERS: dict[int, np.ndarray] = {}


def powers(step: np.uint64, n: int) -> np.ndarray:
    """``1, step, step^2, ..`` (n of them; kept for the next call, as long as the longest text needs)."""
    known = _POWERS.get(int(step))
    if known is None or len(known) < n:
        out = np.full(max(2 * n, 256), step, dtype=_U)
        out[0] = 1
        known = _POWERS[int(step)] = np.multiply.accumulate(out)
    return known[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray,
               space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of non-space bytes, or of bytes outside ``space``) of several texts: ``(starts, ends, first)``.

    ``first[i]`` is the index of text i's first word; words never cross texts. ``offsets``
    are relative to ``data``."""
    inside = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                table: np.ndarray = LOWER_TABLE) -> np.ndarray:
    """A 64-bit polynomial hash of each word, A-Z folded by the default table."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    lens = ends - starts
    total = int(lens.sum())
    head = np.cumsum(lens) - lens
    pos = np.arange(total) - np.repeat(head, lens)
    idx = pos + np.repeat(starts, lens)
    vals = table[data[idx]] * powers(WORD_STEP, int(lens.max()))[pos]
    return mix64(np.add.reduceat(vals, head) + lens.astype(_U))


def text_shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of one text (not distinct); a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(size, n)
    acc = np.zeros(n - k + 1, _U)
    step = powers(SHINGLE_STEP, k)
    for j in range(k):
        acc += hashes[j: n - k + 1 + j] * step[j]
    return mix64(acc + _U(k))


def per_text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, word hashes)`` for every text of an Arrow column."""
    data, offsets = utf8_column(column)
    for a, b in pieces(offsets):
        lo = offsets[a]
        part = data[lo: offsets[b]]
        starts, ends, first = word_spans(part, offsets[a: b + 1] - lo)
        hashes = word_hashes(part, starts, ends)
        for i in range(a, b):
            yield i, hashes[first[i - a]: first[i - a + 1]]


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts lineage)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back (cuts lineage, keeps columns apart)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the columns (53 bits of xxhash64)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def hash_sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most ``most`` rows, by the hash of distinct values ``by``: few beyond that many leave any task."""
    total = rows.count()
    near = rows.where(unit_hash(*[F.col(c) for c in by]) < min(1.0, (1.1 * most + 100) / max(total, 1)))
    return near.orderBy(F.xxhash64(*by), *by).limit(most) if total > most else rows


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
