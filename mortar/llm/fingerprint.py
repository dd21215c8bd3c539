"""Document fingerprints by content-defined chunking.

*Boundaries.* A gear hash rolls over the bytes (``h = 2h + gear[byte]``, 32 bits, so it sees
the last 32 bytes). Chunking is normalised: from ``least`` bytes up to the mean size a cut needs
more zero bits than after it, and ``most`` bytes force one, which keeps sizes close to the
mean. Boundaries depend on content only, so an insertion moves no cut but those near it.

*Fingerprint.* The set of chunk digests (48 bits) with their lengths, whole and sorted, written
as hex, 16 digits a chunk. Equal texts have equal fingerprints; the empty text has ''.

*Likeness.* ``containment(a, b)`` is the share of a's weight (bytes in distinct chunks) that is
also in b; ``likeness`` is the smaller of the two containments.
"""

from __future__ import annotations

import hashlib
import math
import os
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mortar.llm.common import BYTE_TABLE, mix64, powers, random_table, unit_hash

LEAST, MEAN, MOST = 8, 24, 96
HARD_BITS, EASY_BITS = 5, 3
GEAR = (random_table(256, 7) >> np.uint64(32)).astype(np.uint32)
STEP = np.uint64(0x9E6C63D0876A9A63)
SCAN_BYTES = 1 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window (1, 2, 4, .. 32 bytes)."""
    h = GEAR[data]
    width = 1
    while width < 32:
        shifted = h[:-width] << np.uint32(width) if width < len(h) else h[:0]
        h = h.copy()
        if len(shifted):
            h[width:] += shifted
        width *= 2
    return h


def candidates(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions after which a cut may fall: under the hard mask and under the easy one."""
    hard, easy = [], []
    top = np.uint32(32)
    for a in range(0, len(data), SCAN_BYTES):
        lead = min(a, 31)
        h = gear_hashes(data[a - lead: a + SCAN_BYTES])[lead:]
        soft = np.flatnonzero(h >> (top - np.uint32(EASY_BITS)) == 0)
        hard.append(soft[h[soft] >> (top - np.uint32(HARD_BITS)) == 0] + (a + 1))
        easy.append(soft + (a + 1))
    return np.concatenate(hard).tolist(), np.concatenate(easy).tolist()


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks (the last is the length)."""
    n = len(data)
    if n == 0:
        return []
    hard, easy = candidates(data)
    hard.append(n + MOST)
    easy.append(n + MOST)
    ends, at, i, j, last_hard, last_easy = [], 0, 0, 0, len(hard) - 1, len(easy) - 1
    while n - at > LEAST:
        i = bisect_left(hard, at + LEAST, i, last_hard)
        if hard[i] <= at + MEAN:
            at = hard[i]
        else:
            j = bisect_left(easy, at + MEAN, j, last_easy)
            at = min(easy[j], at + MOST)
        if at >= n:
            break
        ends.append(at)
    ends.append(n)
    return ends


def fingerprint(data: bytes) -> np.ndarray:
    """Sorted distinct ``digest << 16 | length`` of the chunks of UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.array(boundaries(raw), np.int64)
    if len(ends) == 0:
        return np.zeros(0, np.uint64)
    starts = np.concatenate(([0], ends[:-1]))
    lens = ends - starts
    pos = np.arange(len(raw)) - np.repeat(starts, lens)
    sums = np.add.reduceat(BYTE_TABLE[raw] * powers(STEP, MOST + 1)[pos], starts)
    digest = mix64(sums + lens.astype(np.uint64)) >> np.uint64(16)
    return np.unique(digest << np.uint64(16) | lens.astype(np.uint64))


def to_hex(print_: np.ndarray) -> str:
    return print_.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def weight(print_: np.ndarray) -> int:
    return int((print_ & np.uint64(0xFFFF)).sum())


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's weight in b; an empty fingerprint is contained in any."""
    total = weight(a)
    return weight(np.intersect1d(a, b, assume_unique=True)) / total if total else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The smaller containment: 1 for equal sets, 0 without a common chunk (two empty ones: 1)."""
    most = max(weight(a), weight(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / most if most else 1.0


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def line_place(rows: DataFrame) -> Column:
    """A double that never falls as the key ``k`` rises; null for a null key.

    Numbers count from the smallest, so large ones keep their differences; strings are read as the 6 bytes
    after what the smallest and the largest share."""
    kind = rows.schema["k"].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        ends = rows.agg(F.min(F.col("k").cast("binary")).alias("a"), F.max(F.col("k").cast("binary")).alias("z")).first()
        shared = len(os.path.commonprefix([bytes(ends["a"] or b""), bytes(ends["z"] or b"")]))
        tail = F.substring(F.col("k").cast("binary"), shared + 1, 6)
        return F.conv(F.rpad(F.hex(tail), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.IntegralType):
        least = rows.agg(F.min("k").alias("a")).first()["a"]
        return (F.col("k").cast("decimal(20,0)") - F.lit(least or 0).cast("decimal(20,0)")).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col("k").cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col("k").cast("int").cast("double")
    return F.col("k").cast("double")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with the text of the next row in descending ``(key, text)`` order, the last with the first's.

    Rows are cut into key ranges (a few times the shuffle partitions; only their bounds reach
    the driver) and sorted within them. A key that fills several ranges has a range of its own, which is cut
    further by text hash, as rows of one key stand in the order of their text hashes. Each range also gets a
    copy of the next range's first row, so every follower is found inside one range and the table is
    shuffled once."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(line_place(rows), F.lit(float("-inf")))
    points = rows.select(place.alias("p")).approxQuantile("p", [i / n for i in range(1, n)], 0.25 / n)
    often = {p: points.count(p) for p in set(points) if points.count(p) > 1}
    bounds = sorted({p for p in points if p > float("-inf")} | {math.nextafter(p, math.inf) for p in often})
    splits = [float("-inf"), *bounds, float("inf")]
    tie = unit_hash(F.col("t")) if often else F.lit(0.0)

    def ranged(df: DataFrame) -> DataFrame:
        df = df.withColumn("p", place)
        if len(splits) < 3:
            return df.withColumn("r", F.lit(0)).drop("p")
        return Bucketizer(splits=splits, inputCol="p", outputCol="q").transform(df).withColumn(
            "r", F.col("q").cast("int")).drop("p", "q")

    slim = ranged(rows.select("k", tie.alias("h")) if often else rows.select("k", F.lit(0.0).alias("h")))
    ends = slim.groupBy("r").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.count("k").alias("some"),
                                 F.count(F.lit(1)).alias("n")).collect()
    cuts = {r["r"]: max(1, r["n"] * n // max(1, sum(x["n"] for x in ends))) for r in ends
            if r["some"] in (0, r["n"]) and r["a"] == r["z"]}  # ranges that hold one key only
    parts = F.create_map(*[F.lit(x) for r, c in cuts.items() if c > 1 for x in (r, c)]) if any(
        c > 1 for c in cuts.values()) else None

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("s", F.lit(0) if parts is None else F.floor(
            F.col("h") * F.coalesce(parts[F.col("r")], F.lit(1))).cast("int"))

    tops = cut(slim).groupBy("r", "s").agg(F.max(F.struct(F.col("k"), F.col("h"))).alias("top")).collect()
    if not tops:
        return rows.select("k", "t", F.col("t").alias("u"))
    tops = sorted(tops, key=lambda x: (-x["r"], -x["s"]))
    heads = [(a["r"], a["s"], b["top"]["k"], b["top"]["h"]) for a, b in zip(tops, tops[1:] + tops[:1], strict=True)]
    kind = docs.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame(heads, f"r int, s int, k {kind}, h double")
    with_tie = rows.withColumn("h", tie)
    first = with_tie.join(F.broadcast(wanted), with_tie["k"].eqNullSafe(wanted["k"]) & (with_tie["h"] == wanted["h"]))
    first = first.groupBy("r", "s").agg(F.max("t").alias("t"))  # one row a range
    both = cut(ranged(with_tie)).select("r", "s", "k", "h", "t", F.lit(False).alias("guest")).unionByName(
        first.select("r", "s", F.lit(None).cast(kind).alias("k"), F.lit(0.0).alias("h"), "t", F.lit(True).alias("guest")))
    order = Window.partitionBy("r", "s").orderBy(F.col("guest").asc(), F.col("k").desc(), F.col("h").desc(),
                                                 F.col("t").desc())
    return both.withColumn("u", F.lead("t").over(order)).where(~F.col("guest")).select("k", "t", "u")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    Columns: ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, contained_next``. A null text counts as empty; repeated rows each have a row (rows
    of one key stand in a fixed order of their texts); a null key sorts last; one row alone is its own next; other
    columns are not read; an empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            last: tuple[str, np.ndarray] = ("", fingerprint(b""))
            for t, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                u = u or ""
                own = last[1] if last[0] == t else fingerprint(t.encode())
                new = edited(t, u)
                raw = new.encode()
                changed = own if new == t else fingerprint(raw)
                follower = own if u == t else fingerprint(u.encode())
                last = (u, follower)
                out.append((len(t), hashlib.sha256(raw).hexdigest(), to_hex(own), to_hex(changed),
                            likeness(own, changed), likeness(own, follower), containment(own, follower)))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                 "contained_next"])

    kind = docs.schema[key].dataType.simpleString()
    return with_next(docs, key, text).mapInArrow(
        run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, contained_next double")
