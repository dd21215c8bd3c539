"""Token ids in a bit-plane shuffled binary format.

*Format.* Documents in ascending key order form one stream of 32-bit ids, cut into parts
(ranges of keys) and each part into blocks of ``block_ids`` ids (the last may be shorter). A
block is transposed: plane ``p`` holds the p-th byte (or bit) of all its ids, and each plane is
compressed by itself with zstandard. High planes are nearly constant and shrink to nothing.
A stored table has one row per block: ``part, first, n_ids, kind, planes`` (``first``: offset of
its first id in the part) and the chunk index ``docs``: key, offset in the part and length of
every document that has ids in it. Rows are
written by Spark's own committer (executors may be lost at any time), to any file system.

*Reading* decodes each block once; a document that crosses blocks is put together from its
pieces by key, so no task holds a whole part.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mortar.llm.common import pieces, utf8_column

BLOCK_IDS = 1 << 16
PIECE = 4 << 20  # bytes of texts that are encoded at a time (a longer text by itself)
UNITS, PARTS = 1_000_000, 300_000  # bounds of the tables of known units
#: White space other than the plain space and the line feed: texts with it take the slower cut.
ODD_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = f"  | \n|\n |^ | $|[{ODD_SPACES}]"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIMPLE = re.compile(f"[{_LETTERS}\n!-&(-~]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")
_PARTS = re.compile(f" ?[{_LETTERS}]+| ?[^ {_LETTERS}]+")

#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE}
BYTE_CHARS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in BYTE_CHARS)}


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of texts by the library's encoding of their units.

    The vocabulary's splitting pattern always starts a new piece at a single space between two
    other characters, so ids of a text are those of its units in turn. A unit of ASCII and Latin
    letters without an apostrophe or an empty line also splits between letters and others. The
    distinct units of about ``PIECE`` bytes of texts are looked up, the new ones are encoded, and
    the texts' ids are gathered from theirs."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, added))
        self.units: dict[str, bytes] = {}  # after a space
        self.inner: dict[str, bytes] = {}  # parts of units, not after a space

    def library(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, mapped: list[str]) -> list[bytes]:
        """Ids of parts that the pattern leaves whole, in the byte-level alphabet, by the library's model."""
        tokenize = self.model.tokenize
        return [as_bytes([t.id for t in tokenize(w)]) for w in mapped]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units after a space."""
        if len(self.units) + len(units) > UNITS:
            self.units.clear()
        if len(self.inner) + len(units) > PARTS:
            self.inner.clear()
        known, inner = self.units, self.inner
        plain = [u for u in units if u.isascii() and u.isalpha()]
        known.update(zip(plain, self.words([BYTE_CHARS[32] + u for u in plain]), strict=True))
        cut = [(u, _PARTS.findall(" " + u) if _SIMPLE.fullmatch(u) and "\n\n" not in u else [" " + u])
               for u in units if u not in known]
        lacking = {p[0] for _, p in cut if p[0][1:] not in known}
        lacking.update(q for _, p in cut for q in p[1:] if q not in inner)
        whole = [p for p in lacking if _WORD.fullmatch(p)]
        other = list(lacking.difference(whole))
        mapped = "\n".join(whole).encode().decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS[10])
        for some, ids in ((whole, self.words(mapped) if whole else []), (other, self.library(other))):
            for p, raw in zip(some, ids, strict=True):
                if p[0] == " ":
                    known[p[1:]] = raw
                else:
                    inner[p] = raw
        for u, p in cut:
            if len(p) > 1:
                known[u] = b"".join([known[p[0][1:]], *[inner[q] for q in p[1:]]])
        return known

    def cut(self, texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
        """``(heads, units, counts)``: what comes before the first cut of each text, and its units after it."""
        odd = pc.match_substring_regex(texts, _ODD)
        whole = pc.match_substring_regex(texts, self.special) if self.special else pa.repeat(False, len(texts))
        lists = pc.split_pattern(texts, " ")
        unusual = np.flatnonzero(np.asarray(pc.or_(odd, whole)))
        if len(unusual):  # special strings: the library sees the whole text
            parts = [[t] if w else _CUT.split(t) for t, w in zip(
                texts.take(pa.array(unusual)).to_pylist(), whole.take(pa.array(unusual)).to_pylist(), strict=True)]
            at = np.arange(len(texts))
            at[unusual] = len(texts) + np.arange(len(unusual))
            lists = pa.concat_arrays([lists, pa.array(parts, lists.type)]).take(pa.array(at))
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        flat, first = lists.flatten(), np.cumsum(counts) - counts
        rest = np.ones(len(flat), bool)
        rest[first] = False
        return flat.take(pa.array(first)).to_pylist(), flat.filter(pa.array(rest)), counts - 1

    def encode(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: the ids of all texts in turn, ``end`` after each, and how many each has."""
        heads, units, counts = self.cut(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.units.get, distinct))
        lacking = [u for u, f in zip(distinct, found) if f is None]
        if lacking:
            known = self.learn(lacking)
            found = [known[u] if f is None else f for u, f in zip(distinct, found)]
        pool = [*found, *self.library(heads), end]
        sizes = np.fromiter(map(len, pool), np.int32, len(pool)) // 4
        ends = np.cumsum(counts + 2)  # a text's runs: head, units, end
        runs = np.full(ends[-1], len(pool) - 1, np.int32)
        heads_at = ends - counts - 2
        runs[heads_at] = len(found) + np.arange(len(heads))
        rest = np.ones(len(runs), bool)
        rest[heads_at] = rest[ends - 1] = False
        runs[rest] = np.asarray(coded.indices)
        many = sizes[runs]
        stop = np.cumsum(many)
        first = np.cumsum(sizes) - sizes
        at = np.repeat(first[runs] - (stop - many), many) + np.arange(stop[-1])
        return np.frombuffer(b"".join(pool), "<u4")[at], np.diff(stop[ends - 1], prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in _ENCODERS:
        import public_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task per core already
        _ENCODERS[model] = Encoder(public_tokenizers.path(model))
    return _ENCODERS[model]


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Transpose a block of uint32 ids into 4 byte planes or 32 bit planes, each compressed."""
    import zstandard
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = raw.T
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes])
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little", count=n_ids)
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


BLOCK_SCHEMA = ("part int, first long, n_ids int, kind string, planes array<binary>, "
                "docs array<struct<doc_id: {key}, offset: long, n_tokens: long>>")

BLOCK_COLUMNS = ("part", "first", "n_ids", "kind", "planes", "docs")


def encoded_blocks(docs: DataFrame, model: str, end_id: int = 0, kind: str = "byte", block_ids: int = BLOCK_IDS,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of the format. Ranges of keys are sorted (ties by text), encoded and cut in one
    pass over each; a task holds one batch of texts and one block. Nulls: a null text is empty
    (the end id alone), a null key sorts first."""
    kind_of_key = docs.schema[key].dataType.simpleString()
    ranged = docs.select(key, text).repartitionByRange(F.col(key).asc())
    ranged = ranged.sortWithinPartitions(F.col(key).asc(), F.col(text).asc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part = encoder(model), TaskContext.get().partitionId()
        end = np.uint32(end_id).astype("<u4").tobytes()
        held, ready, starts, base = [], 0, [], 0
        key_type = None

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ready, starts, base
            ids = np.concatenate(held)
            at = 0
            while ready - at >= block_ids or last and ready > at:
                here = ids[at: at + block_ids]
                mine = [s for s in starts if s[1] < base + len(here)]
                starts = [s for s in mine if s[1] + s[2] > base + len(here)] + starts[len(mine):]
                doc_type = pa.list_(pa.struct([("doc_id", key_type), ("offset", pa.int64()), ("n_tokens", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([len(here)], pa.int32()),
                     pa.array([kind]), pa.array([to_planes(here, kind)], pa.list_(pa.binary())),
                     pa.array([[dict(zip(("doc_id", "offset", "n_tokens"), s)) for s in mine]], doc_type)],
                    ["part", "first", "n_ids", "kind", "planes", "docs"])
                at, base = at + len(here), base + len(here)
            held, ready = [ids[at:].copy()], ready - at

        for b in batches:
            key_type = b.column(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1).fill_null("")
            _, offsets = utf8_column(texts)
            for i, j in pieces(offsets, PIECE):
                ids, sizes = enc.encode(texts.slice(i, j - i), end)
                at = (base + ready + np.cumsum(sizes) - sizes).tolist()
                starts += zip(keys[i: j], at, sizes.tolist(), strict=True)
                held.append(ids)
                ready += len(ids)
                if ready >= block_ids:
                    yield from cut(False)
        if ready:
            yield from cut(True)

    return ranged.mapInArrow(run, BLOCK_SCHEMA.format(key=kind_of_key))


def write_token_file(docs: DataFrame, path: str, model: str, **options) -> None:
    """Encode ``docs`` and write the format to ``path`` (planes are compressed already)."""
    encoded_blocks(docs, model, **options).write.option("compression", "uncompressed").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each part (one number per part reaches the driver)."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        out[r["part"]] = total
        total += r["n"]
    return out


def start_column(blocks: DataFrame) -> Column:
    starts = part_starts(blocks)
    pairs = [F.lit(v) for kv in starts.items() for v in (int(kv[0]), int(kv[1]))]
    if not pairs:
        return F.lit(0).cast("long")
    table = F.create_map(*[p.cast("int") if i % 2 == 0 else p.cast("long") for i, p in enumerate(pairs)])
    return F.element_at(table, F.col("part"))


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Every document of a token file: ``key, start, n_tokens, ids`` (ids as little-endian bytes).

    A block gives the pieces of the documents in it. Only documents that cross blocks are shuffled,
    to be put together."""
    blocks = read_blocks(spark, path)
    kind_of_key = blocks.schema["docs"].dataType.elementType["doc_id"].dataType
    key_type, key_pa = kind_of_key.simpleString(), to_arrow_type(kind_of_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, base, n, kind, planes, docs = (b.column(c)[i].as_py() for c in BLOCK_COLUMNS)
                ids = from_planes(planes, n, kind)
                cuts = [(max(d["offset"], base), min(d["offset"] + d["n_tokens"], base + n)) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array([d["doc_id"] for d in docs], key_pa),
                     pa.array([d["offset"] for d in docs], pa.int64()), pa.array([d["n_tokens"] for d in docs], pa.int64()),
                     pa.array([a for a, _ in cuts], pa.int64()),
                     pa.array([ids[a - base: e - base].tobytes() for a, e in cuts], pa.binary())],
                    ["part", "doc_id", "offset", "n_tokens", "at", "ids"])

    found = blocks.select(*BLOCK_COLUMNS).mapInArrow(
        run, f"part int, doc_id {key_type}, offset long, n_tokens long, at long, ids binary")
    whole = F.octet_length("ids") == 4 * F.col("n_tokens")
    crossing = found.where(~whole).groupBy("part", "doc_id", "offset", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("runs"))
    glued = crossing.select("part", "doc_id", "offset", "n_tokens",
                            F.expr("aggregate(runs, X'', (a, r) -> concat(a, r.ids))").alias("ids"))
    both = found.where(whole).select("part", "doc_id", "offset", "n_tokens", "ids").unionByName(glued)
    return both.select(F.col("doc_id").alias(key), (start_column(blocks) + F.col("offset")).alias("start"),
                       "n_tokens", "ids")


