"""Near-duplicates by min-max hashing.

*Signatures.* One evaluation of a permutation over a document's shingles gives two signature
values, its minimum and its maximum, so half as many permutations fill the bands. Minima and
maxima go to bands of their own, which keeps the estimate unbiased.

*Candidates.* Documents with the same word sequence are one class, named by the sequence's hash
(not by a document: rows of one id may have different texts); each class is banded once, and
classes are led back to ids after their links are found. A bucket (band value) of many documents is
never expanded into all pairs: its members meet one hub, the member that meets most others.
Verified stars are joined into components, and buckets whose members lie in one component are
done. Members of the others are compared across components only, by an exact prefix filter
on their shingle sets (``prefix_pairs``), so no link between members of a bucket is lost.
Shingles that stand in the same sets are one weighted token there, and sets of few heavy tokens
meet on subsets of them: corpora made of shared paragraphs give few candidates.

*Links.* Each candidate pair is confirmed on the full shingle sets of the whole texts (as shingles or
as all tokens that two sets can share): ``100 * intersection >= 75 * union``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import (SHINGLE_STEP, WORD_STEP, mix64, per_text_words, powers, random_table, saved,
                               text_shingles, written)

PERMUTATIONS, ROWS = 60, 4
PERCENT = 75
CHUNK = 8192
LEVELS = (1, 2, 4, 6)  # tokens that a key of the exact pass joins
SUBSETS = 128  # keys of a set for each level beyond the first; a set of more keeps to lower levels
KEY_ROWS = 1 << 16  # rows of an output batch, about
MULTIPLY = random_table(PERMUTATIONS, 11) | np.uint64(1)
SHIFT = random_table(PERMUTATIONS, 12)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of all permutations over the shingle hashes."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        v = MULTIPLY[:, None] * shingles[None, i: i + CHUNK] + SHIFT[:, None]
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return np.concatenate((low, high))


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(-1, ROWS)
    step = powers(SHINGLE_STEP, ROWS)
    return mix64(mix64(parts * step).sum(axis=1, dtype=np.uint64) + np.arange(len(parts), dtype=np.uint64)).view(np.int64)


def sequence_hashes(words: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of a text's word sequence."""
    size = len(words)
    return ((words * powers(WORD_STEP, size)).sum(dtype=np.uint64) + np.uint64(size),
            (mix64(words) * powers(SHINGLE_STEP, size)).sum(dtype=np.uint64))


def sequences(rows: DataFrame) -> DataFrame:
    """``id, text`` of rows ``id, text``, with the hashes ``s1, s2`` of the word sequence as id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.array([sequence_hashes(words) for _, words in per_text_words(b.column(0))], np.uint64)
            pairs = pairs.reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), b.column(0)], ["s1", "s2", "text"])

    return rows.select("text").mapInArrow(run, "s1 long, s2 long, text string").select(
        F.struct("s1", "s2").alias("id"), "text")


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, s1, s2, bands``: shingles in the set, hash of the word sequence, band values (none if empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, seq, bands = [], [], []
            for _, words in per_text_words(b.column(1)):
                seq.append(sequence_hashes(words))
                found = np.unique(text_shingles(words))
                n.append(len(found))
                bands.append(band_keys(min_max(found)) if len(found) else np.zeros(0, np.int64))
            pairs = np.array(seq, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                 pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32),
                                          np.concatenate([*bands, np.zeros(0, np.int64)]))],
                ["id", "n", "s1", "s2", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets are alike enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1)
            left = per_text_words(batch.column(2))
            good = []
            for (_, x), (i, y) in zip(left, per_text_words(batch.column(3)), strict=True):
                if a[i] != last:
                    last, kept = a[i], np.unique(text_shingles(x))
                other = np.unique(text_shingles(y))
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(kept) + len(other) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), b.filter(mask)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id of the edges ``a, b``.

    Alternates large stars (neighbours above a node join its smallest neighbour) and small stars
    (it and its neighbours below do), which ends after a logarithmic number of rounds."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        now = saved(small.distinct())
        r = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (r["n"], r["x"]) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = (r["n"], r["x"])


def alike(a: str, b: str, percent: int = PERCENT):
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def shingle_rows(texts: DataFrame) -> DataFrame:
    """``rep, n, s``: a row for each shingle in each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(text_shingles(words)).view(np.int64) for _, words in per_text_words(b.column(1))]
            sizes = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes), pa.ListArray.from_arrays(
                    np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate([*sets, np.zeros(0, np.int64)]))],
                ["rep", "n", "s"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"rep {kind}, n long, s array<long>").select(
        "rep", "n", F.explode("s").alias("s"))


def token_lists(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """``rep, component, n, tokens``: each set as weighted tokens ``df, t, w`` that other sets hold too.

    Shingles that stand in exactly the same sets (a shared paragraph, say) are one token whose weight
    is their number, the same in every set that holds it. Shingles of one set only are left out."""
    rows = written(shingle_rows(texts.join(placed.select(F.col("rep").alias("id")), "id", "left_semi")), "shingles")
    held = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("rep")).alias("t")).where("df > 1")
    tokens = rows.join(held, "s").repartition("rep").groupBy("rep", "df", "t").agg(
        F.count(F.lit(1)).alias("w"), F.max("n").alias("n"))
    lists = tokens.groupBy("rep").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("t", "df", "w"))).alias("tokens"))
    return lists.join(placed, "rep")


def token_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, tokens, frequencies and weights of a column of token lists."""
    flat = column.flatten()
    part = [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lens))).astype(np.int64), *part


def subset_keys(t: np.ndarray, df: np.ndarray, w: np.ndarray, needs: tuple[int, int]) -> list[tuple]:
    """``(level, keys, short, left)`` of one set, for the levels that it can be found by.

    Level L: sets with enough in common share L tokens of the prefixes (in one order of all tokens)
    behind which, with the L - 1 heaviest tokens before, less than needed is left. Keys are the
    L-subsets of the prefix; ``short`` marks those within the prefix that the smaller set of a pair
    needs, ``left`` is the weight from the subset's first token on."""
    out = []
    for level in LEVELS:
        order = np.lexsort((t, df)) if level == 1 else np.lexsort((t, df, -w))
        total = np.concatenate(([0], np.cumsum(w[order])))
        bound = total[-1] - total + total[np.minimum(np.arange(len(total)), level - 1)]
        if bound.min() >= needs[0]:
            break
        long, short = (int(np.argmax(bound < need)) for need in needs)
        if level > 1 and comb(long, level) > SUBSETS:
            break
        chosen = np.arange(long)[:, None] if level == 1 else np.array(list(combinations(range(long), level)), np.int64)
        keys = mix64(mix64(t[order].view(np.uint64))[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(level)).view(np.int64)
        out.append((level, keys, chosen[:, -1] < short, (total[-1] - total)[chosen[:, 0]]))
    return out


def prefix_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``a, b`` of different components that may be similar, by an exact filter on ``token_lists``.

    With level 1, tokens are ordered from rare to common, and two sets with enough in common share one
    of the first few (the shorter set needs fewer). Sets of a few heavy tokens, such as documents made
    of paragraphs that many others hold, must share several: they meet on subsets of their heavy
    tokens, so that a paragraph in common is no reason to compare them. A pair meets at the highest
    level that both have."""
    def packed(b: pa.RecordBatch, rows: list, parts: list) -> pa.RecordBatch:
        which = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [b.column(k).take(which) for k in (0, 1, 3)] + [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)],
            ["rep", "n", "component", "key", "short", "left", "level", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, t, df, w = token_columns(b.column(2))
            rows, parts, size = [], [], 0
            for i, n in enumerate(b.column(1).to_pylist()):
                own = slice(at[i], at[i + 1])
                needs = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
                if w[own].sum() < needs[0]:
                    continue
                found = subset_keys(t[own], df[own], w[own], needs)
                top = found[-1][0]
                for level, keys, short, left in found:
                    rows.append(np.full(len(keys), i))
                    parts.append((keys, short, left, np.full(len(keys), level), np.full(len(keys), top)))
                    size += len(keys)
                if size > KEY_ROWS:
                    yield packed(b, rows, parts)
                    rows, parts, size = [], [], 0
            if rows:
                yield packed(b, rows, parts)

    kinds = {f.name: f.dataType.simpleString() for f in lists.schema}
    keys = written(lists.select("rep", "n", "tokens", "component").mapInArrow(
        run, f"rep {kinds['rep']}, n long, component {kinds['component']}, key long, short boolean, left long, "
             "level long, top long"), "prefixes")
    partner = F.when(F.col("level") < F.col("top"), F.array("level")).otherwise(
        F.filter(F.array(*[F.lit(x).cast("long") for x in LEVELS]), lambda v: v >= F.col("level")))
    x = keys.where("short").select(
        "key", F.explode(partner).alias("top"), F.col("rep").alias("x"), F.col("n").alias("nx"),
        F.col("left").alias("lx"), F.col("component").alias("cx"))
    y = keys.select("key", "top", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly"),
                    F.col("component").alias("cy"))
    fits = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    fits &= (F.col("cx") != F.col("cy")) & alike("nx", "ny", percent)
    fits &= (100 + percent) * F.least("lx", "ly") >= percent * (F.col("nx") + F.col("ny"))
    return x.join(y, ["key", "top"]).where(fits).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def token_links(pairs: DataFrame, lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets are alike enough, by the tokens they share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ax, tx, _, wx = token_columns(b.column(3))
            ay, ty, _, _ = token_columns(b.column(5))
            good = []
            for i, (n, m) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                shared = np.isin(tx[ax[i]: ax[i + 1]], ty[ay[i]: ay[i + 1]], assume_unique=True)
                both = int(wx[ax[i]: ax[i + 1]][shared].sum())
                good.append(100 * both >= percent * (n + m - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    x = lists.select(F.col("rep").alias("a"), F.col("n").alias("nx"), F.col("tokens").alias("x"))
    y = lists.select(F.col("rep").alias("b"), F.col("n").alias("ny"), F.col("tokens").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "nx", "x", "ny", "y").mapInArrow(run, f"a {kind}, b {kind}")


def links_between(reps: DataFrame, texts_of, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` that connect all near-duplicates among the representatives ``rep, n, bands``."""
    members = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(members.join(sizes, "bucket").select("bucket", "rep", "n", "size"), "buckets")
    texts = written(texts_of(members.select(F.col("rep").alias("id")).distinct()), "bucket-texts")
    # the original of many edited copies meets more of them than they meet each other: it is the hub
    fame = members.groupBy("rep").agg(F.sum("size").alias("fame"))
    members = members.join(fame, "rep").select("bucket", "rep", "n", "fame")
    hubs = members.groupBy("bucket").agg(F.min(F.struct((-F.col("fame")).alias("f"), "rep", "n")).alias("hub"))
    pairs = members.join(hubs, "bucket").where(F.col("rep") != F.col("hub.rep")).where(
        alike("n", "hub.n", percent)).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    tested = written(pairs, "stars")
    links = written(verified(tested, texts, percent), "star-links")
    comp = components(links).select(F.col("id").alias("rep"), "component")
    placed = members.select("bucket", "rep").join(comp, "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = written(placed.join(mixed, "bucket", "left_semi").select("rep", "component").distinct(), "open")
    both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lists = written(token_lists(texts, open_), "tokens")
    rest = written(prefix_pairs(lists, percent).join(both, ["a", "b"], "left_anti"), "rest")
    return links.unionByName(written(token_links(rest, lists, percent), "rest-links"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, n_shingles, component_id, kept`` (kept: the row's key is its component's).

    A null text counts as empty; empty texts are linked with nothing. Rows of one key are one
    document (their links are joined). A row without a key has no component (null) and is kept.
    Repeated rows each have a row; other columns are not read; an empty table gives an empty one."""
    base = written(signatures(docs, key, text), "signatures")
    named = base.where("id is not null")
    classes = named.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("first"))
    held = named.join(classes, ["s1", "s2"], "left").withColumn("first", F.coalesce("first", "id"))
    place = saved(held.select("id", "n", "first"))
    reps = written(held.where("first = id and n > 0").dropDuplicates(["s1", "s2"]).select(
        F.struct("s1", "s2").alias("rep"), "n", "bands", "first"), "classes")
    firsts = reps.select("rep", "first")

    def texts_of(ids: DataFrame) -> DataFrame:
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        wanted = firsts.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").select(F.col("first").alias("id"))
        return sequences(rows.join(wanted, "id", "left_semi")).join(ids, "id", "left_semi").dropDuplicates(["id"])

    links = links_between(reps.drop("first"), texts_of, percent)
    for end in ("a", "b"):
        links = links.join(firsts.withColumnRenamed("rep", end), end).drop(end).withColumnRenamed("first", end)
    # all classes of one id: each with the least of them
    several = place.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("z")).where("a <> z").select("id", "a")
    shared = place.join(several, "id").where("first <> a").select("a", F.col("first").alias("b")).distinct()
    comp = components(links.select("a", "b").unionByName(shared)).withColumnRenamed("id", "first")
    out = place.join(comp, "first", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))
    lost = base.where("id is null").select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                                           F.col("id").alias("component_id"))
    return out.unionByName(lost).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are near-duplicates of a kept one (all columns)."""
    gone = near_duplicates(docs, percent, key, text).where("not kept").select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
