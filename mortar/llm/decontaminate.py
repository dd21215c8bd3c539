"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

*Windows.* A 64-bit SimHash (sign of the summed bits of the word hashes) is taken of every
window of a text, for a ladder of window sizes fitted to the items: an item of L words is
searched with the largest size that a passage of the asked similarity must hold unbroken
(``clean_run``), and each of its sub-windows of that size is indexed. Running sums give all
windows of a size by one subtraction.

*Search.* The fingerprints are cut into ``radius + 1`` blocks; two within ``radius`` bits agree
in one block at least, so the tables of block values find all fingerprints within the radius.
Candidates are held against the true distance.

*Verification.* A candidate aligns the item with the text; the weighted similarity of the item's
5-word shingles and those of the best passage there, of any length and from a shared one to a
shared one (sum of smaller multiplicities over sum of larger), must be 0.75 or more.

The index is built from the benchmark in slices of about ``SLICE_ITEMS`` items (by hash), each
small enough to send to every task; every slice is searched, so no item is left out. Texts are
read once a slice and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mortar.llm.common import LOWER_TABLE, SHINGLE, pieces, text_shingles, utf8_column, word_hashes

SIMILARITY = 0.75
RADIUS = 3
SLICE_ITEMS = 5_000
SPAN = 1 << 13
#: Word characters: digits, letters and all bytes of non-ASCII characters (so marks around words don't count).
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_by_piece(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, word hashes, bounds)`` of about a megabyte of texts at a time (ASCII letters folded).

    Text ``i`` of a piece has the hashes ``bounds[i]:bounds[i + 1]``."""
    data, offsets = utf8_column(column)
    for a, b in pieces(offsets):
        lo = offsets[a]
        part, rel = data[lo: offsets[b]], offsets[a: b + 1] - offsets[a]
        inside = ~NOT_WORD[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[rel] = True
        starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1]))[: len(part)] | edge[:-1]))
        ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False]))[: len(part)] | edge[1:])) + 1
        yield a, word_hashes(part, starts, ends, LOWER_TABLE), np.searchsorted(starts, rel)


def clean_run(n_words: int, similarity: float = SIMILARITY) -> int:
    """Words of an item that a passage of the similarity must hold in one unbroken run.

    Every edit inside takes four or more of its n shingles and adds as many others, every word
    that is cut off or changed at an end takes one: with k edits inside at most
    ``n (1 - s) - 4 k (1 + s)`` may be missing at the ends. The least run over all k is returned."""
    n = max(1, n_words - SHINGLE + 1)
    runs, k = [], 0
    while (ends := n * (1 - similarity) - 4 * k * (1 + similarity) + 1e-9) >= 0:
        runs.append((n_words - int(ends) - k) // (k + 1))
        k += 1
    return max(1, min(n_words, *runs))


def ladder(longest: int) -> list[int]:
    """Window sizes 1, 2, .. 8, then growing by a fifth."""
    sizes = list(range(1, 9))
    while sizes[-1] < longest:
        sizes.append(sizes[-1] + max(1, sizes[-1] // 5))
    return sizes


def running_bits(words: np.ndarray, longest: int) -> np.ndarray:
    """Sums of the word hashes' bits before each word; they wrap, which differences undo."""
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    sums = np.zeros((len(words) + 1, 64), kind)
    np.cumsum(np.unpackbits(np.ascontiguousarray(words).view(np.uint8)).reshape(-1, 64), axis=0, dtype=kind, out=sums[1:])
    return sums


def simhashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words (a bit is set when most words set it)."""
    if len(sums) <= size:
        return np.zeros(0, np.uint64)
    return np.packbits(sums[size:] - sums[:-size] > size // 2, axis=1).view(np.uint64).ravel()


class Index:
    """Multi-index tables of the items' windows, by window size."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.ids, self.words = [], []
        column = pa.array([t for _, t in items], pa.string())
        for a, words, bounds in words_by_piece(column):
            for i in np.flatnonzero(np.diff(bounds)):
                self.ids.append(items[a + i][0])
                self.words.append(words[bounds[i]: bounds[i + 1]])
        self.keys = [np.unique(text_shingles(w), return_counts=True) for w in self.words]
        steps = np.array(ladder(max(map(len, self.words), default=1)))
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(self.words):
            size = int(steps[steps <= clean_run(len(w), similarity)][-1])
            prints = simhashes(running_bits(w, size), size)
            found.setdefault(size, []).append((prints, np.full(len(prints), k), np.arange(len(prints))))
        self.sizes = {size: self.tables(*map(np.concatenate, zip(*parts))) for size, parts in sorted(found.items())}

    def tables(self, prints: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple:
        blocks = []
        cuts = np.linspace(0, 64, self.radius + 2).astype(int)
        for lo, hi in zip(cuts, cuts[1:]):
            value = self.block(prints, lo, hi)
            order = np.argsort(value, kind="stable")
            held = np.zeros(1 << 16, dtype=bool)  # a first sieve by the block's low 16 bits
            held[value & np.uint64(0xFFFF)] = True
            blocks.append((lo, hi, held, value[order], order))
        return prints, owner, at, blocks

    @staticmethod
    def block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)

    def close(self, mine: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text window, item window) within the radius."""
        prints, _, _, blocks = tables
        wheres, whiches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi, held, values, order in blocks:
            value = self.block(mine, lo, hi)
            pos = np.flatnonzero(held[value & np.uint64(0xFFFF)])
            if not len(pos):
                continue
            first = np.searchsorted(values, value[pos], "left")
            many = np.searchsorted(values, value[pos], "right") - first
            for a in range(0, len(pos), 4096):  # bounded, however many items share a value
                m = many[a: a + 4096]
                where = np.repeat(pos[a: a + 4096], m)
                nth = np.arange(len(where)) - np.repeat(np.cumsum(m) - m, m)
                which = order[np.repeat(first[a: a + 4096], m) + nth]
                near = np.bitwise_count(mine[where] ^ prints[which]) <= self.radius
                wheres.append(where[near])
                whiches.append(which[near])
        return np.concatenate(wheres), np.concatenate(whiches)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """By text: ``(item, start)``, alignments of an item with the text that some close window suggests."""
        out: dict[int, set[tuple[int, int]]] = {}
        longest = max(self.sizes, default=1)
        for a in range(0, len(words), SPAN):
            sums = running_bits(words[a: a + SPAN + longest - 1], longest)
            for size, tables in self.sizes.items():
                where, which = self.close(simhashes(sums[: SPAN + size], size), tables)
                where = where + a
                text = np.searchsorted(bounds, where, "right") - 1
                inside = where + size <= bounds[text + 1]  # windows that cross texts are none
                where, which, text = where[inside], which[inside], text[inside]
                start = where - bounds[text] - tables[2][which]
                for t, k, s in zip(text.tolist(), tables[1][which].tolist(), start.tolist()):
                    out.setdefault(t, set()).add((k, s))
        return out

    def similar(self, item: int, words: np.ndarray, start: int) -> tuple[float, int]:
        """Best weighted similarity of a passage around an alignment, and its first word (0, 0: none enough).

        A passage alike enough has at most ``n / s`` shingles (n: the item's), so all that meet the
        item's span lie within so many words of it. Of these the best is taken, over all its first
        and last shingles that are the item's; ties: the first, then the shortest."""
        own, many = self.keys[item]
        n, size = int(many.sum()), min(SHINGLE, len(self.words[item]))
        most = int(n / self.similarity + 1e-9)
        a, b = max(0, start - most - SHINGLE), max(0, start + len(self.words[item]) + most + SHINGLE)
        here = text_shingles(words[a:b], size)
        spot = np.minimum(np.searchsorted(own, here), len(own) - 1)
        at = np.flatnonzero(own[spot] == here)
        least = max(1, int(np.ceil(n * self.similarity - 1e-9)))
        if len(at) < least:
            return 0.0, 0
        spot = spot[at]
        # a shared shingle counts unless the passage holds as many of it before as the item has
        order, back = np.argsort(spot, kind="stable"), np.full(len(at), -1)
        gap, group = many[spot[order]], np.arange(len(at))
        same = group - gap >= 0
        same[same] = spot[order][group[same] - gap[same]] == spot[order][group[same]]
        back[order[same]] = order[group[same] - gap[same]]
        best, first = 0.0, 0
        for i in range(len(at) - least + 1):
            end = int(np.searchsorted(at, at[i] + most))  # passages of at most so many shingles
            if end - i < least:
                continue
            both = np.cumsum(back[i:end] < i)[least - 1:]
            like = both / (n + (at[i + least - 1:end] - at[i] + 1) - both)
            top = float(like.max())
            if top > best:
                best, first = top, a + int(at[i])
        return best, first

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """``(row, item number, best similarity, its first word, alignments)`` of a column's texts, verified."""
        for row, words, bounds in words_by_piece(column):
            for t, found in sorted(self.candidates(words, bounds).items()):
                mine, best = words[bounds[t]: bounds[t + 1]], {}
                for item, start in sorted(found):
                    like, first = self.similar(item, mine, start)
                    if like >= self.similarity:
                        old = best.get(item, (0.0, 0, 0))
                        best[item] = (*max(old[:2], (like, first), key=lambda x: (x[0], -x[1])), old[2] + 1)
                for item, m in best.items():
                    yield (row + t, item, *m)


def slices(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple]]:
    """The benchmark in hash slices of about ``size`` items, one at a time on the driver."""
    rows = benchmark.select(F.col(item), F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
    n = max(1, -(-rows.count() // size))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id",
                 text: str = "text", item: str = "item_id", item_text: str = "text",
                 slice_items: int = SLICE_ITEMS) -> DataFrame:
    """Every (document, item) with a passage like the item: ``key, item, similarity, first_word, n_places``.

    ``first_word``: where the best passage starts (words from 0; ties: the first), ``n_places``:
    alignments that were verified. Items and texts that are null or without words match nothing;
    repeated rows give repeated results; null keys are kept; other columns are not read; without
    documents or items the result is empty."""
    kinds = docs.schema[key].dataType, benchmark.schema[item].dataType
    item_type = to_arrow_type(kinds[1])

    def search(index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for b in batches:
                out = list(found.matches(b.column(1)))
                rows = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), pa.array([found.ids[o[1]] for o in out], item_type),
                     pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int64()),
                     pa.array([o[4] for o in out], pa.int64())],
                    ["k", "i", "similarity", "first_word", "n_places"])

        return docs.select(key, text).mapInArrow(
            run, f"k {kinds[0].simpleString()}, i {kinds[1].simpleString()}, similarity double, first_word long, "
                 "n_places long")

    out = None
    for rows in slices(benchmark, item, item_text, slice_items):
        part = search(Index(rows, similarity))
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"k": key, "i": item})


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text",
          item: str = "item_id", item_text: str = "text", slice_items: int = SLICE_ITEMS) -> DataFrame:
    """``docs`` without the rows that hold a passage like a benchmark item (all columns, no shuffle)."""
    at = docs.columns.index(text)
    for rows in slices(benchmark, item, item_text, slice_items):
        sent = docs.sparkSession.sparkContext.broadcast(Index(rows, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[m[0] for m in sent.value.matches(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
