"""Toxic passages by maximum-scoring segments over token log-odds.

*Tokens* are words (runs of letters, digits and non-ASCII bytes, lower-cased). A word is looked up whole
and by its prefixes, so inflected forms of a stem that was never seen whole still count.

*Log-odds.* A text counts each of its distinct words and prefixes once. The log-odds that a word speaks for toxic
text come from its own counts under a Dirichlet prior whose shares are those of its shortest prefix's other
words, corrected prefix by prefix (each text counts on one level only), of ``PRIOR`` pseudo-texts at the
start and at most ``BACKING`` handed down. They are moved towards 0 by ``CONFIDENCE`` standard errors; the
k-th occurrence in a text weighs 1/k, and every token pays ``DRIFT``, so that the expected score is negative.

*Segments.* One linear scan finds all maximal segments, the disjoint passages whose score no extension or
cut improves.

*Extreme values.* The best segment among ``n`` tokens of clean text follows a Gumbel law whose location grows
with ``log n``; its two parameters come from the clean training texts. A document's evidence is the least
likely of its best 1, 2, .. segments together (the Poisson sum of the normalised scores), and a logistic
curve turns evidence into a probability. Both are fitted on scores by the log-odds of the *other* half
of the texts; near copies, which share their smallest shingle, fall into the same half and count once.

Fitting uses at most ``MAX_LABELLED`` labelled ids (by hash) and keeps at most ``MAX_FEATURES`` features
(by z-score); scoring covers every row in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import (BYTE_TABLE, WORD_STEP, hash_sample, mix64, per_text_words, pieces, powers, saved,
                               text_shingles, utf8_column, word_hashes, word_spans)

MAX_LABELLED, MAX_FEATURES = 50_000, 65_536
PRIOR, BACKING, CONFIDENCE, DRIFT = 2.0, 20.0, 1.64, 0.3
PREFIXES = (3, 4, 5, 6, 8)
LEAST_SPREAD = 0.5  # of the Gumbel law
COMPACT = 1 << 20  # features kept by a task before they are summed up
BINS, BIN_FROM, BIN_WIDTH = 400, -20.0, 0.25
EULER = 0.5772156649015329
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[48:58] = IS_GAP[65:91] = IS_GAP[97:123] = IS_GAP[128:] = False


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, in place of the same bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3
    out[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


@dataclass
class Words:
    """The words of a few texts: ``kind`` numbers each word's entry in ``features`` (0 pads missing prefixes)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    kind: np.ndarray
    features: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = folded(data)
    starts, ends, first = word_spans(data, offsets, IS_GAP)
    whole = word_hashes(data, starts, ends, BYTE_TABLE)
    distinct, at, kind = np.unique(whole, return_index=True, return_inverse=True)
    features = np.zeros((len(distinct), len(PREFIXES) + 1), np.uint64)
    features[:, -1] = distinct | np.uint64(1)
    if len(distinct):
        s, size = starts[at], ends[at] - starts[at]
        reach = np.minimum(s[:, None] + np.arange(PREFIXES[-1]), len(data) - 1)
        running = np.cumsum(BYTE_TABLE[data[reach]] * powers(WORD_STEP, PREFIXES[-1]), axis=1, dtype=np.uint64)
        for j, n in enumerate(PREFIXES):
            features[:, j] = np.where(size > n, mix64(running[:, n - 1] + np.uint64(n << 32)) | np.uint64(1), 0)
    return Words(starts, ends, first, kind, features)


def texts_of(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """``(first row, words)`` of bounded pieces of a text column; nulls count as empty."""
    data, offsets = utf8_column(column)
    for a, b in pieces(offsets):
        yield a, words_of(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments ``(start, end, score)`` of a row of scores, in linear time.

    Neighbours of one sign always stay together, so the scan steps over runs. A candidate keeps the sums
    before and after it, and a link to the nearest earlier candidate that starts lower."""
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    cuts = np.flatnonzero(np.append(True, positive[1:] != positive[:-1]))
    sums = np.add.reduceat(scores, cuts).tolist()
    edges = [*cuts.tolist(), len(scores)]
    found: list[list] = []  # start, end, sum before, sum after, link
    total = 0.0
    for k, value in enumerate(sums):
        before, total = total, total + value
        if value <= 0:
            continue
        now = [edges[k], edges[k + 1], before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                now[4] = j
                found.append(now)
                break
            now[0], now[2] = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, b - a) for s, e, a, b, _ in found]


@dataclass
class TokenScores:
    """Counts of known features by their sorted hashes, and the share of toxic words among all."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    base: float

    @classmethod
    def fit(cls, keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> TokenScores:
        order = np.argsort(keys)
        return cls(keys[order], toxic[order], clean[order], (n_toxic + 1) / (n_toxic + n_clean + 2))

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        """One number for each row of features (prefixes, then the word); 0 where nothing is sure."""
        at = np.minimum(np.searchsorted(self.keys, features), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == features) if len(self.keys) else np.zeros(features.shape, bool)
        t, c = (np.where(known, v[at], 0.0) if len(v) else np.zeros(features.shape) for v in (self.toxic, self.clean))
        for j in range(features.shape[1] - 2, -1, -1):  # a prefix that the word is too short for holds nothing else
            short = features[:, j] == 0
            t[short, j], c[short, j] = t[short, j + 1], c[short, j + 1]
        for_toxic = np.full(len(features), PRIOR * self.base)
        for_clean = np.full(len(features), PRIOR * (1 - self.base))
        for j in range(features.shape[1] - 1):
            for_toxic += np.maximum(t[:, j] - t[:, j + 1], 0.0)
            for_clean += np.maximum(c[:, j] - c[:, j + 1], 0.0)
            much = np.minimum(1.0, BACKING / (for_toxic + for_clean))
            for_toxic, for_clean = for_toxic * much, for_clean * much
        for_toxic, for_clean = for_toxic + t[:, -1], for_clean + c[:, -1]
        odds = np.log(for_toxic / for_clean) - math.log(self.base / (1 - self.base))
        return np.sign(odds) * np.maximum(np.abs(odds) - CONFIDENCE * np.sqrt(1 / for_toxic + 1 / for_clean), 0.0)

    def of(self, words: Words) -> np.ndarray:
        """A score for each word of the texts."""
        if not len(words.kind):
            return np.zeros(0)
        scores = self.log_odds(words.features)[words.kind]
        high = np.flatnonzero(scores > 0)
        text = np.searchsorted(words.first, high, side="right")
        order = np.lexsort((high, words.kind[high], text))
        new = np.append(True, (np.diff(words.kind[high][order]) != 0) | (np.diff(text[order]) != 0))[: len(high)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(high)), 0))
        scores[high[order]] /= np.arange(len(high)) - start + 1  # repeats tell less and less
        return scores - DRIFT


def segments(words: Words, scores: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """``(number of tokens, segments)`` of each text; positions count from the text's first word."""
    for i in range(len(words.first) - 1):
        own = scores[words.first[i]: words.first[i + 1]]
        yield len(own), maximal_segments(own)


@dataclass
class Gumbel:
    """Law of the best segment among ``n`` clean tokens: location ``at + spread log n``."""

    at: float
    spread: float

    @classmethod
    def fit(cls, n: float, best: float, best2: float, logs: float, logs2: float) -> Gumbel:
        """By moments: sums over ``n`` clean texts of the best score, its square, log length, its square."""
        if n < 1:
            return cls(0.0, 1.0)
        mean, mean_log = best / n, logs / n
        var, var_log = max(best2 / n - mean * mean, 0.0), max(logs2 / n - mean_log * mean_log, 0.0)
        spread = max(math.sqrt(var / (var_log + math.pi ** 2 / 6)), LEAST_SPREAD)
        return cls(mean - spread * (mean_log + EULER), spread)

    def normalised(self, score: float, n: int) -> float:
        return (score - self.at) / self.spread - math.log(max(n, 1))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """-log of about the chance that clean text has such best segments, over the best 1, 2, .. of them."""
        scores = sorted((s for _, _, s in found), reverse=True) or [0.0]
        best = total = self.normalised(scores[0], n)
        ways = 0.0  # log(r! (r-1)!)
        for r, score in enumerate(scores[1:], 2):
            more = self.normalised(score, n)
            if more <= 0:
                break
            total += more
            ways += math.log(r) + math.log(r - 1)
            best = max(best, total - (r - 1) * math.log(total) + ways)
        return best


@dataclass
class Toxicity:
    """Token scores, the law of clean text, and the logistic curve over evidence."""

    tokens: TokenScores
    law: Gumbel
    slope: float
    base: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.base, -30, 30)))


def held_out(key: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, max_labelled: int, key: str, text: str) -> DataFrame:
    """``(half, y, text)``: one text for each label and each group of near copies (equal smallest shingle).

    An id with several labels has their majority, ties count as toxic. Only texts of the chosen ids move."""
    usable = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(key)))
    per = usable.groupBy(F.col(key).alias("k")).agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("y"))
    few = hash_sample(saved(per), max_labelled, "k")  # bounded: at most max_labelled ids and labels
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = np.zeros(b.num_rows, np.int64)
            for i, hashes in per_text_words(b.column(1)):
                least[i] = text_shingles(hashes).min(initial=np.uint64(2 ** 64 - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(least), b.column(0), b.column(1)], ["sketch", "y", "text"])

    sketched = rows.select("y", "text").mapInArrow(run, "sketch long, y int, text string")
    one = sketched.groupBy("sketch", "y").agg(F.min("text").alias("text"))
    return saved(one.select(F.pmod(F.xxhash64("sketch"), F.lit(2)).cast("int").alias("half"), "y", "text"))


def feature_counts(train: DataFrame) -> DataFrame:
    """Per feature: the training texts that have it, by half and label (``c00`` clean of half 0, .., ``c11``).

    Feature 0 holds the sums over texts of their distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            counts = np.zeros((len(keys), 4), np.int64)
            np.add.at(counts, at, np.concatenate([c for _, c in kept]))
            return keys, counts

        def out() -> pa.RecordBatch:
            keys, counts = summed()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts.T)],
                                              ["feature", "c00", "c01", "c10", "c11"])

        for b in batches:
            cell = 2 * b.column(0).to_numpy() + b.column(1).to_numpy()
            for a, words in texts_of(b.column(2)):
                many = np.diff(words.first)
                doc = np.repeat(np.arange(len(many)), many)
                word = np.unique(doc * len(words.features) + words.kind) if len(words.kind) else doc
                held = np.bincount(cell[a + word // max(len(words.features), 1)], minlength=4) if len(word) else np.zeros(4, int)
                kept.append((np.zeros(1, np.uint64), held[None, :]))
                doc, found = word // max(len(words.features), 1), words.features[word % max(len(words.features), 1)]
                flat, doc = found.ravel(), np.repeat(doc, found.shape[1])
                flat, doc = flat[flat != 0], doc[flat != 0]
                order = np.lexsort((doc, flat))
                flat, doc = flat[order], doc[order]
                new = np.append(True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])) if len(flat) else np.zeros(0, bool)
                ones = np.zeros((int(new.sum()), 4), np.int64)
                ones[np.arange(len(ones)), cell[a + doc[new]]] = 1
                kept.append((flat[new], ones))
                size += len(ones)
                if size > COMPACT:
                    kept[:] = [summed()]
                    size = len(kept[0][0])
                    if size > COMPACT // 2:
                        yield out()
                        kept, size = [], 0
        if kept:
            yield out()

    counted = train.select("half", "y", "text").mapInArrow(run, "feature long, c00 long, c01 long, c10 long, c11 long")
    return saved(counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")]))


def best_features(counts: DataFrame, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` features, those with the largest z-scores over all training texts: hashes and counts (n x 4).

    The least z-score follows from counts per thousandth, so no task and no driver holds more than the result."""
    toxic, clean = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10")
    n_toxic, n_clean = float(sizes[1] + sizes[3]) + 1, float(sizes[0] + sizes[2]) + 1
    t = toxic + PRIOR * n_toxic / (n_toxic + n_clean)
    c = clean + PRIOR * n_clean / (n_toxic + n_clean)
    z = F.abs(F.log(t / n_toxic) - F.log(c / n_clean)) / F.sqrt(1 / t + 1 / c)
    ranked = counts.withColumn("z", F.least(F.floor(z * 1000), F.lit(1_000_000)))
    left, least = limit, 0
    for r in ranked.groupBy("z").count().orderBy(F.desc("z")).collect():  # a row for each thousandth that occurs
        if r["count"] > left:
            least = r["z"] + 1
            break
        left -= r["count"]
    top = ranked.where(F.col("z") >= least).toPandas()
    return top["feature"].to_numpy(np.int64).view(np.uint64), top[["c00", "c01", "c10", "c11"]].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES,
        key: str = "doc_id", text: str = "text") -> Toxicity | None:
    """The model, or None where the labels that may be learnt from lack a class."""
    train = training_texts(docs, labels, max_labelled, key, text)
    counted = feature_counts(train)
    sizes = np.array([float(v or 0) for v in counted.where("feature = 0").drop("feature").first() or [0] * 4])
    if sizes[1] + sizes[3] == 0 or sizes[0] + sizes[2] == 0:
        return None
    keys, counts = best_features(counted.where("feature <> 0"), sizes, max_features)
    tokens = TokenScores.fit(keys, counts[:, 1] + counts[:, 3], counts[:, 0] + counts[:, 2],
                             sizes[1] + sizes[3], sizes[0] + sizes[2])
    crossed = [TokenScores.fit(keys, counts[:, 2 * h + 1], counts[:, 2 * h], sizes[2 * h + 1], sizes[2 * h])
               for h in (1, 0)]  # texts of half 0 are scored by half 1

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list]]:
        for b in batches:
            half, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, words in texts_of(b.column(2)):
                own = [list(segments(words, c.of(words))) for c in crossed]
                for i in range(len(words.first) - 1):
                    yield int(y[a + i]), *own[half[a + i]][i]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(5)
        for y, n, found in scanned(batches):
            if y == 0 and n:
                best, size = max((s for _, _, s in found), default=0.0), math.log(n)
                sums += (1.0, best, best * best, size, size * size)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], ["n", "b", "bb", "l", "ll"])

    rows = train.select("half", "y", "text")
    total = rows.mapInArrow(moments, "n double, b double, bb double, l double, ll double").agg(
        *[F.sum(c).alias(c) for c in ("n", "b", "bb", "l", "ll")]).first()
    law = Gumbel.fit(*[float(v or 0.0) for v in total])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BINS, 2), np.int64)
        for y, n, found in scanned(batches):
            at = int((law.evidence(n, found) - BIN_FROM) / BIN_WIDTH)
            counts[min(max(at, 0), BINS - 1), y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), *map(pa.array, counts.T)], ["bin", "clean", "toxic"])

    bins = rows.mapInArrow(histogram, "bin long, clean long, toxic long").groupBy("bin").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic > 0").toPandas()
    x = BIN_FROM + (bins["bin"].to_numpy() + 0.5) * BIN_WIDTH
    return Toxicity(tokens, law, *logistic(x, bins["clean"].to_numpy(float), bins["toxic"].to_numpy(float)))


def logistic(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (0 or more) and base of ``P(toxic | x)`` from counts at each x; targets are smoothed by one case."""
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (clean.sum() + 2)
    z, weight = np.column_stack((x, np.ones(len(x)))), clean + toxic
    goal = (toxic * high + clean * low) / np.maximum(weight, 1)
    beta = np.array([0.0, math.log(max(goal @ weight, 1e-9) / max((1 - goal) @ weight, 1e-9))])
    loss = lambda b: float(weight @ (np.logaddexp(0, z @ b) - goal * (z @ b)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + 1e-6 * np.eye(2),
                               z.T @ (weight * (goal - p)))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def score(docs: DataFrame, model: Toxicity | None, threshold: float = 0.5, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Per row: ``key, held_out, score, predicted, n_passages``.

    A null text counts as empty and is scored like one without a segment; repeated rows each have a row; a null
    key is kept and not held out; an empty table gives an empty one; only key and text are read. Without a
    model every score is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, many = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            if model is not None:
                evidence = np.zeros(b.num_rows)
                for a, words in texts_of(b.column(2)):
                    for i, (n, found) in enumerate(segments(words, model.tokens.of(words)), a):
                        evidence[i] = model.law.evidence(n, found)
                        many[i] = sum(model.law.normalised(s, n) > -math.log(0.01) for _, _, s in found)
                p = model.probability(evidence)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p),
                                              pa.array((p >= threshold).astype(np.int32)), pa.array(many)],
                                             ["k", "held_out", "score", "predicted", "n_passages"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), held_out(F.col(key)).alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"k {kind}, held_out boolean, score double, predicted int, n_passages int"
                           ).withColumnRenamed("k", key)


def passages(docs: DataFrame, model: Toxicity, expected: float = 0.01, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Every significant passage: ``key, first_word, last_word, passage, log_odds, expected``.

    Significant: clean text of that length has such a segment fewer than ``expected`` times. Texts without
    one, empty and null texts have no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            data, offsets = utf8_column(b.column(1))
            for a, words in texts_of(b.column(1)):
                for i, (n, found) in enumerate(segments(words, model.tokens.of(words))):
                    for s, e, value in found:
                        chance = math.exp(-min(max(model.law.normalised(value, n), -700.0), 700.0))
                        if chance < expected:
                            lo = offsets[a] + words.starts[words.first[i] + s]
                            hi = offsets[a] + words.ends[words.first[i] + e - 1]
                            rows.append((a + i, s, e - 1, data[lo:hi].tobytes().decode("utf-8", "replace"), value, chance))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64()),
                pa.array(cols[5], pa.float64())], ["k", "first_word", "last_word", "passage", "log_odds", "expected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"k {kind}, first_word int, last_word int, passage string, log_odds double, expected double"
    ).withColumnRenamed("k", key)
