"""Quality classifier by co-training on two views of a page.

*Views.* The text view sees content only: the mix of characters, word shapes and repetition. The
metadata view sees what a crawler records: language, source, length and line layout.

*Co-training.* Both views are fitted on labelled rows. In each round each view scores all unlabelled
rows, and those of which it is surest (above ``sure`` by its calibrated probability, in the classes'
proportion, more of them from round to round) join the *other* view's training rows as pseudo-labels. A view
that is never sure teaches nothing. Then each view is calibrated (Platt) on labelled rows kept
apart, and a logistic combination of the two calibrated scores is fitted there.

Both views of every distinct row are written once and scanned in every round. What is fitted on is bounded:
rows of ``max_labelled`` labelled keys, drawn by hash, and ``max_pool`` pseudo-labels.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import hash_sample, mix64, pieces, saved, utf8_column, word_hashes, word_spans, written

MAX_LABELLED, MAX_POOL = 4_000, 4_000
ROUNDS = 3
SURE = 0.95
BINS, BIN = 600, 0.05  # confidences (calibrated log-odds) are counted in steps
GROUPS = 16  # hash groups of language and of source

#: Bytes counted one by one: printable ASCII and the line feed; the rest are control and non-ASCII bytes.
CHAR_BIN = np.full(256, 96)
CHAR_BIN[32:127] = np.arange(95)
CHAR_BIN[10] = 95
CHAR_BIN[128:] = 97
N_TEXT, N_META = 98 + 6, 2 * GROUPS + 6


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two feature matrices of rows ``(text, lang, source)``; nulls count as empty."""
    data, offsets = utf8_column(batch.column(0))
    n = len(offsets) - 1
    text, meta = np.zeros((n, N_TEXT)), np.zeros((n, N_META))
    for a, b in pieces(offsets):
        lo = offsets[a]
        part, rel = data[lo: offsets[b]], offsets[a: b + 1] - offsets[a]
        size = np.diff(rel).astype(float)
        owner = np.repeat(np.arange(b - a), np.diff(rel))
        counts = np.bincount(owner * 98 + CHAR_BIN[part], minlength=(b - a) * 98).reshape(b - a, 98)
        text[a:b, :98] = np.sqrt(counts / np.maximum(size, 1)[:, None])
        starts, ends, first = word_spans(part, rel)
        hashes, lens = word_hashes(part, starts, ends), (ends - starts).astype(float)
        many = np.diff(first)
        per = np.maximum(many, 1)
        doc = np.repeat(np.arange(b - a), many)
        distinct = np.bincount(np.unique(np.stack((doc.astype(np.uint64), hashes)), axis=1)[0].astype(int),
                               minlength=b - a) if len(hashes) else np.zeros(b - a)
        upper = (part >= 65) & (part <= 90)
        last = part[ends - 1] if len(ends) else part[:0]
        odd = (last < 128) & ~(((last | 32) >= 97) & ((last | 32) <= 122)) & (last != 44) & (last != 46)
        text[a:b, 98:] = np.stack((
            np.log1p(many), _per(lens, first) / per / 10, _per(lens <= 3, first) / per,
            distinct / per, _per(upper, rel) / np.maximum(size, 1), _per(odd, first) / per), axis=1)
        feeds = _per(part == 10, rel)
        lines = feeds + (size > 0)
        ends_line = np.concatenate(((part[1:] == 10), [True]))[: len(part)] if len(part) else np.zeros(0, bool)
        closed = _per(((part == 46) | (part == 33) | (part == 63)) & ends_line, rel)
        blank = _per((part == 10) & ends_line, rel)
        meta[a:b, 2 * GROUPS:] = np.stack((
            np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / np.maximum(lines, 1)) / 8,
            closed / np.maximum(lines, 1), blank / np.maximum(lines, 1), (size == 0)), axis=1)
    for at, column in ((0, batch.column(1)), (GROUPS, batch.column(2))):
        raw, off = utf8_column(column)
        sums = [raw[off[i]: off[i + 1]].astype(np.uint64) for i in range(n)]
        group = np.array([int(mix64(np.array([hash_bytes(s)], np.uint64))[0] % np.uint64(GROUPS)) for s in sums], int)
        meta[np.arange(n), at + group] = 1
    return text, meta


def hash_bytes(values: np.ndarray) -> int:
    out = 7
    for v in values.tolist():
        out = (out * 1_000_003 + v) % (1 << 64)
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        beta = np.zeros(z.shape[1])
        for _ in range(steps):  # Newton
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            w = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(penalty),
                                   z.T @ (weight * (y - p)) - penalty * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:], -30, 30)


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """``a, b`` with ``P(good) = sigmoid(a * score + b)`` (smoothed targets, so both stay finite)."""
    pos, neg = y.sum(), (1 - y).sum()
    goal = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.column_stack((scores, np.ones(len(scores))))
    beta = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    loss = lambda b: float((np.logaddexp(0, z @ b) - goal * (z @ b)).sum())
    for _ in range(steps):
        p = sigmoid(z @ beta)
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (goal - p))
        while np.abs(step).max() > 1e-9 and loss(beta + step) > loss(beta):
            step = step / 2  # Newton's step overshoots where classes are almost apart
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Two fitted views, their calibrations and the combination."""

    models: tuple[Logistic, Logistic]
    calibrations: tuple[tuple[float, float], tuple[float, float]]
    mixture: np.ndarray

    @classmethod
    def fit(cls, views_: tuple[np.ndarray, np.ndarray], y: np.ndarray, lessons, rounds: int = ROUNDS) -> CoTrained:
        """A third of the labelled rows calibrates. ``lessons(models, calibrations, round)`` gives, for each view,
        the rows (its own features) and labels that the other view is surest of among all unlabelled rows."""
        held = np.arange(len(y)) % 3 == 0
        base = [(v[~held], y[~held]) for v in views_]
        models = tuple(Logistic.fit(*t) for t in base)
        calibrated = lambda: tuple(platt(m.logit(v[held]), y[held]) for m, v in zip(models, views_))
        for r in range(1, rounds + 1):
            taught = lessons(models, calibrated(), r)
            if not any(len(t[1]) for t in taught):
                break
            models = tuple(Logistic.fit(np.vstack((x, tx)), np.concatenate((t, ty)))
                           for (x, t), (tx, ty) in zip(base, taught))
        cals = calibrated()
        scores = np.column_stack([c[0] * m.logit(v[held]) + c[1] for c, m, v in zip(cals, models, views_)])
        z = np.column_stack((np.ones(len(scores)), np.clip(scores, -12, 12)))
        beta = np.array([0.0, 0.5, 0.5])
        for _ in range(50):
            p = sigmoid(z @ beta)
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.eye(3)
            beta = beta + np.linalg.solve(h, z.T @ (y[held] - p) - (beta - np.array([0.0, 0.5, 0.5])))
        return cls(models, cals, beta)

    def score(self, views_: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated P(good) by the text view, by the metadata view, and combined."""
        each = [c[0] * m.logit(v) + c[1] for c, m, v in zip(self.calibrations, self.models, views_)]
        z = np.column_stack((np.ones(len(each[0])), *[np.clip(e, -12, 12) for e in each]))
        return sigmoid(each[0]), sigmoid(each[1]), sigmoid(z @ self.mixture)


def inputs(docs: DataFrame, text: str) -> list:
    return [F.col(text).alias("text"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source")]


def view_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, key: str, text: str) -> DataFrame:
    """Both views of every row, once for each distinct content: ``k, y`` (null: unlabelled), ``a, m`` (float32 bytes).

    The labelled rows are those of at most ``max_labelled`` keys, by hash; a key with several labels has their
    majority. Copies of an unlabelled page, however many, are one row."""
    per = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("k")).agg(
        (F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))
    few = hash_sample(saved(per), max_labelled, "k")
    rows = docs.select(F.col(key).alias("k"), *inputs(docs, text)).join(F.broadcast(few), "k", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary())
                      for v in views(b.select(["text", "lang", "source"]))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), *packed], ["k", "y", "a", "m"])

    kind = docs.schema[key].dataType.simpleString()
    out = rows.select("k", "y", "text", "lang", "source").mapInArrow(run, f"k {kind}, y double, a binary, m binary")
    known = F.when(F.col("y").isNotNull(), F.col("k"))
    return written(out.select(known.alias("k"), "y", "a", "m").distinct(), "views")


def unpacked(column, width: int) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float32) for v in column], float).reshape(len(column), width)


def surest(pages: DataFrame, models: tuple, calibrations: tuple, quota: tuple[int, int], sure: float) -> list:
    """For each view, the rows that the other view is surest of: ``(features, labels)``, at most ``quota`` (bad, good).

    All unlabelled pages are scored twice: counts by teacher, class and confidence give the least confidence
    that fits the quota; then only the rows above it leave their tasks."""
    from_bin = math.log(sure / (1 - sure))

    def rated(batch: pa.RecordBatch) -> tuple[list, list]:
        own = [unpacked(batch.column(c).to_pylist(), w) for c, w in (("a", N_TEXT), ("m", N_META))]
        z = [c[0] * m.logit(v) + c[1] for c, m, v in zip(calibrations, models, own)]
        return z, [np.minimum(np.floor((np.abs(x) - from_bin) / BIN), BINS - 1).astype(int) for x in z]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BINS), np.int64)
        for b in batches:
            for k, (z, at) in enumerate(zip(*rated(b))):
                for good in (0, 1):
                    total[k, good] += np.bincount(at[(at >= 0) & ((z > 0) == good)], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    free = pages.where("y is null").select("a", "m")
    counts = np.zeros(4 * BINS, np.int64)
    for r in free.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(2, 2, BINS)
    down = np.cumsum(counts[:, :, ::-1], axis=2)[:, :, ::-1]  # rows at least that sure
    least = np.array([[np.argmax(np.append(down[k, g] <= quota[g], True)) for g in (0, 1)] for k in (0, 1)])
    # the class's bin just below the quota gives the share of its rows (by hash) that still fits
    share = np.zeros((2, 2))
    for k in (0, 1):
        for g in (0, 1):
            at = least[k, g] - 1
            if at >= 0 and counts[k, g, at]:
                above = down[k, g, least[k, g]] if least[k, g] < BINS else 0
                share[k, g] = (quota[g] - above) / counts[k, g, at]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draw = np.array([zlib.crc32(v) for v in b.column("a").to_pylist()], float) / 2 ** 32
            for k, (z, at) in enumerate(zip(*rated(b))):
                g = (z > 0).astype(int)
                mask = (at >= 0) & ((at >= least[k][g]) | ((at == least[k][g] - 1) & (draw < share[k][g])))
                if mask.any():
                    rows = pa.array(np.flatnonzero(mask))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), 1 - k)), pa.array(g[mask].astype(float)),
                         b.column("m" if k == 0 else "a").take(rows)], ["pupil", "y", "x"])

    found = free.mapInArrow(pick, "pupil long, y double, x binary").toPandas()  # about the quota, for each view and class
    found = found.sort_values(["pupil", "y", "x"], kind="stable")
    return [(unpacked(part.x.tolist(), width), part.y.to_numpy(float))
            for part, width in ((found[found.pupil == v], w) for v, w in ((0, N_TEXT), (1, N_META)))]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL,
        rounds: int = ROUNDS, key: str = "doc_id", text: str = "text", sure: float = SURE) -> CoTrained | None:
    """The classifier, or None when the labels hold fewer than three rows of a class.

    ``max_labelled``: labelled keys that are fitted on, one row each (of rows of one key the least by content).
    ``max_pool``: pseudo-labels that a view teaches the other in the last round, of all unlabelled rows."""
    pages = view_rows(docs, labels, max_labelled, key, text)
    one = pages.where("y is not null").groupBy("k").agg(F.min(F.struct("a", "m")).alias("x"), F.min("y").alias("y"))
    known = one.select("k", "x.a", "x.m", "y").toPandas()  # at most max_labelled rows
    known = known.iloc[np.argsort([zlib.crc32(str(k).encode()) for k in known.k], kind="stable")]
    y = known.y.to_numpy(float)
    held = np.arange(len(y)) % 3 == 0
    if len(y) == 0 or min((y[m] > 0.5).sum() for m in (held, ~held)) < 1 or min((y[m] < 0.5).sum() for m in (held, ~held)) < 1:
        return None

    def lessons(models: tuple, calibrations: tuple, r: int) -> list:
        size = max_pool * r // rounds
        good = int(size * y.mean())
        return surest(pages, models, calibrations, (size - good, good), sure)

    return CoTrained.fit((unpacked(known.a.tolist(), N_TEXT), unpacked(known.m.tolist(), N_META)), y, lessons, rounds)


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Per row: ``key, p_text, p_meta, score, keep`` (score >= threshold).

    A null text, language or source counts as empty and is scored as such; repeated rows have a
    row each; null keys are kept; other columns are not read; an empty table gives an empty one.
    Without a model (no usable labels) all probabilities are 1 and every row is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m, s = probabilities(model, b.select(["text", "lang", "source"]))
            yield pa.RecordBatch.from_arrays([b.column("k"), *map(pa.array, (a, m, s, s >= threshold))],
                                             ["k", "p_text", "p_meta", "score", "keep"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), *inputs(docs, text)).mapInArrow(
        run, f"k {kind}, p_text double, p_meta double, score double, keep boolean").withColumnRenamed("k", key)


def probabilities(model: CoTrained | None, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        return tuple(np.ones(batch.num_rows) for _ in range(3))
    return model.score(views(batch))


def kept(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that the classifier keeps, with all their columns (one pass, no shuffle).

    Nulls count as empty texts and values; each repeated row is judged by itself; no column is added, so none
    clashes; an empty table gives an empty one; without a model every row is kept."""
    at = [docs.columns.index(c) for c in (text, "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.RecordBatch.from_arrays([b.column(i).cast(pa.string()) for i in at], ["text", "lang", "source"])
            yield b.filter(pa.array(probabilities(model, part)[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
