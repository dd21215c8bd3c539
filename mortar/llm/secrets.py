"""Secret scans whose false positives are removed by a random forest.

*Candidates* (whole texts, one pass): values with a known key prefix; values assigned to a credential name,
quoted ones whatever their length and marks; and runs of 16 or more key-like characters with a digit.
*Findings for training* are labelled rows ``value, before, after, path, label``; ``format_labels``
labels the clear cases of a corpus by format rules (known key prefixes and quoted assignments to
a credential name; pure numbers, repeated patterns and placeholders), from a bounded sample.
*Features*: length, character transitions (share of class changes, log-likelihood under the
transitions of plain words), entropy, dictionary coverage, path and neighbouring words (hashed).
*Forest*: MLlib random forest; every candidate of the corpus is scored by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import hash_sample, mix64, saved, written

MAX_FINDINGS = 5_000
WORD_GROUPS, PATH_GROUPS = 24, 8
_WORD = re.compile(r"[^\W\d_]+|\S")

# Common words and word parts, for dictionary coverage.
DICTIONARY = ("the and for with that this from have not are was but you all can her his one our out day get has him how"
              " man new now old see two way who its did yes use may say she too any key name test user example license"
              " password token secret value data file code page text web index home site true false null none id date"
              " time ing ion tion ment able ness less ful est ers ent der die und ein des que les con por para une").split()
_DICTIONARY = re.compile("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))))

# Beginnings of public credential formats; names that credentials are assigned to.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "xoxp-", "AIza")
NAMES = ("token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "auth")
_NAMED = "|".join(NAMES)
_RUN = r"[A-Za-z0-9+/_=\-]"
#: A credential name, then a quoted value or a bare one of 6 or more characters; a known prefix and 8 more; a long run.
ASSIGNED = re.compile(r"(?:%s)[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}(?:\"([^\"\r\n]{4,512})\"|'([^'\r\n]{4,512})'|([^\s\"'<>,;]{6,512}))"
                      % _NAMED, re.IGNORECASE)
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:%s)%s{8,}" % ("|".join(re.escape(p) for p in PREFIXES), _RUN))
LONG_RUN = re.compile(_RUN + "{16,}")
PLACEHOLDERS = ("example", "xxxx", "placeholder", "changeme", "your", "dummy", "sample")


def char_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def entropy(value: str) -> float:
    counts = np.array([value.count(c) for c in set(value)], float) / max(len(value), 1)
    return float(-(counts * np.log2(counts)).sum())


VOWELS = set("aeiouyAEIOUY")


def group(text: str, n: int) -> int:
    code = np.uint64(5381)
    with np.errstate(over="ignore"):
        for b in text.encode():
            code = code * np.uint64(33) + np.uint64(b)
    return int(mix64(np.array([code]))[0] % np.uint64(n))


def feature_row(value: str, before: str, after: str, path: str) -> list[float]:
    kinds = [char_class(c) for c in value]
    n = max(len(value), 1)
    moves = np.zeros((4, 4))
    for a, b in zip(kinds, kinds[1:]):
        moves[a, b] += 1
    letters = [c for c in value if c.isalpha()]
    turns = sum((a in VOWELS) != (b in VOWELS) for a, b in zip(letters, letters[1:]))
    covered = sum(len(m.group()) for m in _DICTIONARY.finditer(value.lower()))
    hexa = sum(c in "0123456789abcdefABCDEF" for c in value)
    row = [math.log(n), entropy(value), covered / n, hexa / n, turns / max(len(letters) - 1, 1), len(set(value)) / n]
    row += (moves / max(n - 1, 1)).ravel().tolist()
    words = [0.0] * WORD_GROUPS
    for w in _WORD.findall(before.lower())[-3:]:
        words[group(w, WORD_GROUPS // 2)] += 1
    for w in _WORD.findall(after.lower())[:2]:
        words[WORD_GROUPS // 2 + group(w, WORD_GROUPS // 2)] += 1
    paths = [0.0] * PATH_GROUPS
    paths[group(path, PATH_GROUPS)] = 1.0
    return row + words + paths


def format_label(value: str, before: str) -> float:
    """1 a credential, 0 none, NaN unclear."""
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS) or len(set(value)) <= 4:
        return 0.0
    if value.startswith(PREFIXES):
        return 1.0
    if re.search(r"(?:%s)\W{0,3}[=:]\W{0,3}$" % _NAMED, before.lower()):
        digits, letters = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
        return 1.0 if digits and letters and entropy(value) > 2.5 else math.nan
    if not any(c.isdigit() for c in value):
        return 0.0
    if value.isdigit() or entropy(value) < 2.5:
        return 0.0
    return math.nan


SCHEMA = "start long, value string, before string, after string, path string, label double, x array<double>"


def spans(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of every candidate: assigned values first, then prefixed ones and runs that meet none of them."""
    found = []
    for m in ASSIGNED.finditer(text):
        found.append(m.span(next(g for g in (1, 2, 3) if m.group(g) is not None)))
    for rule in (PREFIXED, LONG_RUN):
        taken, k = sorted(found), 0
        for m in rule.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            clear = k == len(taken) or taken[k][0] >= m.end()
            if clear and (rule is PREFIXED or any(c.isdigit() for c in m.group())):
                found.append(m.span())
    return sorted(found)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate of every text: ``k, start`` (code points)``, value, before, after, path, label, x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for start, end in spans(t or ""):
                    value, before, after = t[start:end], t[max(0, start - 40): start], t[end: end + 20]
                    rows.append(i)
                    out.append((start, value, before, after, p or "", format_label(value, before),
                                feature_row(value, before, after, p or "")))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["k", "start", "value", "before", "after", "path", "label", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.col(path).cast("string")).mapInArrow(run, f"k {kind}, {SCHEMA}")


def labelled(found: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """A bounded sample of the clear findings, by hash of the value: half for each label, so a rare one is not lost.

    Of equal values with equal neighbours one is drawn; more than that many leave no task."""
    clear = found.where(~F.isnan("label") & F.col("label").isNotNull())
    one = clear.groupBy("label", F.xxhash64("value", "before", "after", "path").alias("h")).agg(F.min("x").alias("x"))
    one = saved(one)
    return hash_sample(one.where("label = 1"), most // 2, "h").unionByName(
        hash_sample(one.where("label = 0"), most // 2, "h")).select("x", "label")


def fit(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel | None:
    """The forest, or None unless both classes are there. ``findings``: ``x, label`` (bounded)."""
    rows = findings.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label")).coalesce(1)
    seen = rows.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    if seen["a"] is None or seen["a"] == seen["b"]:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, key: str = "doc_id",
         text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate: ``key, start, length, masked, digest, score, secret`` (score >= threshold).

    ``findings``: labelled rows ``x, label``; by default the clear cases of the corpus. The value is
    given masked, with a SHA-256 digest. Null or empty texts have no candidates; a null path is '';
    repeated rows give repeated findings; null keys are kept; an empty table gives an empty result;
    without findings of both classes the format rules alone decide (unclear: score 0.5)."""
    found = written(candidates(docs, key, text, path), "findings")
    model = fit(written(labelled(found), "labelled") if findings is None else findings)
    if model is None:
        scored = found.withColumn("score", F.when(F.isnan("label"), F.lit(0.5)).otherwise(F.col("label")))
    else:
        scored = model.transform(found.withColumn("features", array_to_vector("x"))).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select(F.col("k").alias(key), "start", F.length("value").cast("long").alias("length"),
                         F.concat(F.substring("value", 1, 4), F.lit("...")).alias("masked"),
                         F.sha2("value", 256).alias("digest"), "score", (F.col("score") >= threshold).alias("secret"))
