"""Toxicity: segments against brute force, held-out accuracy, planted passages."""

import random
import zlib

import numpy as np
import pytest

from mortar.llm import toxicity
from mortar.llm.common import table
from mortar.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute_segments(scores):
    """By definition: the best segment (ties: the shortest, then the first), then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            value = sum(scores[i:j])
            if value > 0 and (best is None or (value, -(j - i)) > (best[0], -(best[2] - best[1]))):
                best = (value, i, j)
    if best is None:
        return []
    value, i, j = best
    right = [(a + j, b + j, v) for a, b, v in brute_segments(scores[j:])]
    return [*brute_segments(scores[:i]), (i, j, value), *right]


def test_all_maximal_segments():
    random.seed(1)
    for _ in range(300):
        scores = [random.choice([-3.0, -1.0, -0.5, 0.25, 2.0, 5.0]) + random.random() / 100 for _ in range(random.randint(0, 14))]
        got = toxicity.maximal_segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert np.allclose([v for *_, v in got], [v for *_, v in brute_segments(scores)])


def test_segments_of_a_long_row_are_found_in_linear_time():
    scores = np.where(np.arange(400_000) % 2, -1.0, 1.0) + np.linspace(0, -1e-3, 400_000)
    assert toxicity.maximal_segments(scores)


def test_nested_prefix_odds():
    hashes = np.array([[11, 21], [11, 22], [0, 31], [11, 99]], np.uint64)  # prefix, word; the last word is unseen
    scores = toxicity.TokenScores.fit(np.array([11, 21, 22, 31], np.uint64), np.array([60.0, 60, 0, 3]),
                                      np.array([300.0, 0, 300, 30]), 100, 900)
    odds = scores.log_odds(hashes)
    assert odds[0] > 2 and odds[1] < 0 and abs(odds[2]) < 0.5 and abs(odds[3]) < 1


def test_held_out_accuracy(spark):
    df = QUERIES["op13_toxicity"](spark, SF)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = df.join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.98
    toxic = [r["score"] for r in held if r["toxic"] == 1]
    clean = [r["score"] for r in held if r["toxic"] == 0]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.95


SCHEMA = "doc_id long, text string, k string, y int, toxic int, score double, text2 string"


def planted(n=300):
    random.seed(2)
    plain = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "ester", "fol") for b in ("na", "ric", "tos", "um", "ive", "or")]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(plain, k=random.randint(5, 120))
        if i % 6 == 0:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["vile", "Vilest,", "vilely", "ROTTER"]))
        rows.append((i, " ".join(words)))
        labels.append((i, i % 6 == 0))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = planted()
    docs = spark.createDataFrame([(*r, "x", 0, 0, 0.0, "y") for r in rows], SCHEMA)
    return toxicity.fit(docs, spark.createDataFrame([(i, int(t)) for i, t in labels], "doc_id long, toxic int"))


def test_planted_passages(spark, model):
    rows, labels = planted()
    docs = spark.createDataFrame([(*r, "x", 0, 0, 0.0, "y") for r in rows], SCHEMA)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == t for i, t in labels) >= 0.98 * len(labels)
    text = "alna berica " * 30 + "you vilest rotter, vile! " + "dunum folive " * 30
    found = toxicity.passages(spark.createDataFrame([(1, text, "x", 0, 0, 0.0, "y")], SCHEMA), model).collect()
    assert len(found) == 1 and found[0]["passage"] == "vilest rotter, vile"
    assert (found[0]["first_word"], found[0]["last_word"]) == (61, 63)


def test_toxicity_edges(spark, model):
    """Nulls, empty and very long texts, repeated rows, clashing columns; labels with nulls and no class."""
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "alna " * 300_000), (5, "vile vile rotter"), (5, "vile vile rotter"),
            (None, "vilest vile rotter"), (7, "é" * 70_000 + " 漢字 \x00")]
    docs = spark.createDataFrame([(*r, "x", 0, 0, 0.0, "y") for r in rows], SCHEMA)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    flags = {}
    for r in got:
        flags.setdefault(r["doc_id"], []).append(r["predicted"])
    assert flags[5] == [1, 1] and flags[None] == [1] and all(flags[i] == [0] for i in (1, 2, 3, 4, 7))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert toxicity.score(docs.limit(0), model).collect() == []
    some = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    none = toxicity.fit(docs, some)
    assert none is None and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), some) is None


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows, labels = planted()
    docs = spark.createDataFrame([(*r, "x", 0, 0, 0.0, "y") for r in rows], SCHEMA)
    wrong = [(i, int(t) if zlib.crc32(str(i).encode()) % 5 else 1 - int(t)) for i, t in labels]
    right = [(i, int(t)) for i, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (wrong, right))
    assert (a.slope, a.base, a.law) == (b.slope, b.base, b.law) and np.array_equal(a.tokens.toxic, b.tokens.toxic)
