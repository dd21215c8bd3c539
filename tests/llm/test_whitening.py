"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from mortar.llm import whitening
from mortar.llm.common import table
from mortar.llm.queries import QUERIES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("rank", [1, 5, 24])
def test_rank_one_updates_add_up(rank):
    rng = np.random.default_rng(rank)
    rows = np.floor(rng.normal(size=(200, rank)) @ rng.normal(size=(rank, 24)) * 50)
    rows[20:40], rows[50:53] = rows[7], 0.0
    d, q = np.zeros(24), np.eye(24)
    for row in rows:
        d, q = whitening.rank_one(d, q, row)
    want = rows.T @ rows
    assert np.abs((q * d) @ q.T - want).max() < 1e-11 * np.abs(want).max()
    assert np.abs(q.T @ q - np.eye(24)).max() < 1e-11
    assert (np.diff(d) >= 0).all()


def test_roots_between_poles():
    d = np.array([0.0, 1.0, 1.0 + 1e-9, 50.0])
    z2 = np.array([1e-6, 3.0, 1e-3, 2.0])
    origin, offset = whitening.secular_roots(d, z2, 2.0)
    roots = d[origin] + offset
    want = np.linalg.eigvalsh(np.diag(d) + 2.0 * np.outer(np.sqrt(z2), np.sqrt(z2)))
    assert np.allclose(roots, want, rtol=1e-13, atol=1e-13)


def test_combined_spectra():
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(30, 6)) for _ in range(4)]
    spectra = [(lambda e: (e[0], e[1]))(np.linalg.eigh(p.T @ p)) for p in parts]
    d, q = whitening.combined(spectra)
    rows = np.vstack(parts)
    assert np.allclose((q * d) @ q.T, rows.T @ rows)


def check(df, rows, k):
    x = np.floor(np.array([v for _, v in rows], dtype=float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = df.toPandas()
    assert len(got) == n * k and (got.n == n).all()
    deviations = {}
    for (key, _), row in zip(rows, x):
        deviations.setdefault(key, set()).add(sum(int(v) ** 2 for v in n * row - sums))
    assert all(v in deviations[key] for key, v in zip(got.vec_id, got.deviation))
    assert [int(v) for v in got.deviation_exact] == got.deviation.tolist()
    assert np.allclose(got.groupby("component").explained.first(), values[:k] / values.sum(), rtol=1e-9)
    assert got.identity_error.max() < 1e-9
    if got.vec_id.nunique() == n:
        w = got.pivot(index="vec_id", columns="component", values="whitened").loc[[key for key, _ in rows]].to_numpy()
        want = z @ vectors[:, :k] / np.sqrt(values[:k])
        assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8


def test_whitening_of_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF_SMALL, "embeddings").collect()]
    df = QUERIES["op12_whitening"](spark, SF_SMALL)
    assert df.columns[:4] == ["vec_id", "component", "n", "deviation"]
    check(df, rows, 8)


SCHEMA = "vec_id long, embedding array<float>, c int, key string, n int"


def test_whitening_edges(spark):
    """Nulls, non-finite entries, other lengths, repeats, fewer dimensions than components, clashing columns."""
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=5)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (94, []), (95, [1.0, 2.0])]
    rows = [(i, v, 1, "x", 2) for i, v in good + bad]
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7))
    check(df, good, 5)
    again = good + [good[3]] * 30
    check(whitening.whiten(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in again], SCHEMA).repartition(3)), again, 5)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1, "x", 2)], SCHEMA)).collect()
    assert [(r["vec_id"], r["whitened"], r["deviation"], r["explained"]) for r in one] == [(None, 0.0, 0, 0.0)] * 2


def test_deviations_beyond_64_bits():
    x = np.array([[100_000, 101_000], [99_000, 100_500]])
    for n in (10, 10 ** 7, 10 ** 10, 10 ** 13):
        sums = np.array([100_123, 100_456]) * n - 7
        want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
        assert whitening.exact_deviation(x, n, sums) == want
