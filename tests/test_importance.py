"""Permutation importance in passes against a plain permutation of each test fold."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pytest

from mortar.operators import evaluate as EV
from mortar.operators import marks as MK
from mortar.operators import splits as S
from mortar.session import freed_shuffles

COLS, SPEC = ["a", "b"], EV.ModelSpec("Linear Regression", "Linear Regression")


def study(n=400, copies=()):
    rng = np.random.default_rng(5)
    t = pd.DataFrame({"row_id": rng.permutation(n) * 3, "group_id": np.arange(n) // 7, "a": rng.random(n), "b": rng.random(n) * 1e4})
    t["y"] = 3 * t["a"] + t["b"] / 5e3 + rng.normal(size=n) / 5
    return pd.concat([t, t.iloc[list(copies)]])


def plainly(test: pd.DataFrame, train_of, n_repeats, seed):
    """``test``: fold and the row's columns; ``train_of(fold)``: the rows that its model is fitted on."""
    drops = {}
    for fold, own in test.sort_values("row_id").groupby("fold"):
        tr = train_of(fold)
        w = np.linalg.lstsq(np.column_stack([np.ones(len(tr)), tr[COLS]]), tr["y"], rcond=None)[0]
        pred = w[0] + own[COLS].to_numpy() @ w[1:]
        sst = ((own["y"] - own["y"].mean()) ** 2).sum()
        for j, c in enumerate(COLS):
            for r in range(n_repeats):
                key = own["row_id"].map(lambda i: (md5(f"{seed}:{j}:{r}:{i}".encode()).hexdigest()[:8], i))  # noqa: B023
                moved = own[c].to_numpy()[np.argsort(key.rank(method="first").to_numpy(), kind="stable")]
                worse = ((own["y"] - pred - w[1 + j] * (moved - own[c])) ** 2).sum() - ((own["y"] - pred) ** 2).sum()
                drops.setdefault((c, fold), []).append(worse / sst)
    return {c: np.mean([np.mean(v) for (d, _), v in drops.items() if d == c]) for c in COLS}


@pytest.mark.parametrize("pass_rows,range_rows", [(EV.PASS_ROWS, EV.RANGE_ROWS), (1000, 16)])
def test_group_folds_in_passes(spark, monkeypatch, pass_rows, range_rows):
    monkeypatch.setattr(EV, "PASS_ROWS", pass_rows)
    monkeypatch.setattr(EV, "RANGE_ROWS", range_rows)
    rows = study()
    marked = MK.group_marks(spark.createDataFrame(rows), 5, 0).drop("group_id").checkpoint()
    test = rows.merge(marked.selectExpr("row_id", "tests[0] AS fold").toPandas(), on="row_id")
    want = plainly(test, lambda f: test[test["fold"] != f], 4, 0)
    got = {r["feature"]: r["importance"] for r in EV.marked_importance(marked, COLS, "y", SPEC, 5, "group", 4).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_fold_table_and_marks_agree_with_copies_of_an_id(spark):
    frame = spark.createDataFrame(study(200, copies=(3, 3, 50))).checkpoint()
    folds = S.fold_table(frame, "group", grouped=frame)
    marked = MK.group_marks(frame, 5, 0).drop("group_id").checkpoint()
    old = EV.permutation_importance_linear(frame.drop("group_id"), folds, COLS, "y", SPEC, 3, 1).collect()
    new = EV.marked_importance(marked, COLS, "y", SPEC, n_repeats=3, seed=1).collect()
    assert [r["feature"] for r in new] == [r["feature"] for r in old]
    assert [r["importance"] for r in new] == pytest.approx([r["importance"] for r in old], rel=1e-9)


def test_a_pass_keeps_no_row_per_permutation(spark):
    """Donors are packed: the rows that are shuffled do not grow with the rows of a fold (n times 120 before)."""
    n, combos = 5000, [(j, r) for j in range(2) for r in range(10)]
    job = EV.Permutations(combos, 0, {(0, 0): 0}, {0: 4}, [[1.0, 2.0]])
    rows = pd.DataFrame({"unit": 0, "part": 0, "tail": [f":{i}" for i in range(n)], "y": 1.0, "pred": 0.5,
                         "x0": np.arange(n) * 1.0, "x1": np.arange(n) * 2.0})
    counts = next(job.counts([rows]))
    job.place(counts.to_dict("records"))
    packed = pd.concat(job.pieces([rows], range(len(combos))))
    assert len(packed) == 4 * (1 + len(combos))
    assert packed[packed["combo"] >= 0]["data"].map(len).sum() == 12 * n * len(combos)


def test_shuffle_files_are_dropped_between_passes(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
        assert spark.range(1000).repartition(3).selectExpr("sum(id)").first()[0] == 499500
    assert spark.conf.get(name) == before
