"""Split invariants and exact greedy group K-fold vs a brute-force walk."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mortar.operators import groups as G
from mortar.operators import marks as MK
from mortar.operators import splits as S
from mortar.sources.tables import mix_valid
from tests.conftest import SF_SMALL


def brute_greedy(sizes: dict, k: int) -> dict:
    loads = [0] * k
    out = {}
    for gid, sz in sorted(sizes.items(), key=lambda t: (-t[1], -t[0])):
        f = int(np.argmin(loads))
        loads[f] += sz
        out[gid] = f
    return out


def closed_form(sizes: dict, k: int) -> dict:
    runs = {}
    for gid, sz in sizes.items():
        runs.setdefault(sz, []).append(gid)
    pieces = S.greedy_pieces([("", s, len(g)) for s, g in sorted(runs.items(), key=lambda t: -t[0])], {"": k})
    out = {}
    for _, s, a, b, c, folds in pieces:
        ids = sorted(runs[s], reverse=True)
        for i in range(a, b):
            out[ids[i]] = folds[(i - a) % c]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=40), min_size=1, max_size=300), st.integers(2, 7))
def test_closed_form_greedy_equals_brute_force(sz, k):
    sizes = {i: s for i, s in enumerate(sz)}
    assert closed_form(sizes, k) == brute_greedy(sizes, k)


def test_group_kfold_spark_equals_brute_force(spark):
    grouped = G.assign_groups(mix_valid(spark, SF_SMALL))
    sizes = {r["group_id"]: r["n"] for r in grouped.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    got = {r["group_id"]: r["fold"] for r in S.group_kfold_assign(grouped, 5).collect()}
    assert got == brute_greedy(sizes, 5)


def test_kfold_invariants(spark):
    base = mix_valid(spark, SF_SMALL)
    n = base.count()
    kf = S.kfold(base, 5, 3, 0).toPandas()
    for rep, part in kf.groupby("repeat"):
        assert len(part) == n and part.row_id.is_unique
        sizes = part.fold.value_counts()
        assert sizes.max() - sizes.min() <= 1
    folds = S.fold_table(base, "random", 5, 2, 0).toPandas()
    for (rep, fold), part in folds.groupby(["repeat", "fold"]):
        assert part.row_id.is_unique and len(part) == n
        tv = (part.split != "test").sum()
        assert (part.split == "val").sum() == max(1, round(tv * 0.2))


def test_group_regime_no_straddling(spark):
    base = mix_valid(spark, SF_SMALL)
    grouped = G.assign_groups(base)
    folds = S.fold_table(base, "group", grouped=grouped)
    audit = S.leakage_audit(folds, grouped).collect()
    assert all(r["n_straddling"] == 0 for r in audit)
    # and val groups never share a group with train rows inside a fold
    j = folds.where("split != 'test'").join(grouped, "row_id").groupBy("fold", "group_id").agg(
        F.countDistinct("split").alias("n")).where("n > 1").count()
    assert j == 0


def test_partition_independence(spark):
    base = mix_valid(spark, SF_SMALL)
    a = S.kfold(base.repartition(1), 5, 2, 0).toPandas().sort_values(["repeat", "row_id"]).reset_index(drop=True)
    b = S.kfold(base.repartition(37), 5, 2, 0).toPandas().sort_values(["repeat", "row_id"]).reset_index(drop=True)
    assert a.equals(b)


def test_run_pieces_random_loads():
    rng = random.Random(3)
    for _ in range(200):
        k = rng.randint(2, 6)
        loads = [rng.randint(0, 50) for _ in range(k)]
        s, m = rng.randint(1, 9), rng.randint(1, 60)
        pieces, new = S._run_pieces(loads, s, m)
        cur = list(loads)
        seq = []
        for _ in range(m):
            f = int(np.argmin(cur))
            cur[f] += s
            seq.append(f)
        got = [fs[(i - a) % c] for a, b, c, fs in pieces for i in range(a, b)]
        assert got == seq and new == cur


def test_fold_marks_equal_fold_table(spark):
    base = mix_valid(spark, SF_SMALL)
    small = base.orderBy("row_id").limit(3)
    for df, repeats in ((base, 3), (small, 2), (base.limit(0), 2)):
        rows = MK.fold_rows(MK.fold_marks(df.select("row_id"), 5, repeats, 0))
        got = sorted((r["repeat"], r["fold"], r["row_id"], r["split"]) for r in rows.collect())
        want = sorted((r["repeat"], r["fold"], r["row_id"], r["split"])
                      for r in S.fold_table(df, "random", 5, repeats, 0).collect())
        assert got == want
