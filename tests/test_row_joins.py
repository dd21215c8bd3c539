"""Joins with a row per data row are not broadcast; folds by cuts equal folds by ranks, copies included."""

import pytest
from pyspark.sql import functions as F

from mortar.operators import marks as MK
from mortar.operators import metrics as M
from mortar.operators import splits as S
from mortar.operators import trees as TR
from mortar.plans import fixtures
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_ranks(df, k, repeats, seed):
    return S.inner_random_split(S.kfold(df, k, repeats, seed), k, seed)


@pytest.mark.parametrize("n, copies", [(0, 1), (3, 1), (211, 1), (60, 2)])
def test_fold_table_by_cuts_equals_ranks(spark, n, copies):
    df = spark.createDataFrame([(i * 7,) for i in range(n) for _ in range(copies)], "row_id long")
    names = ["regime", "repeat", "fold", "row_id", "split"]
    got = sorted(map(tuple, S.fold_table(df, "random", 5, 2, 3).select(*names).collect()))
    assert got == sorted(map(tuple, by_ranks(df, 5, 2, 3).select(*names).collect()))


@pytest.mark.parametrize("copies", [1, 2])
def test_joined_folds_equal_a_later_join(spark, copies):
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(97) for _ in range(copies)], "row_id long, x double")
    plain, both = S.random_folds(df, 5, 2, 0, data=df)
    want = plain.join(df, "row_id").select(*both.columns)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))


def test_oof_folds_have_exact_sizes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "row_id long, x double")
    plain, both = S.random_folds(df, 5, 1, 0, data=df)
    oof = S.oof_folds_random(plain, 4, 0, rows=both)
    assert oof.where("x is null or x <> row_id").count() == 0
    n = {r["fold"]: r["n"] for r in plain.where("split = 'train'").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    for r in oof.groupBy("fold", "inner_fold").agg(F.count("*").alias("n")).collect():
        assert r["n"] == n[r["fold"]] // 4 + (r["inner_fold"] < n[r["fold"]] % 4)


def test_metrics_broadcast_the_group_means_only(spark):
    pred = fixtures.fixture_predictions(spark, SF_SMALL)
    found = plan(M.metrics_all(pred))
    for side in found.split("BroadcastExchange")[1:]:
        assert "Generate" not in side.split("BroadcastHashJoin")[0]
    assert "BuildRight" in found and "BuildLeft" not in found


def test_row_tables_are_not_broadcast(spark):
    assert "Broadcast" not in plan(fixtures.fixture_predictions(spark, SF_SMALL))
    data = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"))
    folds = S.plain_folds(data.select("row_id", F.lit(0).alias("repeat"), (F.col("row_id") % 5).cast("int").alias("fold")), 5, "g")
    frame = TR.assemble(data.withColumn("y", F.col("a")), ["a"], "y")
    assert "Broadcast" not in plan(TR.fold_frames(folds, frame, ("g", 0, 1))[1])


def test_marks_hold_one_hash_for_all_folds(spark):
    """Dozens of hashes in one expression are too much code to be compiled."""
    df = spark.createDataFrame([(i,) for i in range(40)], "row_id long")
    found = plan(MK.fold_marks(df, 5, 5, 0))
    assert 1 <= found.count("md5(") <= 2
