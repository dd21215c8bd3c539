"""Stack queries: all folds of both regimes, and the block form against the long form."""

from pyspark.sql import functions as F

from mortar.operators import metrics as M
from mortar.plans import q_models as QM


def _orders(spark, tmp_path, n=900):
    """A folder with ``orders`` of its own, 30 customers."""
    spark.range(1, n + 1).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 30 + 1).alias("o_custkey"),
        (F.col("id") * 7919 % 100_000).cast("double").alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_cv_stack_runs_all_repeats(spark, tmp_path, monkeypatch):
    seen = []
    whole = M.metrics_all
    monkeypatch.setattr(M, "metrics_all", lambda pred: seen.append(pred) or whole(pred))
    rows = QM.cv_stack(spark, _orders(spark, tmp_path)).collect()
    folds = {tuple(r) for pred in seen for r in pred.select("regime", "repeat", "fold").distinct().collect()}
    assert folds == {("random", r, f) for r in range(5) for f in range(5)} | {("group", 0, f) for f in range(5)}
    assert {r["regime"] for r in rows} == {"random", "group"}


def test_blocks_give_the_stack_of_the_long_table(spark):
    from test_extra_trees import COLS, frame
    from mortar.operators import splits as S
    from mortar.operators import stacking as ST
    features, _, x, y = frame(spark, 400)
    plain, folds = S.random_folds(features, 5, 2, 0, data=features)
    oof = S.oof_folds_random(plain, 5, 0, rows=folds)
    bases = QM.STACK_BASES[:2]
    long = ST.stack_predictions(features, folds, oof, COLS, "y", bases, QM.META_ENET, "s", "fs")
    marked = S.random_marks(features, 5, 2, 0)[1]
    got = ST.marked_stack(features, marked, COLS, "y", bases, QM.META_ENET, "s", "fs", 5, 2)
    at = lambda rows: {(r["repeat"], r["fold"], r["split"], r["row_id"]): r for r in rows}
    want, have = at(long.collect()), at(got.collect())
    assert set(want) == set(have) and len(have) == 2 * 5 * 400
    assert all(abs(have[i]["predicted"] - want[i]["predicted"]) < 1e-7 and have[i]["actual"] == want[i]["actual"] for i in want)


def test_no_row_table_of_smogn_is_broadcast(spark):
    from test_extra_trees import COLS, frame
    from mortar.operators import evaluate as EV
    from mortar.operators import smogn as SM
    from mortar.session import materialize
    features, folds, x, y = frame(spark, 300)
    train = folds.where("split = 'train'").join(features, "row_id")
    aug = SM.augment(train, COLS, "y")
    plan = aug._jdf.queryExecution().optimizedPlan().toString()
    pred = EV.augmented_cv_predictions(features, folds, materialize(aug), COLS, "y", QM.STACK_BASES[:1], "fs", "r")
    assert plan.count("strategy=merge") >= 3 and "strategy=merge" in pred._jdf.queryExecution().optimizedPlan().toString()
