"""Group folds as columns: the rows of the long fold table, from one row for each data row."""

from pyspark.sql import functions as F

from mortar.operators import evaluate as EV
from mortar.operators import marks as MK
from mortar.operators import splits as S
from mortar.operators.gram import fold_moments
from mortar.session import materialize


def grouped_rows(spark, n=700, groups=90):
    rows = [(i, (i * i + i // 3) % groups if i % 4 else 5, float(i % 11), float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, group_id long, x double, y double").repartition(5)


def test_same_folds_as_the_long_table(spark):
    for k, groups in ((5, 90), (3, 4), (5, 2)):  # the last: folds without groups
        grouped = materialize(grouped_rows(spark, groups=groups))
        marked = MK.group_marks(grouped, k)
        assert marked.count() == grouped.count()
        names = ["regime", "repeat", "fold", "row_id", "split"]
        got = sorted(tuple(r) for r in MK.fold_rows(marked, k, "group").select(*names).collect())
        want = sorted(tuple(r) for r in S.inner_group_split(S.group_kfold(grouped, k), grouped, k).select(*names).collect())
        assert got == want
        assert want == sorted(tuple(r) for r in S.fold_table(grouped, "group", k, grouped=grouped).select(*names).collect())


def test_fold_table_of_copies(spark):
    grouped = grouped_rows(spark, n=60, groups=9)
    twice = materialize(grouped.unionByName(grouped))
    want = S.inner_group_split(S.group_kfold(twice), twice, 5)
    got = S.fold_table(twice, "group", grouped=twice).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_moments_and_rows_without_id(spark):
    grouped = grouped_rows(spark)
    grouped = materialize(grouped.unionByName(grouped.limit(9).withColumn("row_id", F.lit(None).cast("long")).withColumn(
        "group_id", F.lit(1000).cast("long"))))
    marked = materialize(MK.group_marks(grouped), by=None)
    got = MK.marked_moments(marked, ["x", "y"], regime="group")
    long = S.inner_group_split(S.group_kfold(grouped), grouped, 5)
    want = fold_moments(grouped.select("row_id", "x", "y"), long, ["x", "y"])
    assert got.keys() == want.keys()
    for key, parts in want.items():
        for split, m in parts.items():
            own = got[key][split]
            assert own.n == m.n and abs(own.my - m.my) < 1e-9 and abs(own.sxy[0] - m.sxy[0]) < 1e-6


def test_predictions_of_copies(spark):
    grouped = grouped_rows(spark, n=60, groups=9)
    grouped = materialize(grouped.unionByName(grouped.where("row_id < 20")))
    spec = [EV.ModelSpec("Linear Regression", "Linear Regression")]
    long = S.inner_group_split(S.group_kfold(grouped), grouped, 5)
    want = EV.gram_cv_predictions(grouped, long, ["x"], "y", spec, "")
    got = EV.marked_cv_predictions(materialize(MK.group_marks(grouped)), ["x"], "y", spec, "", regime="group", copies=True)
    rows = [sorted((r["fold"], r["split"], r["row_id"], round(r["predicted"], 8)) for r in d.collect()) for d in (want, got)]
    assert rows[0] == rows[1]
