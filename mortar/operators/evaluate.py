"""Cross-validated evaluation (I1, I13, I14, G14) for the Gram family.

Plan per (feature set, regime):

1. fold table (F3) - computed once, reused by every model;
2. moment pass - centred sums per disjoint cell of rows (test fold, validation folds);
3. driver - merge the cells of a fold's train rows and one p x p solve per (model, fold);
4. prediction pass - fold table joined with the features and a broadcast coefficient
   table (``#models x #folds`` rows, bounded by the configuration) -> F4 long table;
5. metrics - :mod:`mortar.operators.metrics`.

Only steps 2 and 4 touch the rows; neither shuffles them (aggregates combine map-side,
the coefficient join is a broadcast hash join).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mortar.operators import linear
from mortar.operators import marks as MK
from mortar.operators.gram import collect_grams, fold_moments, gram_agg, moments, shift_means
from mortar.session import row_side

FOLD_KEYS = ["regime", "repeat", "fold"]


@dataclass
class ModelSpec:
    name: str
    solver: str
    params: dict = field(default_factory=dict)


def linear_predict(cols: list[str], b0: Column, beta: Column) -> Column:
    """``b0 + sum_i beta[i] * x_i`` as one Catalyst expression."""
    expr = b0
    for i, c in enumerate(cols):
        expr = expr + F.element_at(beta, i + 1) * F.col(c)
    return expr


def fold_coefficients(features: DataFrame, folds: DataFrame, cols: list[str], label: str,
                      specs: list[ModelSpec], with_means: bool = False) -> list[tuple]:
    """Steps 2-3: ``(model, regime, repeat, fold, b0, [beta])`` in original coordinates.

    With ``with_means`` each row also carries the target mean of the fold's train / val /
    test rows (read off the same Grams), so the metric pass needs no second aggregate."""
    data = features.select("row_id", *cols, label)
    return solve_folds(fold_moments(data, folds, cols + [label]), specs, with_means)


def solve_folds(moments_of: dict, specs: list[ModelSpec], with_means: bool = False) -> list[tuple]:
    """Step 3 on the moments of every fold's splits."""
    rows = []
    for key, parts in sorted(moments_of.items()):
        means = [float(parts[s].my) if s in parts and parts[s].n > 0 else None for s in ("train", "val", "test")]
        for spec in specs:
            b0, beta = linear.SOLVERS[spec.solver](parts["train"], **spec.params)
            row = (spec.name, key[0], int(key[1]), int(key[2]), float(b0), [float(b) for b in beta])
            rows.append(row + tuple(means) if with_means else row)
    return rows


COEF_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("regime", T.StringType()),
    T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType()),
    T.StructField("b0", T.DoubleType()), T.StructField("beta", T.ArrayType(T.DoubleType())),
])


def gram_cv_predictions(features: DataFrame, folds: DataFrame, cols: list[str], label: str,
                        specs: list[ModelSpec], feature_set: str) -> DataFrame:
    """I1 for Gram models: the F4 prediction table for every spec and fold."""
    coefs = fold_coefficients(features, folds, cols, label, specs, with_means=True)
    data = features.select("row_id", *cols, F.col(label).alias("actual"))
    return _predictions(folds.join(data, "row_id"), coefs, cols, feature_set)


def marked_cv_predictions(marked: DataFrame, cols: list[str], label: str, specs: list[ModelSpec], feature_set: str,
                          k: int = 5, regime: str = "random", copies: bool = False) -> DataFrame:
    """I1 on rows that carry their folds (:mod:`mortar.operators.marks`): the same table, no fold table, no shuffle.

    ``copies``: rows with copies of their id count as often as in the long table of group folds (one shuffle)."""
    coefs = solve_folds(MK.marked_moments(marked, cols + [label], k, regime), specs, with_means=True)
    data = marked.select("row_id", *cols, F.col(label).alias("actual"), "tests", "vals")
    data = MK.id_copies(data) if copies else data
    return _predictions(MK.fold_rows(data, k, regime), coefs, cols, feature_set)


def _predictions(rows: DataFrame, coefs: list[tuple], cols: list[str], feature_set: str) -> DataFrame:
    """Step 4 on fold rows that carry the features and ``actual``."""
    schema = T.StructType(COEF_SCHEMA.fields + [T.StructField(f"__m_{s}", T.DoubleType()) for s in ("train", "val", "test")])
    j = rows.join(F.broadcast(rows.sparkSession.createDataFrame(coefs, schema)), FOLD_KEYS)  # models x folds
    ybar = F.when(F.col("split") == "train", F.col("__m_train")).when(F.col("split") == "val", F.col("__m_val")) \
        .otherwise(F.col("__m_test"))
    return j.select("model", F.lit(feature_set).alias("feature_set"), "regime", "repeat", "fold", "split",
                    "row_id", "actual", linear_predict(cols, F.col("b0"), F.col("beta")).alias("predicted"),
                    ybar.alias("__ybar"))


def full_fit(features: DataFrame, cols: list[str], label: str, spec: ModelSpec) -> tuple[float, list[float]]:
    """Refit on all rows (one Gram pass) -> (b0, beta) in original coordinates."""
    data = features.select(*cols, label)
    zc = cols + [label]
    shift = shift_means(data, zc)
    g = collect_grams(gram_agg(data, zc, [], shift), [], len(zc))[()]
    b0, beta = linear.SOLVERS[spec.solver](moments(g), **spec.params)
    return float(b0 + shift[-1] - shift[:-1] @ beta), [float(b) for b in beta]


def loo_ols_predictions(features: DataFrame, cols: list[str], label: str, feature_set: str,
                        model: str = "Linear Regression") -> DataFrame:
    """E3 + H1: exact leave-one-out predictions in one pass (PRESS: e_i / (1 - h_ii)).

    ``h_ii = x~' pinv(X~'X~) x~`` with ``x~ = [1, x - shift]``; the hat expression is a
    fixed (p+1)^2-term Catalyst expression, so no row is refitted and nothing is n^2.
    """
    data = features.select("row_id", *cols, label)
    zc = cols + [label]
    shift = shift_means(data, zc)
    g = collect_grams(gram_agg(data, zc, [], shift), [], len(zc))[()]
    p = len(cols)
    n = g[0, 0]
    sd = np.sqrt(np.maximum(np.diag(g)[1: p + 1] / n - (g[0, 1: p + 1] / n) ** 2, 0.0))
    sd[sd == 0] = 1.0
    d = np.concatenate([[1.0], 1.0 / sd])
    gx = g[: p + 1, : p + 1] * np.outer(d, d)          # scale-free rank tolerance
    gxy = g[: p + 1, p + 1]
    w, v = np.linalg.eigh((gx + gx.T) / 2)
    keep = w > linear.PINV_RTOL * w.max()
    a = ((v[:, keep] / w[keep]) @ v[:, keep].T) * np.outer(d, d)
    coef = a @ gxy
    xs = [F.lit(1.0)] + [F.col(c) - F.lit(float(s)) for c, s in zip(cols, shift[:-1])]
    fit = F.lit(0.0)
    for i in range(p + 1):
        fit = fit + F.lit(float(coef[i])) * xs[i]
    fit = fit + F.lit(float(shift[-1]))
    hat = F.lit(0.0)
    for i in range(p + 1):
        for j in range(i, p + 1):
            wgt = a[i, j] * (1.0 if i == j else 2.0)
            if wgt != 0.0:
                hat = hat + F.lit(float(wgt)) * xs[i] * xs[j]
    resid = F.col(label) - fit
    pred = F.col(label) - F.try_divide(resid, F.lit(1.0) - hat)  # null where no fit exists without the row
    from mortar.operators.rank import rank_by_numeric
    ranked = rank_by_numeric(data, "row_id", out="fold")
    return ranked.select(F.lit(model).alias("model"), F.lit(feature_set).alias("feature_set"),
                         F.lit("loocv").alias("regime"), F.lit(0).alias("repeat"), F.col("fold").cast("long").alias("fold"),
                         F.lit("test").alias("split"), "row_id", F.col(label).alias("actual"), pred.alias("predicted"))


def learning_curve(features: DataFrame, cols: list[str], label: str, k: int = 5,
                   sizes: tuple[float, ...] = tuple(np.linspace(0.2, 1.0, 8)), spec: ModelSpec | None = None):
    """nested train prefixes (row order) per contiguous fold, all sizes in one Gram pass.

    A train row's rank inside fold f's train part is closed-form (folds are contiguous),
    so each row lands in the smallest size bucket that contains it; cumulative sums of
    the bucket Grams give every prefix Gram. -> (train_size, train/test R^2 mean/std).
    """
    from mortar.operators.rank import rank_by_numeric
    from mortar.operators.splits import ntile_fold
    spec = spec or ModelSpec("Linear Regression", "Linear Regression")
    data = features.select("row_id", *cols, label)
    zc = cols + [label]
    shift = shift_means(data, zc)
    ranked = rank_by_numeric(data, "row_id", out="pos", total_col="n")
    n = int(ranked.select("n").first()["n"])
    q, rem = divmod(n, k)
    fold_size = [q + (1 if f < rem else 0) for f in range(k)]
    starts = [sum(fold_size[:f]) for f in range(k)]
    n_max = n - fold_size[0]
    abs_sizes = sorted(set(int(s * n_max) for s in sizes))
    rows = ranked.withColumn("tf", ntile_fold(F.col("pos"), F.col("n"), k)).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("fold") + 1)
    size = F.element_at(F.array(*[F.lit(s) for s in fold_size]), F.col("fold") + 1)
    trank = F.when(F.col("pos") < start, F.col("pos")).otherwise(F.col("pos") - size)
    bucket = F.lit(len(abs_sizes))
    for i in reversed(range(len(abs_sizes))):
        bucket = F.when(trank < abs_sizes[i], F.lit(i)).otherwise(bucket)
    rows = rows.withColumn("bucket", F.when(F.col("tf") == F.col("fold"), F.lit(-1)).otherwise(bucket))
    g = collect_grams(gram_agg(rows.where(F.col("bucket") < len(abs_sizes)), zc, ["fold", "bucket"], shift),
                      ["fold", "bucket"], len(zc))
    out = []
    zero = np.zeros((len(zc) + 1, len(zc) + 1))
    for si, m in enumerate(abs_sizes):
        tr_scores, te_scores = [], []
        for f in range(k):
            gtr = sum((g.get((f, b), zero) for b in range(si + 1)), zero.copy())
            gte = g.get((f, -1), zero)
            a, beta = linear.SOLVERS[spec.solver](moments(gtr), **spec.params)
            for gg, acc in ((gtr, tr_scores), (gte, te_scores)):
                ms = moments(gg)
                w = np.concatenate([[-a], -beta, [1.0]])
                sse = float(w @ gg @ w)
                acc.append(1.0 - sse / ms.syy if ms.syy > 0 else 0.0)
        out.append((int(m), float(np.mean(tr_scores)), float(np.std(tr_scores)), float(np.mean(te_scores)),
                    float(np.std(te_scores))))
    return features.sparkSession.createDataFrame(
        out, "train_size int, train_r2_mean double, train_r2_std double, test_r2_mean double, test_r2_std double")


def permutation_importance_linear(features: DataFrame, folds: DataFrame, cols: list[str], label: str,
                                  spec: ModelSpec, n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """mean R^2 drop when one feature is permuted inside the test fold.

    The model is fitted on each fold's non-test rows (one Gram pass). A permutation of
    column j (repeat r) pairs the test row at position i (row order) with the row at
    hash rank i, never all pairs. For a linear model the permuted prediction is
    ``pred + beta_j (x_perm - x)``.
    """
    plain = folds.select("regime", "repeat", "fold", "row_id",
                         F.when(F.col("split") == "test", "test").otherwise("train").alias("split"))
    coefs = fold_coefficients(features, plain, cols, label, [spec])
    data = features.select("row_id", *cols, label)
    return _importance(plain.where(F.col("split") == "test").join(data, "row_id"), coefs, cols, label, n_repeats, seed)


def marked_importance(marked: DataFrame, cols: list[str], label: str, spec: ModelSpec, k: int = 5, regime: str = "group",
                      n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """F10 on rows that carry the folds of one repeat (:mod:`mortar.operators.marks`): no row stands in a fold table.

    Rows with copies of their id count as often as in the long table of group folds."""
    plain = marked.withColumn("vals", F.array(F.lit(0)))
    coefs = solve_folds(MK.marked_moments(plain, cols + [label], k, regime), [spec])
    test = plain if marked.groupBy("row_id").count().where("count > 1").isEmpty() else MK.id_copies(plain)
    test = test.select(F.lit(regime).alias("regime"), F.lit(0).alias("repeat"), F.col("tests")[0].alias("fold"), "row_id", *cols, label)
    return _importance(test, coefs, cols, label, n_repeats, seed)


PASS_ROWS = 1 << 26   # permuted values that are shuffled at once
RANGE_ROWS = 1 << 18  # positions of one task, about


def _importance(test: DataFrame, coefs: list[tuple], cols: list[str], label: str, n_repeats: int, seed: int) -> DataFrame:
    """Mean drops of R^2 from the test rows ``regime, repeat, fold, row_id, cols, label``.

    The rows are sorted once by (fold, row_id). Hashes are made again for each pass, and a pass shuffles the hashes and
    values of a few permutations only, cut into ranges of the hash; its files are dropped before the next one."""
    from mortar.session import ensure_checkpoint_dir, freed_shuffles
    spark = test.sparkSession
    ensure_checkpoint_dir(spark)
    schema = T.StructType([T.StructField("__unit", T.IntegerType()), *COEF_SCHEMA.fields[1:]])
    units = spark.createDataFrame([(u, *c[1:]) for u, c in enumerate(coefs)], schema)
    rows = test.join(F.broadcast(units), FOLD_KEYS)  # one row for each fold
    rows = rows.select(F.col("__unit").alias("unit"), "row_id", MK.id_tail().alias("tail"), F.col(label).cast("double").alias("y"),
                       linear_predict(cols, F.col("b0"), F.col("beta")).alias("pred"),
                       *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    cores = spark.sparkContext.defaultParallelism
    with freed_shuffles(spark):
        n_parts = max(2 * cores, math.ceil(test.count() / RANGE_ROWS))
        rows = rows.repartitionByRange(n_parts, "unit", "row_id").sortWithinPartitions("unit", "row_id").drop("row_id").checkpoint()
        rows = rows.withColumn("part", F.spark_partition_id())
        e2 = (F.col("y") - F.col("pred")) ** 2
        whole = {r["unit"]: r for r in rows.groupBy("unit").agg(
            F.sum(e2).alias("sse"), F.avg("y").alias("ybar"), F.sum(F.col("y") ** 2).alias("yy"), F.count(F.lit(1)).alias("n")).collect()}
        before: dict[int, int] = {}
        starts = {}  # first position of a partition's rows in their fold
        for r in rows.groupBy("part", "unit").count().orderBy("part").collect():
            starts[r["part"], r["unit"]] = before.get(r["unit"], 0)
            before[r["unit"]] = before.get(r["unit"], 0) + r["count"]
        n = sum(before.values())
        combos = [(j, r) for j in range(len(cols)) for r in range(n_repeats)]
        size = min(RANGE_ROWS, max(1, math.ceil(n / (4 * cores))))
        job = Permutations(combos, seed, starts, {u: math.ceil(m / size) for u, m in before.items()},
                           [[float(b) for b in c[5]] for c in coefs])
        counted = rows.select("unit", "tail").mapInPandas(job.counts, "unit int, combo int, span int, n long")
        job.place(counted.groupBy("unit", "combo", "span").agg(F.sum("n").alias("n")).collect())  # a few for each permutation
        step = max(1, PASS_ROWS // max(1, n))
        found = []
        for s in range(0, len(combos), step):
            some = range(s, min(s + step, len(combos)))
            used = sorted({combos[c][0] for c in some})
            narrow = rows.select("part", "unit", "tail", "y", "pred", *[f"x{j}" for j in used])
            pieces = narrow.mapInPandas(lambda batches, some=some: job.pieces(batches, some),
                                        "task int, unit int, span int, combo int, at long, data binary")
            sums = pieces.repartitionById(job.tasks, F.col("task")).mapInPandas(
                lambda batches, some=some: job.sums(batches, some), "unit int, combo int, sse_p double")
            found += sums.groupBy("unit", "combo").agg(F.sum("sse_p").alias("sse_p")).collect()
    drops: dict[tuple[int, int], list[float]] = {}
    for r in found:
        own = whole[r["unit"]]
        sst = own["yy"] - own["n"] * own["ybar"] ** 2
        if own["sse"] is not None and r["sse_p"] is not None:
            drop = (1.0 - own["sse"] / sst) - (1.0 - r["sse_p"] / sst)
            drops.setdefault((combos[r["combo"]][0], r["unit"]), []).append(drop)
    means: dict[int, list[float]] = {}
    for (j, _), v in sorted(drops.items()):
        means.setdefault(j, []).append(sum(v) / len(v))
    missing = [None] if whole else []  # without any complete row
    out = [(c, sum(means[j]) / len(means[j]) if j in means else m) for j, c in enumerate(cols) for m in ([0] if j in means else missing)]
    return spark.createDataFrame(out, "feature string, importance double").orderBy(F.col("importance").desc())


class Permutations:
    """The tasks of :func:`_importance`. A span is a range of the hash; a fold's spans have some ``n / spans`` rows each.

    ``place`` turns the counts of the spans into ranks, so that a span's task gets its donors, ordered by hash and
    position, and the rows at the positions that are these ranks."""

    def __init__(self, combos: list[tuple[int, int]], seed: int, starts: dict, spans: dict[int, int], betas: list[list[float]]):
        self.combos, self.seed, self.starts, self.spans, self.betas = combos, seed, starts, spans, betas
        self.first = {}
        self.tasks = 0
        for u in sorted(spans):
            self.first[u] = self.tasks
            self.tasks += spans[u]
        self.tasks = max(1, self.tasks)
        self.offsets: dict[int, np.ndarray] = {}

    def place(self, counts) -> None:
        per = {u: np.zeros((len(self.combos), m + 1), dtype=np.int64) for u, m in self.spans.items()}
        for r in counts:
            per[r["unit"]][r["combo"], r["span"] + 1] = r["n"]
        self.offsets = {u: v.cumsum(axis=1) for u, v in per.items()}

    def hashes(self, tails: list[bytes], combo: int) -> np.ndarray:
        """``order_key(seed, j, r, row_id)`` of each row as a number."""
        j, r = self.combos[combo]
        key = f"{self.seed}:{j}:{r}".encode()
        return np.frombuffer(b"".join([md5(key + t).digest()[:4] for t in tails]), ">u4").astype(np.uint32)

    def span_of(self, hashed: np.ndarray, unit: int) -> np.ndarray:
        kind = np.min_scalar_type(self.spans[unit])  # few spans, as bytes, are sorted the fastest
        return (hashed.astype(np.uint64) * np.uint64(self.spans[unit]) >> np.uint64(32)).astype(kind)

    def counts(self, batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for u, own in batch.groupby("unit"):
                tails = [t.encode() for t in own["tail"]]
                for c in range(len(self.combos)):
                    found = np.bincount(self.span_of(self.hashes(tails, c), u), minlength=self.spans[u])
                    total[u, c] = total.get((u, c), 0) + found
        out = [(u, c, s, int(m)) for (u, c), v in total.items() for s, m in enumerate(v) if m]
        yield pd.DataFrame(out, columns=["unit", "combo", "span", "n"])

    def pieces(self, batches, some):
        """Packed rows of one partition: combo -1 holds a span's own rows, the others its donors."""
        used = sorted({self.combos[c][0] for c in some})
        seen: dict[int, int] = {}
        names = ["task", "unit", "span", "combo", "at", "data"]
        held: dict[int, list] = {}

        def packed(u, parts):
            own = pd.concat(parts)
            at = self.starts[int(own["part"].iloc[0]), u] + seen.get(u, 0)
            seen[u] = seen.get(u, 0) + len(own)
            off = self.offsets[u]
            lows, highs = off[some.start:some.stop, :-1].min(axis=0), off[some.start:some.stop, 1:].max(axis=0)
            body = own[["y", "pred", *[f"x{j}" for j in used]]].to_numpy(float)
            for span in range(self.spans[u]):
                a, b = max(at, lows[span]), min(at + len(own), highs[span])
                if a < b:
                    yield self.first[u] + span, u, span, -1, int(a), body[a - at:b - at].tobytes()
            tails = [t.encode() for t in own["tail"]]
            for c in some:
                hashed = self.hashes(tails, c)
                span = self.span_of(hashed, u)
                order = np.argsort(span, kind="stable")
                x = own[f"x{self.combos[c][0]}"].to_numpy(float)[order]
                hashed, ends = hashed[order], np.searchsorted(span[order], np.arange(self.spans[u] + 1))
                for i in range(self.spans[u]):
                    a, b = ends[i], ends[i + 1]
                    if a < b:
                        yield self.first[u] + i, u, i, c, at, hashed[a:b].tobytes() + x[a:b].tobytes()

        def drained(u):
            rows = [*packed(u, held.pop(u))]
            for s in range(0, len(rows), 256):
                yield pd.DataFrame(rows[s:s + 256], columns=names)

        for batch in batches:
            for u, own in batch.groupby("unit"):
                held.setdefault(int(u), []).append(own)
                if sum(map(len, held[u])) >= RANGE_ROWS:
                    yield from drained(u)
        for u in sorted(held):
            yield from drained(u)

    def sums(self, batches, some):
        """The squared error of each permutation over one span."""
        rows = [row for batch in batches for row in batch.itertuples(index=False)]
        rows.sort(key=lambda row: (row.combo, row.at))
        own = [row for row in rows if row.combo < 0]
        used = sorted({self.combos[c][0] for c in some})
        if own:
            u, span, start = own[0].unit, own[0].span, own[0].at
            body = np.concatenate([np.frombuffer(row.data).reshape(-1, 2 + len(used)) for row in own])
        out = []
        for c in some:
            parts = [(row.data, len(row.data) // 12) for row in rows if row.combo == c]
            if not parts:
                continue
            hashed = np.concatenate([np.frombuffer(d, np.uint32, m) for d, m in parts])
            x = np.concatenate([np.frombuffer(d, np.float64, m, 4 * m) for d, m in parts])
            x = x[np.argsort(hashed, kind="stable")]  # pieces stand by position, so equal hashes do too
            a, (j, _) = self.offsets[u][c, span] - start, self.combos[c]
            y, pred, mine = body[a:a + len(x), [0, 1, 2 + used.index(j)]].T
            error = y - (pred + self.betas[u][j] * (x - mine))
            if not np.isnan(error).all():  # nulls count for nothing
                out.append((u, c, float(np.nansum(error * error))))
        yield pd.DataFrame(out, columns=["unit", "combo", "sse_p"])


def augmented_cv_predictions(features: DataFrame, folds: DataFrame, augmented: DataFrame, cols: list[str], label: str,
                             specs: list[ModelSpec], feature_set: str, regime_name: str) -> DataFrame:
    """Fit each fold on its augmented train rows (one Gram pass keyed by fold); score
    train on the real rows, val and test as usual (augmentation never touches them)."""
    spark = features.sparkSession
    zc = cols + [label]
    shift = shift_means(features.select(*zc), zc)
    g = collect_grams(gram_agg(augmented, zc, FOLD_KEYS, shift), FOLD_KEYS, len(zc))
    rows = []
    for key, gm in sorted(g.items()):
        m = moments(gm)
        for spec in specs:
            b0, beta = linear.SOLVERS[spec.solver](m, **spec.params)
            rows.append((spec.name, key[0], int(key[1]), int(key[2]), float(b0 + shift[-1] - shift[:-1] @ beta),
                         [float(b) for b in beta]))
    coefs = spark.createDataFrame(rows, COEF_SCHEMA)
    data = features.select("row_id", *cols, F.col(label).alias("actual"))
    j = folds.join(row_side(data), "row_id").join(F.broadcast(coefs), FOLD_KEYS)
    return j.select("model", F.lit(feature_set).alias("feature_set"), F.lit(regime_name).alias("regime"), "repeat",
                    "fold", "split", "row_id", "actual", linear_predict(cols, F.col("b0"), F.col("beta")).alias("predicted"))
