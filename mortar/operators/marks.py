"""Repeated random folds as two columns next to the features: one row per data row.

The hash-ordered splits of :mod:`mortar.operators.splits` depend only on a row's id and on a few
cut points of the hash order (``k - 1`` per repeat for the test folds, one per (repeat, fold) for
the validation rows). :func:`hash_cuts` finds the cut points exactly with bounded state; after
that a row's folds are plain expressions, so no fold table is shuffled, written or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mortar.functions.hashing import HASH_BITS, hash_bucket, order_key
from mortar.operators.gram import Moments, cell_moments, merge_moments
from mortar.operators.rank import DEFAULT_BUCKET_BITS
from mortar.operators.splits import VAL_FRAC, n_val_of


def hash_cuts(rows: DataFrame, keys: list[str], ranks) -> dict[tuple, dict[int, tuple]]:
    """``{key: {i: (hash, id, split)}}``: the row at each wanted 0-based rank of ``(__h, row_id)`` within a key.

    ``split``: the row before it has the same id (or the id is null), so the cut parts copies of one id.
    ``rows``: ``keys, __h, row_id``; ``ranks(n)``: array column of wanted ranks of a key with n rows. Counts
    per hash bucket place every rank in one bucket; only the rows of those buckets are sorted.
    The driver gets one row per (key, rank)."""
    bucketed = rows.withColumn("__b", hash_bucket(F.col("__h"), DEFAULT_BUCKET_BITS))
    counts = bucketed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("m"))
    side = Window.partitionBy(*keys)  # at most 2^bits rows a key
    placed = counts.withColumn("n", F.sum("m").over(side)).withColumn(
        "before", F.sum("m").over(side.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    wanted = placed.select(*keys, "__b", "before", "m", F.posexplode(ranks(F.col("n"))).alias("i", "rank")).where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    wanted = wanted.select(*keys, "__b", "i", (F.col("rank") - F.col("before")).alias("__at"))
    found = bucketed.join(F.broadcast(wanted), [*keys, "__b"])  # one row per (key, rank)
    order = Window.partitionBy(*keys, "i").orderBy("__h", "row_id")
    found = found.withColumns({"__r": F.row_number().over(order) - 1, "__p": F.lag("row_id").over(order)}).where("__r = __at")
    out: dict[tuple, dict[int, tuple]] = {}
    for r in found.select(*keys, "i", "__h", "row_id", "__p").collect():
        parted = r["row_id"] is None or r["__p"] == r["row_id"]
        out.setdefault(tuple(r[c] for c in keys), {})[r["i"]] = (r["__h"], r["row_id"], parted)
    return out


def parts_copies(cuts: dict[tuple, dict[int, tuple]]) -> bool:
    """Whether a cut parts copies of one id, which then have no folds that depend on the id alone."""
    return any(cut[2] for found in cuts.values() for cut in found.values())


def reached(hashed: Column, cut: Column) -> Column:
    """Whether a row is at or after the cut ``<h, id>`` in the order of (hash, row_id)."""
    return (hashed > cut["h"]) | ((hashed == cut["h"]) & (F.col("row_id") >= cut["id"]))


def id_tail() -> Column:
    """What follows the key in the text that is hashed; a null id leaves nothing, as in :func:`order_key`."""
    return F.coalesce(F.concat(F.lit(":"), F.col("row_id").cast("string")), F.lit(""))


def keyed_hash(key: Column, tail: Column) -> Column:
    """``order_key(key, row_id)``. A key column that runs over a list keeps the code small: Spark compiles one
    hash, while dozens of hashes in one expression are too much for the JVM to compile."""
    return F.substring(F.md5(F.concat(key, tail)), 1, HASH_BITS // 4)


def fold_marks(df: DataFrame, k: int = 5, repeats: int = 5, seed: int = 0, frac: float | None = VAL_FRAC,
               whole_copies: bool = True) -> DataFrame | None:
    """``df`` (with ``row_id``) and ``tests array<int>``, ``vals array<int>``, an entry per repeat.

    ``tests[r]``: the row's test fold (E1); bit f of ``vals[r]``: it is a validation row of fold f (E4);
    without ``frac`` there are none. The same rows as :func:`mortar.operators.splits.fold_table` gives in long form.
    Copies of an id stay together; without ``whole_copies`` the result is None if a cut parts copies."""
    starts = lambda n: F.transform(  # noqa: E731 - first rank of folds 1 .. k - 1
        F.sequence(F.lit(1), F.lit(k - 1)), lambda f: f * F.floor(n / k) + F.least(f, n % k))
    id_type = df.schema["row_id"].dataType
    listed = lambda entries: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in e.items()]) for e in entries])
    at = lambda cut: F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).cast(id_type).alias("id"))
    never = at(("~", None))  # behind every hash

    tries = listed([{"repeat": r, "key": str(r + seed)} for r in range(repeats)])
    tail = F.col("__tail")
    hashed = df.select("row_id", id_tail().alias("__tail")).withColumn("t", F.explode(tries))
    hashed = hashed.withColumn("__h", keyed_hash(F.col("t.key"), tail))
    cuts = hash_cuts(hashed.select("t.repeat", "__h", "row_id"), ["repeat"], starts)
    if not whole_copies and parts_copies(cuts):
        return None
    steps = F.array(*[F.array(*[at(cuts[r,][f]) if f in cuts.get((r,), {}) else never for f in range(k - 1)] or [never])
                      for r in range(repeats)])
    keys = F.array(*[F.lit(str(r + seed)) for r in range(repeats)])
    # a lambda binds its value, which is so found once a row, however often it is used
    once = lambda value, use: F.transform(F.array(value), use)[0]
    folds_of = lambda tail: F.zip_with(F.transform(keys, lambda key: keyed_hash(key, tail)), steps,
                                       lambda hv, own: F.aggregate(own, F.lit(0), lambda n, cut: n + reached(hv, cut).cast("int")))
    if frac is None:
        return df.select(*df.columns, once(id_tail(), folds_of).alias("tests"), F.array(*[F.lit(0)] * repeats).alias("vals"))
    parts = [(r, f) for r in range(repeats) for f in range(k)]
    named = [{"repeat": r, "fold": f, "key": f"{seed}:v:{r}:{f}"} for r, f in parts]
    each = df.select("row_id", id_tail().alias("__tail")).select("row_id", "__tail", folds_of(tail).alias("__t"))
    each = each.withColumn("v", F.explode(listed(named))).where(F.col("__t")[F.col("v.repeat")] != F.col("v.fold"))
    each = each.withColumn("__h", keyed_hash(F.col("v.key"), tail))
    vcuts = hash_cuts(each.select("v.repeat", "v.fold", "__h", "row_id"), ["repeat", "fold"],
                      lambda n: F.array(n_val_of(n, frac)))
    if not whole_copies and parts_copies(vcuts):
        return None
    inner = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in e.items()], F.lit(1 << e["fold"]).alias("bit"), end["h"].alias("h"),
                               end["id"].alias("id"))
                      for e, end in ((e, at(vcuts[p][0]) if 0 in vcuts.get(p, {}) else never) for e, p in zip(named, parts))])

    def marks(tail: Column) -> Column:
        return once(folds_of(tail), lambda t: F.struct(t.alias("tests"), once(bits(t, tail), by_repeat).alias("vals")))

    def bits(t: Column, tail: Column) -> Column:
        held = F.transform(inner, lambda e: F.when(t[e["repeat"]] != e["fold"], keyed_hash(e["key"], tail)))
        return F.zip_with(held, inner, lambda hv, e: F.when(~reached(hv, e), e["bit"]).otherwise(0))

    def by_repeat(all_bits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.aggregate(
            F.slice(all_bits, r * k + 1, k), F.lit(0), lambda n, b: n + b))

    marked = df.select(*df.columns, once(id_tail(), marks).alias("__marks"))
    return marked.select(*df.columns, "__marks.tests", "__marks.vals")


def inner_marks(marked: DataFrame, k: int, repeats: int, inner_k: int, seed: int = 0) -> DataFrame | None:
    """``marked`` with ``inner array<int>``, an entry for each (repeat, fold): the row's inner fold (E6), -1 outside the train part.

    None if a cut parts copies of an id."""
    parts = [(r, f) for r in range(repeats) for f in range(k)]
    id_type = marked.schema["row_id"].dataType
    in_train = lambda e: (F.col("tests")[e["repeat"]] != e["fold"]) & (
        F.call_function("shiftright", F.col("vals")[e["repeat"]], e["fold"]).bitwiseAND(1) == 0)
    named = lambda r, f: [F.lit(r).alias("repeat"), F.lit(f).alias("fold"), F.lit(f"{seed}:oof:{r}:{f}").alias("key")]
    each = marked.select("row_id", "tests", "vals", id_tail().alias("__tail")).withColumn(
        "v", F.explode(F.array(*[F.struct(*named(r, f)) for r, f in parts]))).where(in_train(F.col("v")))
    each = each.withColumn("__h", keyed_hash(F.col("v.key"), F.col("__tail")))
    cuts = hash_cuts(each.select("v.repeat", "v.fold", "__h", "row_id"), ["repeat", "fold"], lambda n: F.transform(
        F.sequence(F.lit(1), F.lit(inner_k - 1)), lambda f: f * F.floor(n / inner_k) + F.least(f, n % inner_k)))
    if parts_copies(cuts):
        return None
    at = lambda cut: F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).cast(id_type).alias("id"))
    steps = lambda p: F.array(*[at(cuts.get(p, {}).get(i, ("~", None))) for i in range(inner_k - 1)])
    listed = F.array(*[F.struct(*named(*p), steps(p).alias("steps")) for p in parts])
    once = lambda value, use: F.transform(F.array(value), use)[0]
    past = lambda e, tail: once(keyed_hash(e["key"], tail), lambda hv: F.aggregate(
        e["steps"], F.lit(0), lambda n, cut: n + reached(hv, cut).cast("int")))
    inner = once(id_tail(), lambda tail: F.transform(listed, lambda e: F.when(in_train(e), past(e, tail)).otherwise(-1)))
    return marked.select(*marked.columns, inner.alias("inner"))


def group_marks(grouped: DataFrame, k: int = 5, seed: int = 0, frac: float = VAL_FRAC) -> DataFrame:
    """``grouped`` (``row_id, group_id, ..``; rows without an id are left out) with ``tests`` and ``vals`` of one repeat.

    The folds of ``fold_table(.., "group")`` (E2 + E5). A group's folds are found once, and each row gets them by one
    join on its group, so that no row is repeated for each fold."""
    from mortar.operators.splits import group_kfold_assign
    from mortar.session import materialize, row_side
    rows = grouped.where(F.col("row_id").isNotNull())
    live = rows.groupBy("group_id").agg(F.lit(True).alias("__live"))  # groups that have folds to be in
    groups = materialize(group_kfold_assign(grouped, k).join(row_side(live), "group_id").select("group_id", "fold"), by="group_id")
    kind = grouped.schema["group_id"].dataType
    hashed = lambda fold: order_key(F.lit(seed), F.lit("g"), F.lit(0), fold, F.col("group_id"))
    each = groups.select(F.col("group_id"), F.col("fold").alias("__t"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    each = each.where(F.col("__t") != F.col("fold")).withColumn("__h", hashed(F.col("fold")))
    cuts = hash_cuts(each.select("fold", "__h", F.col("group_id").alias("row_id")), ["fold"], lambda n: F.array(n_val_of(n, frac)))
    bits = F.lit(0)
    for f in range(k):
        hv, cut = hashed(F.lit(f)), cuts.get((f,), {}).get(0, ("~", None))
        past = (hv > F.lit(cut[0])) | ((hv == F.lit(cut[0])) & (F.col("group_id") >= F.lit(cut[1]).cast(kind)))
        bits = bits + F.when((F.col("fold") != f) & ~past, 1 << f).otherwise(0)
    marks = groups.select("group_id", F.array("fold").alias("tests"), F.array(bits).alias("vals"))
    return rows.join(row_side(marks), "group_id")


def id_copies(marked: DataFrame) -> DataFrame:
    """Each row once for every pair of copies of its id, as the long table of group folds joined by id has them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("row_id"))
    each = marked.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n") * F.col("__n"))))
    return each.drop("__n", "__i")


def per_repeat(marked: DataFrame, regime: str = "random") -> DataFrame:
    """A row per (data row, repeat): ``regime, repeat, __test, __vals`` (a narrow step)."""
    rest = [c for c in marked.columns if c not in ("tests", "vals")]
    both = marked.select(*rest, F.posexplode(F.arrays_zip("tests", "vals")).alias("repeat", "__m"))
    return both.select(F.lit(regime).alias("regime"), "repeat", F.col("__m.tests").alias("__test"),
                       F.col("__m.vals").alias("__vals"), *rest)


def fold_rows(marked: DataFrame, k: int = 5, regime: str = "random") -> DataFrame:
    """F3 with the other columns of ``marked``: ``regime, repeat, fold, split, ..`` (a narrow step)."""
    rows = per_repeat(marked, regime).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held = F.expr("shiftright(__vals, fold) & 1") == 1
    split = F.when(F.col("__test") == F.col("fold"), "test").when(held, "val").otherwise("train")
    return rows.withColumn("split", split).drop("__test", "__vals")


def marked_moments(marked: DataFrame, cols: list[str], k: int = 5, regime: str = "random") -> dict[tuple, dict[str, Moments]]:
    """``{(regime, repeat, fold): {split: Moments}}``; a cell is (repeat, test fold, set of validation folds)."""
    cells = cell_moments(per_repeat(marked, regime), cols, ["repeat", "__test", "__vals"])
    out = {}
    for repeat in sorted({key[0] for key in cells}):
        mine = [(t, v, m) for (r, t, v), m in cells.items() if r == repeat]
        for f in range(k):
            parts = {"test": [m for t, _, m in mine if t == f], "val": [m for _, v, m in mine if v >> f & 1],
                     "train": [m for t, v, m in mine if t != f and not v >> f & 1]}
            out[(regime, repeat, f)] = {s: merge_moments(x, len(cols) - 1) for s, x in parts.items()}
    return out
