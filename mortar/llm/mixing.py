"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed into cells (source x language x topic). Raking scales the cells' token
weights to one target margin after the other until all margins fit; the fitted cells give each
document a weight, and inclusion probabilities proportional to it are calibrated so that the
expected number of sampled tokens is the budget (cells that would need more than all their
documents are taken whole, and the rest carries their share). A document is sampled when the
hash of its key and text falls under its probability, so the decision does not depend on other rows or on
partitions. Rows that share key and text draw one by one: their hash takes in their place in the table.

Cells stay a distributed table; only single numbers reach the driver. Up to ``CELL_BOUND`` cells
they are put into one partition, as a round then needs no shuffle, and are broadcast to the
documents; beyond it the same plan shuffles. The results are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import saved, unit_hash

CELL_BOUND = 100_000
MARGINS = ("source", "lang", "topic")
#: Exponent of a margin's share in its target: 1 keeps the corpus as it is, 0 evens it out.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}

# Marks that decide the topic of a text, the first that is found.
TOPIC_MARKS = (("legal", ("licen", "Licen", "copyright", "Copyright")), ("table", (" | ",)),
               ("record", ("@", "token =")), ("markup", ("</", "%%%", "***")))


def topic_of(text: Column) -> Column:
    """A topic by surface marks; 'prose' without any, '' without text."""
    out = F.when(F.length(text) > 0, F.lit("prose")).otherwise(F.lit(""))
    for name, marks in reversed(TOPIC_MARKS):
        found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words of a text, by its spaces and line breaks (a null or empty text: 0)."""
    gaps = sum((F.length(text) - F.length(F.replace(text, F.lit(c))) for c in (" ", "\n")), F.lit(0))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("double")


def features(docs: DataFrame, text: str = "text") -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
            topic_of(body).alias("topic"), tokens_of(body).alias("tokens")]


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """``margin, share``: the margin's token shares to the power, summing to 1."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
    total = sums.agg(F.sum("p").alias("s")).first()["s"] or 1.0
    return sums.select(margin, (F.col("p") / F.lit(total)).alias("share"))


def over_values(cells: DataFrame, margin: str, want: DataFrame) -> DataFrame:
    """A target over the values that occur, scaled to sum to 1."""
    there = cells.where("tokens > 0").select(margin).distinct().join(want.select(margin, "share"), margin)
    whole = there.agg(F.sum("share").alias("s")).first()["s"] or 1.0
    return there.withColumn("share", F.col("share") / F.lit(float(whole)))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, rounds_per_job: int = 1,
         most_rounds: int = 60) -> DataFrame:
    """``cells`` (margins, ``tokens``) with the fitted ``weight`` (share of the mixture).

    Targets sum to 1 over the values that occur (``over_values``); a value without a target gets weight 0. Stops when no margin is off by more than ``tolerance`` of the mixture, or after
    ``most_rounds`` (margins that contradict each other have no fit; the last margin then holds)."""
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"]
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(total or 1.0)))
    for m, want in targets.items():
        out = out.join(want.select(m, F.col("share").alias(f"goal_{m}")), m, "left").withColumn(
            f"goal_{m}", F.coalesce(f"goal_{m}", F.lit(0.0)))
    small = out.count() <= CELL_BOUND
    pack = (lambda d: d.coalesce(1)) if small else (lambda d: d)
    out = saved(pack(out))
    done = 0
    while done < most_rounds:
        for _ in range(rounds_per_job):
            for m in targets:
                sums = pack(out).groupBy(m).agg(F.sum("weight").alias("s"))
                out = pack(out).join(sums, m).withColumn("weight", F.when(
                    F.col("s") > 0, F.col("weight") * F.col(f"goal_{m}") / F.col("s")).otherwise(0.0)).drop("s")
        out = saved(pack(out))
        done += rounds_per_job
        off = [pack(out).groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"goal_{m}")).alias("off")).select("off")
               for m in targets]
        worst = reduce(DataFrame.unionAll, off).agg(F.max("off").alias("w")).first()["w"]
        if worst is None or worst <= tolerance:
            break
    return out.drop(*[f"goal_{m}" for m in targets])


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` (``tokens, weight``) with the inclusion ``probability`` whose expected tokens meet the budget.

    ``p = min(1, scale * weight / tokens)``; the scale follows from the cells that are not taken
    whole, and those from the scale, until neither changes (each step takes more cells whole)."""
    ratio = F.col("weight") / F.col("tokens")
    scale, seen = 0.0, -1
    while True:
        whole = ratio * F.lit(scale) >= 1
        r = cells.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0.0)).alias("t"), F.count(F.when(whole, 1)).alias("n"),
                      F.sum(F.when(whole, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if r["n"] == seen or not r["w"]:
            break
        seen, scale = r["n"], max(scale, (budget - r["t"]) / r["w"])
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(float(scale))))


def mixture(docs: DataFrame, keep: float = 0.8, temper: dict[str, float] | None = None,
            targets: dict[str, DataFrame] | None = None, text: str = "text") -> tuple[DataFrame, int]:
    """The fitted cells ``source, lang, topic, weight, probability`` and their number.

    ``keep``: expected share of the tokens that is sampled. ``targets``: by margin, ``margin, share``;
    by default the corpus's own shares to the powers of ``temper``."""
    cells = saved(docs.select(*features(docs, text)).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    temper = TEMPER if temper is None else temper
    if targets is None:
        targets = {m: tempered_targets(cells, m, temper[m]) for m in MARGINS}
    else:
        targets = {m: over_values(cells, m, t) for m, t in targets.items()}
    fitted = rake(cells, targets)
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0.0
    out = saved(calibrate(fitted, keep * total))
    return out, out.count()


def with_probability(docs: DataFrame, cells: DataFrame, n_cells: int, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Rows of ``docs`` as a struct ``row``, with their cell's numbers and the decision ``sampled``.

    Texts without tokens belong to no cell: weight null, probability 1, as they cost nothing."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *features(docs, text))
    right = cells.select(*MARGINS, "weight", "probability", F.col("tokens").alias("cell"))
    rows = rows.withColumn("draw", unit_hash(F.lit("mix"), F.col(f"row.{key}"), F.col(f"row.{text}")))
    rows = redrawn(rows)
    found = rows.join(F.broadcast(right) if n_cells <= CELL_BOUND else right, list(MARGINS), "left")
    p = F.coalesce("probability", F.lit(1.0))
    return found.withColumn("weight", F.col("weight") * F.col("tokens") / F.col("cell")).withColumn(
        "probability", p).withColumn("sampled", F.col("draw") < F.col("probability"))


def redrawn(rows: DataFrame) -> DataFrame:
    """``rows`` whose equal draws (repeated rows) are drawn anew by their place in the table.

    Without repeats nothing is joined; the values that repeat are broadcast only after they are counted."""
    again = saved(rows.groupBy(F.col("draw").alias("same")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same"))
    n = again.count()
    if n == 0:
        return rows
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    joined = placed.join(F.broadcast(again) if n <= CELL_BOUND else again, placed["draw"] == again["same"], "left")
    return joined.withColumn("draw", F.when(F.col("same").isNull(), F.col("draw")).otherwise(
        unit_hash(F.lit("again"), F.col("draw"), F.col("place")))).drop("same", "place")


def mix(docs: DataFrame, keep: float = 0.8, key: str = "doc_id", **options) -> DataFrame:
    """Per row: ``key, source, lang, topic, tokens, weight, probability, sampled``.

    ``weight``: the row's share of the target mixture. A null source or language is a value of its
    own (''); a null or empty text has no tokens and is always sampled; rows of one key with
    different texts, null keys too, draw apart, and so do repeated rows; an empty table gives an empty one."""
    cells, n = mixture(docs, keep, **options)
    return with_probability(docs, cells, n, key, options.get("text", "text")).select(
        F.col(f"row.{key}").alias(key), *MARGINS, F.col("tokens").cast("long").alias("tokens"), "weight",
        "probability", "sampled")


def sampled(docs: DataFrame, keep: float = 0.8, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mixture samples, with all their columns.

    Nulls, empty texts, repeated rows and an empty table are treated as ``mix`` says; the rows travel as one
    struct, so no column of theirs can clash with those added."""
    cells, n = mixture(docs, keep, **options)
    return with_probability(docs, cells, n, key, options.get("text", "text")).where("sampled").select("row.*")
