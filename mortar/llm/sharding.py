"""Sharding by balanced label propagation.

Linked rows should share a shard while shards stay even. Rows start in a shard by their own hash. In each
round every row counts the shards of its neighbours (a Spark join of links and labels), proposes
the best one if it beats its own, and moves with the probability that the quotas allow, so that
no shard outgrows ``1 + slack`` of its share (but for the spread of the draws). Of linked rows that
would move only the one with the higher draw does, which keeps neighbours from swapping; so every
move takes links out of the cut, and the rounds end when no row that would gain can be taken.
Where the quotas stop the rounds before a group is together, the whole group goes to the shard that
the rounds brought most of its rows to. A last pass makes the sizes exact: rows beyond a shard's quota, those without links first and
linked ones together, fill the shards below theirs.

Only numbers per shard reach the driver. Ranks inside a shard come from counts per hash bucket
plus a row number within the bucket, so no task sorts a whole shard.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mortar.llm.common import saved, unit_hash

BUCKET_ROWS = 20_000


def text_links(rows: DataFrame) -> DataFrame:
    """Links of equal texts: each row with the smallest row of its text (a star, not all pairs).

    ``rows``: ``id, digest``. Counts per text come first, so texts that occur once are not linked."""
    hubs = rows.groupBy("digest").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(hubs, "digest").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))


def start_label(n_shards: int, *key: Column) -> Column:
    return F.floor(unit_hash(F.lit("shard"), *key) * n_shards).cast("int")


def accepted_moves(size: list[int], flow: list[list[int]], quota: int) -> list[list[int]]:
    """How many of the moves ``flow[from][to]`` can be taken so that no shard outgrows the quota.

    Moves are taken along paths that end in a shard with room, or along cycles of shards (each gives
    as many rows as it gets), until there is neither: an all-zero result means that none can move."""
    n = len(size)
    room, rest, taken = [quota - x for x in size], [list(f) for f in flow], [[0] * n for _ in range(n)]

    def walk() -> tuple[list[int], bool] | None:
        dead: set[int] = set()
        for s in range(n):
            path = [s]
            while path:
                at = path[-1]
                to = next((t for t in range(n) if rest[at][t] and (room[t] > 0 or t in path)), None)
                if to is not None:
                    return (path[path.index(to):] + [to], False) if room[to] <= 0 else (path + [to], True)
                to = next((t for t in range(n) if rest[at][t] and t not in dead), None)
                if to is None:
                    dead.add(path.pop())
                else:
                    path.append(to)
        return None

    while (found := walk()) is not None:
        path, ends = found
        steps = list(zip(path, path[1:]))
        many = min(rest[s][t] for s, t in steps)
        if ends:
            many = min(many, room[path[-1]])
            room[path[-1]] -= many
            room[path[0]] += many
        for s, t in steps:
            rest[s][t] -= many
            taken[s][t] += many
    return taken


def flows(moves: list, n_shards: int) -> list[list[int]]:
    """``flow[from][to]`` of the moves ``label, want, n`` (at most n_shards^2 rows)."""
    flow = [[0] * n_shards for _ in range(n_shards)]
    for r in moves:
        if r["want"] is not None:
            flow[r["label"]][r["want"]] += r["n"]
    return flow


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int, total: int, rounds: int | None = None,
              slack: float = 0.02) -> DataFrame:
    """Labels of the linked rows when none can better its place any more: ``id, label``.

    ``nodes``: linked rows ``id, label``; ``links``: ``a, b``; ``total``: rows of the whole table
    (the quota of a shard is ``(1 + slack) * total / n_shards``; unlinked rows fill what remains);
    ``rounds``: stop after so many (None: go on to the end, which each move brings nearer)."""
    quota = max(int((1 + slack) * total / n_shards), -(-total // n_shards))
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    for turn in itertools.count():
        if turn == rounds:
            break
        seen = ends.join(nodes.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(
            F.count(F.lit(1)).alias("n"))
        # most neighbours, then the smallest shard: one aggregate row a node, however many neighbours
        best = seen.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("top"),
                                      F.collect_list(F.struct("label", "n")).alias("all"))  # at most n_shards
        want = best.select("id", (-F.col("top.m")).alias("want"), F.col("top.n").alias("gain"), "all")
        moved = nodes.join(want, "id", "left").select(
            "id", "label", "want", (F.col("gain") - F.coalesce(F.aggregate(
                F.filter("all", lambda x: x["label"] == F.col("label")), F.lit(0).cast("long"),
                lambda s, x: s + x["n"]), F.lit(0))).alias("gain"))
        moved = saved(moved.select("id", "label", "want", F.coalesce(F.col("gain") > 0, F.lit(False)).alias("willing")))
        counts = moved.groupBy("label", F.when(F.col("willing"), F.col("want")).alias("want")).agg(
            F.count(F.lit(1)).alias("n")).collect()  # at most n_shards^2 rows
        size = [0] * n_shards
        for r in counts:
            size[r["label"]] += r["n"]
        if not any(map(any, accepted_moves(size, flows(counts, n_shards), quota))):
            break
        # of linked rows that would move, the one with the higher draw goes: gains stay what they are
        draw = F.struct(F.xxhash64(F.lit("draw"), F.lit(turn), F.col("id")).alias("u"), F.col("id").alias("i"))
        movers = moved.where("willing").select(F.col("id").alias("other"), draw.alias("top"))
        above = ends.join(movers, "other").groupBy("id").agg(F.max("top").alias("top"))
        moved = saved(moved.join(above, "id", "left").select(
            "id", "label", "want", (F.col("willing") & (F.col("top").isNull() | (draw > F.col("top")))).alias("go")))
        counts = moved.where("go").groupBy("label", "want").agg(F.count(F.lit(1)).alias("n")).collect()
        flow = flows(counts, n_shards)
        taken = accepted_moves(size, flow, quota)
        share = F.array(*[F.lit(k / max(n, 1)) for ks, ns in zip(taken, flow) for k, n in zip(ks, ns)])
        allowed = F.element_at(share, F.col("label") * n_shards + F.col("want") + 1)
        go = F.col("go") & (unit_hash(F.lit("move"), F.lit(turn), F.col("id")) < allowed)
        nodes = moved.select("id", F.when(go, F.col("want")).otherwise(F.col("label")).alias("label"))
    return nodes


def gathered(nodes: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (``id, label``) with every group that is still cut in the shard of most of its rows.

    ``near``: ``id, near``; the rows of one ``near`` are a group if no link leaves them, so no link is cut by this.
    The shards may outgrow their quotas; :func:`even_rows` then moves rows of whole groups."""
    side = lambda end: near.select(F.col("id").alias(end), F.col("near").alias(f"near_{end}"))
    across = links.join(side("a"), "a").join(side("b"), "b").where("near_a <> near_b")
    open_ = across.select(F.explode(F.array("near_a", "near_b")).alias("near")).distinct()
    held = nodes.join(near, "id")
    most = held.groupBy("near", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("near").agg(  # n_shards rows a group
        F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("top"), F.count(F.lit(1)).alias("parts"))
    home = most.where("parts > 1").join(open_, "near", "left_anti").select("near", (-F.col("top.m")).alias("home"))
    return held.join(home, "near", "left").select("id", F.coalesce("home", "label").alias("label"))


def even_rows(rows: DataFrame, n_shards: int, total: int) -> DataFrame:
    """Exact row counts: ``rows`` (``id, label, near, tie, single`` and others) with ``shard`` and gapless ``slot``.

    Rank of a row in its label: linked rows first, then by hash of ``near``, which linked rows share.
    Rows ranked beyond the quota are numbered over all labels and dealt to the labels below theirs,
    after their own rows. A bucket of too many rows (one large group) is cut by the rows' own hash."""
    buckets = max(1, min(4096, -(-total // (n_shards * BUCKET_ROWS))))
    mark = unit_hash(F.lit("slot"), F.coalesce("near", "id"))
    rows = rows.withColumn("u", mark).withColumn("bucket", (F.floor(F.col("u") * buckets)
                                                            + F.when(F.col("single"), buckets).otherwise(0)).cast("int"))
    parts = rows.groupBy("label", "bucket").agg(F.ceil(F.count(F.lit(1)) / (2 * BUCKET_ROWS)).alias("parts"))
    rows = rows.join(F.broadcast(parts), ["label", "bucket"]).withColumn(  # n_shards * 2 * buckets at most
        "part", F.floor(unit_hash(F.lit("part"), F.col("id"), F.col("tie")) * F.col("parts")).cast("int")).drop("parts")
    counts = rows.groupBy("label", "bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("label").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).drop("n")
    have = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    over, fill, at_over, at_fill = [], [], 0, 0
    for s in range(n_shards):
        n = have.get(s, 0)
        over.append(at_over - quota[s])                       # overflow number = rank + over[s]
        at_over += max(0, n - quota[s])
        fill.append((at_fill, at_fill + max(0, quota[s] - n), min(n, quota[s])))
        at_fill = fill[-1][1]
    inner = Window.partitionBy("label", "bucket", "part").orderBy("u", "id", "tie")
    ranked = rows.join(offsets, ["label", "bucket", "part"]).withColumn("rank", F.col("before") + F.row_number().over(inner) - 1)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)
    ranked = ranked.withColumn("spare", F.when(F.col("rank") >= pick(quota, F.col("label")),
                                               F.col("rank") + pick(over, F.col("label"))))
    target = F.lit(None).cast("int")
    for s, (a, b, _) in enumerate(fill):
        target = F.when((F.col("spare") >= a) & (F.col("spare") < b), F.lit(s)).otherwise(target)
    ranked = ranked.withColumn("shard", F.coalesce(F.when(F.col("spare").isNotNull(), target), F.col("label")))
    slot = F.when(F.col("spare").isNull(), F.col("rank")).otherwise(
        F.col("spare") - pick([f[0] for f in fill], F.col("shard")) + pick([f[2] for f in fill], F.col("shard")))
    return ranked.withColumn("slot", slot).drop("label", "bucket", "part", "near", "u", "before", "rank", "spare")


def shard_rows(docs: DataFrame, n_shards: int = 8, rounds: int | None = None, links: DataFrame | None = None,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row in a shard: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``rows``: counts of shards differ by one at most. ``size``: UTF-8 bytes of the text plus 1
    (null: 1, crc 0); ``slot``: 0.. without gaps in a shard. ``links`` (``a, b``: keys) are the edges to
    keep inside shards; by default equal texts. Rows with a null key are placed by their text;
    repeated rows have a slot each; other columns are not read; an empty table gives an empty one."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.xxhash64(raw, F.lit(1)).alias("digest"),
                       F.xxhash64(F.lit("2"), raw).alias("tie"))
    rows = saved(rows)  # numbers only: texts are read once
    total = rows.count()
    if links is None:
        keyed = rows.where("id is not null").select("id", F.struct("digest", "tie", "size").alias("digest"))
        links = text_links(keyed)
    links = saved(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    ends = links.select(F.col("a").alias("id"), "b").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("b")))
    ends = saved(ends.groupBy("id").agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("near")))
    nodes = propagate(ends.select("id", start_label(n_shards, F.col("id")).alias("label")), links, n_shards, total, rounds)
    nodes = saved(gathered(nodes, ends, links)).withColumnRenamed("label", "found").join(ends, "id")
    labelled = rows.join(nodes, "id", "left").select(
        "id", "size", "text_crc32", "tie", "near", F.coalesce("found", start_label(n_shards, F.col("id"), F.col("tie")))
        .alias("label"), F.col("found").isNull().alias("single"))
    return even_rows(labelled, n_shards, total).select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
