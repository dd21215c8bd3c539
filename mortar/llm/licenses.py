"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word bigram of every text is hashed and joined with the bigrams of the license
templates (a fixed table). A hit at word ``i`` of the text and ``j`` of a template votes for the
diagonal ``i - j``: all bigrams of an unbroken copy share one. Votes are aggregated by document,
template and diagonal; diagonals next to each other are merged (inserted or missing words
shift a copy by a little); a span counts when it holds enough of the template's bigrams, whose
words were compared in the join, so equal hashes alone never count. A phrase whose
template must match whole is found at every place where its words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_SHIFT = 3
LEAST_SHARE = 0.6

# The phrases whose every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of public license texts and notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
           " granted",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                " associated documentation files",
    "mit-release": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
}


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, ASCII letters (folded) and non-ASCII characters."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(low, NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def bigrams(words: Column) -> Column:
    """``struct(w, v)`` for each word and its follower (null after the last)."""
    return F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("v")))


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """``(label, base, size, j, w, v)``: every bigram of every phrase (base) and template."""
    rows = []
    for base, items in ((True, [(v, k) for k, v in phrases.items()]), (False, list(templates.items()))):
        for label, text in items:
            ws = text.split()
            rows += [(label, base, len(ws) - 1, j, ws[j], ws[j + 1]) for j in range(len(ws) - 1)]
    return spark.createDataFrame(rows, "label string, base boolean, size int, j int, w string, v string")


def votes(docs: DataFrame, grams: DataFrame, key: str, text: str) -> DataFrame:
    """Hits aggregated by row, template and diagonal: its bigrams' ``places`` in the template, first and last word."""
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), words_of(F.col(text)).alias("words"))
    rolled = rows.select("k", "h", F.posexplode(bigrams(F.col("words"))).alias("i", "g"))
    rolled = rolled.select("k", "h", "i", F.col("g.w").alias("w"), F.col("g.v").alias("v"),
                           F.xxhash64("g.w", "g.v").alias("x"))
    table = F.broadcast(grams.withColumn("x", F.xxhash64("w", "v")))  # fixed templates: a few hundred rows
    hits = rolled.join(table, ["x"]).where((rolled["w"] == table["w"]) & (rolled["v"] == table["v"]))
    return hits.groupBy("k", "h", "label", "base", "size", (F.col("i") - F.col("j")).alias("d")).agg(
        F.array_sort(F.collect_set("j")).alias("places"), F.min("i").alias("lo"), F.max("i").alias("hi"))


def spans(found: DataFrame, max_shift: int = MAX_SHIFT, least_share: float = LEAST_SHARE) -> DataFrame:
    """Verified spans: neighbouring diagonals of a template merged, then held against its size.

    Diagonals stay together while each is at most ``max_shift`` from the one before and its words
    lie within the span so far (plus ``max_shift``); phrases need every bigram on one diagonal. A place of the
    template counts once, however many diagonals hold it."""
    side = Window.partitionBy("k", "h", "label", "base").orderBy("d")
    before = side.rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("base") | (F.col("d") - F.lag("d").over(side) > max_shift)
           | (F.col("lo") > F.max("hi").over(before) + max_shift + 1))
    parts = found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    parts = parts.withColumn("span", F.sum("new").over(side))
    merged = parts.groupBy("k", "h", "label", "base", "size", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = F.least(F.lit(1.0), F.col("n") / F.col("size"))
    need = F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(least_share))
    close = F.col("base") | (F.col("hi") - F.col("lo") + 1 <= F.col("size") + 2 * max_shift)
    return merged.withColumn("share", share).where((F.col("share") >= need) & close)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base``: places of phrases; ``first_word`` / ``last_word``: their smallest and largest start
    (null without any); ``base_labels`` / ``labels``: of phrases / of all spans, distinct, sorted,
    comma-joined ('' without any); ``score``: the best share of a template found (0 without any).
    A null or empty text has no words; a null key and repeated rows keep their own rows; other
    columns are not read; an empty table gives an empty one."""
    grams = template_grams(docs.sparkSession, PHRASES if phrases is None else phrases,
                           TEMPLATES if templates is None else templates)
    found = spans(votes(docs, grams, key, text))
    base = F.col("base")
    per_row = found.groupBy("k", "h").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("lo"))).alias("first_word"),
        F.max(F.when(base, F.col("lo"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"), F.max("share").alias("score"))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"),
                       F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    joined = rows.alias("a").join(per_row.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k"))
                                  & (F.col("a.h") == F.col("b.h")), "left")
    return joined.select(
        F.col("a.k").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
