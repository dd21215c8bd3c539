"""Catalog part 4: scoring (K1-K7) over request rows derived from ``mix``."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortar.functions import features as fx
from mortar.operators import evaluate as EV
from mortar.operators import score as K
from mortar.plans import sql_blocks as Q
from mortar.plans.registry import query, with_ctes
from mortar.sources.tables import TARGET, mix, mix_valid

STRENGTH_PRED_SQL = "20.0 + ggbfs / 20.0 + curing_temp_c / 10.0 - water / 10.0 - 15.0"
SLUMP_PRED_SQL = "(flyash + ggbfs) / 4.0 + water - 80.0"


def _requests(spark, sf):
    return mix(spark, sf)


def fixture_scores(spark, sf, kind):
    return K.score(_requests(spark, sf), K.fixture_predict(kind), kind)


def _scored_sql(kind):
    pred = STRENGTH_PRED_SQL if kind == "strength" else SLUMP_PRED_SQL
    clamp = "greatest(0.0, p)" if kind == "strength" else "round_even(greatest(0.0, p), 0)"
    classes = K.STRENGTH_CLASSES if kind == "strength" else K.WORKABILITY_CLASSES
    case = "CASE " + " ".join(f"WHEN c < {b} THEN '{lab}'" for b, lab in classes if b is not None) + \
        f" ELSE '{classes[-1][1]}' END"
    ranges = K.STRENGTH_RANGES if kind == "strength" else K.SLUMP_RANGES
    warns = [f"CASE WHEN {n} IS NOT NULL AND ({n} < {lo} OR {n} > {hi}) THEN '{n}=' || CAST({n} AS VARCHAR) || "
             f"' outside [{lo}, {hi}]' END" for n, (lo, hi) in ranges.items()]
    return {
        "s1": f"SELECT *, (flyash + ggbfs) <= 0 AS rejected, CASE WHEN (flyash + ggbfs) <= 0 THEN NULL ELSE {pred} END AS p FROM mix",
        "s2": f"SELECT *, CASE WHEN rejected THEN NULL ELSE {clamp} END AS c FROM s1",
        "scored": (f"SELECT row_id, p AS prediction, c AS prediction_clamped, CASE WHEN rejected THEN NULL ELSE {case} END AS class, "
                   f"concat_ws('; ', {', '.join(warns)}) AS warning_text, "
                   f"CAST({' + '.join('(CASE WHEN w IS NULL THEN 0 ELSE 1 END)'.replace('w', w) for w in warns)} AS INTEGER) AS n_warnings, "
                   f"rejected FROM s2"),
    }


@query("score_clamp", with_ctes("SELECT row_id, prediction, prediction_clamped FROM scored", **_scored_sql("strength")))
def score_clamp(spark, sf):
    return fixture_scores(spark, sf, "strength").select("row_id", "prediction", "prediction_clamped")


@query("score_clamp_slump", with_ctes("SELECT row_id, prediction, prediction_clamped FROM scored", **_scored_sql("slump")))
def score_clamp_slump(spark, sf):
    return fixture_scores(spark, sf, "slump").select("row_id", "prediction", "prediction_clamped")


@query("strength_class", with_ctes("SELECT row_id, class FROM scored", **_scored_sql("strength")))
def strength_class(spark, sf):
    return fixture_scores(spark, sf, "strength").select("row_id", "class")


@query("workability_class", with_ctes("SELECT row_id, class FROM scored", **_scored_sql("slump")))
def workability_class(spark, sf):
    return fixture_scores(spark, sf, "slump").select("row_id", "class")


@query("score_reject", with_ctes("SELECT row_id, rejected FROM scored WHERE rejected", **_scored_sql("strength")))
def score_reject(spark, sf):
    return fixture_scores(spark, sf, "strength").where("rejected").select("row_id", "rejected")


def _warn_cols(df):
    return df.select("row_id", F.size("warnings").alias("n_warnings"),
                     F.concat_ws("; ", "warnings").alias("warning_text"))


@query("range_warnings", with_ctes("SELECT row_id, n_warnings, warning_text FROM scored", **_scored_sql("strength")))
def range_warnings(spark, sf):
    return _warn_cols(fixture_scores(spark, sf, "strength"))


@query("range_warnings_slump", with_ctes("SELECT row_id, n_warnings, warning_text FROM scored", **_scored_sql("slump")))
def range_warnings_slump(spark, sf):
    return _warn_cols(fixture_scores(spark, sf, "slump"))


@query("range_warnings_learned", with_ctes(
    "SELECT row_id, CAST(len(outside) AS INTEGER) AS n_warnings, array_to_string(outside, ',') AS warning_inputs FROM "
    "(SELECT row_id, list_filter([" + ", ".join(f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN '{c}' END" for c in K.STRENGTH_INPUTS)
    + "], lambda x: x IS NOT NULL) AS outside FROM mix, r)", mixv=Q.MIXV,
    r="SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in K.STRENGTH_INPUTS)
      + " FROM mixv WHERE curing_temp_c <= 60"))
def range_warnings_learned(spark, sf):
    """K6: every request against the ranges of the train rows, here the mixes cured at 60 degrees or less."""
    train = mix_valid(spark, sf).where("curing_temp_c <= 60")
    found = K.range_warnings(K.learned_ranges(train, K.STRENGTH_INPUTS))
    return _requests(spark, sf).select("row_id", F.size(found).alias("n_warnings"), F.concat_ws(
        ",", F.transform(found, lambda w: F.substring_index(w, "=", 1))).alias("warning_inputs"))


def champion(spark, sf, kind="strength"):
    """I14 + A7: refit a ridge champion on the serving features of every valid row."""
    base = mix_valid(spark, sf)
    serve = K.serve_frame(base, kind).join(base.select("row_id", TARGET), "row_id")
    cols = fx.STRENGTH_SERVE_9 if kind == "strength" else fx.SLUMP_SERVE_9
    b0, beta = EV.full_fit(serve, cols, TARGET, EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0}))
    return K.LinearModel(cols, b0, beta, "Ridge", "serve_9")


@query("score_batch", check="INV")
def score_batch(spark, sf):
    """K1: score every request with the refitted, persisted and reloaded champion."""
    from mortar.session import scratch_dir
    m = champion(spark, sf)
    path = scratch_dir(spark, "champion")
    m.save(spark, path)
    loaded = K.LinearModel.load(spark, path)
    return K.score(_requests(spark, sf), loaded.predict(), "strength")


@query("score_stream", with_ctes("SELECT row_id, prediction, prediction_clamped, class, n_warnings, warning_text, rejected "
                                 "FROM scored", **_scored_sql("strength")))
def score_stream(spark, sf):
    """K7: the same scoring as a Structured Streaming job over a file source."""
    from mortar.streaming.score_stream import stream_score
    out = stream_score(spark, _requests(spark, sf), K.fixture_predict("strength"), "strength")
    return out.select("row_id", "prediction", "prediction_clamped", "class", F.size("warnings").alias("n_warnings"),
                      F.concat_ws("; ", "warnings").alias("warning_text"), "rejected")
