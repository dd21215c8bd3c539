"""Streaming scoring equals batch scoring; clamps and rejects behave."""

from pyspark.sql import functions as F

from mortar.operators import score as K
from mortar.sources.tables import mix
from mortar.streaming.score_stream import stream_score
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    req = mix(spark, SF_SMALL)
    batch = K.score(req, K.fixture_predict("strength"), "strength")
    streamed = stream_score(spark, req, K.fixture_predict("strength"), "strength")
    cols = ["row_id", "prediction", "prediction_clamped", "class", "rejected"]
    a = batch.select(*cols).toPandas().sort_values("row_id").reset_index(drop=True)
    b = streamed.select(*cols).toPandas().sort_values("row_id").reset_index(drop=True)
    assert a.equals(b)


def test_clamp_and_reject(spark):
    req = mix(spark, SF_SMALL)
    out = K.score(req, K.fixture_predict("slump"), "slump")
    assert out.where("prediction_clamped < 0").count() == 0
    rej = out.where("rejected")
    assert rej.where(F.col("prediction").isNotNull()).count() == 0
    assert rej.count() == req.where("flyash + ggbfs <= 0").count()
