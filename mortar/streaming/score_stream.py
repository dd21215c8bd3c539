"""K7: stateless streaming scoring (file source -> score -> parquet sink with checkpoint).

The request stream is a folder of parquet files on the shared file system; each
micro-batch is scored by the same Catalyst expressions as the batch path
(:func:`mortar.operators.score.score`), so streaming equals batch row for row. No state,
so no watermark. ``availableNow`` drains what is there and stops (restartable: the
checkpoint records processed files, so a lost executor or driver replays safely).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from mortar.operators import score as K
from mortar.session import scratch_dir


def stream_score(spark: SparkSession, requests: DataFrame, predict: Column, kind: str = "strength",
                 files: int = 4) -> DataFrame:
    """Write ``requests`` as a file-source folder, stream-score it, return the sink table."""
    src = scratch_dir(spark, "requests")
    sink = scratch_dir(spark, "scored")
    ckpt = scratch_dir(spark, "scored-ckpt")
    requests.repartition(files).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
    scored = K.score(stream, predict, kind)
    q = (scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
