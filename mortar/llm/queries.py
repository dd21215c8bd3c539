"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.llm import (decontaminate, fingerprint, licenses, mixing, neardup, quality, repair, secrets, sharding,
                        tokencount, tokenfile, toxicity, whitening)
from mortar.llm.common import table
from mortar.session import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(documents(spark, sf_dir))


@query
def op2_mixture(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir), keep=0.8)


@query
def op3_token_counts(spark, sf_dir):
    return tokencount.count_tokens(documents(spark, sf_dir), "piece_bpe_32k.model", limit=4096)


@query
def op4_contaminated(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op5_secrets(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


@query
def op6_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


@query
def op8_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


@query
def op9_token_file(spark, sf_dir):
    path = scratch_dir(spark, "token-file")
    tokenfile.write_token_file(documents(spark, sf_dir), path, "byte_bpe_50k.json", end_id=0)
    read = tokenfile.read_documents(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_shards(spark, sf_dir):
    return sharding.shard_rows(documents(spark, sf_dir), n_shards=8)


@query
def op11_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), n_components=8)


@query
def op13_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
