"""One query for each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import backoff_lm, best_fit_packing, best_fit_shards, bloom_neighbours, compact_windows, cube_mixing, hirschberg_repair, nn_descent, ordinal_quality, piecewise_hash, prefix_tree_join, url_trust, warc_segments
from timberline.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op9_best_fit_shards(spark, folder):
    placed = best_fit_shards.shard(table(spark, folder, "documents"), Scratch(spark), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_url_trust(spark, folder):
    return url_trust.judge(table(spark, folder, "pages"), Scratch(spark), URL_RULES)


@query
def op2_best_fit_packing(spark, folder):
    return best_fit_packing.pack(table(spark, folder, "documents"), Scratch(spark), public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op4_cube_mixing(spark, folder):
    mixed = cube_mixing.mix(table(spark, folder, "documents"), Scratch(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times")


@query
def op5_piecewise_hash(spark, folder):
    return piecewise_hash.compare_edits(table(spark, folder, "documents"))


@query
def op7_backoff_lm(spark, folder):
    docs = table(spark, folder, "documents")
    return backoff_lm.score(docs, Scratch(spark), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


@query
def op8_ordinal_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = ordinal_quality.fit(docs, grades(table(spark, folder, "labels")), grades=3)
    return ordinal_quality.score(docs, model, least=2)


@query
def op3_nn_descent(spark, folder):
    return nn_descent.near_duplicates(table(spark, folder, "embeddings"), Scratch(spark))


@query
def op1_prefix_tree_join(spark, folder):
    return prefix_tree_join.join(table(spark, folder, "documents"), Scratch(spark))


@query
def op6_compact_windows(spark, folder):
    return compact_windows.repeats(table(spark, folder, "documents"), Scratch(spark))


@query
def op13_warc_segments(spark, folder):
    return warc_segments.round_trip(table(spark, folder, "pages"), Scratch(spark)).drop("whole")


ORACLES["op13_warc_segments"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
     q AS (SELECT page_id, octet_length(data)::BIGINT AS payload_bytes, sha1(data) AS payload_digest, max(page_id) OVER (PARTITION BY data) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM q"""


@query
def op12_hirschberg_repair(spark, folder):
    return hirschberg_repair.repair_damaged(table(spark, folder, "conversations"), Scratch(spark))


@query
def op11_bloom_neighbours(spark, folder):
    return bloom_neighbours.variants(bloom_neighbours.counted(table(spark, folder, "documents")), Scratch(spark))
