"""The corpus pipeline: reject, deduplicate, cut repeats, mix, pack.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and
read again as the next one's docs. A row is known by the hash of its id and text, so
null and repeated ids need no care; equal rows are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import best_fit_packing, compact_windows, cube_mixing, ordinal_quality, prefix_tree_join
from timberline.llm.common import Scratch, fresh
from timberline.llm.queries import grades, table

CAPACITY = 1024


def _known_by(docs: DataFrame) -> tuple[DataFrame, str]:
    name = fresh(docs, "mark")
    return docs.withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))), name


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates good more likely than not; it learns from the labels of its own input."""
    model = ordinal_quality.fit(docs, grades(table(spark, sf_dir, "labels")), grades=3)
    return ordinal_quality.accepted(docs, model, least=2)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one with the smallest id."""
    marked, mark = _known_by(docs)
    scratch = Scratch(spark)
    linked = prefix_tree_join.join(marked.select("doc_id", mark, "text"), scratch, width=5, part=80, id_col=mark)
    linked = linked.distinct().join(marked.select(mark, "doc_id").distinct(), mark)
    # A null id is chosen last.
    choice = F.struct(F.col("doc_id").isNull(), "doc_id", mark)
    kept = linked.groupBy("component_id").agg(F.min(choice)[mark].alias(mark)).select(mark)
    kept = scratch.keep(kept, "kept")
    scratch.drop(*[name for name in scratch.paths if name != "kept"])
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has; n_chars follows the text."""
    cut = compact_windows.without_repeats(docs, Scratch(spark))
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    marked, mark = _known_by(docs)
    times = fresh(marked, "times")
    mixed = cube_mixing.mix(marked.select(mark, "text", "source"), Scratch(spark), id_col=mark)
    mixed = mixed.groupBy(mark).agg(F.sum("times").cast("int").alias(times)).filter(F.col(times) > 0)
    taken = marked.join(mixed, mark).dropDuplicates([mark])
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return best_fit_packing.pack(docs, Scratch(spark), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", reject),
    ("n-gram Jaccard join", deduplicate),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# The classifier, the cube method and the packing can't be put in SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
