"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and reread as the next stage's documents.

Defined cases are those of the stages' operators: documents without an id, text or source, with empty or very
long texts, ties, repeated rows, empty tables and further columns, whatever their names, pass as these say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from gradeloom.llm.storage import discard, materialize
from gradeloom.llm.words import word_count


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    whole = docs.select(F.struct("*").alias("_whole"), "text", "source")
    return quality_rules.apply_rules(whole, carry=["_whole"]).where("kept").select("_whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, even with other numbers or names, go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(F.struct("*").alias("_whole"), "doc_id", "source", "text", word_count(F.col("text")).alias("_words")), size=F.col("_words"))
    return mixed.select("_whole", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_whole.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and its slot there."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Near-duplicates can't be found in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # the stage's input, unless it is the given table
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
