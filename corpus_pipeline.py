"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of documents.

In all stages: null, empty and very long texts are rows like others, texts are worked on whole, repeated rows are judged
alike, columns of any names are kept as they are, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import decontaminate, mixing, neardup, quality, sharding
from factweave.llm.shared import bounded_batches, written

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts have fewer than 50 words and go."""
    bounded_batches(spark)
    marked = docs.withColumn("__quality_measures", quality.quality_measures(F.col("text")))
    return marked.where(quality.verdict(F.col("__quality_measures"))[1]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts that share 80 % of their five-word shingles. That with the
    smallest doc_id stays (null last); rows that share it rank by a hash of all columns, equal rows are one."""
    bounded_batches(spark)
    return neardup.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; hit passages are cut out of the others, whose n_chars, if there is one, follows.
    Null texts have no hits and stay."""
    bounded_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = F.col("__benchmark_hits")
    found = decontaminate.benchmark_hits(docs, items, into="__benchmark_hits").where(~decontaminate.contaminated(hits))
    cut = F.size(hits["spans"]) > 0
    found = found.withColumn("text", decontaminate.without_spans(F.col("text"), hits["spans"]))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Null texts have size 0 and are sampled at their source's rate; a
    null source is one."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, which replace columns of these names. Equal rows share their places in any order."""
    return sharding.interleave(docs, SHARDS)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Left out: SQL here doesn't have the hashes of candidates and CRC-32.
ORACLE_SQL = None
