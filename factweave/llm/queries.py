"""The queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, licenses, mixing, quality, sharding, simhash, substrings, urls, warc
from .shared import bounded_batches, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(licenses.license_notices(F.col("text"))).alias("n"))
    return docs.select("doc_id", "n.*")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")  # noqa: E731  urn:page:<id>
    return warc.read_warc(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("f")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    rows = mixing.expected_copies(docs)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", quality.quality_measures(F.col("text")).alias("m"))
    base_failed, kept = quality.verdict(F.col("m"))
    base = [F.col(f"m.{c}") for c in quality.FIELDS[:5]]
    return docs.select("doc_id", *base, base_failed.alias("base_failed"), kept.alias("kept"), "m.covered_words", "m.longest_repeat")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", sharding.row_size(text).alias("size"), sharding.text_crc32(text).alias("text_crc32"))
    rows = sharding.interleave(docs, 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    rows = decontaminate.benchmark_hits(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "hits")
    ids = F.sha2(F.array_join(F.array_sort(h["items"]), ",").cast("binary"), 256)
    return rows.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), ids.alias("items_sha256"), decontaminate.contaminated(h).alias("contaminated"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.coalesce("dedup.kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_warc, op3_simhash, op4_mixing, op5_hmm, op6_quality, op7_sharding, op8_urls, op9_decontaminate, op10_substrings)}
