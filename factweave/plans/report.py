"""Reports: showcase cases, rejected evidence, publisher audit, batch and replay counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_else
from .serve import with_document

#: Relation types of each case.
CASES = {
    "1. CORROBORATED ACROSS DOCUMENTS": ["corroborates"],
    "2. CONTRADICTION": ["contradicts"],
    "3. RECONCILED BY CONTEXT": ["reconciled_time", "reconciled_units", "reconciled_scope"],
    "4. UNRESOLVED / NEEDS REVIEW": ["needs_review"],
}


def cases(relations: DataFrame, limit: int = 2) -> DataFrame:
    """The first relations of each case: adjudicated ones first, then the surest."""
    case = reduce(lambda c, k: c.when(F.col("relation_type").isin(CASES[k]), k), list(CASES)[1:], F.when(F.col("relation_type").isin(CASES[next(iter(CASES))]), next(iter(CASES))))
    order = Window.partitionBy("case").orderBy(F.desc(F.col("decided_by") == "llm"), F.desc_nulls_last("confidence"), "fact_a_id", "fact_b_id")
    return relations.withColumn("case", case).where("case is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def shown(sided: DataFrame) -> DataFrame:
    """Text of relations with structs a and b."""
    def side(tag):
        f = F.col(tag)
        head = F.concat(F.lit(f"    {tag.upper()}: "), f["subject"], F.lit(" · "), f["predicate"], F.lit(" = "), or_else(f["value_raw"], "(non-numeric)"), F.lit("  ["), or_else(f["period_raw"], "no period"), F.lit("]"))
        source = F.concat(F.lit("       source: "), or_else(f["title"], f["filename"]), F.lit(" p."), f["page"], F.lit("  ("), f["grounding"], F.lit(")"))
        return [head, source, F.concat(F.lit('       quote : "'), F.substring(F.coalesce(f["source_quote"], F.lit("")), 1, 150), F.lit('"'))]

    title = F.concat(F.lit("  ["), "relation_type", F.lit("] decided_by="), "decided_by", F.lit(" sim="), F.format_string("%.3f", "similarity"), F.lit(" conf="), "confidence")
    return sided.withColumn("text", F.concat_ws("\n", title, *side("a"), *side("b"), F.concat(F.lit("    reasoning: "), F.coalesce("explanation", F.lit("")))))


def rejected_evidence(facts: DataFrame, documents: DataFrame, limit: int = 3) -> DataFrame:
    """Unverified facts whose quotes came closest."""
    rows = facts.where(~F.col("quote_verified")).orderBy(F.desc_nulls_last("quote_score"), "fact_id").limit(limit)
    return with_document(rows.drop("embedding"), documents, "filename").orderBy(F.desc_nulls_last("quote_score"), "fact_id")


def publisher_audit(relations: DataFrame, facts: DataFrame, documents: DataFrame, limit: int = 2) -> DataFrame:
    """Relations where a's subject is its document's publisher and b's subject is another."""
    side = lambda n: with_document(facts.select("fact_id", "doc_id", "subject", "predicate", "value_raw"), documents, "publisher").select(F.col("fact_id").alias(f"fact_{n}_id"), F.col("subject").alias(f"{n}_subject"), F.col("predicate").alias(f"{n}_predicate"), F.col("value_raw").alias(f"{n}_value"), F.col("publisher").alias(f"{n}_publisher"))
    a = side("a").where(F.lower("a_subject") == F.lower("a_publisher"))
    joined = relations.join(a, "fact_a_id").join(side("b"), "fact_b_id").where(F.lower("a_subject") != F.lower("b_subject"))
    return joined.orderBy(F.desc("similarity"), "fact_a_id", "fact_b_id").limit(limit)


def batch_counters(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, kind, name, n): grounding tiers and relation types of each document."""
    tiers = facts.groupBy("doc_id", F.lit("grounding").alias("kind"), F.col("grounding").alias("name")).agg(F.count("*").alias("n"))
    owned = relations.join(facts.select(F.col("fact_id").alias("fact_a_id"), "doc_id"), "fact_a_id")
    return tiers.unionByName(owned.groupBy("doc_id", F.lit("relation").alias("kind"), F.col("relation_type").alias("name")).agg(F.count("*").alias("n")))


def replay_totals(pairs: DataFrame) -> DataFrame:
    """(doc_id, key, n) of decided pairs, and the totals with a null doc_id."""
    key = F.when(F.col("status") == "rule", F.concat("relation_type", F.lit("/rule"))).otherwise(F.col("status"))
    return pairs.select(F.col("a_doc").alias("doc_id"), key.alias("key")).rollup("key", "doc_id").agg(F.count("*").alias("n")).where("key is not null").select("doc_id", "key", "n")
