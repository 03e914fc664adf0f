"""Serving queries over documents, facts and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_any, qualifiers_from_json
from ..sources.store import Store


def with_document(facts: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    names = columns or ("filename", "title", "publisher", "doc_date")
    return facts.join(documents.select("doc_id", *names), "doc_id")


def served(facts: DataFrame) -> DataFrame:
    """Facts as readers get them: no vector; qualifiers that are stored as JSON text are parsed."""
    facts = facts.drop("embedding")
    if dict(facts.dtypes).get("qualifiers") == "string":
        facts = facts.withColumn("qualifiers", qualifiers_from_json(F.col("qualifiers")))
    return facts


def search_facts(facts: DataFrame, documents: DataFrame, doc_id: int | None = None, fact_type: str | None = None, verified: bool | None = None, grounding: str | None = None, q: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Latest facts first. Empty texts don't filter; doc_id and verified do unless None."""
    if limit > 1000:
        raise ValueError("limit is at most 1000")
    tests = []
    if doc_id is not None:
        tests.append(F.col("doc_id") == doc_id)
    if fact_type:
        tests.append(F.col("fact_type") == fact_type)
    if verified is not None:
        tests.append(F.col("quote_verified") == verified)
    if grounding:
        tests.append(F.col("grounding") == grounding)
    if q:
        tests.append(like_any([F.col("subject"), F.col("predicate"), F.col("source_quote")], q))
    for t in tests:
        facts = facts.where(t)
    return with_document(served(facts), documents, "filename", "title").orderBy(F.desc("fact_id")).offset(offset).limit(limit)


def fact_detail(facts: DataFrame, documents: DataFrame, fact_id: int) -> DataFrame:
    """One row, or none if there is no such fact."""
    return with_document(served(facts.where(F.col("fact_id") == fact_id)), documents)


def verified_facts(facts: DataFrame, documents: DataFrame, exclude_doc_id: int | None = None) -> DataFrame:
    kept = facts.where(F.col("quote_verified") & F.col("embedding").isNotNull())
    return with_document(kept if exclude_doc_id is None else kept.where(F.col("doc_id") != exclude_doc_id), documents)


def both_sides(relations: DataFrame) -> DataFrame:
    """(fact_id, other_id, and the relation): each relation from either end."""
    a = relations.withColumns({"fact_id": F.col("fact_a_id"), "other_id": F.col("fact_b_id")})
    return a.unionByName(relations.withColumns({"fact_id": F.col("fact_b_id"), "other_id": F.col("fact_a_id")}))


def fact_relations(relations: DataFrame, facts: DataFrame, documents: DataFrame, fact_id: int) -> DataFrame:
    own = relations.where((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id))
    own = own.withColumn("other_id", F.when(F.col("fact_a_id") == fact_id, F.col("fact_b_id")).otherwise(F.col("fact_a_id")))
    details = with_document(served(facts), documents)
    other = details.select(F.struct(*details.columns).alias("other"))
    return own.join(other, F.col("other_id") == F.col("other.fact_id"), "left").orderBy("relation_type", "fact_a_id", "fact_b_id")


def with_sides(relations: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """relations with both facts as structs a and b."""
    details = with_document(served(facts), documents)
    for side in ("a", "b"):
        relations = relations.join(details.select(F.struct(*details.columns).alias(side)), F.col(f"fact_{side}_id") == F.col(f"{side}.fact_id"), "left")
    return relations


def list_relations(relations: DataFrame, facts: DataFrame, documents: DataFrame, relation_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Surest first, then latest. The page is cut before its facts are looked up."""
    if limit > 500:
        raise ValueError("limit is at most 500")
    rows = relations.where(F.col("relation_type") == relation_type) if relation_type else relations
    order = [F.desc_nulls_last("confidence"), F.desc("fact_a_id"), F.desc("fact_b_id")]
    return with_sides(rows.orderBy(*order).offset(offset).limit(limit), facts, documents).orderBy(*order)


def documents_overview(documents: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("doc_id").agg(F.count("*").alias("fact_count"), F.count_if("quote_verified").alias("grounded_count"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("fact_count", "grounded_count")}
    return documents.join(counts, "doc_id", "left").withColumns(filled).orderBy(F.desc("doc_id"))


def counts(documents: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of eight counts; one pass over each table."""
    verified, state = F.col("quote_verified"), F.col("grounding")
    d = documents.agg(F.count("*").alias("documents"))
    f = facts.agg(F.count("*").alias("facts"), F.count_if(verified).alias("grounded"), F.count_if(~verified).alias("ungrounded"), F.count_if(state == "verbatim").alias("verbatim"), F.count_if(state == "reflowed").alias("reflowed"))
    r = relations.agg(F.count("*").alias("relations"), F.count_if(F.col("relation_type") == "contradicts").alias("contradictions"))
    return d.crossJoin(f).crossJoin(r)  # one row each


def relations_by_type(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation_type", "decided_by").agg(F.count("*").alias("c"))


def top_fact_types(facts: DataFrame, n: int = 20) -> DataFrame:
    return facts.groupBy("fact_type").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "fact_type").limit(n)


def stats(documents: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """The counts in one row, with lists by_relation and by_fact_type."""
    r, t = relations_by_type(relations), top_fact_types(facts)
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    return counts(documents, facts, relations).crossJoin(listed(r, "by_relation")).crossJoin(listed(t, "by_fact_type"))


def health(documents: DataFrame, facts: DataFrame, relations: DataFrame, client: bool = False) -> DataFrame:
    return counts(documents, facts, relations).select(F.lit(True).alias("ok"), F.lit(client).alias("llm"), "*")


def newest(rows: DataFrame, by: str, n: int = 60) -> DataFrame:
    """The latest rows, as a live list shows them."""
    return rows.orderBy(F.desc(by)).limit(n)


class Reader:
    """The serving queries over a store. Parameters that are empty or None don't filter."""

    def __init__(self, store: Store):
        self.store = store

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.store.read(t) for t in ("documents", "facts", "relations"))

    def health(self, client: bool = False) -> DataFrame:
        d, f, r = self._tables()
        return health(d, f, r, client)

    def stats(self) -> DataFrame:
        return stats(*self._tables())

    def documents(self) -> DataFrame:
        d, f, _ = self._tables()
        return documents_overview(d, f)

    def facts(self, **params) -> DataFrame:
        d, f, _ = self._tables()
        return search_facts(f, d, **{k: v for k, v in params.items() if v is not None and v != ""})

    def fact(self, fact_id: int) -> DataFrame:
        d, f, _ = self._tables()
        return fact_detail(f, d, fact_id)

    def relations(self, **params) -> DataFrame:
        d, f, r = self._tables()
        return list_relations(r, f, d, **{k: v for k, v in params.items() if v is not None and v != ""})

    def fact_relations(self, fact_id: int) -> DataFrame:
        d, f, r = self._tables()
        return fact_relations(r, f, d, fact_id)
