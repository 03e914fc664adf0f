"""Registered queries of the claims engine, each with DuckDB SQL where that can say it."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import period, quantity, text
from ..operators import grounding, relate, similarity
from ..operators.facts import assembled_facts, with_period
from ..sources import boundary, prompts, store
from ..sources.store import Store, shared_home
from ..sources import pages as P
from . import adapters as A
from . import oracle_parts as O
from ..streaming.ingest import ingest_batch, ingest_stream, read_events
from . import replay, report, serve

QUERIES: dict = {}
ORACLES: dict = {}
#: Vectors of the test tables are far apart: thresholds are lower than the defaults, the budget too.
REPLAY = Config(floor=0.25, rule_floor=0.30, budget=10)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WITH_PAGES = f"WITH {A.PAGES}"
WITH_FACTS = f"WITH {A.FACTS_RAW}, {A.DOCUMENTS}, {A.RELATIONS}"
PARSED = f"WITH {A.FACTS_RAW}, fv AS (SELECT *, value_raw AS raw FROM raw_facts), {O.quantity('fv')}, fp AS (SELECT * EXCLUDE (raw), period_raw AS raw FROM q), {O.period('fp')}"
CLAIM_KEY = "subject || ' | ' || predicate || ' | status=' || status"


# --- pages -----------------------------------------------------------------------------------------


@query(f"{WITH_PAGES} SELECT doc_id, page, text FROM pg")
def q_pages_split(spark: SparkSession, d: str) -> DataFrame:
    return P.pages_of_lines(A.table(spark, d, "documents"))


@query(f"{WITH_PAGES} SELECT doc_id, page, combined FROM pg")
def q_page_combined(spark, d):
    return A.pages(spark, d).select("doc_id", "page", "combined")


@query(rf"{WITH_PAGES} SELECT doc_id, page FROM pg WHERE regexp_matches(combined, '\S')")
def q_nonblank_pages(spark, d):
    return A.pages(spark, d).where(~P.is_blank(F.col("combined"))).select("doc_id", "page")


@query(rf"""{WITH_PAGES} SELECT doc_id, ((page - 1) // 10)::INT AS chunk, min(page) AS start_page, max(page) AS end_page, string_agg('[[page ' || page || ']]' || chr(10) || combined, chr(10) || chr(10) ORDER BY page) AS text
FROM pg WHERE regexp_matches(combined, '\S') GROUP BY ALL""")
def q_chunks(spark, d):
    return P.chunks(A.pages(spark, d))


@query(f"{WITH_PAGES} SELECT doc_id, substr(string_agg(combined, chr(10) || chr(10) ORDER BY page), 1, 6000) AS head FROM pg WHERE page <= 3 GROUP BY doc_id")
def q_doc_head(spark, d):
    return P.doc_heads(A.pages(spark, d))


@query("""SELECT n_nationkey AS id, 'TABLE:' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' | ' || n_regionkey || ' | ' || chr(10) ELSE '' END || 'total | two words | ' || n_nationkey AS tables_text FROM nation""")
def q_table_render(spark, d):
    n = A.table(spark, d, "nation")
    cell = lambda c: F.col(c).cast("string") if c in n.columns else F.lit(c).cast("string")
    blank = F.array(F.lit(" "), F.lit(None).cast("string"), F.lit("\t"))
    first = F.when(n.n_nationkey % 2 == 0, F.array(F.concat(F.lit("  "), "n_name"), cell("n_regionkey"), F.lit(None).cast("string"))).otherwise(blank)
    rows = F.array(first, blank, F.array(F.lit(" total"), F.lit("two\nwords "), cell("n_nationkey")))
    return n.select(F.col("n_nationkey").alias("id"), P.rendered_tables(F.array(rows, F.array(blank))).alias("tables_text"))


# --- quantities and periods ------------------------------------------------------------------------

SAMPLES_Q = f"WITH s AS ({A.dealt(A.QUANTITIES, 'hint')}), {O.quantity('s', 'hint')}"
SAMPLES_P = f"WITH s AS ({A.dealt(A.PERIODS, 'convention')}), {O.period('s', 'convention')}"
#: The same samples on both sides of a pair: parsed as CTEs (a) and (b).
_PAIR = "WITH s AS (SELECT id, raw, {kind} FROM ({dealt})), {parse}, s2 AS (SELECT id, other_raw AS raw, other_{kind} AS {kind} FROM ({dealt})), {parse2}"


def _paired(samples, kind: str, parse, names: str) -> str:
    dealt, second = A.dealt(samples, kind), parse("s2", kind)
    for name in names.split():
        second = second.replace(f"{name} AS (SELECT", f"{name}_2 AS (SELECT").replace(f"FROM {name})", f"FROM {name}_2)").replace(f"FROM {name} ", f"FROM {name}_2 ")
    return _PAIR.format(kind=kind, dealt=dealt, parse=parse("s", kind), parse2=second) 


PAIRS_Q = _paired(A.QUANTITIES, "hint", O.quantity, "q0 q1 q")
PAIRS_P = _paired(A.PERIODS, "convention", O.period, "p0 p1 p2 p3 p4 p")


@query(f"{SAMPLES_Q} SELECT id, value, unit, dimension FROM q")
def q_quantity_samples(spark, d):
    return A.quantity_samples(spark, d).select("id", quantity.parse_quantity(F.col("raw"), F.col("hint")).alias("q")).select("id", "q.value", "q.unit", "q.dimension")


@query(f"{PARSED} SELECT fact_id, value, unit, dimension FROM q")
def q_parse_quantity(spark, d):
    return A.raw_facts(spark, d).select("fact_id", quantity.parse_quantity(F.col("value_raw")).alias("q")).select("fact_id", "q.value", "q.unit", "q.dimension")


@query(f"{SAMPLES_Q} SELECT id, hc AS currency, hs AS scale FROM q")
def q_unit_hint(spark, d):
    return A.quantity_samples(spark, d).select("id", quantity.parse_unit_hint(F.col("hint")).alias("h")).select("id", "h.currency", "h.scale")


@query(f"{SAMPLES_Q} SELECT id, sgn AS sign, cur AS currency, sc AS scale FROM q WHERE raw IS NOT NULL")
def q_sign_currency_scale(spark, d):
    low = F.lower(quantity.stripped(F.col("raw")))
    return A.quantity_samples(spark, d).where("raw is not null").select("id", quantity.sign_of(low).alias("sign"), quantity.currency_of(low).alias("currency"), quantity.scale_of(low).alias("scale"))


@query(f"{PAIRS_Q} SELECT a.id, {O.comparable('a', 'b')} AS why, {O.agree('a', 'b')} AS agree FROM q a JOIN q_2 b USING (id)")
def q_values_compared(spark, d):
    parsed = lambda raw, hint: quantity.parse_quantity(F.col(raw), F.col(hint))
    s = A.quantity_samples(spark, d).select("id", parsed("raw", "hint").alias("a"), parsed("other_raw", "other_hint").alias("b"))
    return s.select("id", quantity.comparability(F.col("a"), F.col("b")).alias("why"), quantity.values_agree(F.col("a"), F.col("b")).alias("agree"))


@query(f"{SAMPLES_P} SELECT id, start::VARCHAR AS start, end_::VARCHAR AS end_, kind FROM p")
def q_period_samples(spark, d):
    return with_period(A.period_samples(spark, d), "p", "raw", "convention").select("id", F.col("p.start").cast("string").alias("start"), F.col("p.end").cast("string").alias("end_"), "p.kind")


@query(f"{PARSED} SELECT fact_id, start::VARCHAR AS start, end_::VARCHAR AS end_, kind FROM p")
def q_parse_period(spark, d):
    return with_period(A.raw_facts(spark, d).select("fact_id", "period_raw"), "p").select("fact_id", F.col("p.start").cast("string").alias("start"), F.col("p.end").cast("string").alias("end_"), "p.kind")


@query(f"{PAIRS_P} SELECT a.id, {O.relation('a', 'b')} AS relation FROM p a JOIN p_2 b USING (id)")
def q_periods_relation(spark, d):
    s = with_period(with_period(A.period_samples(spark, d), "a", "raw", "convention"), "b", "other_raw", "other_convention")
    return s.select("id", period.periods_relation(F.col("a"), F.col("b")).alias("relation"))


# --- grounding -------------------------------------------------------------------------------------

CANON = r"lower(trim(regexp_replace(translate({0}, '’‘“”–—−', '''''\"\"---'), '\s+', ' ', 'g')))".replace('\\"', '"')
NUMS = r"list_distinct(list_transform(regexp_extract_all({0}, '\d[\d,]*\.?\d*'), lambda t: rtrim(replace(t, ',', ''), '.')))"
WORDS = "list_distinct(regexp_extract_all({0}, '[a-z]{{3,}}'))"
GROUND = f"""WITH {A.PAGES}, {A.QUOTES}, c AS (SELECT fact_id, {CANON.format('quote')} AS q, {CANON.format('page_text')} AS p FROM quotes),
t AS (SELECT *, {NUMS.format('q')} AS qn, {NUMS.format('p')} AS pn, {WORDS.format('q')} AS qw, {WORDS.format('p')} AS pw FROM c),
v AS (SELECT *, list_has_all(pn, qn) AS there, CASE WHEN len(qw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(qw, pw)) / len(qw)::DOUBLE END AS cover FROM t)"""


@query(f"{WITH_PAGES} SELECT doc_id, page, {CANON.format('text')} AS canon, {WORDS.format(CANON.format('text'))}.list_sort() AS words, {NUMS.format(CANON.format('text'))}.list_sort() AS numbers FROM pg")
def q_canon_tokens(spark, d):
    c = text.canon(F.col("text"), compatibility=False)
    p = A.pages(spark, d).select("doc_id", "page", c.alias("canon"))
    return p.select("doc_id", "page", "canon", F.sort_array(text.long_words(F.col("canon"))).alias("words"), F.sort_array(text.numbers(F.col("canon"))).alias("numbers"))


@query(f"{GROUND} SELECT fact_id, there, round(cover, 6) AS cover FROM v")
def q_overlap(spark, d):
    c = A.quotes(spark, d).select("fact_id", text.canon(F.col("quote"), False).alias("q"), text.canon(F.col("page_text"), False).alias("p"))
    return c.select("fact_id", text.numbers_present(text.numbers(F.col("q")), text.numbers(F.col("p"))).alias("there"), F.round(text.word_coverage(text.long_words(F.col("q")), text.long_words(F.col("p"))), 6).alias("cover"))


@query(f"""{GROUND} SELECT fact_id, CASE WHEN length(q) < 12 OR p = '' THEN 'unverified' WHEN contains(p, q) THEN 'verbatim' WHEN there AND (len(qn) > 0 OR len(qw) >= 4) AND cover >= 0.8 THEN 'reflowed' ELSE 'unverified' END AS grounding,
CASE WHEN length(q) < 12 OR p = '' THEN 0.0 WHEN contains(p, q) THEN 1.0 WHEN NOT there THEN 0.0 ELSE round(cover, 3) END::DOUBLE AS score FROM v""")
def q_verify_native(spark, d):
    g = grounding.with_grounding(A.quotes(spark, d), fuzzy=False, compatibility=False)
    return g.select("fact_id", "grounding", F.round("score", 3).alias("score"))


@query()
def q_verify_fuzzy(spark, d):
    return grounding.with_grounding(A.quotes(spark, d)).select("fact_id", "grounding", "score")


@query()
def q_ground_facts(spark, d):
    q = A.quotes(spark, d).drop("page_text").withColumn("start_page", F.expr("(page - 1) div 10 * 10 + 1").cast("int")).withColumn("end_page", F.col("start_page") + 9).withColumn("page", F.when(F.col("fact_id") % 3 == 0, F.col("page") + 1).otherwise(F.col("page")))
    return grounding.ground_facts(q, A.pages(spark, d)).select("fact_id", "page", "grounding", "quote_score", "quote_verified")


@query(f"{WITH_FACTS} SELECT fact_id, {CLAIM_KEY} AS claim_key, 'status=' || status AS qualifiers FROM raw_facts")
def q_claim_key(spark, d):
    return A.raw_facts(spark, d).select("fact_id", text.claim_key(F.col("subject"), F.col("predicate"), F.col("qualifiers")).alias("claim_key"), text.qualifier_text(F.col("qualifiers")).alias("qualifiers"))


@query(f"{WITH_FACTS} SELECT fact_id FROM (SELECT fact_id, row_number() OVER (PARTITION BY doc_id, {CLAIM_KEY}, value_raw, period_raw ORDER BY page, fact_id) AS n FROM raw_facts) WHERE n = 1")
def q_fact_dedupe(spark, d):
    f = A.facts(spark, d).withColumn("quote", F.col("source_quote")).withColumn("chunk", F.col("page")).withColumn("ordinal", F.col("fact_id"))
    return grounding.first_of_each(f).select("fact_id")


# --- similarity and relations ----------------------------------------------------------------------

VECTORS = """vf AS (SELECT vec_id AS fact_id, label::BIGINT AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
sim AS (SELECT a.fact_id AS a_id, b.fact_id AS b_id, a.doc_id AS a_doc, b.doc_id AS b_doc, list_dot_product(a.e, b.e) AS s FROM vf a JOIN vf b ON {test}),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_id DESC) AS rank FROM sim WHERE s >= 0.25) WHERE rank <= 5)"""
EARLIER, OTHERS = VECTORS.format(test="b.doc_id < a.doc_id"), VECTORS.format(test="b.doc_id <> a.doc_id")
PARSED_V = PARSED.replace("value_raw AS raw FROM raw_facts)", "value_raw AS raw FROM (SELECT * REPLACE (CASE WHEN fact_id % 2 = 0 THEN (fact_id % 3) || '.5%' ELSE value_raw END AS value_raw, CASE WHEN fact_id % 2 = 0 THEN 'FY2' || (fact_id % 5) ELSE period_raw END AS period_raw) FROM raw_facts))")
REPLAYED = f"""{PARSED_V}, {EARLIER},
v AS (SELECT fact_id, start, end_, value, unit, dimension FROM p),
cls AS (SELECT cand.*, {O.relation('a', 'b')} AS periods, {O.comparable('a', 'b')} AS comparable,
  CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL AND a.dimension IN ('currency', 'ratio') AND b.dimension IN ('currency', 'ratio') AND {O.relation('a', 'b')} = 'equal' AND {O.agree('a', 'b')} THEN 'corroborates' END AS raw_type
  FROM cand JOIN v a ON a_id = a.fact_id JOIN v b ON b_id = b.fact_id),
gate AS (SELECT *, CASE WHEN s >= 0.30 THEN raw_type END AS relation_type FROM cls),
bud AS (SELECT *, CASE WHEN relation_type IS NOT NULL THEN 'rule' WHEN row_number() OVER (PARTITION BY a_doc, relation_type IS NULL ORDER BY s DESC, a_id, rank) <= 10 THEN 'adjudicate' ELSE 'unexamined' END AS status FROM gate)"""


def _vectors(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("label").cast("long").alias("doc_id"), "embedding")


def _candidates(pairs):
    return pairs.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {OTHERS} SELECT a_id, b_id, round(s, 6) AS similarity, rank FROM cand")
def q_topk_similarity(spark, d):
    return _candidates(similarity.candidates(_vectors(spark, d), _vectors(spark, d), 0.25))


@query(f"WITH {EARLIER} SELECT a_id, b_id, round(s, 6) AS similarity, rank FROM cand")
def q_replay_candidates(spark, d):
    v = _vectors(spark, d)
    return _candidates(similarity.candidates(v, v, 0.25, earlier=True, broadcast_bytes=0))


@query(f"{REPLAYED} SELECT a_id, b_id, periods, comparable, raw_type AS relation_type FROM cls")
def q_classify(spark, d):
    f = A.vector_facts(spark, d)
    pairs = similarity.candidates(f, f, 0.25, earlier=True)
    side = lambda n: f.select(F.struct(*relate.FACT).alias(n))
    joined = pairs.join(side("a"), F.col("a_id") == F.col("a.fact_id")).join(side("b"), F.col("b_id") == F.col("b.fact_id"))
    return relate.classified(joined).select("a_id", "b_id", "periods", "comparable", "relation_type")


@query(f"{REPLAYED} SELECT a_id, b_id, relation_type, status FROM bud")
def q_gate_and_budget(spark, d):
    return replay.replay_pairs(A.vector_facts(spark, d), REPLAY).select("a_id", "b_id", "relation_type", "status")


@query(f"{REPLAYED} SELECT a_doc, count(*) AS unexamined FROM bud WHERE status = 'unexamined' GROUP BY a_doc")
def q_unexamined(spark, d):
    return replay.replay_pairs(A.vector_facts(spark, d), REPLAY).where("status = 'unexamined'").groupBy("a_doc").agg(F.count("*").alias("unexamined"))


VERDICT_TYPES = ["contradicts", "reconciled_time", "unrelated", "nonsense", "reconciled_scope"]


def _verdicts(spark, d):
    """An answer for every pair of ids, in place of an adjudicator's."""
    pairs = similarity.candidates(_vectors(spark, d), _vectors(spark, d), 0.25, earlier=True)
    kind = F.element_at(F.array(*map(F.lit, VERDICT_TYPES)), ((F.col("a_id") + F.col("b_id")) % 5 + 1).cast("int"))
    return pairs.select(F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), kind.alias("relation_type"), F.lit("told").alias("explanation"), F.when(F.col("a_id") % 2 == 0, 0.75).alias("confidence"))


@query(f"""{REPLAYED}, told AS (SELECT *, {VERDICT_TYPES}[((a_id + b_id) % 5 + 1)::INT] AS t FROM bud)
SELECT a_id AS fact_a_id, b_id AS fact_b_id, CASE WHEN status = 'rule' THEN relation_type WHEN t = 'nonsense' THEN 'needs_review' ELSE t END AS relation_type, CASE WHEN status = 'rule' THEN 'rule' ELSE 'llm' END AS decided_by,
round(s, 6) AS similarity, CASE WHEN status = 'rule' THEN 0.95 WHEN a_id % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM told WHERE status = 'rule' OR (status = 'adjudicate' AND t <> 'unrelated')""")
def q_replay_relations(spark, d):
    out = replay.replay(A.vector_facts(spark, d), _verdicts(spark, d), REPLAY)
    return out.select("fact_a_id", "fact_b_id", "relation_type", "decided_by", F.round("similarity", 6).alias("similarity"), "confidence")


@query(f"""{REPLAYED}, t AS (SELECT a_doc AS doc_id, CASE WHEN status = 'rule' THEN relation_type || '/rule' ELSE status END AS key FROM bud)
SELECT doc_id, key, count(*) AS n FROM t GROUP BY doc_id, key UNION ALL SELECT NULL, key, count(*) FROM t GROUP BY key""")
def q_replay_totals(spark, d):
    return report.replay_totals(replay.replay_pairs(A.vector_facts(spark, d), REPLAY))


@query(f"""{WITH_FACTS}, c AS (SELECT fact_b_id AS fact_a_id, fact_a_id AS fact_b_id, similarity FROM rels UNION ALL SELECT fact_a_id + 1, fact_b_id, similarity FROM rels UNION ALL SELECT fact_b_id, fact_a_id + 1, similarity - 1 FROM rels)
SELECT c.fact_a_id, c.fact_b_id FROM c WHERE similarity >= 0 AND (least(c.fact_a_id, c.fact_b_id), greatest(c.fact_a_id, c.fact_b_id)) NOT IN (SELECT (least(fact_a_id, fact_b_id), greatest(fact_a_id, fact_b_id)) FROM rels)""")
def q_relations_dedupe(spark, d):
    r = A.relations(spark, d)
    turned = r.select(F.col("fact_b_id").alias("fact_a_id"), F.col("fact_a_id").alias("fact_b_id"), "similarity")
    moved = r.select((F.col("fact_a_id") + 1).alias("fact_a_id"), "fact_b_id", "similarity")
    again = moved.select(F.col("fact_b_id").alias("fact_a_id"), F.col("fact_a_id").alias("fact_b_id"), (F.col("similarity") - 1).alias("similarity"))
    return store.new_relations(turned.unionByName(moved).unionByName(again), r).select("fact_a_id", "fact_b_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'contradicts' ELSE 'needs_review' END AS relation_type FROM orders")
def q_verdict_validate(spark, d):
    o = A.table(spark, d, "orders")
    given = F.when(F.col("o_orderpriority") == "1-URGENT", "contradicts").otherwise(F.lower("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), boundary.valid_type(given).alias("relation_type"))


# --- serving ---------------------------------------------------------------------------------------

DETAIL = "f.fact_id, f.doc_id, f.page, f.fact_type, f.subject, f.value_raw, f.grounding, d.filename, d.title"
_DETAIL = ["fact_id", "doc_id", "page", "fact_type", "subject", "value_raw", "grounding", "filename", "title"]


@query(f"{WITH_FACTS} SELECT {DETAIL} FROM raw_facts f JOIN docs d USING (doc_id) WHERE subject ILIKE '%build%' OR predicate ILIKE '%build%' OR source_quote ILIKE '%build%' ORDER BY f.fact_id DESC LIMIT 200")
def q_facts_search(spark, d):
    return serve.search_facts(A.raw_facts(spark, d), A.documents(spark, d), q="build").select(_DETAIL)


@query(f"{WITH_FACTS} SELECT {DETAIL} FROM raw_facts f JOIN docs d USING (doc_id) WHERE f.doc_id = 2 AND fact_type = 'financial' AND quote_verified AND grounding = 'verbatim' ORDER BY f.fact_id DESC LIMIT 1000")
def q_facts_filter(spark, d):
    return serve.search_facts(A.raw_facts(spark, d), A.documents(spark, d), 2, "financial", True, "verbatim", "", 1000).select(_DETAIL)


@query(f"{WITH_FACTS} SELECT {DETAIL} FROM raw_facts f JOIN docs d USING (doc_id) ORDER BY f.fact_id DESC LIMIT 50 OFFSET 100")
def q_facts_page(spark, d):
    return serve.search_facts(A.raw_facts(spark, d), A.documents(spark, d), limit=50, offset=100).select(_DETAIL)


@query(f"{WITH_FACTS} SELECT {DETAIL} FROM raw_facts f JOIN docs d USING (doc_id) WHERE fact_id = 42")
def q_fact_detail(spark, d):
    return serve.fact_detail(A.raw_facts(spark, d), A.documents(spark, d), 42).select(_DETAIL)


@query(f"{WITH_FACTS} SELECT f.fact_id, f.doc_id, d.publisher, d.doc_date FROM raw_facts f JOIN docs d USING (doc_id) JOIN embeddings e ON e.vec_id = f.fact_id WHERE quote_verified AND f.doc_id <> 3")
def q_verified_facts(spark, d):
    v = _vectors(spark, d).drop("doc_id")
    return serve.verified_facts(A.raw_facts(spark, d).join(v, "fact_id", "left"), A.documents(spark, d), 3).select("fact_id", "doc_id", "publisher", "doc_date")


SIDES = "r.fact_a_id, r.fact_b_id, r.relation_type, r.confidence, a.subject AS a_subject, b.subject AS b_subject, b.value_raw AS b_value"


@query(f"""{WITH_FACTS} SELECT {SIDES} FROM (SELECT * FROM rels WHERE relation_type = 'contradicts' ORDER BY confidence DESC NULLS LAST, fact_a_id DESC, fact_b_id DESC LIMIT 100 OFFSET 10) r LEFT JOIN raw_facts a ON a.fact_id = fact_a_id LEFT JOIN raw_facts b ON b.fact_id = fact_b_id""")
def q_relations_page(spark, d):
    rows = serve.list_relations(A.relations(spark, d), A.raw_facts(spark, d), A.documents(spark, d), "contradicts", offset=10)
    return rows.select("fact_a_id", "fact_b_id", "relation_type", "confidence", F.col("a.subject").alias("a_subject"), F.col("b.subject").alias("b_subject"), F.col("b.value_raw").alias("b_value"))


@query(f"{WITH_FACTS} SELECT r.relation_type, CASE WHEN fact_a_id = 154 THEN fact_b_id ELSE fact_a_id END AS other_id, o.subject AS other_subject FROM rels r LEFT JOIN raw_facts o ON o.fact_id = CASE WHEN fact_a_id = 154 THEN fact_b_id ELSE fact_a_id END WHERE fact_a_id = 154 OR fact_b_id = 154")
def q_fact_relations(spark, d):
    rows = serve.fact_relations(A.relations(spark, d), A.raw_facts(spark, d), A.documents(spark, d), 154)
    return rows.select("relation_type", "other_id", F.col("other.subject").alias("other_subject"))


@query(f"{WITH_FACTS} SELECT fact_a_id AS fact_id, fact_b_id AS other_id, relation_type FROM rels UNION ALL SELECT fact_b_id, fact_a_id, relation_type FROM rels")
def q_relations_both_sides(spark, d):
    return serve.both_sides(A.relations(spark, d)).select("fact_id", "other_id", "relation_type")


@query(f"{WITH_FACTS} SELECT doc_id, filename, title, (SELECT count(*) FROM raw_facts f WHERE f.doc_id = d.doc_id) AS fact_count, (SELECT count(*) FROM raw_facts f WHERE f.doc_id = d.doc_id AND quote_verified) AS grounded_count FROM docs d")
def q_documents_overview(spark, d):
    return serve.documents_overview(A.documents(spark, d), A.raw_facts(spark, d)).select("doc_id", "filename", "title", "fact_count", "grounded_count")


COUNTS = """(SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM raw_facts) AS facts, (SELECT count(*) FROM raw_facts WHERE quote_verified) AS grounded, (SELECT count(*) FROM raw_facts WHERE NOT quote_verified) AS ungrounded,
(SELECT count(*) FROM raw_facts WHERE grounding = 'verbatim') AS verbatim, (SELECT count(*) FROM raw_facts WHERE grounding = 'reflowed') AS reflowed, (SELECT count(*) FROM rels) AS relations, (SELECT count(*) FROM rels WHERE relation_type = 'contradicts') AS contradictions"""


@query(f"{WITH_FACTS} SELECT {COUNTS}")
def q_counts(spark, d):
    return serve.counts(A.documents(spark, d), A.raw_facts(spark, d), A.relations(spark, d))


@query(f"{WITH_FACTS} SELECT true AS ok, false AS llm, {COUNTS}")
def q_health(spark, d):
    return serve.health(A.documents(spark, d), A.raw_facts(spark, d), A.relations(spark, d))


@query(f"{WITH_FACTS} SELECT relation_type, decided_by, count(*) AS c FROM rels GROUP BY ALL")
def q_stats_relations(spark, d):
    return serve.relations_by_type(A.relations(spark, d))


@query(f"{WITH_FACTS} SELECT fact_type, count(*) AS c FROM raw_facts GROUP BY 1 ORDER BY c DESC, fact_type LIMIT 20")
def q_stats_fact_types(spark, d):
    return serve.top_fact_types(A.raw_facts(spark, d))


@query(f"""{WITH_FACTS}, r AS (SELECT relation_type, decided_by, count(*) AS c FROM rels GROUP BY ALL), t AS (SELECT fact_type, count(*) AS c FROM raw_facts GROUP BY 1 ORDER BY c DESC, fact_type LIMIT 20)
SELECT {COUNTS}, (SELECT string_agg(relation_type || '/' || decided_by || '=' || c, ',' ORDER BY relation_type, decided_by) FROM r) AS by_relation, (SELECT string_agg(fact_type || '=' || c, ',' ORDER BY fact_type) FROM t) AS by_fact_type""")
def q_stats(spark, d):
    s = serve.stats(A.documents(spark, d), A.raw_facts(spark, d), A.relations(spark, d))
    named = lambda name, text: F.array_join(F.transform(name, text), ",").alias(name)
    relation = named("by_relation", lambda x: F.concat(x["relation_type"], F.lit("/"), x["decided_by"], F.lit("="), x["c"].cast("string")))
    return s.withColumns({"by_relation": relation, "by_fact_type": named("by_fact_type", lambda x: F.concat(x["fact_type"], F.lit("="), x["c"].cast("string")))})


# --- reports ---------------------------------------------------------------------------------------


@query(f"""{WITH_FACTS}, c AS (SELECT *, CASE WHEN relation_type = 'corroborates' THEN '1. CORROBORATED ACROSS DOCUMENTS' WHEN relation_type = 'contradicts' THEN '2. CONTRADICTION' WHEN relation_type LIKE 'reconciled%' THEN '3. RECONCILED BY CONTEXT' ELSE '4. UNRESOLVED / NEEDS REVIEW' END AS "case" FROM rels)
SELECT "case", n, fact_a_id, fact_b_id FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY (decided_by = 'llm') DESC, confidence DESC, fact_a_id, fact_b_id) AS n FROM c) WHERE n <= 2""")
def q_report_cases(spark, d):
    return report.cases(A.relations(spark, d)).select("case", F.col("n").cast("long").alias("n"), "fact_a_id", "fact_b_id")


_SIDE = """'    {T}: ' || {t}.subject || ' · ' || {t}.predicate || ' = ' || coalesce(nullif({t}.value_raw, ''), '(non-numeric)') || '  [' || coalesce(nullif({t}.period_raw, ''), 'no period') || ']' || chr(10) || '       source: ' || coalesce(nullif({t}.title, ''), {t}.filename) || ' p.' || {t}.page || '  (' || {t}.grounding || ')' || chr(10) || '       quote : "' || substr(coalesce({t}.source_quote, ''), 1, 150) || '"'"""


@query(f"""{WITH_FACTS}, c AS (SELECT *, CASE WHEN relation_type = 'corroborates' THEN '1. CORROBORATED ACROSS DOCUMENTS' WHEN relation_type = 'contradicts' THEN '2. CONTRADICTION' WHEN relation_type LIKE 'reconciled%' THEN '3. RECONCILED BY CONTEXT' ELSE '4. UNRESOLVED / NEEDS REVIEW' END AS "case" FROM rels),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY (decided_by = 'llm') DESC, confidence DESC, fact_a_id, fact_b_id) AS n FROM c) WHERE n <= 2),
fd AS (SELECT f.*, filename, title FROM raw_facts f JOIN docs USING (doc_id))
SELECT "case", n, concat_ws(chr(10), '  [' || relation_type || '] decided_by=' || decided_by || ' sim=' || printf('%.3f', top.similarity) || ' conf=' || top.confidence, {_SIDE.format(T='A', t='a')}, {_SIDE.format(T='B', t='b')}, '    reasoning: ' || coalesce(explanation, '')) AS text
FROM top LEFT JOIN fd a ON a.fact_id = fact_a_id LEFT JOIN fd b ON b.fact_id = fact_b_id""")
def q_report_text(spark, d):
    return report.shown(serve.with_sides(report.cases(A.relations(spark, d)), A.raw_facts(spark, d), A.documents(spark, d))).select("case", "n", "text")


@query(f"{WITH_FACTS} SELECT fact_id, quote_score, filename FROM raw_facts JOIN docs USING (doc_id) WHERE NOT quote_verified ORDER BY quote_score DESC NULLS LAST, fact_id LIMIT 3")
def q_rejected_evidence(spark, d):
    return report.rejected_evidence(A.raw_facts(spark, d), A.documents(spark, d)).select("fact_id", "quote_score", "filename")


@query(f"""{WITH_FACTS} SELECT r.fact_a_id, r.fact_b_id, a.subject AS a_subject, b.subject AS b_subject, r.similarity FROM rels r JOIN raw_facts a ON a.fact_id = r.fact_a_id JOIN docs da ON da.doc_id = a.doc_id JOIN raw_facts b ON b.fact_id = r.fact_b_id JOIN docs db ON db.doc_id = b.doc_id
WHERE lower(a.subject) = lower(da.publisher) AND lower(a.subject) <> lower(b.subject) ORDER BY r.similarity DESC, r.fact_a_id, r.fact_b_id LIMIT 20""")
def q_publisher_audit(spark, d):
    return report.publisher_audit(A.relations(spark, d), A.raw_facts(spark, d), A.documents(spark, d), 20).select("fact_a_id", "fact_b_id", "a_subject", "b_subject", "similarity")


@query(f"{WITH_FACTS} SELECT doc_id, 'grounding' AS kind, grounding AS name, count(*) AS n FROM raw_facts GROUP BY ALL UNION ALL SELECT f.doc_id, 'relation', relation_type, count(*) FROM rels JOIN raw_facts f ON f.fact_id = fact_a_id GROUP BY ALL")
def q_batch_counters(spark, d):
    return report.batch_counters(A.raw_facts(spark, d), A.relations(spark, d))


# --- from pages to relations --------------------------------------------------------------------------


class PageReader:
    """A model's stand-in: of each page in an excerpt, its first 60 characters as a fact about the page. It fails on
    excerpts that begin at page 21."""

    def ask(self, prompt: str) -> dict:
        body = prompt.split("EXCERPT:\n", 1)[1]
        pages = re.findall(r"\[\[page (\d+)\]\]\n([^\n]*)", body)
        if pages[0][0] == "21":
            raise ValueError("this excerpt can't be read")
        return {"facts": [{"fact_type": "opening", "subject": f"page {n}", "predicate": "begins", "qualifiers": [], "value_raw": "", "period_raw": "", "page": int(n), "quote": line[:60], "confidence": 0.5} for n, line in pages]}


def _read(spark, d):
    """(documents, pages, chunks, answers) of the whole documents table, through prompts and the stand-in."""
    pages = A.pages(spark, d)
    documents = A.table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"))
    documents = boundary.document_context(documents.where("doc_id is not null"), None)
    chunks = P.chunks(pages)
    answers = boundary.extracted_chunks(chunks, documents, PageReader, per_minute=float("inf"), retries=1)
    home = shared_home(spark, "answers")
    answers.write.parquet(home)
    return documents, pages, chunks, spark.read.schema(answers.schema).parquet(home)


#: Pages of chunks that the stand-in reads, numbered inside their chunk.
READ = rf"""{WITH_PAGES}, nb AS (SELECT *, ((page - 1) // 10)::INT AS chunk FROM pg WHERE regexp_matches(combined, '\S')),
ch AS (SELECT doc_id, chunk, min(page) AS start_page, max(page) AS end_page FROM nb GROUP BY ALL),
rd AS (SELECT nb.*, row_number() OVER (PARTITION BY nb.doc_id, chunk ORDER BY page) - 1 AS ordinal, substr(string_split(combined, chr(10))[1], 1, 60) AS quote FROM nb JOIN ch USING (doc_id, chunk) WHERE start_page <> 21)"""


@query(f"{READ} SELECT doc_id, chunk, ordinal::INT AS ordinal, page, 'page ' || page AS subject, quote FROM rd")
def q_extract_facts(spark, d):
    return boundary.raw_facts(_read(spark, d)[3]).select("doc_id", "chunk", "ordinal", "page", "subject", "quote")


@query(f"""{READ}, f AS (SELECT doc_id, count(*) AS n FROM rd WHERE quote <> '' GROUP BY doc_id), dd AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, 'doc' AS event, 1 AS n, NULL::BIGINT AS facts FROM dd UNION ALL SELECT DISTINCT doc_id, 'plan', 1, NULL FROM ch UNION ALL SELECT doc_id, 'note', count(*), NULL FROM ch WHERE start_page = 21 GROUP BY doc_id
UNION ALL SELECT doc_id, 'fact', n, NULL FROM f UNION ALL SELECT doc_id, 'done', 1, n FROM f UNION ALL SELECT doc_id, 'error', 1, NULL FROM dd WHERE doc_id NOT IN (SELECT doc_id FROM f))
SELECT * FROM e""")
def q_ingest_events(spark, d):
    """All documents from pages to stored facts in one batch; its events by document and kind, and what done tells."""
    documents, pages, chunks, answers = _read(spark, d)
    home = shared_home(spark, "ingest")
    s = Store(spark, f"{home}/store")
    embed = lambda keys: np.zeros((len(keys), 2), np.float32)  # noqa: E731  nothing is alike: no relations are looked for
    facts = assembled_facts(boundary.raw_facts(answers), pages, chunks, documents, embed=embed)
    with s.scratch(facts) as written:
        ingest_batch(s, documents, written, config=Config(floor=0.5), chunks=answers, write_events=lambda e: e.select("line").write.text(f"{home}/events"))
    e = read_events(spark, f"{home}/events")
    return e.groupBy("doc_id", "event").agg(F.count("*").alias("n"), F.max(F.col("totals")["facts"]).alias("facts"))


@query(f"""{WITH_FACTS}, fd AS (SELECT f.*, coalesce(title, filename) AS doc FROM raw_facts f JOIN docs USING (doc_id))
SELECT fact_a_id, fact_b_id, {O.prompt(prompts.ADJUDICATION)} AS prompt FROM rels JOIN fd a ON a.fact_id = fact_a_id JOIN fd b ON b.fact_id = fact_b_id""")
def q_adjudication_prompts(spark, d):
    f = A.raw_facts(spark, d)
    side = lambda n: f.select(F.struct("fact_id", "doc_id", *relate.SHOWN, "subject", "value_raw", "period_raw").alias(n))
    r = A.relations(spark, d).join(side("a"), F.col("fact_a_id") == F.col("a.fact_id")).join(side("b"), F.col("fact_b_id") == F.col("b.fact_id"))
    r = r.withColumn("signals", F.concat(F.lit("- similarity "), text.decimals(F.col("similarity"), 2)))
    return prompts.with_documents(r, A.documents(spark, d)).select("fact_a_id", "fact_b_id", prompts.adjudication().alias("prompt"))


@query(f"""{WITH_FACTS} SELECT fact_a_id, fact_b_id, CASE relation_type WHEN 'corroborates' THEN 'Corroborates' WHEN 'contradicts' THEN 'Contradicts' WHEN 'reconciled_time' THEN 'Reconciled · time' WHEN 'reconciled_units' THEN 'Reconciled · units' ELSE 'Needs review' END AS label,
similarity::DECIMAL(18, 3)::DECIMAL(18, 2)::VARCHAR AS sim, (round(confidence * 100)::BIGINT) || '%' AS conf, substr(explanation, 1, 10) AS short FROM rels""")
def q_relation_display(spark, d):
    r = A.relations(spark, d)
    return r.select("fact_a_id", "fact_b_id", text.relation_label(F.col("relation_type")).alias("label"), text.decimals(F.col("similarity"), 2).alias("sim"), text.percent(F.col("confidence")).alias("conf"), text.clipped(F.col("explanation"), 10).alias("short"))


@query(f"{WITH_FACTS} SELECT fact_id, subject FROM raw_facts ORDER BY fact_id DESC LIMIT 60")
def q_newest_facts(spark, d):
    return serve.newest(A.raw_facts(spark, d).select("fact_id", "subject"), "fact_id")


# --- ingest ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey || '.PDF' AS filename FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def q_skip_ingested(spark, d):
    name = lambda t, k: A.table(spark, d, t).select(F.concat(F.col(k).cast("string"), F.lit(".PDF")).alias("filename"))
    files = name("orders", "o_orderkey").where(P.is_wanted_file(F.col("filename")))
    return store.not_yet_ingested(files, name("documents", "doc_id")).select("filename")


@query(f"{WITH_FACTS} SELECT doc_id, filename FROM docs WHERE doc_id IN (SELECT doc_id FROM raw_facts)")
def q_drop_empty_docs(spark, d):
    return store.kept_documents(A.documents(spark, d), A.raw_facts(spark, d)).select("doc_id", "filename")


@query(f"{WITH_FACTS} SELECT fact_id AS old_id, row_number() OVER (ORDER BY doc_id, page, fact_id) AS fact_id FROM raw_facts")
def q_numbered_facts(spark, d):
    f = A.raw_facts(spark, d).select(F.col("fact_id").alias("old_id"), "doc_id", F.col("page").alias("chunk"), F.col("fact_id").alias("ordinal"))
    return store.numbered_facts(f).select("old_id", F.col("fact_id").cast("long").alias("fact_id"))


@query("""SELECT event_id, '{"event":"' || event_type || '","user":' || user_id || ',"day":"' || strftime(ts, '%Y-%m-%d') || '","note":null}' AS line FROM events""")
def q_events_ndjson(spark, d):
    e = A.table(spark, d, "events")
    body = F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"), F.col("ts").cast("date").alias("day"), F.lit(None).cast("string").alias("note"))
    return e.select("event_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Gemini free-tier quota exhausted for the day' ELSE event_type || ' failed' END AS short, event_id % 3 = 0 OR event_id % 3 = 1 AS transient FROM events""")
def q_errors(spark, d):
    message = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("429 RESOURCE_EXHAUSTED. "), "event_type")).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(" failed\nService Unavailable"))).otherwise(F.concat("event_type", F.lit(" failed\nbad input")))
    return A.table(spark, d, "events").select("event_id", text.short_error(message).alias("short"), text.is_transient(message).alias("transient"))


@query(f"""{REPLAYED} SELECT a_id AS fact_a_id, b_id AS fact_b_id, relation_type, round(s, 6) AS similarity FROM bud WHERE status = 'rule'""")
def q_stream_ingest(spark, d):
    """Documents of vector facts one after the other through the stream; the end state equals the batch."""
    home = shared_home(spark, "stream")
    # One file a document; the stream takes files up by age, so each is made as old as its document's place.
    f = A.vector_facts(spark, d)
    f.withColumn("folder", F.col("doc_id")).repartition("folder").write.partitionBy("folder").parquet(f"{home}/in")
    store.aged(spark, f"{home}/in", "folder")
    s = Store(spark, f"{home}/store")

    def prepare(batch):
        docs = batch.select("doc_id").distinct().withColumn("filename", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).withColumn("title", F.col("filename"))
        return docs, batch.drop("folder")

    ingest_stream(spark, f"{home}/in", f.schema, s, f"{home}/checkpoint", prepare, REPLAY).awaitTermination()
    return s.read("relations").select("fact_a_id", "fact_b_id", "relation_type", F.round("similarity", 6).alias("similarity"))
