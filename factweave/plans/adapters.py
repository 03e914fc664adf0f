"""The engine's tables made of the star schema, in Spark and (as CTEs) in DuckDB SQL.

Orders stand for facts, order priorities for documents, lines of documents for pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantity, text
from ..operators.facts import with_period
from ..sources import pages as P

#: Raw quantities and periods that exercise every branch, with unit hints and conventions.
QUANTITIES = [
    ("₹8,142 crore", None), ("Rs. 2,194.5 crore", None), ("1.5 lakh", None), ("$3.2 billion", None), ("USD 450 million", None), ("US$ 1.2 bn", None), ("6.5%", None), ("6.5 per cent", None),
    ("650 bps", None), ("25 basis points", None), ("8,142.5", None), ("₹(452) Cr", None), ("Rs. (1,008) crore", None), ("(6.3%)", None), ("384K Tons", None), ("₹127Cr", None), ("₹8,142 Cr (1)", None),
    ("2,194", "(₹ in millions)"), ("2,194 crore", "(₹ in millions)"), ("FY24 revenue 500", None), ("Rs 100 crore, up 12%", None), ("2 lakh crore", None), ("(-452)", None), ("-(452)", None), ("no figure", None),
    ("€ unknown", None), ("12", "(in %)"), ("3 hundred", None), ("4 trillion dollars", None), ("£7 mn", None), ("gbp 9 tn", None), ("12 (3)", None), ("+5 lacs", None), ("5 pp", None), ("", None), (None, None),
]
PERIODS = [
    ("FY24", "IN"), ("FY2023-24", "IN"), ("FY 2024-25", "IN"), ("2024-25", "IN"), ("FY2024/25", "IN"), ("the first quarter of FY2025/26", "IN"), ("Q4 FY24", "IN"), ("Q1 FY24", "IN"), ("H1 FY25", "IN"), ("H2 FY25", "IN"),
    ("CY2024", "IN"), ("as at 31 March 2024", "IN"), ("March 31, 2024", "IN"), ("31.03.2024", "IN"), ("31/03/2024", "IN"), ("March 2024", "IN"), ("during the period under review", "IN"), ("", "IN"), (None, "IN"),
    ("FY23-24", "IN"), ("H1 FY2024-25", "IN"), ("H1 FY25", "CY"), ("FY1998-99", "IN"), ("1998-99", "IN"), ("FY2023-2025", "IN"), ("2024-03-31", "IN"), ("2011-12-31", "IN"), ("10 marketing 2024", "IN"), ("31.02.2024", "IN"),
    ("31 Feb 2024", "IN"), ("year ended March 31, 2024", "IN"), ("FY24", "CY"), ("Q3 fy 2022", "CY"), ("fiscal year 2021", "IN"), ("calendar year 2019", "IN"), ("in 1987", "IN"), ("Q2", "IN"), ("FY2024–25", "IN"), ("FY2023-204", "IN"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, samples: list[tuple], kind: str) -> DataFrame:
    """A sample for each order, in turn, and another one (a, b), so that all pairs of samples come up."""
    k, n = F.col("o_orderkey"), len(samples)
    rows = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for x, c in zip(r, ("raw", kind), strict=True)]) for r in samples])
    dealt = table(spark, sf_dir, "orders").select(k.alias("id"), F.element_at(rows, (k % n + 1).cast("int")).alias("a"), F.element_at(rows, (F.expr(f"o_orderkey div {n}") % n + 1).cast("int")).alias("b"))
    return dealt.select("id", "a.*", F.col("b.raw").alias("other_raw"), F.col(f"b.{kind}").alias(f"other_{kind}"))


def quantity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, QUANTITIES, "hint")


def period_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, PERIODS, "convention")


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with raw values and periods, before parsing."""
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    value = F.when(k % 5 == 0, F.concat(F.lit("$"), money)).when(k % 5 == 1, F.concat(F.lit("₹"), money, F.lit(" crore"))).when(k % 5 == 2, F.concat((F.col("o_custkey") % 3).cast("string"), F.lit(".5%"))).when(k % 5 == 3, money).otherwise(F.concat(F.lit("Rs. ("), money, F.lit(") lakh")))
    fiscal = F.year(day) + F.when(F.month(day) >= 4, 1).otherwise(0)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    when = (
        F.when(k % 6 == 0, F.concat(F.lit("FY"), two(fiscal))).when(k % 6 == 1, F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" FY"), fiscal.cast("string")))
        .when(k % 6 == 2, F.concat(F.lit("31 March "), F.year(day).cast("string"))).when(k % 6 == 3, F.date_format(day, "MMMM yyyy"))
        .when(k % 6 == 4, F.concat((fiscal - 1).cast("string"), F.lit("-"), two(fiscal))).otherwise(F.concat(F.lit("CY"), F.year(day).cast("string")))
    )
    kind = F.when(F.col("o_orderstatus") == "F", "financial").when(F.col("o_orderstatus") == "O", "operational").otherwise("guidance")
    state = F.when(k % 7 == 0, "unverified").when(k % 7 <= 2, "reflowed").otherwise("verbatim")
    return d.select(
        k.alias("fact_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("doc_id"), (k % 40 + 1).cast("int").alias("page"), kind.alias("fact_type"), F.col("c_mktsegment").alias("subject"),
        F.lit("order total").alias("predicate"), F.array(F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("value"))).alias("qualifiers"), value.alias("value_raw"), when.alias("period_raw"),
        F.concat(F.col("c_name"), F.lit(" ordered "), money).alias("source_quote"), (k % 7 != 0).alias("quote_verified"), F.round((k % 100) / 100, 2).alias("quote_score"), state.alias("grounding"), F.round((k % 20) / 20, 2).alias("confidence"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(raw_facts(spark, sf_dir))


def parsed(d: DataFrame) -> DataFrame:
    d = d.withColumn("claim_key", text.claim_key(F.col("subject"), F.col("predicate"), F.col("qualifiers")))
    d = with_period(d.withColumn("q", quantity.parse_quantity(F.col("value_raw"))), "p")
    names = {"value_num": "q.value", "unit": "q.unit", "dimension": "q.dimension", "period_start": "p.start", "period_end": "p.end", "period_kind": "p.kind"}
    return d.withColumns({k: F.col(v) for k, v in names.items()}).drop("q", "p")


def vector_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the vector of the same id, in the document named by its label; every other one is a
    percentage of a fiscal year, so that some agree."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("label").cast("long").alias("label"), "embedding")
    k = F.col("fact_id")
    raw = raw_facts(spark, sf_dir)
    raw = raw.withColumns({"value_raw": F.when(k % 2 == 0, F.concat((k % 3).cast("string"), F.lit(".5%"))).otherwise(F.col("value_raw")), "period_raw": F.when(k % 2 == 0, F.concat(F.lit("FY2"), (k % 5).cast("string"))).otherwise(F.col("period_raw"))})
    return parsed(raw.join(v, "fact_id")).withColumn("doc_id", F.col("label")).drop("label").withColumn("quote_verified", F.lit(True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a priority; 3 has no title; 6 has no facts."""
    own = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().unionByName(spark.createDataFrame([("6-EMPTY",)], "o_orderpriority string"))
    k = F.substring("o_orderpriority", 1, 1).cast("long")
    publisher = F.when(k % 2 == 1, "building").otherwise("Automobile")
    return own.select(k.alias("doc_id"), F.concat(F.lower("o_orderpriority"), F.lit(".pdf")).alias("filename"), F.when(k != 3, F.col("o_orderpriority")).alias("title"), publisher.alias("publisher"), F.lit("2024-03-31").alias("doc_date"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    types = F.array(*[F.lit(t) for t in ("corroborates", "contradicts", "reconciled_time", "reconciled_units", "needs_review")])
    return table(spark, sf_dir, "orders").select(k.alias("fact_a_id"), (k + 7).alias("fact_b_id"), F.element_at(types, (k % 5 + 1).cast("int")).alias("relation_type"), F.when(k % 3 == 0, "rule").otherwise("llm").alias("decided_by"), F.concat(F.lit("because "), k.cast("string")).alias("explanation"), F.round((k % 1000) / 1000, 3).alias("similarity"), F.round((k % 20) / 20, 2).alias("confidence"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages; every third page has a table text."""
    p = P.pages_of_lines(table(spark, sf_dir, "documents"))
    p = p.withColumn("tables_text", F.when(F.col("page") % 3 == 0, F.concat(F.lit("TABLE:\nrow | "), F.col("page").cast("string"))).otherwise(""))
    return p.withColumn("combined", P.combined(F.col("text"), F.col("tables_text")))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote for each page: a part of it as it stands, its words turned round, a part with an invented number, or
    words of no page."""
    p = pages(spark, sf_dir).select("doc_id", "page", "text", "combined")
    words = F.slice(F.split("text", " "), 1, 12)
    k = (F.col("doc_id") + F.col("page")) % 4
    quote = F.when(k == 0, F.substring("text", 3, 50)).when(k == 1, F.array_join(F.reverse(words), " ")).when(k == 2, F.concat(F.substring("text", 3, 40), F.lit(" 98765"))).otherwise(F.lit("Entirely different wording about nothing on that page"))
    p = p.select((F.col("doc_id") * 1000000 + F.col("page")).alias("fact_id"), "doc_id", "page", quote.alias("quote"), F.col("combined").alias("page_text"))
    return p.repartition(2 * spark.sparkContext.defaultParallelism, "fact_id")  # the fuzzy test costs far more than a shuffle


# --- the same in DuckDB SQL, as CTEs -------------------------------------------------------------

FACTS_RAW = """raw_facts AS (SELECT o_orderkey AS fact_id, substr(o_orderpriority, 1, 1)::BIGINT AS doc_id, (o_orderkey % 40 + 1)::INT AS page,
  CASE o_orderstatus WHEN 'F' THEN 'financial' WHEN 'O' THEN 'operational' ELSE 'guidance' END AS fact_type, c_mktsegment AS subject, 'order total' AS predicate, o_orderstatus AS status,
  CASE o_orderkey % 5 WHEN 0 THEN '$' || money WHEN 1 THEN '₹' || money || ' crore' WHEN 2 THEN (o_custkey % 3) || '.5%' WHEN 3 THEN money ELSE 'Rs. (' || money || ') lakh' END AS value_raw,
  CASE o_orderkey % 6 WHEN 0 THEN 'FY' || printf('%02d', fy % 100) WHEN 1 THEN 'Q' || quarter(o_orderdate) || ' FY' || fy WHEN 2 THEN '31 March ' || year(o_orderdate) WHEN 3 THEN strftime(o_orderdate, '%B %Y')
    WHEN 4 THEN (fy - 1) || '-' || printf('%02d', fy % 100) ELSE 'CY' || year(o_orderdate) END AS period_raw,
  c_name || ' ordered ' || money AS source_quote, o_orderkey % 7 <> 0 AS quote_verified, round((o_orderkey % 100) / 100.0::DOUBLE, 2) AS quote_score,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unverified' WHEN o_orderkey % 7 <= 2 THEN 'reflowed' ELSE 'verbatim' END AS grounding, round((o_orderkey % 20) / 20.0::DOUBLE, 2) AS confidence
  FROM (SELECT *, o_totalprice::DECIMAL(18,2)::VARCHAR AS money, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy FROM orders) o JOIN customer ON o_custkey = c_custkey)"""

DOCUMENTS = """docs AS (SELECT substr(p, 1, 1)::BIGINT AS doc_id, lower(p) || '.pdf' AS filename, CASE WHEN substr(p, 1, 1) <> '3' THEN p END AS title,
  CASE WHEN substr(p, 1, 1)::INT % 2 = 1 THEN 'building' ELSE 'Automobile' END AS publisher, '2024-03-31' AS doc_date FROM (SELECT DISTINCT o_orderpriority AS p FROM orders UNION ALL SELECT '6-EMPTY'))"""

RELATIONS = """rels AS (SELECT o_orderkey AS fact_a_id, o_orderkey + 7 AS fact_b_id, ['corroborates', 'contradicts', 'reconciled_time', 'reconciled_units', 'needs_review'][(o_orderkey % 5 + 1)::INT] AS relation_type,
  CASE WHEN o_orderkey % 3 = 0 THEN 'rule' ELSE 'llm' END AS decided_by, 'because ' || o_orderkey AS explanation, round((o_orderkey % 1000) / 1000.0::DOUBLE, 3) AS similarity, round((o_orderkey % 20) / 20.0::DOUBLE, 2) AS confidence
  FROM orders)"""

PAGES = """pg AS (SELECT doc_id, page, text, tables_text, coalesce(text, '') || CASE WHEN tables_text <> '' THEN chr(10) || tables_text ELSE '' END AS combined FROM (
  SELECT doc_id, page::INT AS page, text, CASE WHEN page % 3 = 0 THEN 'TABLE:' || chr(10) || 'row | ' || page ELSE '' END AS tables_text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)))"""

QUOTES = """quotes AS (SELECT doc_id * 1000000 + page AS fact_id, doc_id, page, CASE (doc_id + page) % 4 WHEN 0 THEN substr(text, 3, 50) WHEN 1 THEN array_to_string(list_reverse(string_split(text, ' ')[1:12]), ' ') WHEN 2 THEN substr(text, 3, 40) || ' 98765'
  ELSE 'Entirely different wording about nothing on that page' END AS quote, combined AS page_text FROM pg)"""


def dealt(rows: list[tuple], kind: str) -> str:
    """A CTE body: a sample for each order, in turn, and another."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    n, lists = len(rows), [f"([{', '.join(quote(r[i]) for r in rows)}])" for i in (0, 1)]
    first, second = "(o_orderkey % {0} + 1)::INT", "((o_orderkey // {0}) % {0} + 1)::INT"
    own, other = ([f"{x}[{at.format(n)}]" for x in lists] for at in (first, second))
    return f"SELECT o_orderkey AS id, {own[0]} AS raw, {own[1]} AS {kind}, {other[0]} AS other_raw, {other[1]} AS other_{kind} FROM orders"
