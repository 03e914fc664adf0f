"""Prompts for an external model, as Column expressions over documents, chunks and pairs of facts.

A template's {slots} are filled with columns of these names; what a column holds is never read as a template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else, plain_quotes, qualifier_text

CONTEXT = """Say what this document is, from its first pages. Answer in JSON with title, publisher, doc_date, primary_entity (whom
most of its figures describe; not always the publisher), fy_convention (IN for years from April to March, else CY) and
currency_hint. Leave a field empty rather than guess.

PAGES:
{head}
"""

EXTRACTION = """List statements of fact in this excerpt that could be checked, and held against another document.

Document: {title}
Published by: {publisher}
Dated: {doc_date}
Mostly about: {primary_entity}
Fiscal years: {fy_convention}

Answer in JSON: {"facts": [...]}, each with fact_type, subject (by name; resolve words like "we" and "the company"), predicate,
qualifiers (a list of key and value: all that narrows what a figure means), value_raw and period_raw (as printed, empty if
not given), unit_hint, page (the number in the [[page N]] mark above the quote), quote (word for word) and confidence (0 to 1).
Leave out opinions, plans and headings. At most {cap} facts, the weightiest first.

EXCERPT:
{text}
"""

ADJUDICATION = """Two documents make these statements. Say how they relate.

A, from {a_document}, page {a_page}: {a_subject} | {a_predicate} | qualifiers: {a_qualifiers} | value: {a_value} | period: {a_period}
   "{a_quote}"
B, from {b_document}, page {b_page}: {b_subject} | {b_predicate} | qualifiers: {b_qualifiers} | value: {b_value} | period: {b_period}
   "{b_quote}"

Already computed:
{signals}

Answer in JSON with relation_type, explanation and confidence. relation_type is unrelated unless both are the same claim;
corroborates if they agree; reconciled_time, reconciled_units or reconciled_scope if period, unit or scope explains the difference;
contradicts only if period and basis are known to be the same and the values still differ; else needs_review. The explanation
names what decided, with the figures and their sources.
"""


def filled(template: str, slots: dict[str, Column]) -> Column:
    """The template with each {slot} replaced by its column (null: empty); other braces stay."""
    parts = re.split(r"\{(%s)\}" % "|".join(map(re.escape, slots)), template)
    return F.concat(*[F.coalesce(slots[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def context(head: str = "head") -> Column:
    return filled(CONTEXT, {"head": F.col(head)})


def extraction(cap: int = 25, text: str = "text") -> Column:
    names = ("title", "publisher", "doc_date", "primary_entity", "fy_convention")
    return filled(EXTRACTION, {n: F.col(n) for n in names} | {"cap": F.lit(cap), "text": F.col(text)})


def adjudication() -> Column:
    """Of rows with fact structs a and b (with title and filename) and signals."""
    slots = {"signals": F.col("signals")}
    for s in ("a", "b"):
        f = F.col(s)
        slots |= {
            f"{s}_document": or_else(f["title"], f["filename"]), f"{s}_page": f["page"], f"{s}_subject": f["subject"], f"{s}_predicate": f["predicate"],
            f"{s}_qualifiers": qualifier_text(f["qualifiers"], "; "), f"{s}_value": or_else(f["value_raw"], "(non-numeric)"), f"{s}_period": or_else(f["period_raw"], "(not stated)"), f"{s}_quote": plain_quotes(f["source_quote"]),
        }
    return filled(ADJUDICATION, slots)


def with_documents(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs whose fact structs a and b also say title and filename."""
    for s in ("a", "b"):
        names = documents.select(F.col("doc_id").alias("__d"), F.col("title").alias("__t"), F.col("filename").alias("__f"))
        pairs = pairs.join(names, F.col(f"{s}.doc_id") == F.col("__d"), "left")
        pairs = pairs.withColumn(s, F.col(s).withField("title", F.col("__t")).withField("filename", F.col("__f"))).drop("__d", "__t", "__f")
    return pairs
