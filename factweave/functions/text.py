"""Text helpers: canonical form, tokens, keys, messages, display formats."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _nfkc(col: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in col.to_pylist()], pa.string())


def canon(text: Column, compatibility: bool = True) -> Column:
    """Quotes and dashes made plain, white space collapsed, lower case; NFKC first unless told not to.
    ASCII texts, for which NFKC does nothing, never reach Python."""
    text = F.coalesce(text, F.lit(""))
    if compatibility:
        text = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))
    plain = F.translate(text, "’‘“”–—−", "''\"\"---")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def numbers(text: Column) -> Column:
    """Distinct numbers, without thousands separators and trailing points."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.rtrim(F.replace(t, F.lit(","), F.lit("")), F.lit("."))))


def long_words(text: Column) -> Column:
    """Distinct runs of at least three ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)))


def numbers_present(quote_numbers: Column, page_numbers: Column) -> Column:
    return F.size(F.array_except(quote_numbers, page_numbers)) == 0


def word_coverage(quote_words: Column, page_words: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(quote_words, page_words)), F.size(quote_words)), F.lit(0.0))


def or_else(value: Column, default: Column | str) -> Column:
    """Null and empty text give way to the default."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def _pairs(qualifiers: Column, between: str) -> Column:
    return F.array_join(F.transform(qualifiers, lambda q: F.concat(F.coalesce(q["key"], F.lit("None")), F.lit("="), F.coalesce(q["value"], F.lit("None")))), between)


def claim_key(subject: Column, predicate: Column, qualifiers: Column) -> Column:
    """What a fact is about, without its value."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.trim(F.concat_ws(" | ", blank(subject), blank(predicate), blank(_pairs(qualifiers, " "))))


def qualifier_text(qualifiers: Column, between: str = ", ") -> Column:
    return or_else(_pairs(qualifiers, between), "none")


def qualifiers_from_json(text: Column) -> Column:
    """Bad JSON gives an empty list; null and empty text stay as null."""
    kind = "array<struct<key:string,value:string>>"
    return F.when(F.nullif(text, F.lit("")).isNotNull(), F.coalesce(F.from_json(text, kind), F.array().cast(kind)))


def short_error(message: Column) -> Column:
    """One line for people: the fixed quota sentence, or the first line cut at 160."""
    quota = message.contains("RESOURCE_EXHAUSTED") | message.contains("429") | F.lower(message).contains("quota")
    return F.when(quota, "Gemini free-tier quota exhausted for the day").otherwise(F.substring(F.element_at(F.split(message, r"\r\n|\n|\r"), 1), 1, 160))


def is_transient(message: Column) -> Column:
    return F.lower(message).rlike("429|rate|quota|503|500|unavailable|timeout|deadline")


def like_any(columns: list[Column], term: str) -> Column:
    """Case-insensitive LIKE '%term%' in any column; % and _ of the term are wildcards, a backslash is itself."""
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    out = columns[0].ilike(pattern)
    for c in columns[1:]:
        out = out | c.ilike(pattern)
    return out


#: Names of relation types for readers; other types read like the last.
RELATION_LABELS = {
    "corroborates": "Corroborates", "contradicts": "Contradicts", "reconciled_time": "Reconciled · time", "reconciled_units": "Reconciled · units", "reconciled_scope": "Reconciled · scope", "needs_review": "Needs review",
}


def relation_label(relation_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RELATION_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, relation_type), F.lit(RELATION_LABELS["needs_review"]))


def clipped(text: Column, n: int) -> Column:
    """The first n characters; null is empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def decimals(x: Column, places: int) -> Column:
    """Rounded half up, by the number's decimal notation."""
    return F.format_string(f"%.{places}f", x.cast("double"))


def percent(x: Column) -> Column:
    """A share as a whole percent."""
    return F.concat(F.round(x * 100).cast("long").cast("string"), F.lit("%"))


def plain_quotes(text: Column) -> Column:
    """Double quotes made single, for text that stands between double quotes."""
    return F.translate(F.coalesce(text, F.lit("")), '"', "'")
