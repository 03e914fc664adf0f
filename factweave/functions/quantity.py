"""Human-written quantities as Column expressions (no Python on the executors)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words.
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6, "mln": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12,
}
#: Currency tokens in order of precedence.
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD",
    "dollars": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}
SYMBOLS = ("₹", "$", "€", "£")
NUMBER = r"[-+]?\d[\d,]*\.?\d*"
GAP = r"[\s\p{Z}]*"
#: The first number stands in a bracket that holds no other one: accounting notation for a negative.
BRACKETED = r"^[^0-9]*\([^()0-9]*[-+]?\d[\d,]*\.?\d*[^()]*\)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def first_of(tests: list[tuple[Column, object]]) -> Column:
    """The value of the first test that holds, else null."""
    return reduce(lambda chain, t: chain.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body names it. Plans of long cascades stay
    small this way; written out, they'd repeat each regular expression in every branch."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _alone(low: Column, word: str) -> Column:
    return low.rlike(rf"(?<![a-z])\Q{word}\E(?![a-z])")


def currency_of(low: Column) -> Column:
    return first_of([(low.contains(t) if t in SYMBOLS else _alone(low, t), code) for t, code in CURRENCIES.items()])


def scale_of(low: Column) -> Column:
    """The longest scale word decides; null where there is none."""
    return first_of([(low.rlike(rf"(?<![a-z]){w}s?(?![a-z])"), SCALES[w]) for w in sorted(SCALES, key=len, reverse=True)])


def to_number(text: Column) -> Column:
    return F.regexp_replace(text, "[,+]", "").try_cast("double")


def sign_of(low: Column) -> Column:
    return F.when(low.rlike(BRACKETED), -1.0).otherwise(1.0)


def parse_unit_hint(hint: Column) -> Column:
    """struct(currency, scale) of a table header such as '(₹ in crore)'."""
    low = F.lower(F.coalesce(hint, F.lit("")))
    return F.struct(currency_of(low).alias("currency"), scale_of(low).alias("scale"))


def parse_quantity(raw: Column, unit_hint: Column | None = None) -> Column:
    """struct(value, unit, dimension, raw). Basis points come before percent, percent before currency
    and scale; the first number counts; a hint only fills in what the text doesn't say."""
    points = rf"({NUMBER}){GAP}(?:bps|basis points?)"
    percent = rf"({NUMBER}){GAP}(?:%|(?:per{GAP}cent|percent|percentage{GAP}points?|pp)\b)"
    hint = parse_unit_hint(unit_hint if unit_hint is not None else F.lit(None).cast("string"))

    def parts(text: Column) -> Column:
        low = F.lower(text)
        found = {
            "text": text, "sign": sign_of(low), "points": F.regexp_extract(low, points, 1), "percent": F.regexp_extract(low, percent, 1),
            "number": to_number(F.regexp_extract(low, NUMBER, 0)), "currency": currency_of(low), "scale": F.coalesce(scale_of(low), F.lit(1.0)), "hint": hint,
        }
        return F.struct(*[c.alias(k) for k, c in found.items()])

    def decide(p: Column) -> Column:
        number = p["number"] * p["sign"]
        scale = F.when(p["scale"] == 1.0, F.coalesce(p["hint"]["scale"], F.lit(1.0))).otherwise(p["scale"])
        currency = F.when(number.isNull(), p["currency"]).otherwise(F.coalesce(p["currency"], p["hint"]["currency"]))
        is_points, is_ratio = p["points"] != "", (p["points"] != "") | (p["percent"] != "")
        value = F.when(is_points, to_number(p["points"]) / 100 * p["sign"]).when(is_ratio, to_number(p["percent"]) * p["sign"]).otherwise(number * scale)
        unit = F.when(is_ratio, "percent").otherwise(currency)
        kind = F.when(is_ratio, "ratio").when(currency.isNotNull(), "currency").when(number.isNotNull(), "count")
        return F.struct(value.alias("value"), unit.alias("unit"), kind.alias("dimension"), F.coalesce(p["text"], F.lit("")).alias("raw"))

    return let(let(stripped(raw), parts), decide)


def comparability(a: Column, b: Column) -> Column:
    """comparable, or why not: missing_value, different_dimension, different_currency."""
    return (
        F.when(a["value"].isNull() | b["value"].isNull(), "missing_value")
        .when(~a["dimension"].eqNullSafe(b["dimension"]), "different_dimension")
        .when((a["dimension"] == "currency") & ~a["unit"].eqNullSafe(b["unit"]), "different_currency")
        .otherwise("comparable")
    )


def values_agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    largest = F.greatest(F.abs(a["value"]), F.abs(b["value"]))
    close = (a["value"] == b["value"]) | (F.try_divide(F.abs(a["value"] - b["value"]), largest) <= tolerance)
    return F.coalesce((comparability(a, b) == "comparable") & close, F.lit(False))
