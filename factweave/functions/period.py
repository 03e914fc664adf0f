"""Fiscal and calendar periods as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantity import let, stripped

#: Month prefixes and ordinals in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ORDINALS = ["first", "second", "third", "fourth"]
#: The forms of periods.
FISCAL = r"(?:fy|fiscal(?:\s+year)?)"
QUARTER = r"\bq([1-4])(?:\b|\s*fy)"
QUARTER_WORD = r"\b(first|second|third|fourth)\s+quarter\b"
SPAN_MAYBE_FISCAL = rf"{FISCAL}?\s*'?(\d{{4}})\s*[-/]\s*'?(\d{{2,4}})"
SPAN_FISCAL = rf"{FISCAL}\s*'?(\d{{4}})\s*[-/]\s*'?(\d{{2,4}})"
SHORT_FISCAL = rf"{FISCAL}\s*'?(\d{{2,4}})\b"
HALF = r"h([12])\s*[,\-]?\s*fy\s*'?(\d{2,4})"
BARE_SPAN = r"\b(\d{4})\s*[-/]\s*(\d{2,4})\b"
DAY_NUMERIC = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
DAY_MONTH = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+(\d{4})\b"
MONTH_DAY = r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
MONTH_YEAR = r"\b([a-z]{3,9})\s+(\d{4})\b"
CALENDAR = r"(?:cy|calendar\s+year)\s*'?(\d{2,4})\b"
BARE_YEAR = r"\b(?:19|20)\d{2}\b"


def _day(y: Column, m: Column | int, d: Column | int) -> Column:
    """The date, or null where there is no such day."""
    m, d = (x if isinstance(x, Column) else F.lit(x) for x in (m, d))
    return F.when(y.between(1, 9999), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


def _full_year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def _span_end(start: Column, tail: Column) -> Column:
    """End year of '2023-24' (century of the start) or '2023-2024'."""
    return F.when(F.length(tail) == 2, F.concat(F.substring(start, 1, 2), tail)).otherwise(tail).try_cast("int")


def parse_period(raw: Column, convention: Column | str = "IN") -> Column:
    """struct(start, end, raw, kind). Days that don't exist give kind unknown."""
    convention = convention if isinstance(convention, Column) else F.lit(convention)

    def parts(text: Column) -> Column:
        low = F.translate(F.lower(text), "–—", "--")
        part = lambda pattern, g: F.regexp_extract(low, pattern, g)
        year = lambda pattern, g: part(pattern, g).try_cast("int")
        month = lambda pattern, g: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part(pattern, g), 1, 3)).cast("int")
        ordinal = F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS)), part(QUARTER_WORD, 1)).cast("int"), F.lit(0))
        found = {
            "text": text, "cy": convention == "CY", "quarter": F.coalesce(year(QUARTER, 1), ordinal), "loose1": part(SPAN_MAYBE_FISCAL, 1), "loose2": part(SPAN_MAYBE_FISCAL, 2),
            "half": part(HALF, 1), "half_y": year(HALF, 2), "span1": part(SPAN_FISCAL, 1), "span2": part(SPAN_FISCAL, 2), "short": year(SHORT_FISCAL, 1), "bare1": part(BARE_SPAN, 1), "bare2": part(BARE_SPAN, 2),
            "n_d": year(DAY_NUMERIC, 1), "n_m": year(DAY_NUMERIC, 2), "n_y": year(DAY_NUMERIC, 3), "d_d": year(DAY_MONTH, 1), "d_m": month(DAY_MONTH, 2), "d_y": year(DAY_MONTH, 3),
            "m_m": month(MONTH_DAY, 1), "m_d": year(MONTH_DAY, 2), "m_y": year(MONTH_DAY, 3), "my_m": month(MONTH_YEAR, 1), "my_y": year(MONTH_YEAR, 2), "calendar": year(CALENDAR, 1), "year": year(BARE_YEAR, 0),
        }
        return F.struct(*[c.alias(k) for k, c in found.items()])

    def kind(p: Column) -> Column:
        """The first form that fits, and the year it speaks of."""
        bare1, bare2 = p["bare1"].try_cast("int"), _span_end(p["bare1"], p["bare2"])
        loose = _span_end(p["loose1"], p["loose2"])
        tail = _full_year(p["span2"].try_cast("int"))
        whole = F.concat(F.substring(p["span1"], 1, 2), p["span2"]).try_cast("int")
        forms = [
            (p["quarter"].isNotNull(), "quarter", F.when(loose == p["loose1"].try_cast("int") + 1, loose).otherwise(_full_year(p["short"]))),
            (p["half"] != "", "half", _full_year(p["half_y"])),
            (p["span1"] != "", "fy", F.when(tail < p["span1"].try_cast("int"), whole).otherwise(tail)),
            (p["short"].isNotNull(), "fy", _full_year(p["short"])),
            ((bare1 > 1900) & (bare1 < 2100) & (bare2 == bare1 + 1), "fy", bare2),
            (p["n_m"].between(1, 12) & p["n_d"].between(1, 31), "numeric", p["n_y"]),
            (p["d_m"] > 0, "day month", p["d_y"]),
            (p["m_m"] > 0, "month day", p["m_y"]),
            (p["my_m"] > 0, "month", p["my_y"]),
            (p["calendar"].isNotNull(), "calendar", _full_year(p["calendar"])),
            (p["year"].isNotNull(), "calendar", p["year"]),
        ]
        of = lambda name, y: F.struct(F.lit(name).alias("form"), y.cast("int").alias("y"), p.alias("p"))
        chain = F.when(F.coalesce(p["text"], F.lit("")) == "", of("unknown", F.lit(None)))
        for test, name, y in forms:
            chain = chain.when(test, of(name, y))
        return chain.otherwise(of("unknown", F.lit(None)))

    def bounds(k: Column) -> Column:
        form, y, p = k["form"], k["y"], k["p"]
        first_year = F.when(p["cy"], y).otherwise(y - 1)
        begin = F.when(p["cy"], _day(y, 1, 1)).otherwise(_day(y - 1, 4, 1))
        quarter = F.add_months(begin, 3 * (p["quarter"] - 1))
        day = F.when(form == "numeric", _day(y, p["n_m"], p["n_d"])).when(form == "day month", _day(y, p["d_m"], p["d_d"])).when(form == "month day", _day(y, p["m_m"], p["m_d"]))
        month = _day(y, p["my_m"], 1)
        fiscal_end = F.when(p["cy"], _day(y, 12, 31)).otherwise(_day(y, 3, 31))
        first_half = p["half"] == "1"
        start = F.when(form == "quarter", quarter).when(form == "half", F.when(first_half, begin).otherwise(_day(first_year, 10, 1))).when(form == "fy", begin).when(form == "month", month).when(form == "calendar", _day(y, 1, 1)).otherwise(day)
        end = F.when(form == "quarter", F.last_day(F.add_months(quarter, 2))).when(form == "half", F.when(first_half, _day(first_year, 9, 30)).otherwise(fiscal_end)).when(form == "fy", fiscal_end).when(form == "month", F.last_day(month)).when(form == "calendar", _day(y, 12, 31)).otherwise(day)
        name = F.when(form.isin("numeric", "day month", "month day"), "instant").otherwise(form)
        return F.struct(start.alias("start"), end.alias("end"), F.coalesce(p["text"], F.lit("")).alias("raw"), name.alias("kind"))

    def checked(r: Column) -> Column:
        both = r["start"].isNotNull() & r["end"].isNotNull()
        return F.struct(F.when(both, r["start"]).alias("start"), F.when(both, r["end"]).alias("end"), r["raw"].alias("raw"), F.when(both, r["kind"]).otherwise("unknown").alias("kind"))

    return let(let(let(let(stripped(raw), parts), kind), bounds), checked)


def periods_relation(a: Column, b: Column) -> Column:
    """equal, overlap, disjoint or unknown, of closed intervals; kinds don't matter."""
    a_end, b_end = F.coalesce(a["end"], a["start"]), F.coalesce(b["end"], b["start"])
    return (
        F.when(a["start"].isNull() | b["start"].isNull(), "unknown")
        .when((a["start"] == b["start"]) & (a_end == b_end), "equal")
        .when((a["start"] <= b_end) & (b["start"] <= a_end), "overlap")
        .otherwise("disjoint")
    )
