"""DuckDB SQL of the parsing functions, written apart from the Spark expressions (RE2 has no look-around)."""

from __future__ import annotations

import re

#: Fixed values, written down here once more so that a wrong entry of the tables under test shows: scale words, and
#: currency tokens in order of precedence (symbols count wherever they stand).
SCALE_WORDS = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6, "mln": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12,
}
TOKENS = {
    "INR": ["₹", "rs", "rs.", "inr", "rupee", "rupees"], "USD": ["$", "us$", "usd", "dollar", "dollars"], "EUR": ["€", "eur"], "GBP": ["£", "gbp"],
}

N = r"[-+]?\d[\d,]*\.?\d*"
_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def _word(low: str, w: str, tail: str = "") -> str:
    return rf"regexp_matches({low}, '(^|[^a-z]){w.replace('.', chr(92) + '.').replace('$', chr(92) + '$')}{tail}($|[^a-z])')"


def currency(low: str) -> str:
    tests = [f"WHEN {f'contains({low}, {chr(39)}{t}{chr(39)})' if t in '₹$€£' else _word(low, t)} THEN '{c}'" for c, tokens in TOKENS.items() for t in tokens]
    return f"CASE {' '.join(tests)} END"


def scale(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {_word(low, w, 's?')} THEN {SCALE_WORDS[w]!r}::DOUBLE" for w in sorted(SCALE_WORDS, key=len, reverse=True)) + " END"


def _num(e: str) -> str:
    return f"TRY_CAST(regexp_replace({e}, '[,+]', '', 'g') AS DOUBLE)"


def quantity(source: str, hint: str = "NULL::VARCHAR") -> str:
    """CTE q: source's columns (raw among them) with value, unit, dimension."""
    bps, pct = rf"'({N})\s*(?:bps|basis points?)'", rf"'({N})\s*(?:%|(?:per\s*cent|percent|percentage\s*points?|pp)\b)'"
    return f"""q0 AS (SELECT *, lower(trim(raw)) AS low, lower(coalesce({hint}, '')) AS hl FROM {source}),
q1 AS (SELECT *, CASE WHEN regexp_matches(low, '^[^0-9]*\\([^()0-9]*[-+]?\\d[\\d,]*\\.?\\d*[^()]*\\)') THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn, {currency('low')} AS cur, {scale('low')} AS sc, {currency('hl')} AS hc, {scale('hl')} AS hs,
  {_num(f"regexp_extract(low, '{N}')")} AS num, regexp_matches(low, {bps}) AS isb, regexp_matches(low, {pct}) AS isp, {_num(f"regexp_extract(low, {bps}, 1)")} AS vb, {_num(f"regexp_extract(low, {pct}, 1)")} AS vp FROM q0),
q AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN isb THEN vb / 100 * sgn WHEN isp THEN vp * sgn ELSE num * sgn * CASE WHEN coalesce(sc, 1) = 1 THEN coalesce(hs, 1) ELSE sc END END AS value,
  CASE WHEN raw IS NULL THEN NULL WHEN isb OR isp THEN 'percent' WHEN num IS NULL THEN cur ELSE coalesce(cur, hc) END AS unit,
  CASE WHEN raw IS NULL THEN NULL WHEN isb OR isp THEN 'ratio' WHEN num IS NULL THEN CASE WHEN cur IS NOT NULL THEN 'currency' END WHEN coalesce(cur, hc) IS NOT NULL THEN 'currency' ELSE 'count' END AS dimension FROM q1)"""


def _date(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 1 AND 9999 THEN TRY_CAST(printf('%04d-%02d-%02d', ({y})::INT, ({m})::INT, ({d})::INT) AS DATE) END"


def period(source: str, convention: str = "'IN'") -> str:
    """CTE p: source's columns (raw among them) with start, end_, kind."""
    f = r"(?:fy|fiscal(?:\s+year)?)"
    ex = lambda p, g: f"regexp_extract(plow, '{p}', {g})"
    num = lambda p, g: f"TRY_CAST({ex(p, g)} AS INT)"
    full = lambda e: f"CASE WHEN {e} < 100 THEN {e} + 2000 ELSE {e} END"
    span, fspan, short, half = rf"{f}?\s*''?(\d{{4}})\s*[-/]\s*''?(\d{{2,4}})", rf"{f}\s*''?(\d{{4}})\s*[-/]\s*''?(\d{{2,4}})", rf"{f}\s*''?(\d{{2,4}})\b", r"h([12])\s*[,\-]?\s*fy\s*''?(\d{2,4})"
    bare, dn, dm, md, my, cy = r"\b(\d{4})\s*[-/]\s*(\d{2,4})\b", r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b", r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+(\d{4})\b", r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b", r"\b([a-z]{3,9})\s+(\d{4})\b", r"(?:cy|calendar\s+year)\s*''?(\d{2,4})\b"
    mon = lambda p, g: f"coalesce(list_position({_MONTHS}, substr({ex(p, g)}, 1, 3)), 0)"
    cat = lambda p: f"TRY_CAST(CASE WHEN length({ex(p, 2)}) = 2 THEN substr({ex(p, 1)}, 1, 2) || {ex(p, 2)} ELSE {ex(p, 2)} END AS INT)"
    fs = lambda y: f"CASE WHEN {convention} = 'CY' THEN {_date(y, '1', '1')} ELSE {_date(f'{y} - 1', '4', '1')} END"
    fe = lambda y: f"CASE WHEN {convention} = 'CY' THEN {_date(y, '12', '31')} ELSE {_date(y, '3', '31')} END"
    return f"""p0 AS (SELECT *, translate(lower(trim(raw)), '–—', '--') AS plow FROM {source}),
p1 AS (SELECT *, coalesce({num(r'\bq([1-4])(?:\b|\s*fy)', 1)}, nullif(coalesce(list_position(['first','second','third','fourth'], {ex(r'\b(first|second|third|fourth)\s+quarter\b', 1)}), 0), 0)) AS qn,
  CASE WHEN {cat(span)} = {num(span, 1)} + 1 THEN {cat(span)} ELSE {full(num(short, 1))} END AS qy, {ex(half, 1)} AS hn, {full(num(half, 2))} AS hy,
  regexp_matches(plow, '{fspan}') AS isf, CASE WHEN {full(num(fspan, 2))} < {num(fspan, 1)} THEN TRY_CAST(substr({ex(fspan, 1)}, 1, 2) || {ex(fspan, 2)} AS INT) ELSE {full(num(fspan, 2))} END AS fy,
  regexp_matches(plow, '{short}') AS iss, {full(num(short, 1))} AS sy, {num(bare, 1)} AS b1, {cat(bare)} AS b2,
  {num(dn, 1)} AS n1, {num(dn, 2)} AS n2, {num(dn, 3)} AS n3, {num(dm, 1)} AS m1, {mon(dm, 2)} AS m2, {num(dm, 3)} AS m3, {mon(md, 1)} AS k1, {num(md, 2)} AS k2, {num(md, 3)} AS k3,
  {mon(my, 1)} AS y1, {num(my, 2)} AS y2, {full(num(cy, 1))} AS cy, {num(r'\b(?:19|20)\d{2}\b', 0)} AS yr FROM p0),
p2 AS (SELECT *, CASE WHEN coalesce(raw, '') = '' THEN 'unknown' WHEN qn IS NOT NULL THEN 'quarter' WHEN hn <> '' THEN 'half' WHEN isf OR iss OR (b1 > 1900 AND b1 < 2100 AND b2 = b1 + 1) THEN 'fy'
  WHEN (n2 BETWEEN 1 AND 12 AND n1 BETWEEN 1 AND 31) OR m2 > 0 OR k1 > 0 THEN 'instant' WHEN y1 > 0 THEN 'month' WHEN cy IS NOT NULL OR yr IS NOT NULL THEN 'calendar' ELSE 'unknown' END AS k0,
  CASE WHEN isf THEN fy WHEN iss THEN sy ELSE b2 END AS yy, CASE WHEN cy IS NOT NULL THEN cy ELSE yr END AS cc,
  CASE WHEN n2 BETWEEN 1 AND 12 AND n1 BETWEEN 1 AND 31 THEN {_date('n3', 'n2', 'n1')} WHEN m2 > 0 THEN {_date('m3', 'm2', 'm1')} WHEN k1 > 0 THEN {_date('k3', 'k1', 'k2')} END AS inst FROM p1),
p3 AS (SELECT *, CASE k0 WHEN 'quarter' THEN ({fs('qy')} + to_months((3 * (qn - 1))::INT))::DATE WHEN 'half' THEN CASE WHEN hn = '1' THEN {fs('hy')} ELSE {_date(f"year({fs('hy')})", '10', '1')} END
  WHEN 'fy' THEN {fs('yy')} WHEN 'instant' THEN inst WHEN 'month' THEN {_date('y2', 'y1', '1')} WHEN 'calendar' THEN {_date('cc', '1', '1')} END AS s0 FROM p2),
p4 AS (SELECT *, CASE k0 WHEN 'quarter' THEN last_day((s0 + to_months(2))::DATE) WHEN 'half' THEN CASE WHEN hn = '1' THEN {_date(f"year({fs('hy')})", '9', '30')} ELSE {fe('hy')} END
  WHEN 'fy' THEN {fe('yy')} WHEN 'instant' THEN inst WHEN 'month' THEN last_day(s0) WHEN 'calendar' THEN {_date('cc', '12', '31')} END AS e0 FROM p3),
p AS (SELECT *, CASE WHEN s0 IS NOT NULL AND e0 IS NOT NULL THEN s0 END AS start, CASE WHEN s0 IS NOT NULL AND e0 IS NOT NULL THEN e0 END AS end_, CASE WHEN s0 IS NOT NULL AND e0 IS NOT NULL THEN k0 ELSE 'unknown' END AS kind FROM p4)"""


def relation(a: str, b: str) -> str:
    """Relation of two periods given as row aliases with start and end_."""
    return f"CASE WHEN {a}.start IS NULL OR {b}.start IS NULL THEN 'unknown' WHEN {a}.start = {b}.start AND {a}.end_ = {b}.end_ THEN 'equal' WHEN {a}.start <= {b}.end_ AND {b}.start <= {a}.end_ THEN 'overlap' ELSE 'disjoint' END"


def comparable(a: str, b: str) -> str:
    return f"CASE WHEN {a}.value IS NULL OR {b}.value IS NULL THEN 'missing_value' WHEN {a}.dimension IS DISTINCT FROM {b}.dimension THEN 'different_dimension' WHEN {a}.dimension = 'currency' AND {a}.unit IS DISTINCT FROM {b}.unit THEN 'different_currency' ELSE 'comparable' END"


def agree(a: str, b: str) -> str:
    return f"coalesce({comparable(a, b)} = 'comparable' AND ({a}.value = {b}.value OR abs({a}.value - {b}.value) / nullif(greatest(abs({a}.value), abs({b}.value)), 0) <= 0.01), false)"


#: What the slots of a prompt hold, of facts a and b (with doc, their document's name).
PROMPT_SLOTS = {"signals": "'- similarity ' || similarity::DECIMAL(18, 3)::DECIMAL(18, 2)"}
for _s in ("a", "b"):
    PROMPT_SLOTS |= {
        f"{_s}_document": f"{_s}.doc", f"{_s}_page": f"{_s}.page", f"{_s}_subject": f"{_s}.subject", f"{_s}_predicate": f"{_s}.predicate", f"{_s}_qualifiers": f"'status=' || {_s}.status",
        f"{_s}_value": f"{_s}.value_raw", f"{_s}_period": f"{_s}.period_raw", f"{_s}_quote": f"replace({_s}.source_quote, chr(34), chr(39))",
    }


def prompt(template: str) -> str:
    parts = re.split(r"\{([a-z_]+)\}", template)
    return " || ".join(f"coalesce(({PROMPT_SLOTS[p]})::VARCHAR, '')" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))
