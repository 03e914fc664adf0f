"""DuckDB SQL for those corpus queries that SQL expresses.

Left out: 1 (zstandard), 3 (XXH64), 5 (trained), 7 (CRC-32), pipeline.
"""

from .urls import RULES

WORDS = r"'[^\x20\x09-\x0D]+'"


def _fraction(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size, md5(coalesce(text, '')) AS m FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
t AS (SELECT source, n, source_size, coalesce(least(2.0::DOUBLE * source_size, weight * max(own) FILTER (own * weight < 2.0::DOUBLE * source_size) OVER ()), 2.0::DOUBLE * source_size)::DOUBLE AS target,
  {_fraction("'mix-1'", "coalesce(source, chr(0))")} AS u FROM o),
r AS (SELECT doc_id, size, m, d.source, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  floor({_fraction("'mix-1'", "coalesce(doc_id::VARCHAR, chr(0))", "m")} * ceil(n / 4096.0::DOUBLE)) AS b FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY b, size, doc_id NULLS FIRST, m)::DOUBLE AS k FROM r)
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u)) * size)::BIGINT AS taken FROM k
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
-- maximal repeats of at least 8 words: for a pair of equal 8-word windows, extended as far as windows agree
e AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS lag FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i <> b.i),
runs AS (SELECT doc_id, lag, min(i) AS s, max(i) + 8 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS k FROM p) GROUP BY doc_id, lag, k),
c AS (SELECT doc_id, max(e - s) AS longest FROM runs GROUP BY doc_id),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS x FROM (SELECT DISTINCT doc_id, i FROM p), range(8) t(k)) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORDS}))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORDS})))))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(cov.n, 0)::BIGINT AS covered_words, coalesce(c.longest, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= 0.25 * n_words AND longest_repeat <= 0.125 * n_words) AS kept, covered_words, longest_repeat FROM m
"""

URLS = f"""
WITH rules(verdict, rh, rp) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT h.*, verdict, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

DECONTAMINATE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM ip),
dp AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns)),
hit AS (SELECT dp.doc_id, dp.n, i, item_id FROM dp JOIN ip ON dp.n = ip.n AND dp.g = ip.g),
hw AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
x AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM f) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f) r WHERE r.doc_id = t.doc_id AND r.p = t.p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: The reader's results; archives themselves are tested by round trips. URLs here have no byte that needs an escape.
WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, strlen(html)::BIGINT AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to, url AS target_uri FROM f
"""

ORACLES = {"op2_warc": WARC, "op4_mixing": MIXING, "op6_quality": QUALITY, "op8_urls": URLS, "op9_decontaminate": DECONTAMINATE, "op10_substrings": SUBSTRINGS}
