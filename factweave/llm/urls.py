"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Each distinct URL expands into expressions: every suffix of its host at a label edge, times the
prefixes of its path at the lengths that rules' paths have. Expressions meet rules by the first
SHORT hex digits of their SHA-256; candidates are confirmed by the full digest, and of the
confirmed rules the longest wins (equally long: the longer host, then block before allow).

The rule table is read as it is; Spark broadcasts it only below its own size threshold. Beyond, an expression that very
many URLs have (com with an empty path, or a common host) would be one key: URLs fall into SALTS parts by their
hash, each of which meets its own copy of the rules.

Edge cases: a null url or one without :// has an empty host and path, no rule fits it and it gets the
default verdict; repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8  # hex digits: 32 bits
SALTS = 16  # copies of the rules; the URLs of one expression are dealt over as many keys

#: The rules as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where there is no ://"""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with columns host, path, rule (host and path of the rule that decides, else null) and verdict.
    rules: (verdict, host, path). Same-named input columns are replaced."""
    rules = rules.dropDuplicates(["verdict", "host", "path"]).withColumn("digest", F.sha2(F.concat("host", F.lit("\n"), "path"), 256))
    rules = rules.select(F.substring("digest", 1, SHORT).alias("short"), "digest", "verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    # One row: the path lengths to expand to. Their number is bounded by the longest rule path.
    lengths = rules.agg(F.coalesce(F.collect_set(F.length("rule_path")), F.array().cast("array<int>")).alias("lengths"))
    host, path = url_parts(F.col("__url"))
    urls = pages.select(F.col(url).alias("__url")).where("__url is not null").distinct().select("__url", host.alias("h"), path.alias("p")).where("h <> ''")
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = urls.join(F.broadcast(lengths)).withColumn("hosts", F.array_distinct(suffixes)).withColumn("cuts", F.expr("filter(lengths, n -> n <= length(p))"))
    words = urls.select("__url", F.explode("hosts").alias("host"), "cuts", "p").select("__url", "host", F.explode("cuts").alias("n"), "p")
    words = words.withColumn("digest", F.sha2(F.concat("host", F.lit("\n"), F.expr("substring(p, 1, n)")), 256)).select("__url", F.substring("digest", 1, SHORT).alias("short"), F.col("digest").alias("own"))
    words = words.withColumn("salt", F.pmod(F.xxhash64("__url"), F.lit(SALTS)).cast("int"))
    salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = words.join(salted, ["short", "salt"]).where("own = digest")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), "verdict", "rule_host", "rule_path"))
    best = found.groupBy("__url").agg(best.alias("__best"))
    host, path = url_parts(F.col(url))
    out = pages.withColumn("__url", F.col(url)).join(best, "__url", "left").drop("__url")
    named = {"host": host, "path": path, "rule": F.concat("__best.rule_host", "__best.rule_path"), "verdict": F.coalesce("__best.verdict", F.lit(default))}
    return out.withColumns(named).drop("__best")
