"""Evidence grounding: is a quote on its page, and how directly.

Cheap native tests come first; only quotes that are long enough and not found as they are reach
the fuzzy matcher in Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .windows import best_windows

MIN_QUOTE, MIN_FUZZY, MIN_WORDS = 12, 40, 4


def _fuzzy(threshold: float):
    @F.arrow_udf(T.DoubleType())
    def fuzzy(quotes: pa.Array, pages: pa.Array, least: pa.Array) -> pa.Array:
        return pa.array(best_windows(quotes.to_pylist(), pages.to_pylist(), threshold, least.fill_null(0.0).to_numpy(zero_copy_only=False)), pa.float64())

    return fuzzy


def _of_quote(d: DataFrame, quote: str, compatibility: bool) -> DataFrame:
    d = d.withColumn("__q", X.canon(F.col(quote), compatibility))
    return d.withColumns({"__qn": X.numbers(F.col("__q")), "__qw": X.long_words(F.col("__q"))})


def _of_page(d: DataFrame, page_text: str, compatibility: bool) -> DataFrame:
    d = d.withColumn("__p", X.canon(F.col(page_text), compatibility))
    return d.withColumns({"__pn": X.numbers(F.col("__p")), "__pw": X.long_words(F.col("__p"))})


def with_grounding(pairs: DataFrame, quote: str = "quote", page_text: str = "page_text", threshold: float = 0.88, coverage: float = 0.8, fuzzy: bool = True, compatibility: bool = True, strict_numbers: bool = False, found_only: bool = False) -> DataFrame:
    """pairs with grounding (verbatim, reflowed, unverified) and score.

    strict_numbers: a quote with a number that the page lacks is never verbatim by the fuzzy test.
    fuzzy, compatibility: leave out the fuzzy test, or NFKC. found_only: scores of unverified quotes don't matter, so
    windows that can't reach the threshold aren't aligned."""
    d = _of_page(_of_quote(pairs, quote, compatibility), page_text, compatibility)
    return _tested(d, threshold, coverage, fuzzy, strict_numbers, found_only)


def _tested(d: DataFrame, threshold: float = 0.88, coverage: float = 0.8, fuzzy: bool = True, strict_numbers: bool = False, found_only: bool = False) -> DataFrame:
    """with_grounding of pairs with the columns of _of_quote and _of_page, which go."""
    usable = (F.length("__q") >= MIN_QUOTE) & (F.length("__p") > 0)
    d = d.withColumn("__usable", usable).withColumn("__exact", usable & F.contains("__p", "__q"))
    d = d.withColumn("__there", X.numbers_present(F.col("__qn"), F.col("__pn"))).withColumn("__cover", X.word_coverage(F.col("__qw"), F.col("__pw")))
    wanted = F.col("__usable") & ~F.col("__exact") & (F.length("__q") >= MIN_FUZZY)
    if strict_numbers:
        wanted = wanted & F.col("__there")
    reflowed = F.col("__there") & ((F.size("__qn") > 0) | (F.size("__qw") >= MIN_WORDS)) & (F.col("__cover") >= coverage)
    best = F.lit(0.0)
    if fuzzy:
        # Where the score is another's unless the threshold is reached, or at least the coverage, lower likenesses don't matter.
        enough = F.lit(threshold - 1e-9)
        least = enough if found_only else F.when(reflowed, enough).when(F.col("__there"), F.least(F.col("__cover"), enough)).otherwise(0.0)
        # Nulls cost the matcher nothing.
        d = d.withColumn("__best", F.coalesce(_fuzzy(threshold)(F.when(wanted, F.col("__q")), F.when(wanted, F.col("__p")), least), F.lit(0.0)))
        best = F.col("__best")
    state = F.when(~F.col("__usable"), "unverified").when(F.col("__exact") | (best >= threshold), "verbatim").when(reflowed, "reflowed").otherwise("unverified")
    score = (
        F.when(~F.col("__usable"), 0.0).when(F.col("__exact"), 1.0).when(best >= threshold, best)
        .when(~F.col("__there"), best).when(reflowed, F.round("__cover", 3)).otherwise(F.greatest(best, F.col("__cover")))
    )
    hidden = [c for c in ("__q", "__p", "__usable", "__exact", "__qn", "__pn", "__there", "__qw", "__pw", "__cover", "__best") if c in d.columns]
    return d.withColumns({"grounding": state, "score": score}).drop(*hidden)


def ground_facts(facts: DataFrame, pages: DataFrame, fact_id: str = "fact_id", **options) -> DataFrame:
    """facts (fact_id, doc_id, page, quote, start_page, end_page) with grounding, quote_verified, quote_score
    and the page that supports them best. pages: (doc_id, page, combined).

    Only facts that their claimed page doesn't support look at the other pages of their chunk; the first
    page with the best rank wins, and no fact is dropped."""
    texts = pages.select(F.col("doc_id").alias("__d"), F.col("page").alias("__page"), F.col("combined").alias("page_text"))
    claimed = facts.join(texts, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__page")), "left").drop("__d", "__page")
    # Which facts are lost shows without their scores, for a fraction of the work.
    lost = with_grounding(claimed, found_only=True, **options).where("grounding = 'unverified'").select(F.col(fact_id).alias("__f"), "doc_id", "page", "quote", "start_page", "end_page")
    claimed = with_grounding(claimed, **options).drop("page_text")
    near = (F.col("doc_id") == F.col("__d")) & F.col("__page").between(F.col("start_page"), F.col("end_page")) & (F.col("__page") != F.coalesce("page", F.lit(-1)))
    # A page meets many facts: it is moved as it stands and made canonical once, beside its document's facts.
    alike = options.pop("compatibility", True)
    parts = max(2 * facts.sparkSession.sparkContext.defaultParallelism, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    beside = _of_page(texts.repartition(parts, "__d"), "page_text", alike).drop("page_text")
    others = _of_quote(lost, "quote", alike).drop("quote").join(beside, near).drop("doc_id", "page", "start_page", "end_page", "__d")
    tried = _tested(others, found_only=True, **options).where("grounding <> 'unverified'")
    rank = F.when(F.col("grounding") == "verbatim", 2).otherwise(1)
    best = tried.groupBy("__f").agg(F.max_by(F.struct("__page", "grounding", "score"), F.struct(rank, -F.col("__page"))).alias("__best"))
    out = claimed.join(best, F.col(fact_id) == F.col("__f"), "left")
    moved = {"page": F.coalesce("__best.__page", "page"), "grounding": F.coalesce("__best.grounding", "grounding"), "quote_score": F.round(F.coalesce("__best.score", "score"), 3)}
    out = out.withColumns(moved).drop("__best", "__f", "score")
    return out.withColumn("quote_verified", F.col("grounding") != "unverified")


def first_of_each(facts: DataFrame) -> DataFrame:
    """One fact for each claim key, value and period text of a document: the first extracted. Facts without
    claim key or quote are left out."""
    named = facts.where((F.coalesce("claim_key", F.lit("")) != "") & (F.coalesce("quote", F.lit("")) != ""))
    same = Window.partitionBy("doc_id", "claim_key", "value_raw", "period_raw").orderBy("chunk", "ordinal")
    return named.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")

