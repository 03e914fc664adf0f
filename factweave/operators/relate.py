"""Deterministic pair classification, similarity gate, adjudication budget and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.period import periods_relation
from ..functions.quantity import comparability, values_agree
from ..functions.text import or_else
from ..sources.boundary import valid_type

FACT = ["fact_id", "doc_id", "subject", "value_raw", "value_num", "unit", "dimension", "period_raw", "period_start", "period_end", "period_kind"]
#: What prompts and events also show of a fact, where it is there.
SHOWN = ["page", "predicate", "qualifiers", "source_quote", "grounding"]


def quantity_of(f: Column) -> Column:
    return F.struct(f["value_num"].alias("value"), f["unit"].alias("unit"), f["dimension"].alias("dimension"), F.coalesce(f["value_raw"], F.lit("")).alias("raw"))


def period_of(f: Column) -> Column:
    return F.struct(f["period_start"].alias("start"), f["period_end"].alias("end"), F.coalesce(f["period_raw"], F.lit("")).alias("raw"), or_else(f["period_kind"], "unknown").alias("kind"))


def classified(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """pairs with fact structs a and b: periods, comparable, relation_type (corroborates or null), explanation,
    signals. Null means that arithmetic doesn't decide."""
    a, b = F.col("a"), F.col("b")
    qa, qb, pa, pb = quantity_of(a), quantity_of(b), period_of(a), period_of(b)
    d = pairs.withColumn("periods", periods_relation(pa, pb)).withColumn("comparable", comparability(qa, qb))
    numeric = qa["value"].isNotNull() & qb["value"].isNotNull()
    measured = lambda q: F.coalesce(q["dimension"].isin("currency", "ratio"), F.lit(False))
    settled = numeric & (F.col("periods") != "unknown")
    unitless = settled & ~(measured(qa) & measured(qb))
    foreign = settled & ~unitless & (F.col("comparable") == "different_currency")
    agree = settled & ~unitless & (F.col("periods") == "equal") & values_agree(qa, qb, tolerance)
    number = lambda q: F.concat_ws(" ", F.coalesce(q["value"].cast("string"), F.lit("None")), F.coalesce(q["unit"], F.lit("")))
    lines = [
        F.concat(F.lit("- periods: "), or_else(pa["raw"], "?"), F.lit(" vs "), or_else(pb["raw"], "?"), F.lit(" -> "), F.col("periods")),
        F.concat(F.lit("- values comparable: "), F.when(F.col("comparable") == "comparable", "True").otherwise("False"), F.lit(" ("), F.col("comparable"), F.lit(")")),
        F.concat(F.lit("- normalized values: "), number(qa), F.lit(" vs "), number(qb)),
        F.when(unitless, "- both values are unitless counts: units not verified by normalization"),
        F.when(foreign, F.concat(F.lit("- different currencies ("), qa["unit"], F.lit(" vs "), qb["unit"], F.lit("): not directly comparable without a period-appropriate exchange rate. Do not convert; if these are the same claim, the relation is reconciled_units."))),
    ]
    percent = f"{tolerance:.0%}"
    text = F.concat(F.lit("Both report "), qa["raw"], F.lit(" and "), qb["raw"], F.lit(" for the same period ("), or_else(pa["raw"], "same period"), F.lit(f"); values agree within {percent}."))
    return d.withColumns({"relation_type": F.when(agree, "corroborates"), "explanation": F.when(agree, text).otherwise(""), "signals": F.concat_ws("\n", *lines)})


def gated(pairs: DataFrame, rule_floor: float = 0.88) -> DataFrame:
    """A rule decides only for pairs of at least rule_floor similarity; for others the signals say so."""
    weak = F.col("similarity") < rule_floor
    note = F.concat(F.lit("\n- claim-key similarity: "), F.format_string("%.2f", "similarity"), F.lit(" (moderate: verify these are the same claim before relating them)"))
    return pairs.withColumns({"signals": F.when(weak, F.concat("signals", note)).otherwise(F.col("signals")), "relation_type": F.when(~weak, F.col("relation_type")), "explanation": F.when(weak, "").otherwise(F.col("explanation"))})


def budgeted(pairs: DataFrame, budget: int = 60) -> DataFrame:
    """status of each pair: rule, adjudicate (the best ``budget`` undecided pairs of a document) or unexamined."""
    best = Window.partitionBy("a_doc", F.col("relation_type").isNull()).orderBy(F.desc("similarity"), "a_id", "rank")
    status = F.when(F.col("relation_type").isNotNull(), "rule").when(F.row_number().over(best) <= budget, "adjudicate").otherwise("unexamined")
    return pairs.withColumn("status", status)


def decided(pairs: DataFrame, facts: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidate pairs (a_id, b_id, a_doc, similarity, rank) with facts' structs, verdict and status."""
    side = lambda n: facts.select(F.struct(*FACT, *[c for c in SHOWN if c in facts.columns]).alias(n))
    d = pairs.join(side("a"), F.col("a_id") == F.col("a.fact_id")).join(side("b"), F.col("b_id") == F.col("b.fact_id"))
    return budgeted(gated(classified(d, config.tolerance), config.rule_floor), config.budget)


def relations(pairs: DataFrame, verdicts: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Relations of decided pairs. verdicts (VERDICTS, and error where the call failed) answers the pairs to
    adjudicate; without an answer a pair stays unrelated, nothing is guessed."""
    out = ["fact_a_id", "fact_b_id", "relation_type", "decided_by", "explanation", "similarity", "confidence"]
    ids = [F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id")]
    rule = pairs.where("status = 'rule'").select(*ids, "relation_type", F.lit("rule").alias("decided_by"), "explanation", "similarity", F.lit(config.rule_confidence).alias("confidence"))
    if verdicts is None:
        return rule.select(out)
    from ..functions.text import short_error

    failed = F.col("error").isNotNull() if "error" in verdicts.columns else F.lit(False)
    error = short_error(F.col("error")) if "error" in verdicts.columns else F.lit("")
    asked = pairs.where("status = 'adjudicate'").select(*ids, "similarity")
    told = asked.join(verdicts, ["fact_a_id", "fact_b_id"]).select(
        "fact_a_id", "fact_b_id", F.when(failed, "needs_review").otherwise(valid_type(F.col("relation_type"))).alias("relation_type"), F.when(failed, "rule").otherwise("llm").alias("decided_by"),
        F.when(failed, F.concat(F.lit("Adjudication call failed: "), error)).otherwise(F.coalesce("explanation", F.lit(""))).alias("explanation"), "similarity",
        F.when(failed, 0.0).otherwise(F.coalesce("confidence", F.lit(config.default_confidence))).alias("confidence"),
    )
    return rule.select(out).unionByName(told.where("relation_type <> 'unrelated'").select(out))
