"""The external model's place: extraction and adjudication clients, rate limit, retries.

Nothing here invents an answer. A client is any object with ``ask(prompt) -> dict``; without one,
precomputed tables (raw facts, verdicts) take its place.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else
from . import prompts

TRANSIENT = re.compile("429|rate|quota|503|500|unavailable|timeout|deadline")


class RateLimiter:
    """At least 60 / per_minute seconds between calls of one process."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute, clock, sleep, 0.0

    def acquire(self) -> None:
        if (wait := self.next - self.clock()) > 0:
            self.sleep(wait)
        self.next = max(self.clock(), self.next) + self.gap


def with_retries(call: Callable[[], dict], retries: int = 5, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Call again after transient errors, with growing random pauses."""
    for attempt in range(retries):
        try:
            return call()
        except Exception as e:
            if attempt == retries - 1 or not TRANSIENT.search(str(e).lower()):
                raise
            sleep(min(cap, 2.0**attempt + random.random()))
    raise ValueError("no attempt allowed")


def ask_each(prompts: DataFrame, make_client: Callable[[], object], per_minute: float = 10, retries: int = 5) -> DataFrame:
    """prompts (key columns, prompt) with reply (JSON) and error columns; one failure stays one row's.
    The limit holds for a process, so partitions are few by the caller's choice."""
    import json

    def run(batches: Iterator):
        client, limiter = make_client(), RateLimiter(per_minute)
        for pdf in batches:
            replies, errors = [], []
            for p in pdf["prompt"]:
                limiter.acquire()
                try:
                    replies.append(json.dumps(with_retries(lambda p=p: client.ask(p), retries)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    replies.append(None)
                    errors.append(str(e))
            yield pdf.assign(reply=replies, error=errors)

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in prompts.dtypes)
    return prompts.mapInPandas(run, f"{kinds}, reply string, error string")


REPLIED_FACTS = "struct<facts:array<struct<fact_type:string,subject:string,predicate:string,qualifiers:array<struct<key:string,value:string>>,value_raw:string,unit_hint:string,period_raw:string,page:int,quote:string,confidence:double>>>"
CONTEXT = ["title", "publisher", "doc_date", "primary_entity", "fy_convention", "currency_hint"]
REPLIED_CONTEXT = f"struct<{','.join(f'{c}:string' for c in CONTEXT)}>"
REPLIED_VERDICT = "struct<relation_type:string,explanation:string,confidence:double>"


def replied(reply: Column, kind: str) -> Column:
    """The reply (JSON text) as a struct; null where it isn't of that form."""
    return F.from_json(reply, kind)


def extracted_chunks(chunks: DataFrame, documents: DataFrame, make_client: Callable[[], object], cap: int = 25, per_minute: float = 10, retries: int = 5) -> DataFrame:
    """chunks (doc_id, chunk, start_page, end_page, text) with reply and error: the model's answer to each chunk's prompt.
    One chunk's failure stays its own. Write the result before it is read twice: calls cost."""
    context = documents.select("doc_id", *[c for c in CONTEXT if c != "currency_hint"])
    asked = chunks.join(context, "doc_id").withColumn("prompt", prompts.extraction(cap))
    return ask_each(asked.select("doc_id", "chunk", "start_page", "end_page", "prompt"), make_client, per_minute, retries)


def raw_facts(answers: DataFrame) -> DataFrame:
    """RAW_FACTS of extracted_chunks, in the order of the replies; replies that hold no list of facts give none."""
    rows = answers.select("doc_id", "chunk", F.posexplode(replied(F.col("reply"), REPLIED_FACTS)["facts"]).alias("ordinal", "fact"))
    return rows.select("doc_id", "chunk", "ordinal", "fact.*")


def verdicts(pairs: DataFrame, documents: DataFrame, make_client: Callable[[], object], per_minute: float = 10, retries: int = 5) -> DataFrame:
    """VERDICTS and error for decided pairs (facts a and b, signals, status) that are left to adjudicate."""
    asked = prompts.with_documents(pairs.where("status = 'adjudicate'"), documents).withColumn("prompt", prompts.adjudication())
    answers = ask_each(asked.select(F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "prompt"), make_client, per_minute, retries)
    answer = replied(F.col("reply"), REPLIED_VERDICT)
    return answers.select("fact_a_id", "fact_b_id", answer["relation_type"].alias("relation_type"), answer["explanation"].alias("explanation"), answer["confidence"].alias("confidence"), "error")


def contexts(heads: DataFrame, make_client: Callable[[], object], per_minute: float = 10, retries: int = 5) -> DataFrame:
    """(doc_id, CONTEXT) of document heads; all null where the call failed."""
    answers = ask_each(heads.select("doc_id", prompts.context().alias("prompt")), make_client, per_minute, retries)
    return answers.select("doc_id", replied(F.col("reply"), REPLIED_CONTEXT).alias("c")).select("doc_id", *[F.col(f"c.{c}") for c in CONTEXT])


def document_context(documents: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """documents (doc_id, filename) with the context columns; defaults where the model gave none."""
    names = CONTEXT
    joined = documents.join(contexts.select("doc_id", *names), "doc_id", "left") if contexts is not None else documents.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    return joined.withColumns({n: F.coalesce(n, F.lit("")) for n in names} | {"title": or_else(F.col("title"), F.col("filename")), "fy_convention": or_else(F.col("fy_convention"), "IN")})


#: Relation types that an adjudicator may give.
RELATION_TYPES = ["corroborates", "contradicts", "reconciled_time", "reconciled_units", "reconciled_scope", "unrelated", "needs_review"]


def valid_type(relation_type):
    """Unknown types become needs_review."""
    return F.when(relation_type.isin(RELATION_TYPES), relation_type).otherwise("needs_review")
