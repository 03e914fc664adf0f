"""Incremental ingest with Structured Streaming: each batch meets the stored corpus only.

A micro-batch is one batch plan; state lives in the store, and appends are idempotent, so a batch
that is repeated after a failure changes nothing.

Events tell readers of each batch's progress, one JSON object a line: doc, plan, note (a chunk that could not be read, a budget
that is used up), fact, relation, error (a document without facts, which isn't kept) and done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import short_error
from ..operators import relate
from ..operators.similarity import candidates
from ..plans import serve
from ..sources.store import Store, kept_documents

#: Fields of events that a reader may rely on; others of a line are left out when events are read.
EVENT = "event string, doc_id long, id long, filename string, pages int, chunks int, page int, level string, message string, type string, decided_by string, similarity double, fact_type string, subject string, predicate string, value_raw string, period_raw string, quote string, quote_verified boolean, quote_score double, grounding string, explanation string, totals map<string,long>, counts map<string,long>"


def ingest_batch(store: Store, documents: DataFrame, facts: DataFrame, verdicts: DataFrame | None = None, config: Config = Config(), chunks: DataFrame | None = None, write_events=None) -> None:
    """Add documents (new by file name) with their facts; relations against documents with smaller ids.
    Documents without facts aren't kept. chunks (doc_id, chunk, start_page, end_page, error): what was read of them.
    write_events(lines): takes the batch's events, if given. Pairs are compared once, for relations and events alike."""
    fresh = documents.join(store.read("documents").select("filename"), "filename", "left_anti")
    store.append_documents(kept_documents(fresh, facts))
    store.append_facts(facts.join(store.read("documents").select("doc_id"), "doc_id", "left_semi"))
    corpus = store.read("facts").where(F.col("quote_verified") & F.col("embedding").isNotNull())
    own = corpus.join(facts.select("fact_id"), "fact_id", "left_semi")
    found = candidates(own, corpus, config.floor, config.top_k, earlier=True, broadcast_bytes=config.broadcast_bytes)
    with store.scratch(relate.decided(found, corpus, config)) as pairs:
        made = relate.relations(pairs, verdicts, config)
        if write_events is None:
            store.append_relations(made)
            return
        with store.scratch(store.fresh_relations(made)) as new:
            store.append("relations", new)
            write_events(events(store, documents, facts, pairs, new, chunks, config))


def _lines(df: DataFrame, event: str, *columns) -> DataFrame:
    body = F.struct(F.lit(event).alias("event"), *columns)
    return df.select("doc_id", F.lit(event).alias("event"), F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def _given(df: DataFrame, *names: str) -> list:
    return [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]


def events(store: Store, documents: DataFrame, facts: DataFrame, pairs: DataFrame, made: DataFrame, chunks: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(doc_id, event, line) of a batch: nulls kept, dates as text."""
    out = [_lines(documents, "doc", "doc_id", *_given(documents, "filename", "page_count", "title", "publisher", "doc_date", "primary_entity", "fy_convention"))]
    if chunks is not None:
        planned = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_page").alias("pages"))
        out.append(_lines(planned, "plan", "doc_id", "chunks", "pages"))
        unread = F.concat(F.lit("Pages "), F.col("start_page"), F.lit("-"), F.col("end_page"), F.lit(" were not read: "), short_error(F.col("error")))
        out.append(_lines(chunks.where("error is not null"), "note", "doc_id", F.lit("warn").alias("level"), unread.alias("message")))
    quote = next(c for c in ("quote", "source_quote") if c in facts.columns) if {"quote", "source_quote"} & set(facts.columns) else None
    text = F.col(quote).alias("quote") if quote else F.lit(None).cast("string").alias("quote")
    fields = _given(facts, "page", "subject", "predicate", "value_raw", "period_raw", "fact_type", "quote_verified", "grounding", "quote_score")
    out.append(_lines(facts, "fact", F.col("fact_id").alias("id"), "doc_id", *fields, text))
    sides = [F.struct(*_given(facts, "fact_id", "doc_id", "page", "subject", "predicate", "value_raw", "period_raw", "grounding")).alias(s) for s in ("a", "b")]
    stored = store.read("facts")
    told = made
    for s, side in zip(("a", "b"), sides, strict=True):
        told = told.join(stored.select(side), F.col(f"fact_{s}_id") == F.col(f"{s}.fact_id"))
    told = told.withColumn("doc_id", F.col("a.doc_id"))
    out.append(_lines(told, "relation", "doc_id", F.col("relation_type").alias("type"), "decided_by", "explanation", F.round("similarity", 3).alias("similarity"), "a", "b"))
    used = pairs.groupBy(F.col("a_doc").alias("doc_id")).agg(F.count_if(F.col("status") == "unexamined").alias("unexamined"))
    spent = F.concat(F.lit(f"The budget of {config.budget} adjudications is used up; "), F.col("unexamined"), F.lit(" more pairs were left unexamined."))
    out.append(_lines(used.where("unexamined > 0"), "note", "doc_id", F.lit("warn").alias("level"), spent.alias("message")))
    read = facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if("quote_verified").alias("grounded"))
    joined = documents.select("doc_id").join(read, "doc_id", "left").join(used, "doc_id", "left").join(told.groupBy("doc_id").agg(F.count("*").alias("relations")), "doc_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("facts", "grounded", "relations", "unexamined")}).withColumn("ungrounded", F.col("facts") - F.col("grounded"))
    counts = serve.counts(store.read("documents"), stored, store.read("relations"))
    totals = F.struct("facts", "grounded", "ungrounded", "relations", "unexamined").alias("totals")
    done = joined.where("facts > 0").select("doc_id", totals).crossJoin(counts.select(F.struct(*counts.columns).alias("counts")))  # one row
    out.append(_lines(done, "done", "doc_id", "totals", "counts"))
    out.append(_lines(joined.where("facts = 0"), "error", "doc_id", F.lit("No facts were found, so the document is not kept.").alias("message")))
    return reduce(DataFrame.unionByName, out)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """EVENT rows of NDJSON files; blank lines are passed over, lines that aren't JSON have no event."""
    lines = spark.read.text(path).where(r"value rlike '\\S'")
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")


def ingest_stream(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str, prepare, config: Config = Config(), available_now: bool = True):
    """Watch a folder of parquet files. prepare(batch) gives (documents, facts) of a micro-batch; events go to
    <store>/events. Returns the running query."""

    def each(batch: DataFrame, number: int) -> None:
        documents, facts = prepare(batch)
        path = f"{store.path}/events/batch-{number:08d}"
        ingest_batch(store, documents, facts, None, config, write_events=lambda e: e.select("line").write.mode("overwrite").text(path))

    writer = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
