"""From raw extracted facts to stored facts: key, dedupe, quantity, period, vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import period, quantity, text
from ..sources.store import numbered_facts
from .grounding import first_of_each, ground_facts

WIDTH = 384


def hashed_vectors(keys: list[str | None], width: int = WIDTH) -> np.ndarray:
    """Unit vectors of word and letter-triple counts, hashed: the embedder that needs no model."""
    import zlib

    out = np.zeros((len(keys), width), np.float32)
    for i, k in enumerate(keys):
        line = f" {(k or '').lower()} "
        for part in [*line.split(), *(line[j : j + 3] for j in range(len(line) - 2))]:
            h = zlib.crc32(part.encode())
            out[i, h % width] += 1 if h & 0x80000000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedded(key: Column, embed=hashed_vectors) -> Column:
    """Vectors of claim keys; embed(list of keys) gives a float32 matrix, once a batch."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(col: pa.Array) -> pa.Array:
        return pa.array(list(embed(col.to_pylist())), pa.list_(pa.float32()))

    return vectors(key)


def with_period(facts: DataFrame, into: str, raw: str = "period_raw", convention: str | None = None) -> DataFrame:
    """facts with the parsed period. Texts of periods repeat: each is parsed once with each convention and joined back, by
    broadcast where they are few."""
    keys = [raw] if convention is None else [raw, convention]
    texts = facts.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    texts = texts.withColumn(into, period.parse_period(F.col(f"__{raw}"), F.lit("IN") if convention is None else F.col(f"__{convention}")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return facts.join(texts, same, "left").drop(*[f"__{k}" for k in keys])


def assembled_facts(raw: DataFrame, pages: DataFrame, chunks: DataFrame, documents: DataFrame, first_id: int = 1, embed=hashed_vectors) -> DataFrame:
    """raw (RAW_FACTS) to facts: grounded, keyed, deduplicated, normalized, numbered; verified ones with a
    vector. documents gives each document's fiscal-year convention."""
    spans = chunks.select("doc_id", "chunk", "start_page", "end_page")
    keyed = raw.join(spans, ["doc_id", "chunk"], "left").withColumn("claim_key", text.claim_key(F.col("subject"), F.col("predicate"), F.col("qualifiers")))
    numbered = numbered_facts(first_of_each(keyed), first_id)
    grounded = ground_facts(numbered, pages)
    grounded = grounded.join(documents.select("doc_id", "fy_convention"), "doc_id", "left")
    q = quantity.parse_quantity(F.col("value_raw"), F.col("unit_hint"))
    parsed = with_period(grounded.withColumn("__q", q).withColumn("fy_convention", F.coalesce("fy_convention", F.lit("IN"))), "__p", "period_raw", "fy_convention")
    columns = {"value_num": "__q.value", "unit": "__q.unit", "dimension": "__q.dimension", "period_start": "__p.start", "period_end": "__p.end", "period_kind": "__p.kind", "source_quote": "quote"}
    parsed = parsed.withColumns({k: F.col(v) for k, v in columns.items()}).drop("__q", "__p", "fy_convention")
    return parsed.withColumn("embedding", F.when(F.col("quote_verified"), embedded(F.when(F.col("quote_verified"), F.col("claim_key")), embed)))
