"""Replay: all verified facts against those of earlier documents, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import relate
from ..operators.similarity import candidates
from ..sources.store import new_relations


def replay_pairs(facts: DataFrame, config: Config = Config()) -> DataFrame:
    """Decided pairs of facts (FACTS): candidates, rule verdicts, budget."""
    usable = facts.where(F.col("quote_verified") & F.col("embedding").isNotNull())
    pairs = candidates(usable, usable, config.floor, config.top_k, earlier=True, broadcast_bytes=config.broadcast_bytes)
    return relate.decided(pairs, usable, config)


def replay(facts: DataFrame, verdicts: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Relations, each pair once."""
    made = relate.relations(replay_pairs(facts, config), verdicts, config)
    return new_relations(made, made.limit(0))
