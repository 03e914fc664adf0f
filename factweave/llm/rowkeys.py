"""Rows told by a key of all their columns, however often they are repeated.

Operators that place or sample rows do so on slim groups of equal rows (key, count), which a map-side combine keeps
small, and then give each place a row of its key. Equal rows can stand for each other, so a row
repeated 10^8 times is one group, and its places are dealt in portions of PORTION to as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PORTION = 4096
KEY = ["__row_key1", "__row_key2"]


def _hashable(name: str, kind: str) -> list[Column]:
    c = F.col(f"`{name}`")
    if "map<" in kind or "variant" in kind:
        c = F.to_json(F.struct(c))
    return [c, F.size(c)] if kind.startswith("array<") else [c]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY, 128 bits of all columns (which of them are null, too)."""
    parts = [p for name, kind in docs.dtypes for p in _hashable(name, kind)]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in docs.columns])
    return docs.withColumns({KEY[0]: F.xxhash64(nulls, *parts), KEY[1]: F.xxhash64(F.lit(1), nulls, *parts)})


def portions(groups: DataFrame, n: str) -> DataFrame:
    """groups once for each PORTION of their n, dealt anew, with __portion (from 0) and __first (places before it)."""
    several = groups.withColumn("__portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / PORTION))))
    return several.withColumn("__first", F.col("__portion") * PORTION)


def each(portion: DataFrame, n: str) -> DataFrame:
    """A row for each of the n of a group, with __nth (from 1 in the group)."""
    last = F.least(F.col(n), F.col("__first") + PORTION)
    return portion.withColumn("__nth", F.explode(F.sequence(F.col("__first") + 1, last))).drop("__first")


def given_rows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Each of places (KEY, __portion, more; written) with the columns of a row of docs (keyed) that has its key.

    Texts are shuffled once. Only keys with more than one portion need their row in several tasks."""
    one = docs.dropDuplicates(KEY)
    out = one.join(places.where("__portion = 0"), KEY)
    more = places.where("__portion > 0")
    if more.isEmpty():
        return out.drop("__portion")
    ranges = more.groupBy(*KEY).agg(F.max("__portion").alias("__last"))
    hot = docs.join(ranges.select(*KEY), KEY, "left_semi").dropDuplicates(KEY).join(ranges, KEY)
    hot = hot.withColumn("__portion", F.explode(F.sequence(F.lit(1).cast("long"), "__last"))).drop("__last")
    return out.unionByName(hot.join(more, [*KEY, "__portion"])).drop("__portion")
