"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank - 1/2) / rows of its source. In the order of fractional ranks every stretch holds the
sources in the mixture's proportions, and the order is cut into shards of equal row counts (``rows`` law:
at most one apart). slot counts from 0 inside each shard.

Scale: ranks come from counts of hash blocks (about BLOCK rows each) plus sums inside a block, and the
global order from counts of blocks of fractional ranks, so neither a source with a third of all rows nor the
global order needs one task. Equal rows are one group with a count (rowkeys) until places are dealt, and the shuffle hash
takes in all columns, so null or repeated ids and rows repeated without end are spread as well. Only the tables of
block counts are summed in one window a source.

Edge cases: a null source is a source; a null text has size 8 and crc 0; null or repeated doc_ids are
rows like others; equal rows share their places in any order, unequal ones are ordered by their hashes, so reruns agree;
columns shard and slot of the input are replaced, others of any name kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rowkeys
from .shared import written

BLOCK = 4096
SPACE = 1 << 32
SEED = "shard-1"


def shuffle_key(seed: str, *keys: Column) -> Column:
    """An integer in [0, 2^32) fixed by seed and keys."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")


def _offsets(rows: DataFrame, group: list[str], block: str, n: Column) -> DataFrame:
    """rows with before: how many rows (n each) of their group lie in earlier blocks."""
    counts = rows.groupBy(*group, block).agg(F.sum(n).alias("m"))
    window = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(block)
    counts = counts.withColumn("before", F.sum("m").over(window) - F.col("m"))
    renamed = counts.select(*[F.col(c).alias(f"{c}_k") for c in (*group, block)], "before")
    condition = F.lit(True)
    for c in (*group, block):
        condition = condition & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    return rows.join(renamed, condition).drop(*[f"{c}_k" for c in (*group, block)])


def interleave(docs: DataFrame, shards: int, seed: str = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with columns shard (int) and slot (long). Same-named input columns are replaced.

    Ranks are taken over ids, sources and hashes alone; whole rows are shuffled once, to meet their places."""
    base = docs.drop("shard", "slot")
    whole = rowkeys.keyed(base)
    slim = whole.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("src"), *rowkeys.KEY)
    out = rowkeys.given_rows(whole, written(places(slim, shards, seed), "places"))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def places(slim: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(KEY, __portion, __shard, __slot) of rows (id, src, KEY)."""
    rows = slim.groupBy("id", "src", *rowkeys.KEY).agg(F.count("*").alias("n"))
    rows = written(rows.withColumn("h", shuffle_key(seed, F.col("id"), *map(F.col, rowkeys.KEY))), "shard-groups")
    sizes = rows.groupBy("src").agg(F.sum("n").alias("src_n")).select(F.col("src").alias("s"), "src_n", F.sum("src_n").over(Window.partitionBy()).alias("all"))
    rows = rows.join(sizes, F.col("src").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", F.floor(F.col("h") * F.ceil(F.col("src_n") / BLOCK) / SPACE))
    rows = _offsets(rows, ["src"], "block", F.col("n"))
    inside = Window.partitionBy("src", "block").orderBy("h", "id", *rowkeys.KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.col("before") + F.sum("n").over(inside) - F.col("n")).drop("block")
    rows = rowkeys.portions(rows, "n").repartition(*rowkeys.KEY, "__portion")
    rows = rowkeys.each(rows, "n").withColumn("frac", (F.col("before") + F.col("__nth") - 0.5) / F.col("src_n")).drop("before", "src_n", "n", "__nth")
    rows = rows.withColumn("part", F.floor(F.col("frac") * F.ceil(F.col("all") / BLOCK)))
    rows = _offsets(rows, [], "part", F.lit(1))
    order = Window.partitionBy("part").orderBy("frac", F.col("src").asc_nulls_last(), "h", *rowkeys.KEY)
    rows = rows.withColumn("place", F.col("before") + F.row_number().over(order) - 1)
    # Shard k holds the places from ceil(k * all / shards) on.
    rows = rows.withColumn("__shard", F.expr(f"cast((place * {shards}L) div all as int)"))
    first = F.expr(f"(__shard * all + {shards - 1}L) div {shards}L")
    return rows.select(*rowkeys.KEY, "__portion", "__shard", (F.col("place") - first).cast("long").alias("__slot"))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
