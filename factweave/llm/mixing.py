"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) get weights in turn and share ``share`` of all sizes;
a target never exceeds ``most`` times its source's size, and the excess is shared again by weight. That
is target = least(most * size, level * weight) for the one level at which targets add up.

Sampling: each document of a source expects rate = target / size of its source copies. Expected copies
are summed up in a fixed order, one random offset a source is added, and a document is emitted once for
each integer boundary that its interval crosses. Order: hashed blocks of about BLOCK documents,
by size inside each, so that every stretch of the order holds all sizes and taken sizes come near targets.

Scale: sizes are taken in one pass over the texts. Equal rows are one group with a count (rowkeys), blocks are
hashed from id and key together, so neither null ids nor a source with a third of all rows, nor a row repeated without
end, meet in one task; prefix sums come from counts of blocks (one small row each) plus sums inside blocks.

Edge cases: null texts have size 0 and are sampled like others; a null source is a source; a source
of size 0 has target 0 and none of its documents are taken; repeated rows are sampled one by one; rows that share id
and size are ordered by a hash of their columns, so reruns agree; columns of any names are kept (names beginning with
__ and one of this module's are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rowkeys
from .shared import written

BLOCK = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\0")) if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, n, source_size) with target and rate; one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # By the level at which a source is full: those before it are full at its own level, the rest share by weight.
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ranked = ranked.withColumn("own", rest / F.sum("weight").over(after))
    ranked = ranked.withColumn("full", F.col("own") * F.col("weight") >= most * F.col("source_size"))
    level = F.max(F.when(~F.col("full"), F.col("own"))).over(Window.partitionBy())
    ranked = ranked.withColumn("target", F.coalesce(F.least(most * F.col("source_size"), level * F.col("weight")), most * F.col("source_size")).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.withColumn("rate", rate).select("source", "n", "source_size", "target", "rate")


def sampled(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """Groups of equal rows (id, source, size, tie columns) with how many they are (n), the places before them in their
    source (before), and source_size, target, rate and offset of the source."""
    ties = [c for c in rows.columns if c not in ("id", "source", "size")]
    groups = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "mixing-groups")
    totals = targets(groups.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    totals = totals.select(F.col("source").alias("s"), F.ceil(F.col("n") / BLOCK).alias("blocks"), "source_size", "target", "rate", uniform(F.lit(seed), F.col("source")).alias("offset"))
    groups = groups.join(totals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    groups = groups.withColumn("block", F.floor(uniform(F.lit(seed), F.col("id"), *map(F.col, ties)) * F.col("blocks"))).drop("blocks")
    earlier = Window.partitionBy("s").orderBy("b")
    blocks = groups.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.sum("n").alias("m"))
    blocks = blocks.withColumn("base", F.sum("m").over(earlier) - F.col("m")).drop("m")
    inside = Window.partitionBy("source", "block").orderBy("size", "id", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
    groups = groups.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return groups.withColumn("before", F.col("base") + F.col("inside")).drop("s", "b", "block", "base", "inside")


def _boundary(place: Column) -> Column:
    return F.floor(place * F.col("rate") + F.col("offset"))


def expected_copies(rows: DataFrame, **options) -> DataFrame:
    """rows (id, source, size, and columns that tell rows of one id apart) with source_size, target and copies: how
    often each row is taken."""
    portions = rowkeys.portions(sampled(rows, **options), "n").repartition("id", "size", "__portion")
    place = F.col("before") + F.col("__nth")
    return rowkeys.each(portions, "n").withColumn("copies", (_boundary(place) - _boundary(place - 1)).cast("int")).select(*rows.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixture: rows of docs, each as often as it is taken."""
    whole = rowkeys.keyed(docs)
    rows = whole.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), *rowkeys.KEY)
    taken = sampled(rows, **options).select(*rowkeys.KEY, (_boundary(F.col("before") + F.col("n")) - _boundary(F.col("before"))).alias("n")).where("n > 0")
    # A group of n rows is taken as often as its n intervals cross boundaries; which of the equal rows that are is all one.
    places = written(rowkeys.portions(taken, "n"), "mixing-places")
    places = places.withColumn("__times", F.least(F.col("n") - F.col("__first"), F.lit(rowkeys.PORTION).cast("long"))).select(*rowkeys.KEY, "__portion", "__times")
    rows = rowkeys.given_rows(whole, places)
    return rows.withColumn("__times", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select(*[F.col(f"`{c}`") for c in docs.columns])
