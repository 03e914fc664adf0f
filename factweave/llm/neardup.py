"""Near-duplicates at a similarity of word shingles: the byte-position index with count filtering over wide fingerprints.

A text is the set of its shingles of five words (fewer words are one shingle); texts whose sets have a Jaccard similarity
of LEAST or more are linked. Bits of a SimHash say too little about that: at 0.8 about 15 % of them differ, 10 of 64,
while eight positional bytes guarantee a shared one up to 7. So the positional bytes of this fingerprint are not
bits of a sum but a byte each of BYTES minimum hashes, which two texts share with the chance of their
similarity. Index, tally and verification are those of the SimHash operator:

1. Inverted index: a posting's key is RUN bytes at their positions, one posting for each of BYTES / RUN stretches. A pair at
   similarity s shares none with the chance (1 - s ** RUN) ** (BYTES / RUN): 1.3e-7 at 0.8, less above.
2. Count filter: of texts that hang together by postings, pairs that share fewer than MIN_SHARED positional bytes go; a
   pair at 0.8 shares 160 on average, with a deviation of 5.7.
3. What is left is verified on the shingles themselves: exact Jaccard similarity. Each text is held against those that no
   link has reached yet, so dense groups shrink at once.

Texts with equal sets are one member from the start. Groups that hang together are worked on in blocks of about MEMBERS
texts or BLOCK_BYTES bytes, each with the group's first text, which most often joins them; where a group still falls apart into
several parts, its blocks are also held against each other, two at a time. So memory has a bound and no group is
gathered in one task; the pairs of blocks are only worked on for groups whose texts don't all link.

Shingles are told apart by 64-bit hashes of their words' XXH3 digests, sets by 128 bits.

Edge cases: null, empty and word-free texts have the empty set and are copies of each other; a null doc_id ranks last;
equal rows are one, rows that share an id rank by the hash of all their columns; columns of any names are kept;
an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rowkeys
from .components import components
from .shared import written
from .words import SPACES, U64, Words, gram_values, mix, text_chunks

SHINGLE, LEAST = 5, 0.8
BYTES, RUN, MIN_SHARED = 200, 5, 120
MEMBERS, BLOCK_BYTES = 512, 16 << 20
CHUNK = 1 << 20
_random = np.random.default_rng(77).integers(1, 1 << 63, (2, BYTES), dtype=np.int64).astype(U64)
FLIPS, FACTORS = _random[0], _random[1] | U64(1)
FACTOR = 0xD6E8FEB86659FD93
SET_KEYS = (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))


def shingles(texts: list[bytes | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, those of text i at first[i] .. first[i + 1] - 1, in rising order."""
    w = Words(texts, SPACES, lower=True)
    hashes, _ = w.hashes()
    at, grams = w.grams(hashes, n, FACTOR)
    doc = w.docs()[at] if len(w) else at
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = np.concatenate([gram_values(hashes, w.first[[d]], int(w.counts[d]), FACTOR) for d in short])
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def fingerprints(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each set (two numbers), and its positional bytes (one row a text)."""
    n = len(first) - 1
    keys, places = np.zeros((n, 2), U64), np.zeros((n, BYTES), np.uint8)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        heads = first[:-1][full]
        with np.errstate(over="ignore"):
            for i, key in enumerate(SET_KEYS):
                keys[full, i] = mix(np.add.reduceat(mix(grams ^ key), heads) + np.diff(first)[full].astype(U64))
            for k in range(BYTES):
                least = np.minimum.reduceat((grams ^ FLIPS[k]) * FACTORS[k], heads)
                places[full, k] = (mix(least) >> U64(56)).astype(np.uint8)
    return keys, places


@F.arrow_udf(T.StructType([T.StructField("f", T.BinaryType()), T.StructField("places", T.BinaryType())]))
def _fingerprint(col: pa.Array) -> pa.Array:
    keys, places = [], []
    for _, part in text_chunks(col.cast(pa.binary()).to_pylist(), CHUNK):
        k, p = fingerprints(*shingles(part))
        keys += [x.tobytes() for x in k]
        places += [x.tobytes() for x in p]
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.binary())], ["f", "places"])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (rising arrays) have at least that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def linked(texts: list[bytes | None], least: float = LEAST, parts: list | None = None) -> list[int]:
    """For each text the first one that verified links reach. parts: texts of one part are linked already."""
    sets, places = [], []
    for _, some in text_chunks(texts, CHUNK):
        grams, first = shingles(some)
        places.append(fingerprints(grams, first)[1])
        sets += [grams[first[i] : first[i + 1]].copy() for i in range(len(some))]
    places = np.concatenate(places)
    part = np.unique(parts, return_inverse=True)[1] if parts is not None else np.arange(len(sets))
    root, waiting = [-1] * len(sets), np.arange(len(sets))
    for i in range(len(sets)):
        if root[i] >= 0:
            continue
        root[i], front = i, [i]
        waiting = waiting[waiting != i]
        while front and len(waiting):
            x = front.pop()
            near = (places[waiting] == places[x]).sum(1) >= MIN_SHARED
            reached = part[waiting] == part[x]
            reached[near] |= np.array([similar(sets[x], sets[y], least) for y in waiting[near].tolist()], bool)
            for y in waiting[reached].tolist():
                root[y] = i
                front.append(y)
            waiting = waiting[~reached]
    return root


def _verified(least: float):
    """Partitions sorted by block and set to edges (g, u, v): a spanning tree of each block's links."""

    def block(g: bytes, fs: list[bytes], texts: list[bytes], parts: list[bytes]) -> pa.RecordBatch:
        pairs = [(fs[i], fs[r]) for i, r in enumerate(linked(texts, least, parts)) if i != r]
        us, vs = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array([g] * len(us), pa.binary()), pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["g", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fs, texts, parts = None, [], [], []
        for b in batches:
            columns = (b["g"].to_pylist(), b["block"].to_pylist(), b["f"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["part"].to_pylist())
            for g, k, f, text, part in zip(*columns, strict=True):
                if (g, k) != now and fs:
                    yield block(now[0], fs, texts, parts)
                    fs, texts, parts = [], [], []
                now = g, k
                if not fs or fs[-1] != f:  # the first text of a group comes to its own block twice
                    fs.append(f)
                    texts.append(text)
                    parts.append(part)
        if fs:
            yield block(now[0], fs, texts, parts)

    return run


def _block_links(members: DataFrame, texts: DataFrame, least: float, name: str) -> DataFrame:
    """Edges (g, u, v) of the links inside each block of members (g, block, f, part, KEY)."""
    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = texts.join(members, rowkeys.KEY).select("g", "block", "f", "text", "part")
    return written(rows.repartition(n, "g", "block").sortWithinPartitions("g", "block", "f").mapInArrow(_verified(least), "g binary, u binary, v binary"), name)


def candidate_groups(prints: DataFrame) -> DataFrame:
    """(f, g): texts that hang together by postings, and the smallest f of their group. prints: (f, places), written."""
    stretch = lambda i: F.xxhash64(F.lit(i), F.substring("places", i * RUN + 1, RUN))
    postings = prints.select("f", "places").dropDuplicates(["f"]).select("f", F.explode(F.array(*[stretch(i) for i in range(BYTES // RUN)])).alias("posting"))
    # Only postings of two texts or more go on; each of their texts hangs on the smallest.
    firsts = written(postings.groupBy("posting").agg(F.min("f").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"), "postings")
    edges = postings.join(firsts, "posting").where("f <> v").select(F.col("f").alias("u"), "v")
    return written(components(edges).select(F.col("node").alias("f"), F.col("root").alias("g")), "candidate-groups")


def roots_of(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(f, root) of the texts that verified links join to others. members: (f, g, n_bytes, KEY), written."""
    several = members.groupBy("g").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    several = several.withColumn("blocks", F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("b") / BLOCK_BYTES)).cast("int")).where("blocks > 1")
    several = written(several.select("g", "blocks"), "several-blocks")
    own = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    blocked = members.join(several, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.when(F.col("blocks") > 1, own).otherwise(0))
    one_part = F.col("f").alias("part")  # nothing is linked yet
    columns = ["g", "block", "f", one_part, *rowkeys.KEY]
    first = blocked.where("f = g and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = _block_links(blocked.select(*columns).unionByName(first.select(*columns)), texts, least, "block-links")
    if several.isEmpty():
        return links.select(F.col("u").alias("f"), F.col("v").alias("root"))
    roots = written(components(links.select("u", "v")).select(F.col("node").alias("f"), "root"), "block-roots")
    # Groups that are still in several parts: their blocks two at a time, parts taken as they are.
    parts = written(blocked.where("blocks > 1").join(roots, "f", "left").withColumn("part", F.coalesce("root", "f")), "parts")
    apart = written(parts.groupBy("g").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("g"), "apart")
    if apart.isEmpty():
        return roots
    pairs = parts.join(apart, "g").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    pairs = pairs.withColumn("block", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    more = _block_links(pairs.select("g", "block", "f", "part", *rowkeys.KEY), texts, least, "pair-links")
    return components(links.unionByName(more).select("u", "v")).select(F.col("node").alias("f"), "root")


def one_of_each(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which one stands for each group of linked texts: that with the smallest doc_id (null last)."""
    if least < LEAST:
        raise ValueError(f"the index is made for similarities of {LEAST} or more")
    s, whole = F.col("s"), rowkeys.keyed(docs)
    prints = whole.select(F.col(doc_id).alias("doc_id"), *rowkeys.KEY, F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"), _fingerprint(F.col(text)).alias("s"))
    prints = written(prints.select("doc_id", *rowkeys.KEY, "n_bytes", s["f"].alias("f"), s["places"].alias("places")), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *rowkeys.KEY, "n_bytes")
    # Texts with equal sets are one member before any join.
    firsts = written(prints.groupBy("f").agg(F.min(rank).alias("k")), "members")
    members = firsts.join(candidate_groups(prints), "f").select("f", "g", "k.n_bytes", *[F.col(f"k.{k}").alias(k) for k in rowkeys.KEY])
    texts = whole.select(*rowkeys.KEY, F.col(text).alias("text"))
    roots = roots_of(written(members, "grouped"), texts, least)
    keep = firsts.join(roots, "f", "left").groupBy(F.coalesce("root", "f").alias("root")).agg(F.min("k").alias("k"))
    keep = written(keep.select(*[F.col(f"k.{k}").alias(k) for k in rowkeys.KEY]), "kept")
    return whole.join(keep, rowkeys.KEY, "left_semi").dropDuplicates(rowkeys.KEY).select(*[F.col(f"`{c}`") for c in docs.columns])
