"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints at ``max_bits`` <= 4 differing bits share
at least 8 - 4 = 4 of them. The positions fall into groups of 3, 3 and 2; four shared bytes put
two into one group, so each linked pair shares a posting of the inverted index whose key is a
pair of positions of one group with their two byte values (seven postings a fingerprint). Inside a
posting, shared positional bytes are tallied for each pair, pairs below the guaranteed minimum go,
and the rest are verified by counting differing bits.

A posting is held in one task as eight bytes a distinct fingerprint. Its size is bounded by the fingerprints that
share two bytes, about one in 65,536 of all; linked ones don't add to it without end, as a ball of 4 bits holds 679,121 fingerprints.
Postings longer than ``SPLIT`` are split by a further position: members that are linked share four
bytes, of which at most two are in the key, so each pair meets again in a smaller posting. No pair
table is emitted: a posting returns at most one edge less than it has members (a spanning forest of
its links), which keeps all components. Equal fingerprints are one member.

Components are found on nodes that begin with the smallest doc_id of a fingerprint, so the smallest node of a
component is its name and no join gathers a large component's rows in one task.

Edge cases: null, empty and word-free texts have fingerprint zero and link like any other; a null
doc_id never names a component unless all its members' are null; repeated rows get equal results; rows that share an
id rank by the hash of all their columns; columns of any names are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rowkeys
from .components import components
from .shared import written
from .words import LOWER, text_chunks

SEED = 42
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
KEYS = [(a, b) for g in GROUPS for i, a in enumerate(g) for b in g[i + 1 :]]
SPLIT = 2048
CHUNK = 1 << 20


def fingerprints(texts: list[bytes | None], shingle: int = 4) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    hashed, sizes = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.translate(LOWER).split() if t else []
        if words:
            line = b" ".join(words)
            k = min(shingle, len(words))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashed += [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
            sizes[i] = len(words) - k + 1
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.array(hashed, np.uint64)
        heads = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), heads)
            out[full] |= (2 * ones.astype(np.int64) > sizes[full]).astype(np.uint64) << np.uint64(bit)
    return out


@F.arrow_udf(T.LongType())
def _fingerprint(col: pa.Array) -> pa.Array:
    texts = col.cast(pa.binary()).to_pylist()
    parts = [fingerprints(part) for _, part in text_chunks(texts, CHUNK)]
    return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint's 64 bits as a long."""
    return _fingerprint(text)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes agree, from the exclusive or."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8) == 0).sum(1)


class _Forest:
    """Union-find over the fingerprints of one posting."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def posting_links(f: np.ndarray, used: tuple[int, ...], max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what is linked among distinct fingerprints that agree in the used positions."""
    if len(f) > SPLIT and len(used) < 8 - max_bits:
        # Linked members share one more position at least: every posting by another position, as
        # long as the bytes differ enough there to make the parts smaller.
        view = np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8)
        others = [p for p in range(8) if p not in used]
        if all(2 * np.bincount(view[:, p]).max() <= len(f) for p in others):
            for p in others:
                order = np.argsort(view[:, p], kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(view[order, p])) + 1):
                    if len(part) > 1:
                        yield from posting_links(f[part], (*used, p), max_bits)
            return
    # Breadth first: each member is held against those that nothing has reached yet, and what it
    # reaches leaves them, so that dense groups shrink at once.
    waiting = f
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            x = waiting ^ (at := front.pop())
            near = _shared_bytes(x) >= 8 - max_bits
            near[near] = _bits(x[near]) <= max_bits
            if near.any():
                reached, waiting = waiting[near], waiting[~near]
                front += list(reached)
                for r in reached.tolist():
                    yield int(at), r


def _postings(max_bits: int):
    """Partitions sorted by (slot, key) to spanning edges of each posting."""

    def run(batches):
        held = []  # stretches of the posting that isn't at its end yet
        for b in batches:
            part = tuple(b[c].to_numpy(zero_copy_only=False) for c in ("slot", "key", "f"))
            if not len(part[0]):
                continue
            cuts = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1
            if held and (held[-1][0][-1], held[-1][1][-1]) != (part[0][0], part[1][0]):
                cuts = np.concatenate([[0], cuts])
            if not len(cuts):
                held.append(part)
                continue
            done = [np.concatenate(x) for x in zip(*held, tuple(x[: cuts[-1]] for x in part), strict=True)]
            before = sum(len(h[0]) for h in held)
            held = [tuple(x[cuts[-1] :] for x in part)]
            yield _edges(done[0], before + cuts[:-1], done[2], max_bits)
        if held:
            yield _edges(np.concatenate([h[0] for h in held]), np.zeros(0, int), np.concatenate([h[2] for h in held]), max_bits)

    return run


def _edges(slot: np.ndarray, cuts: np.ndarray, f: np.ndarray, max_bits: int) -> pa.RecordBatch:
    us, vs = [], []
    f = f.view(np.uint64)
    heads, stops = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(f)]]).astype(int)
    sizes = stops - heads
    forest = _Forest()

    def add(pairs):
        for a, b in pairs:
            if forest.join(a, b):
                us.append(a)
                vs.append(b)

    # Short postings all at once, by the distance of two members; long ones each by itself.
    short = np.repeat(sizes <= 64, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for lag in range(1, min(64, int(sizes[sizes <= 64].max(initial=0)))):
        i = np.flatnonzero(short[:-lag] & (group[:-lag] == group[lag:]))
        x = f[i] ^ f[i + lag]
        near = _shared_bytes(x) >= 8 - max_bits if len(x) else np.zeros(0, bool)
        i = i[near]
        i = i[_bits(x[near]) <= max_bits]
        add(zip(f[i].tolist(), f[i + lag].tolist(), strict=True))
    for g in np.flatnonzero(sizes > 64):
        add(posting_links(f[heads[g] : stops[g]], KEYS[int(slot[heads[g]])], max_bits))
    to = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([to(us), to(vs)], names=["u", "v"])


def near_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints in column ``f`` as all their links do."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees two shared bytes in one group up to 4 bits only")
    spark = prints.sparkSession
    byte = lambda p: F.shiftrightunsigned("f", 8 * p).bitwiseAND(F.lit(255))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), (byte(a) * 256 + byte(b)).cast("int").alias("key")) for i, (a, b) in enumerate(KEYS)])
    rows = prints.select("f").select("f", F.explode(slots).alias("s")).select("s.slot", "s.key", "f")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "slot", "key").sortWithinPartitions("slot", "key").mapInArrow(_postings(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, KEY, f, component_id) for each row of docs: the key of its columns, its fingerprint and the
    smallest doc_id that links reach."""
    whole = rowkeys.keyed(docs)
    prints = written(whole.select(F.col(doc_id).alias("doc_id"), *rowkeys.KEY, fingerprint(F.col(text)).alias("f")), "prints")
    # Exact copies are reduced to their smallest id before any join.
    nodes = written(prints.groupBy("f").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m")), "nodes")
    nodes = nodes.select("f", F.struct("m.none", "m.doc_id", "f").alias("node"))
    links = written(near_links(nodes.select("f"), max_bits).distinct(), "near-links")
    side = lambda c: nodes.select(F.col("f").alias(c), F.col("node").alias(f"{c}_node"))
    edges = links.join(side("u"), "u").join(side("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    roots = components(edges).select(F.col("node.f").alias("f"), F.col("root.doc_id").alias("name"), F.lit(True).alias("linked"))
    named = nodes.join(roots, "f", "left").select("f", F.when(F.col("linked"), F.col("name")).otherwise(F.col("node.doc_id")).alias("component_id"))
    return prints.join(written(named, "named"), "f", "left").select("doc_id", *rowkeys.KEY, "f", "component_id")


def hex_digits(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def one_of_each(docs: DataFrame, max_bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which one stands for each group: that with the smallest doc_id (null last)."""
    groups = near_duplicates(docs, max_bits, doc_id, text)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *rowkeys.KEY)
    # Without any doc_id a component has no name; its fingerprints then stand for themselves.
    keep = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("f")).alias("own")).agg(F.min(rank).alias("k"))
    keep = written(keep.select(*[F.col(f"k.{k}").alias(k) for k in rowkeys.KEY]), "kept")
    return rowkeys.keyed(docs).join(keep, rowkeys.KEY, "left_semi").dropDuplicates(rowkeys.KEY).select(*[F.col(f"`{c}`") for c in docs.columns])
