"""Substring deduplication with a log-structured fingerprint index.

The index is a set of immutable runs. A run holds, by bucket (the top bits of a fingerprint),
the sorted fingerprints of the word windows of the documents that it took in. Neighbouring buckets share a slot, which is
one file with a row group for each bucket (small ones share it); a bucket's task reads its own from where it lies (runs never travel). A new batch of documents
is split into chunks; each chunk sends, once for each distinct window, a fingerprint to its bucket.
There the batch is sorted, merge-joined with the runs, and each window that history holds, or that
a smaller doc_id of the batch holds, is reported back to its chunk. The bucket's new fingerprints
become the batch's run. When ``fanout`` runs are live, the batch's job writes one merged run
instead, which replaces them (compaction).

Matches are verified by a second fingerprint that travels with the first and is made of other word hashes (the two
halves of each word's 128-bit XXH3 digest): 96 bits decide. For 10^13 windows the expected number of false matches is below 0.001.

Batches must come in ascending doc_id ranges (``deduplicate`` cuts them so): history then only
holds smaller ids. Hot windows are reduced before the shuffle to one row per chunk.

Edge cases: null and empty texts have no windows; a null doc_id ranks after all others and such rows
never remove from each other; rows that share a doc_id don't remove from each other, equal ones get equal results; ids that
aren't whole numbers are numbered in their order first; columns of any names are kept, one named like the result is
replaced; an empty table gives no rows; texts of any length are taken whole. Input must
read the same way twice (a scan or a written table).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import delete, release, shared_folder, written
from .words import SPACES, U64, Words, chunked, covered, gram_values

CHUNK = 4 << 20
BUCKET = 4 << 20  # bytes of text whose windows share a bucket, about
SLOT_BITS = 4  # a slot holds so many buckets, as a power of 2 ...
SLOTS_BITS = 5  # ... as far as this power of slots is left
ROW_GROUP = 1 << 20  # bytes, from which a file's next row begins a row group; a larger row has its own
SECOND = 0xC2B2AE3D27D4EB4F
LAST = (1 << 63) - 1  # a null doc_id
ROWS = "kind string, bucket int, chunk string, n long, a binary, b binary, c binary, d binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned values, one plane for each byte, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_rising(blob: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 4]
    names = ["kind", "bucket", "chunk", "n", "a", "b", "c", "d"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def _chunk_rows(docs: list[tuple], window: int, bits: int) -> list[tuple]:
    """A chunk's windows by bucket, and one row that says which positions belong to which document."""
    docs.sort(key=lambda r: (r[0], r[1]))
    w = Words([r[2] for r in docs], SPACES)
    ids = np.array([r[0] for r in docs], np.int64)
    keys = np.array([r[1] for r in docs], np.int64)
    name = hashlib.blake2b(ids.tobytes() + keys.tobytes(), digest_size=12).hexdigest()
    h, h2 = w.hashes()
    at, one = w.grams(h, window)
    if not len(at):
        return []
    doc = ids[w.docs()[at]]
    order = np.argsort(one, kind="stable")  # equal fingerprints stay in the order of doc_id
    new = np.concatenate([[True], np.diff(one[order]) != 0])
    smallest = doc[order][new][np.cumsum(new) - 1]
    mine = np.empty(len(at), bool)
    mine[order] = doc[order] == smallest
    # Later documents of the chunk already know; only the first document's windows travel.
    known = at[~mine]
    at, one, doc = at[mine], one[mine], doc[mine]
    two = (gram_values(h2, at, window, SECOND) >> U64(32)).astype(np.uint32)
    bucket = (one >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    rows = [("doc", int(name[:8], 16) % (1 << bits), name, len(docs), ids.tobytes(), keys.tobytes(), w.first.astype(np.int64).tobytes(), pack_rising(known.astype(np.uint32)) if len(known) else None)]
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        own, counts = np.unique(doc[part], return_counts=True)
        owners = pack_rising(own.astype(np.uint64)) + b"|split|" + pack(counts.astype(np.uint32))
        rows.append(("new", int(bucket[part[0]]), name, len(part), pack(one[part]), pack(two[part]), pack_rising(at[part].astype(np.uint32)), owners))
    return rows


def _fingerprints(window: int, bits: int):
    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b["doc_id"].to_pylist(), b["key"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True)

        for part in chunked(rows(), lambda r: len(r[2] or b"") + 1, CHUNK):
            yield _table(_chunk_rows(part, window, bits))

    return run


def _merge_join(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the batch's distinct (a, b) a run (x, y) holds, both rising by a and x: one walk over the merged keys."""
    held = np.zeros(len(a), bool)
    keys, second = np.concatenate([x, a]), np.concatenate([y, b])
    order = np.argsort(keys, kind="stable")  # merges the two sorted stretches, the run's first among equals
    keys, second, mine = keys[order], second[order], order >= len(x)
    lag = 1
    while len(keys) > lag and (same := keys[lag:] == keys[:-lag]).any():
        hit = same & mine[lag:] & ~mine[:-lag] & (second[lag:] == second[:-lag])
        held[order[lag:][hit] - len(x)] = True
        lag += 1
    return held


def _stored(runs: list[str], slot: int, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bucket's part of each run, read from where it lies."""
    for run in runs:
        store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", f"{run}/slot={slot}"))
        if store.get_file_info(path).type == fs.FileType.Directory:
            for row in ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["a", "b"], filter=ds.field("bucket") == bucket).to_pylist():
                yield unpack_rising(row["a"], "u8"), unpack(row["b"], "u4")


def _merge(stored: list[str], whole: bool):
    """One bucket: the batch's windows against its own smaller ids and the runs' fingerprints.
    whole: the bucket's new run takes in the stored ones."""

    def run(group):
        slot = group["slot"][0].as_py()
        rows = group.drop_columns("slot").to_pylist()
        news = [r for r in rows if r["kind"] == "new"]
        runs = list(_stored(stored, slot, rows[0]["bucket"]))
        out = [tuple(r.values()) for r in rows if r["kind"] == "doc"]
        if news:
            one, two, doc = (np.concatenate(x) for x in zip(*map(_windows, news), strict=True))
            order = np.argsort(one)
            same = np.diff(one[order]) == 0
            if (same & (np.diff(two[order].astype(np.int64)) != 0)).any():
                order = np.lexsort((two, one))
            new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order].astype(np.int64)) != 0)])
            heads = np.flatnonzero(new)
            a, b = one[order][heads], two[order][heads]
            smallest = np.minimum.reduceat(doc[order], heads)
            old = np.zeros(len(a), bool)
            for x, y in runs:
                old |= _merge_join(a, b, x, y)
            group_of = np.cumsum(new) - 1
            flagged = np.empty(len(one), bool)
            flagged[order] = old[group_of] | (doc[order] > smallest[group_of])
            at = 0
            for r in news:
                hits = np.flatnonzero(flagged[at : at + r["n"]])
                at += r["n"]
                if len(hits):
                    positions = unpack_rising(r["c"], "u4")[hits]
                    out.append(("hit", r["bucket"], r["chunk"], len(hits), pack_rising(positions), None, None, None))
            runs.append((a[~old], b[~old]))
        if runs and (whole or news):
            kept = runs if whole else runs[-1:]
            a, b = np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
            order = np.argsort(a)
            if len(a):
                out.append(("run", rows[0]["bucket"], None, len(a), pack_rising(a[order]), pack(b[order]), None, None))
        return pa.Table.from_batches([_table(out)])

    return run


def _windows(row: dict) -> tuple:
    own, counts = row["d"].split(b"|split|", 1) if row["d"].count(b"|split|") == 1 else _split_exact(row)
    return unpack(row["a"], "u8"), unpack(row["b"], "u4"), np.repeat(unpack_rising(own, "u8").astype(np.int64), unpack(counts, "u4"))


def _split_exact(row: dict) -> tuple[bytes, bytes]:
    """The mark also came up inside a compressed part: take the cut at which all windows are told of."""
    parts = row["d"].split(b"|split|")
    for k in range(1, len(parts)):
        own, counts = b"|split|".join(parts[:k]), b"|split|".join(parts[k:])
        try:
            if int(unpack(counts, "u4").sum()) == row["n"] and len(unpack(own, "u8")) == len(unpack(counts, "u4")):
                return own, counts
        except (zstandard.ZstdError, ValueError):
            continue
    raise ValueError("a block of windows can't be read")


def _by_document(group):
    """The flagged windows of one chunk, as one list of word positions for each document."""
    rows = group.to_pylist()
    head = next((r for r in rows if r["kind"] == "doc"), None)
    ids, keys, found = [], [], []
    if head:
        flags = [unpack_rising(r["a"], "u4") for r in rows if r["kind"] == "hit"]
        if head["d"]:
            flags.append(unpack_rising(head["d"], "u4"))
        at = np.sort(np.concatenate(flags)).astype(np.int64) if flags else np.zeros(0, np.int64)
        first = np.frombuffer(head["c"], np.int64)
        cuts = np.searchsorted(at, first)
        for d in np.flatnonzero(np.diff(cuts)):
            ids.append(int(np.frombuffer(head["a"], np.int64)[d]))
            keys.append(int(np.frombuffer(head["b"], np.int64)[d]))
            found.append(pack_rising((at[cuts[d] : cuts[d + 1]] - first[d]).astype(np.uint32)))
    return pa.table({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "windows": pa.array(found, pa.binary())})


class FingerprintIndex:
    """The log-structured index in a folder; ``add`` deduplicates a batch against it and itself."""

    def __init__(self, spark: SparkSession, path: str, window: int = 13, buckets: int = 256, fanout: int = 3):
        self.spark, self.path, self.window, self.fanout = spark, path, window, fanout
        self.bits = max(0, math.ceil(math.log2(max(1, buckets))))
        self.shared_bits = max(0, min(SLOT_BITS, self.bits - SLOTS_BITS))
        self.runs: list[str] = []
        self.batches = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id not null, key, text) join the index. Returns (id, key, windows): word positions,
        packed, at which windows start that a smaller doc_id has."""
        fresh = docs.select("doc_id", "key", "text").mapInArrow(_fingerprints(self.window, self.bits), ROWS)
        whole = len(self.runs) + 1 >= self.fanout
        if whole:
            # A bucket without new windows is merged as well.
            every = self.spark.range(1 << self.bits).select(F.lit("all").alias("kind"), F.col("id").cast("int").alias("bucket"))
            fresh = fresh.unionByName(every, allowMissingColumns=True)
        out = f"{self.path}/batch-{self.batches:05d}"
        slot = F.shiftright("bucket", self.shared_bits)
        # A slot's buckets are one task's, group after group, so that a run has one file for each slot.
        merged = fresh.withColumn("slot", slot).repartitionById(1 << self.bits - self.shared_bits, "slot").groupBy("slot", "bucket").applyInArrow(_merge(self.runs, whole), ROWS)
        kept = merged.withColumn("slot", F.when(F.col("kind") == "run", slot).otherwise(-1))
        kept.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 1).partitionBy("slot").parquet(out)
        stale, self.runs = (self.runs, [out]) if whole else ([], [*self.runs, out])
        flags = f"{self.path}/flags-{self.batches:05d}"
        # Several chunks can hold equal (doc_id, text) rows; which of them speaks makes no difference.
        self.spark.read.schema(f"{ROWS}, slot int").parquet(out).where("slot = -1").groupBy("chunk").applyInArrow(_by_document, "id long, key long, windows binary").write.parquet(flags)
        for s in stale:
            delete(self.spark, s)
        self.batches += 1
        release(self.spark)
        return self.spark.read.schema("id long, key long, windows binary").parquet(flags)


def _batches(docs: DataFrame, batches: int) -> tuple[list, int]:
    """Inclusive doc_id bounds of the batches, and the bytes of text."""
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)]).alias("q"), F.sum(F.octet_length("text")).alias("n")).first()
    return sorted(set(cuts.q or [])), cuts.n or 0


def deduplicate(docs: DataFrame, window: int = 13, batches: int = 4, fanout: int = 3, doc_id: str = "doc_id", text: str = "text", into: str = "dedup") -> DataFrame:
    """docs with a struct column ``into``: n_words, n_removed, kept (the words that stay, joined by one
    space; null for a null text). Documents are added to a new index in ``batches`` rising doc_id
    ranges; a word goes if a window over it also starts in a document with a smaller doc_id."""
    spark = docs.sparkSession
    left = _numbered(docs, doc_id).withColumn("__text_key", F.xxhash64(text))
    slim = left.select(F.col("__number").alias("doc_id"), F.col("__text_key").alias("key"), F.col(text).alias("text"))
    bounds, size = _batches(slim, batches)
    index = FingerprintIndex(spark, shared_folder(spark, "substrings"), window, -(-size // BUCKET) or 1, fanout)
    flags = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = slim if low is None else slim.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        found = index.add(part)
        flags = found if flags is None else flags.unionByName(found)
    # A chunk learns of all smaller ids of its windows, so equal rows (doc_id and text) in several chunks know the same.
    flags = flags.groupBy(F.col("id").alias("__number"), F.col("key").alias("__text_key")).agg(F.max("windows").alias("__windows"))
    joined = left.join(flags, ["__number", "__text_key"], "left")
    return joined.withColumn(into, _removed(window)(F.col(text), F.col("__windows"))).drop("__number", "__text_key", "__windows")


def _numbered(docs: DataFrame, doc_id: str) -> DataFrame:
    """docs with __number: the doc_id if it is a whole number, else its place in the order of ids; LAST for null."""
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return docs.withColumn("__number", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)))
    ids = docs.select(F.col(doc_id).alias("__id")).where("__id is not null").distinct().sort("__id")
    ids = written(ids.withColumn("__number", F.monotonically_increasing_id()), "numbers")  # partitions rise as their ids do
    joined = docs.join(ids, F.col(f"`{doc_id}`") == F.col("__id"), "left").drop("__id")
    return written(joined.withColumn("__number", F.coalesce("__number", F.lit(LAST))), "numbered")


def _removed(window: int):
    @F.arrow_udf("n_words long, n_removed long, kept string")
    def removed(col: pa.Array, windows: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for t, blob in zip(col.cast(pa.binary()).to_pylist(), windows.to_pylist(), strict=True):
            words = (t or b"").split()
            n_words.append(len(words))
            gone = 0
            if blob:
                at = unpack_rising(blob, "u4").astype(np.int64)
                drop = covered(len(words), at, at + window)
                gone = int(drop.sum())
                words = [x for x, d in zip(words, drop.tolist(), strict=True) if not d]
            n_removed.append(gone)
            kept.append(None if t is None else b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    return removed
