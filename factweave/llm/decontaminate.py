"""Benchmark decontamination by an FM-index per training shard.

A shard is a bounded run of documents inside one task. Words that no benchmark phrase has end a
phrase, so they become separators, and stretches between separators shorter than the shortest
phrase are left out; neither changes what can be found. Over the rest a suffix array is sorted by
prefix doubling, its Burrows-Wheeler transform goes into a wavelet matrix, all phrases are
backward-searched together through its ranks, and occurrences are located by walking to sampled
suffix positions. Hit words are merged into removal spans.

Words are told apart by their bytes. Benchmark phrases travel to the tasks in blocks of at most BLOCK_BYTES of item
text (a longer item is a block), one after the other: each block's hits are written before the next block is collected, so
driver and executors hold one block at a time however large the benchmark is.

Edge cases: null texts and texts without words have no hits; items without words match nothing;
repeated items (equal id) count once; items with a null id count for hits, not in items; repeated rows are judged
alike; columns of any names are kept, one named like the result is replaced; an empty table gives no rows, an empty
benchmark no hits. Texts of any length are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rowkeys
from .shared import shared_folder, written
from .words import NON_ALNUM, U64, Words, covered, per_doc, text_chunks

SHARD = 4 << 20
BLOCK_BYTES = 4 << 20
SAMPLE = 8
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("words", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


class Phrases:
    """Distinct benchmark windows as rows of word numbers (from 1), right-aligned and zero-padded."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        w = Words([t for _, t in items], NON_ALNUM, lower=True)
        numbers, self.vocabulary = w.numbered()
        doc = w.docs()
        counts = w.counts[doc]
        heads = np.flatnonzero(np.arange(len(w)) - w.first[doc] <= np.maximum(counts - window, 0))
        missing = window - np.minimum(counts[heads], window)
        rows = np.zeros((len(heads), window), np.int32)
        for k in range(window):
            on = np.flatnonzero(missing <= k)
            rows[on, k] = numbers[heads[on] + k - missing[on]] + 1
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(1)
        names: list[set] = [set() for _ in self.rows]
        for p, d in zip(which.ravel().tolist(), doc[heads].tolist(), strict=True):
            names[p].add(items[d][0])
        self.items = [tuple(sorted(x for x in own if x is not None)) for own in names]
        self.shortest = int(self.lengths.min()) if len(heads) else 0


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence given as ranks, by prefix doubling."""
    n, k = len(ranks), 1
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        keys = rank * (n + 1) + second
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            ones = (sequence >> b) & 1
            self.levels.append((b, len(ones) - int(ones.sum()), np.concatenate([[0], np.cumsum(ones)])))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        i, start = ends, np.zeros_like(ends)
        for b, zeros, ones in self.levels:
            one = ((symbols >> b) & 1).astype(bool)
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """Over a sequence of symbols; 0 separates and ends stretches that phrases can't cross."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        cuts = sequence == 0
        # Separators sort first and by position, so that suffixes differ at them at the latest.
        ranks = sequence + int(cuts.sum())
        ranks[cuts] = np.arange(int(cuts.sum()))
        order = suffix_array(ranks)
        self.last = sequence[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols + 1))])
        self.matrix = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        # Sampled: every SAMPLE-th position, and the first of each stretch so that no walk leaves it.
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.at = np.where(self.sampled, order, -1)

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.matrix.rank(symbols, rows)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that each phrase (right-aligned) begins."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((phrases[:, k] > 0) & (low < high))
            if len(on):
                c = phrases[on, k]
                low[on], high[on] = self.step(c, low[on]), self.step(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            rows[open_] = self.step(self.last[rows[open_]], rows[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.at[rows] + walked


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[Words, np.ndarray, list[list[str]]]:
    """The shard's words, which of them are hit, and each text's item ids."""
    w = Words(texts, NON_ALNUM, lower=True)
    hit, items = np.zeros(len(w), bool), [[] for _ in texts]
    if not len(w) or not phrases.shortest:
        return w, hit, items
    doc = w.docs()
    own, words = w.numbered()
    # Words are looked up by their bytes; 0 is a word that no phrase has.
    numbers = (pc.index_in(words, value_set=phrases.vocabulary).fill_null(-1).to_numpy().astype(np.int64) + 1)[own]
    known = numbers > 0
    # Stretches of known words inside one document.
    fresh = np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])]) & known
    stretch = np.cumsum(fresh) - 1
    lengths = np.bincount(stretch[known], minlength=int(fresh.sum())) if known.any() else np.zeros(0, np.int64)
    keep = known.copy()
    keep[known] = lengths[stretch[known]] >= phrases.shortest
    place = np.flatnonzero(keep)
    if not len(place):
        return w, hit, items
    head = fresh[place]
    target = np.arange(len(place)) + np.cumsum(head)
    sequence = np.zeros(len(place) + int(head.sum()) + 1, np.int64)
    word_at = np.full(len(sequence), -1, np.int64)
    sequence[target], word_at[target] = numbers[place], place
    index = FMIndex(sequence, len(phrases.vocabulary))
    low, high = index.search(phrases.rows)
    found = np.flatnonzero(high > low)
    if not len(found):
        return w, hit, items
    sizes = (high - low)[found]
    which = np.repeat(found, sizes)
    rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[found], sizes)
    begin = word_at[index.locate(rows)]
    hit = covered(len(w), begin, begin + phrases.lengths[which])
    pairs = np.unique(doc[begin] * len(phrases.lengths) + which)
    for d, p in zip(*divmod(pairs, len(phrases.lengths)), strict=True):
        items[d].extend(phrases.items[p])
    return w, hit, [sorted(set(x)) for x in items]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "hits") -> DataFrame:
    """docs with a struct column ``into`` of HITS: counts of words and hit words, merged removal
    spans in bytes and in words, and the ids (as strings, sorted) of the items found."""
    slim = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("t")).where("t is not null").distinct()
    total = slim.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks, context = max(1, -(-total // BLOCK_BYTES)), docs.sparkSession.sparkContext

    def sent(block: int):
        own = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block)
        return context.broadcast(Phrases([(r.id, bytes(r.t)) for r in own.toLocalIterator()], window))

    if blocks == 1:
        return docs.withColumn(into, _searched(sent(0))(F.col(text)))
    schema = T.StructType([*(T.StructField(k, T.LongType()) for k in rowkeys.KEY), HITS["words"], HITS["items"], T.StructField("block", T.IntegerType())])
    whole, path = rowkeys.keyed(docs), shared_folder(docs.sparkSession, "hits")
    for b in range(blocks):
        phrases = sent(b)
        hits = whole.select(*rowkeys.KEY, _searched(phrases)(F.col(text)).alias("h")).where("h.n_hit > 0")
        hits.select(*rowkeys.KEY, "h.words", "h.items").write.parquet(f"{path}/block={b}")
        phrases.destroy()
    # One row of hits a block for each text that has any; spans of several blocks are merged where they touch or overlap.
    parts = docs.sparkSession.read.schema(schema).parquet(path).dropDuplicates([*rowkeys.KEY, "block"]).groupBy(*rowkeys.KEY).agg(F.collect_list(F.struct("words", "items")).alias("__parts"))
    joined = whole.join(written(parts, "hit-parts"), rowkeys.KEY, "left")
    return joined.withColumn(into, _merged(F.col(text), F.col("__parts"))).drop("__parts", *rowkeys.KEY)


def _rows(texts, found) -> pa.Array:
    """Arrow rows of HITS from (words, hit flags, items) by shard."""
    out = []
    for w, hit, items in found:
        n_hit = per_doc(hit, w.first)
        for d in range(len(w.counts)):
            row = {"n_words": int(w.counts[d]), "n_hit": int(n_hit[d]), "spans": [], "words": [], "items": items[d]}
            if n_hit[d]:
                f = w.first[d]
                for s, e in zip(*_spans(hit[f : w.first[d + 1]]), strict=True):
                    row["words"].append({"start": int(s), "stop": int(e)})
                    row["spans"].append({"start": int(w.starts[f + s] - w.offsets[d]), "stop": int(w.ends[f + e - 1] - w.offsets[d])})
            out.append(row)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", span), ("words", span), ("items", pa.list_(pa.string()))]))


def _searched(phrases):
    # Called nondeterministic so that a filter on the result doesn't make Spark search twice.
    @F.arrow_udf(HITS)
    def searched(col: pa.Array) -> pa.Array:
        texts = col.cast(pa.binary()).to_pylist()
        return _rows(texts, (search_shard(part, phrases.value) for _, part in text_chunks(texts, SHARD)))

    return searched.asNondeterministic()


@F.arrow_udf(HITS)
def _merged(col: pa.Array, blocks: pa.Array) -> pa.Array:
    found = []
    for t, parts in zip(col.cast(pa.binary()).to_pylist(), blocks.to_pylist(), strict=True):
        w = Words([t], NON_ALNUM, lower=True)
        hit = np.zeros(len(w), bool)
        for p in parts or ():
            for s in p["words"]:
                hit[s["start"] : s["stop"]] = True
        found.append((w, hit, [sorted({x for p in parts or () for x in p["items"]})]))
    return _rows(None, found)


@F.arrow_udf(T.StringType())
def _cut(col: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, cuts in zip(col.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
        for s in reversed(cuts or []):
            t = t[: s["start"]] + t[s["stop"] :]
        out.append(t)
    return pa.array(out, pa.binary()).cast(pa.string())


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its removal spans; unchanged where there are none."""
    return F.when(F.size(spans) > 0, _cut(text, spans)).otherwise(text)


def contaminated(hits: Column) -> Column:
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])
