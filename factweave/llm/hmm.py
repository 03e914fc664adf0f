"""Hidden Markov language model over words, trained by Baum-Welch.

Symbols: the commonest training words each have one, all other words fall into RARE classes by their ending, the end
of a text is one. There are TOP own words and GROWTH times the cube root of the texts' bytes more: 3,600 for 0.5 GB,
8,300 for 30 GB, 95,000 for 100 TB. A state emits a symbol; a word of a class then has
(c + 1) / (n + v + 1) of it (c: its training count, n and v: tokens and distinct words of the class),
so every word of any vocabulary has a probability and those of a text's words multiply to the text's.
The model grows slowly, so that it can be sent to all executors; the vocabulary's counts grow with it all and never leave them.

1. Documents are coded once into chunks (local word numbers, distinct words) in the shared folder.
2. Distinct words of each chunk go to hashed buckets, which add up all training counts and send
   each chunk the counts of its words.
3. Each Baum-Welch round reads the chunks, runs the scaled forward and backward recursions over whole texts and
   adds up expected counts across partitions. Texts of a chunk go side by side, one step of all of them at a
   time; forward vectors are kept for PIECE tokens at most and worked out again from the head of their piece, so a text
   of any length is trained on as one sequence in bounded memory.
4. Scoring runs the scaled forward recursion over whole texts: exact likelihoods.

Words are told apart by 64-bit hashes of their bytes. Edge cases: a null or empty text is the end token alone;
a null doc_id is a training row; ids of any type are kept; repeated rows count as often as they occur; equal counts at the
edge of the commonest words rank by hash; with no training rows all counts are 0 and scores stay finite; an empty
table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .substrings import pack, pack_rising, unpack, unpack_rising
from .words import SPACES, U64, Words, chunked, word_hashes

TOP, GROWTH, RARE, STATES = 2048, 2, 1024, 8
#: Symbols: the end, the classes, the words that have one of their own.
END, CLASS, OWN = 0, 1, 1 + RARE
CHUNK = 6 << 20
PIECE = 1 << 20  # tokens whose forward vectors are held at once
BUCKET = 4 << 20
CODED = "chunk string, ids array<string>, n binary, held binary, local binary, words binary, classes binary, counts binary"
COUNTED = "kind string, chunk string, bucket int, n long, counts binary, class_n array<long>, class_v array<long>, top array<struct<word:long,count:long,class:long>>"


def coded(docs: list[tuple]) -> dict:
    """One chunk of (doc_id, held, text)."""
    w = Words([r[2] for r in docs], SPACES, lower=True)
    held = np.array([r[1] for r in docs], bool)
    numbers, distinct = w.numbered()
    words, place = np.unique(word_hashes(distinct.to_pylist())[:, 0], return_inverse=True)
    local = place[numbers]
    last, second = w.bytes[w.ends - 1].astype(np.int64), w.bytes[np.maximum(w.ends - 2, 0)].astype(np.int64)
    second[w.ends - w.starts < 2] = 0
    classes = np.zeros(len(words), np.uint16)
    classes[local] = (last * 31 + second * 37) % RARE
    counts = np.bincount(local[~held[w.docs()]], minlength=len(words)).astype(np.uint32)
    return {
        "ids": [r[0] for r in docs], "n": pack(w.counts.astype(np.uint32)), "held": held.tobytes(), "local": pack(local.astype(np.uint32)),
        "words": pack_rising(words), "classes": pack(classes), "counts": pack(counts),
    }


def _code(batches):
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0

    def rows():
        for b in batches:
            yield from zip(b["doc_id"].to_pylist(), b["held"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True)

    for docs in chunked(rows(), lambda r: len(r[2] or b"") + 1, CHUNK):
        row = coded(docs) | {"chunk": f"{part}-{k}"}
        k += 1
        yield pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.string())), *((c, pa.binary()) for c in ("n", "held", "local", "words", "classes", "counts"))]))


def _by_bucket(bits: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                words, counts, classes = unpack_rising(r["words"], "u8"), unpack(r["counts"], "u4"), unpack(r["classes"], "u2")
                edges = np.searchsorted(words >> U64(64 - bits) if bits else np.zeros(len(words), U64), np.arange((1 << bits) + 1).astype(U64))
                out = [(k, r["chunk"], pack_rising(words[s:e]), pack(counts[s:e]), pack(classes[s:e])) for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if e > s]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "words", "counts", "classes"])

    return run


_COUNTED = pa.schema([("kind", pa.string()), ("chunk", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("counts", pa.binary()), ("class_n", pa.list_(pa.int64())), ("class_v", pa.list_(pa.int64())), ("top", pa.list_(pa.struct([("word", pa.int64()), ("count", pa.int64()), ("class", pa.int64())])))])


def _count(own_words: int):
    """A bucket's training counts, told to each chunk; sums by class; its commonest words."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        parts = [unpack_rising(r["words"], "u8") for r in rows]
        own = np.concatenate(parts)
        counts = np.concatenate([unpack(r["counts"], "u4") for r in rows]).astype(np.float64)
        words, where = np.unique(own, return_inverse=True)
        total = np.bincount(where, counts).astype(np.int64)
        classes = np.zeros(len(words), np.int64)
        classes[where] = np.concatenate([unpack(r["classes"], "u2") for r in rows])
        out, at = [], 0
        for r, p in zip(rows, parts, strict=True):
            out.append({"kind": "reply", "chunk": r["chunk"], "bucket": r["bucket"], "n": len(p), "counts": pack(total[where[at : at + len(p)]].astype(np.uint64))})
            at += len(p)
        seen = total > 0
        most = np.lexsort((words.view(np.int64), -total))[:own_words]  # ties in the same order as among buckets
        top = [{"word": w, "count": c, "class": k} for w, c, k in zip(words[most].view(np.int64).tolist(), total[most].tolist(), classes[most].tolist(), strict=True) if c]
        out.append({"kind": "sums", "n": int(total.sum()), "class_n": np.bincount(classes, total, RARE).astype(np.int64).tolist(), "class_v": np.bincount(classes[seen], minlength=RARE).tolist(), "top": top})
        return pa.Table.from_pylist(out, _COUNTED)

    return run


@dataclass
class Model:
    """top: fingerprints (sorted) and counts of the words with symbols of their own."""

    top: np.ndarray
    top_counts: np.ndarray
    class_n: np.ndarray  # tokens and distinct words of each class, without the top words
    class_v: np.ndarray
    tokens: int
    distinct: int
    ends: int
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # states x symbols

    def symbols(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Symbols of distinct words."""
        out = CLASS + classes.astype(np.int64)
        if len(self.top):
            slot = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
            out = np.where(self.top[slot] == words, OWN + slot, out)
        return out

    def in_class(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its symbol."""
        c = np.clip(symbols - CLASS, 0, RARE - 1)
        share = np.log10((counts + 1) / (self.class_n[c] + self.class_v[c] + 1))
        return np.where(symbols >= OWN, 0.0, share)


def first_model(sums: DataFrame, ends: int, own_words: int) -> Model:
    tops = sums.select(F.explode("top").alias("t")).select("t.*")
    # Counts that too few words reach to matter go first, so that not each partition sends its own_words rows to be merged.
    least, reached = 0, 0
    for r in tops.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(own_words).collect():
        least, reached = r["count"], reached + r.n
        if reached >= own_words:
            break
    top = tops.where(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(own_words).collect()
    by_class = {r[0]: (r[1], r[2]) for r in sums.select(F.posexplode(F.arrays_zip("class_n", "class_v")).alias("c", "x")).groupBy("c").agg(F.sum("x.class_n"), F.sum("x.class_v")).collect()}
    n, v = (np.array([by_class.get(c, (0, 0))[i] for c in range(RARE)], np.float64) for i in (0, 1))
    words, counts, classes = (np.array([r[c] for r in top], np.int64) for c in ("word", "count", "class"))
    order = np.argsort(words.view(U64))
    tokens, distinct = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    # The words with own symbols leave their classes.
    np.subtract.at(n, classes, counts)
    np.subtract.at(v, classes, 1)
    unigram = np.concatenate([[ends], n, counts[order]]) + 0.1
    jitter = np.exp(0.7 * np.random.default_rng(7).standard_normal((STATES, len(unigram))))
    jitter[:, END] = 1
    emits = unigram * jitter
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(moves, 0.9)
    return Model(words.view(U64)[order], counts[order], n, v, tokens, distinct, ends, np.full(STATES, 1 / STATES), moves, emits / emits.sum(1, keepdims=True))


def sequence(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts with their ends, offsets of the texts, symbols of the distinct words)."""
    n = unpack(row["n"], "u4").astype(np.int64)
    own = model.symbols(unpack_rising(row["words"], "u8"), unpack(row["classes"], "u2"))
    offsets = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(offsets[-1], END, np.int64)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = own[unpack(row["local"], "u4")]
    return out, offsets, own


class Steps:
    """Texts side by side, longest first: the symbols of step 0 of all of them, then of step 1 of those that go on, ..."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.order = np.argsort(-lengths, kind="stable")
        self.live = len(lengths) - np.cumsum(np.bincount(lengths))[:-1]  # texts longer than t
        self.starts = np.concatenate([[0], np.cumsum(self.live)])
        step = np.repeat(np.arange(len(self.live)), self.live)
        self.text = np.arange(len(step)) - self.starts[step]
        self.before = self.starts[np.maximum(step - 1, 0)] + self.text  # the same text's place one step earlier
        self.code = symbols[offsets[:-1][self.order][self.text] + step]

    def pieces(self) -> list[tuple[int, int]]:
        """Ranges of steps of about PIECE symbols."""
        cuts, at = [0], 0
        while at < len(self.live):
            at = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + PIECE, "right")) - 1)
            cuts.append(at)
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def forward(self, first: int, last: int, a: np.ndarray | None, start: np.ndarray, moves: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward vectors and scales of steps first .. last - 1; a: the vectors of the step before."""
        base, ones = self.starts[first], np.ones(STATES, table.dtype)
        alpha = table[self.code[base : self.starts[last]]]
        scales = np.empty(len(alpha), table.dtype)
        edges = (self.starts[first : last + 1] - base).tolist()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            x = alpha[i:j]
            x *= start if a is None else a[: j - i] @ moves
            scales[i:j] = s = x @ ones
            x /= s[:, None]
            a = x
        return alpha, scales


def expected(symbols: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Expected counts of one set of texts, as one vector: start, moves, emits, log-likelihood."""
    steps = Steps(symbols, offsets)
    start, moves, table = (np.ascontiguousarray(x, np.float32) for x in (model.start, model.moves, model.emits.T))
    pieces = steps.pieces()
    heads = [None]
    for first, last in pieces[:-1]:
        alpha, _ = steps.forward(first, last, heads[-1], start, moves, table)
        heads.append(alpha[steps.starts[last - 1] - steps.starts[first] :].copy())
    begin, pairs, emits, logs = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(model.emits.shape), 0.0
    ahead_of = np.zeros((0, STATES), np.float32)  # of the step after a piece
    for (first, last), head in zip(pieces[::-1], heads[::-1], strict=True):
        low, high = steps.starts[first], steps.starts[last]
        alpha, scales = steps.forward(first, last, head, start, moves, table)
        code = steps.code[low:high]
        # ahead: what a step and those after it say of its state, before its own forward vector.
        ahead = table[code] / scales[:, None]
        beta = np.ones_like(ahead)
        edges = (steps.starts[first : last + 1] - low).tolist()
        for i, j in zip(edges[-2::-1], edges[:0:-1], strict=True):
            if len(ahead_of):
                np.matmul(ahead_of, moves.T, out=beta[i : i + len(ahead_of)])
            ahead[i:j] *= beta[i:j]
            ahead_of = ahead[i:j]
        inner = edges[1]
        pairs += alpha[steps.before[low + inner : high] - low].T @ ahead[inner:]
        if head is not None:
            pairs += head[: len(ahead_of)].T @ ahead_of
        beta *= alpha
        beta /= beta.sum(1, keepdims=True)
        if head is None:
            begin += beta[: edges[1]].sum(0)
        emits += [np.bincount(code, beta[:, k], emits.shape[1]) for k in range(STATES)]
        logs += np.log(scales.astype(np.float64)).sum()
        ahead_of = ahead_of.copy()
    return np.concatenate([begin, (pairs * model.moves).ravel(), emits.ravel(), [logs]])


def _expect(model):
    def run(batches):
        total = np.zeros(STATES + STATES * STATES + model.value.emits.size + 1)
        for b in batches:
            for row in b.to_pylist():
                symbols, offsets, _ = sequence(row, model.value)
                keep = ~np.frombuffer(row["held"], bool)
                if keep.any():
                    on = np.repeat(keep, np.diff(offsets))
                    total += expected(symbols[on], np.concatenate([[0], np.cumsum(np.diff(offsets)[keep])]), model.value)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return run


def _add(batches):
    total = None
    for b in batches:
        for v in b["v"].to_pylist():
            total = np.frombuffer(v) if total is None else total + np.frombuffer(v)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def reestimated(model: Model, v: np.ndarray) -> Model:
    cuts = np.cumsum([STATES, STATES * STATES, model.emits.size])
    start, moves, emits, _ = np.split(v, cuts)
    norm = lambda x, eps: (x + eps) / (x + eps).sum(-1, keepdims=True)
    return Model(**(model.__dict__ | {"start": norm(start, 0.1), "moves": norm(moves.reshape(STATES, STATES), 0.1), "emits": norm(emits.reshape(model.emits.shape), 0.02)}))


def log10_likelihood(symbols: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Scaled forward recursion over whole texts."""
    steps = Steps(symbols, offsets)
    table, a = np.ascontiguousarray(model.emits.T), None
    out = np.zeros(len(steps.order))
    for first, last in steps.pieces():
        alpha, scales = steps.forward(first, last, a, model.start, model.moves, table)
        a = alpha[steps.starts[last - 1] - steps.starts[first] :].copy()
        out += np.bincount(steps.text[steps.starts[first] : steps.starts[last]], np.log10(scales), len(out))
    scores = np.empty(len(out))
    scores[steps.order] = out
    return scores


def _score(model):
    m = model.value

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        row = next((r for r in rows if r["local"] is not None), None)
        if row is None:
            return _scored([], [], [], [], m, [], [])
        replies = sorted((r for r in rows if r["reply"] is not None), key=lambda r: r["bucket"])
        counts = np.concatenate([unpack(r["reply"], "u8") for r in replies]).astype(np.int64) if replies else np.zeros(0, np.int64)
        symbols, offsets, own = sequence(row, m)
        local, n = unpack(row["local"], "u4"), np.diff(offsets) - 1
        text = np.repeat(np.arange(len(n)), n)
        total = lambda x: np.bincount(text, x[local], len(n))
        floor = m.tokens + m.distinct + 1
        base = total(np.log10((counts + 1) / floor)) + math.log10((m.ends + 1) / floor)
        known = total(counts > 0).astype(np.int64) + (m.ends > 0)
        score = log10_likelihood(symbols, offsets, m) + total(m.in_class(own, counts))
        return _scored(row["ids"], np.frombuffer(row["held"], bool).tolist(), n + 1, known, m, base, score)

    return run


SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(ids, held, n, known, m, base, score) -> pa.Table:
    columns = [(ids, pa.string()), (held, pa.bool_()), (n, pa.int64()), (known, pa.int64()), ([m.tokens] * len(ids), pa.int64()), (base, pa.float64()), (score, pa.float64())]
    return pa.table([pa.array(x, t) for x, t in columns], names=[x.split()[0] for x in SCORES.split(", ")])


def train(coded_docs: DataFrame, rounds: int, size: int) -> tuple[Model, DataFrame]:
    """The model, and (chunk, bucket, reply) with the counts of the chunks' words. coded_docs: written."""
    spark = coded_docs.sparkSession
    sc = spark.sparkContext
    own_words = TOP + round(GROWTH * size ** (1 / 3))
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET))))
    parts = coded_docs.select("chunk", "words", "counts", "classes").mapInArrow(_by_bucket(bits), "bucket int, chunk string, words binary, counts binary, classes binary")
    counted = written(parts.groupBy("bucket").applyInArrow(_count(own_words), COUNTED), "counts")
    ends = coded_docs.select(F.expr("size(ids) - (length(hex(held)) - length(replace(hex(held), '01', ''))) div 2").alias("n")).agg(F.sum("n")).first()[0] or 0
    model = first_model(counted.where("kind = 'sums'"), ends, own_words)
    for _ in range(rounds):
        sent = sc.broadcast(model)
        sums = coded_docs.select("n", "held", "local", "words", "classes").mapInArrow(_expect(sent), "v binary").repartition(16).mapInArrow(_add, "v binary").collect()
        model = reestimated(model, sum(np.frombuffer(r.v) for r in sums))
    return model, counted.where("kind = 'reply'").select("chunk", "bucket", F.col("counts").alias("reply"))


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def score_texts(docs: DataFrame, rounds: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCORES of each row of docs, under the model of those rows that aren't held out."""
    kind = docs.schema[doc_id].dataType
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), held_out(F.col(doc_id)).alias("held"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = written(slim.mapInArrow(_code, CODED), "coded")
    model, replies = train(chunks, rounds, size)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = chunks.select("chunk", "ids", "n", "held", "local", "words", "classes", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("reply"))
    told = replies.select("chunk", *[F.lit(None).cast(t).alias(c) for c, t in own.dtypes[1:7]], "bucket", "reply")
    scores = own.unionByName(told).groupBy("chunk").applyInArrow(_score(sent), SCORES)
    return scores.withColumn("doc_id", F.col("doc_id").cast(kind))
