"""Claim-key similarity join: exact cosine, top K a fact.

The right side goes to all tasks only if its vectors are known to be small; else both sides are cut into
blocks and each pair of blocks is multiplied in one task. Either way a left fact sends at most
K candidates a block, which are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "a_id long, b_id long, a_doc long, b_doc long, similarity double"
BLOCK_ROWS = 16384
BATCH, TILE = 512, 4096


def _best(left: pd.DataFrame, ids: np.ndarray, docs: np.ndarray, matrix: np.ndarray, floor: float, k: int, earlier: bool) -> Iterator[pd.DataFrame]:
    """Up to k candidates of each left row, best first, later ids first among equals. BATCH rows meet TILE others at a time, and
    only what can still be among the k best of a row is kept of them. Documents in order of ids spare the most tiles."""
    for at in range(0, len(left), BATCH):
        part = left.iloc[at : at + BATCH]
        own, doc = part["fact_id"].to_numpy(), part["doc_id"].to_numpy()
        vectors = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        least = np.full(len(part), floor)
        rows, columns, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for low in range(0, len(ids), TILE):
            there = docs[low : low + TILE]
            if earlier and there.min() >= doc.max():
                continue
            sims = vectors @ matrix[low : low + TILE].T
            fit = sims >= least[:, None]
            fit &= (there[None, :] < doc[:, None]) if earlier else (there[None, :] != doc[:, None])
            if np.count_nonzero(fit) > 8 * k * len(part) and sims.shape[1] > k:  # more than is worth putting in order
                sims[~fit] = -np.inf
                fit &= sims >= np.partition(sims, -k, axis=1)[:, -k, None]  # with all that equal the k-th
            r, c = np.nonzero(fit)
            if not len(r):
                continue
            rows, columns, found = np.concatenate((rows, r)), np.concatenate((columns, c + low)), np.concatenate((found, sims[r, c]))
            order = np.lexsort((-ids[columns], -found, rows))
            rows, columns, found = rows[order], columns[order], found[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            full = place == k - 1
            least[rows[full]] = np.maximum(found[full], floor)
            keep = place < k
            rows, columns, found = rows[keep], columns[keep], found[keep]
        yield pd.DataFrame({"a_id": own[rows], "b_id": ids[columns], "a_doc": doc[rows], "b_doc": docs[columns], "similarity": found})


def candidates(new: DataFrame, stored: DataFrame, floor: float = 0.78, k: int = 5, earlier: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """PAIRS and rank: for each fact of new its k most similar facts of stored in other documents (earlier: in
    documents with a smaller id). Both sides: (fact_id, doc_id, embedding)."""
    left = new.select(F.col("fact_id").cast("long"), F.col("doc_id").cast("long"), "embedding").where("embedding is not null")
    right = stored.select(F.col("fact_id").cast("long"), F.col("doc_id").cast("long"), "embedding").where("embedding is not null")
    if floor > 0:  # nothing is that like a vector of zeros
        left, right = (x.where(F.exists("embedding", lambda v: v != 0)) for x in (left, right))
    n, width = right.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n * width * 8 <= broadcast_bytes:
        rows = right.orderBy("doc_id", "fact_id").toPandas()
        matrix = np.stack(rows["embedding"].to_numpy()).astype(np.float64) if n else np.zeros((0, 1))
        sent = new.sparkSession.sparkContext.broadcast((rows["fact_id"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64), matrix))

        def run(batches):
            ids, docs, m = sent.value
            for pdf in batches:
                if len(ids):
                    yield from _best(pdf, ids, docs, m, floor, k, earlier)

        # Vectors of a few files are few tasks' work otherwise; a task's rows are of neighbouring documents.
        tasks = 4 * new.sparkSession.sparkContext.defaultParallelism
        pairs = left.repartition(tasks, "fact_id").sortWithinPartitions("doc_id").mapInPandas(run, PAIRS)
    else:
        m = max(1, math.ceil(left.count() / BLOCK_ROWS))
        b = max(1, math.ceil(n / BLOCK_ROWS))
        block = lambda parts: F.pmod(F.xxhash64("fact_id"), F.lit(parts)).cast("int")
        lefts = left.withColumn("l", block(m)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        rights = right.withColumn("r", block(b)).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        # Own names: both sides may come from the same table.
        rights = rights.select(*[F.col(c).alias(f"b_{c}") for c in ("fact_id", "doc_id", "embedding", "l", "r")])

        def multiply(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(c):
                return pd.DataFrame(columns=[x.split()[0] for x in PAIRS.split(", ")])
            a, c = a.sort_values("doc_id"), c.sort_values("b_doc_id")
            return pd.concat(_best(a, c["b_fact_id"].to_numpy(), c["b_doc_id"].to_numpy(), np.stack(c["b_embedding"].to_numpy()).astype(np.float64), floor, k, earlier))

        pairs = lefts.groupBy("l", "r").cogroup(rights.groupBy("b_l", "b_r")).applyInPandas(multiply, PAIRS)
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("similarity"), F.desc("b_id")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
