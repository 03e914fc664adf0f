"""Quality rules with suffix-array repetition limits.

For each document, suffixes are sorted by prefix doubling; the longest-common-prefix values of
neighbours in that order give, for each position, the longest repeated substring that starts
there. The union of those spans is the union of all maximal repeated substrings.

Only suffixes whose first ``min_repeat`` words occur elsewhere in their document can start a
repeat of that length, so the array holds these and the suffixes ``min_repeat`` words on, which settle their order,
and no others; that changes no result. Words are compared by their bytes (numbers of the chunk's distinct words).

The limits: repeats of at least 8 words may cover a quarter of a document's words, and the longest may be an
eighth of them. A document that the base rule keeps can have up to half its words in short repeats, so both
limits decide cases of their own.

Edge cases: null and empty texts, and texts without words, have all counts 0 and fail the base
rule (fewer than 50 words). Texts of any length are taken whole. Repeated rows are judged alike, each by
itself; there are no ties to break and no other column of a row is looked at, so extra columns of any name are
left as they are. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import SPACES, U64, Words, covered, mix, per_doc, text_chunks

CHUNK = 2 << 20
#: The symbol characters.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repeated_in_doc(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeats(w: Words, numbers: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the length of the longest substring of at least min_repeat words that starts
    there and occurs again in the same document (0: none); and the repeating suffixes in order."""
    n, doc = len(w), w.docs()
    longest = np.zeros(n, np.int64)
    at, grams = w.grams(w.local_hashes(), min_repeat)
    with np.errstate(over="ignore"):
        grams = mix(grams + doc[at].astype(U64) * U64(0x9FB21C651E98DF25))
    live = at[repeated_in_doc(grams)]
    if not len(live):
        return longest, live
    stop = w.first[1:][doc]
    # True order of the first min_repeat words, of the repeating suffixes and of those that many words on.
    ahead = live + min_repeat
    held = np.union1d(live, ahead[ahead < stop[live]])
    columns = [np.where(held + k < stop[held], numbers[np.minimum(held + k, n - 1)], -1) for k in range(min_repeat)]
    order, new = _sorted([doc[held], *columns])
    # Where nothing is ranked, ranks differ from all others.
    nothing = -1 - np.arange(n + min_repeat, dtype=np.int64)
    levels, depth = [], min_repeat
    while True:
        rank = nothing.copy()
        rank[held[order]] = np.cumsum(new) - 1
        levels.append((depth, rank))
        if new.all():
            break
        on = held + depth
        second = np.where(on < stop[held], rank[np.minimum(on, n)], -1)
        order, new = _sorted([rank[held], second])
        depth *= 2
    is_live = np.zeros(n, bool)
    is_live[live] = True
    suffixes = held[order]
    suffixes = suffixes[is_live[suffixes]]
    left, right = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(len(left), np.int64)
    for depth, rank in reversed(levels):
        lcp += np.where(rank[np.minimum(left + lcp, n)] == rank[np.minimum(right + lcp, n)], depth, 0)
    going = lcp > 0
    for _ in range(min_repeat - 1):
        x, y = left + lcp, right + lcp
        # A step only counts where all before it matched.
        going = going & (x < stop[left]) & (y < stop[right])
        going = going & (numbers[np.minimum(x, n - 1)] == numbers[np.minimum(y, n - 1)])
        if not going.any():
            break
        lcp += going
    longest[left] = lcp
    longest[right] = np.maximum(longest[right], lcp)
    return longest, suffixes


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their columns, and where in it a row differs from the one before."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    return order, new


def measures(texts: list[bytes | None], min_repeat: int) -> np.ndarray:
    """One row of FIELDS for each text."""
    w = Words(texts, SPACES)
    n = len(w)
    heads = w.offsets[:-1]
    body = ~SPACES[w.bytes] & ((w.bytes & 0xC0) != 0x80)
    out = np.zeros((len(texts), len(FIELDS)), np.int64)
    out[:, 0] = w.counts
    out[:, 1] = np.add.reduceat(body, heads, dtype=np.int64)
    out[:, 2] = np.add.reduceat(SYMBOLS[w.bytes], heads, dtype=np.int64)
    for i, t in enumerate(texts):
        if t and b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[i, 3] = len(lines) - len(set(lines))
    if n:
        at, grams = w.grams(w.local_hashes(), 3)
        with np.errstate(over="ignore"):
            again = at[repeated_in_doc(mix(grams + w.docs()[at].astype(U64) * U64(0x9FB21C651E98DF25)))]
        out[:, 4] = per_doc(covered(n, again, again + 3), w.first)
        longest, _ = repeats(w, w.numbered()[0], min_repeat)
        begin = np.flatnonzero(longest)
        out[:, 5] = per_doc(covered(n, begin, begin + longest[begin]), w.first)
        np.maximum.at(out[:, 6], w.docs()[begin], longest[begin])
    return out


def quality_measures(text: Column, min_repeat: int = 8) -> Column:
    """A struct of FIELDS (longs) for each text; covered_words and longest_repeat are those of
    repeated substrings of at least min_repeat words."""

    @F.arrow_udf(", ".join(f"{f} long" for f in FIELDS))
    def measured(col: pa.Array) -> pa.Array:
        texts = col.cast(pa.binary()).to_pylist()
        parts = [measures(part, min_repeat) for _, part in text_chunks(texts, CHUNK)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FIELDS)), np.int64)
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], list(FIELDS))

    return measured(text)


def verdict(m: Column, max_covered: float = 0.25, max_longest: float = 0.125) -> tuple[Column, Column]:
    """(base_failed, kept) from a struct of measures. Rejected besides base failures: documents of
    which repeats cover more than max_covered, or one repeat is longer than max_longest of the words."""
    n = m["n_words"]
    base_failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
    kept = ~base_failed & (m["covered_words"] <= max_covered * n) & (m["longest_repeat"] <= max_longest * n)
    return base_failed, kept
