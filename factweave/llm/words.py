"""Vectorised word splitting and numbering of many UTF-8 texts at once.

Texts are joined into one byte buffer and word edges come from a byte-class table. Words are told apart by
their bytes: a dictionary of the chunk's distinct words numbers them. Where words of different chunks must
meet, each distinct word has a 128-bit XXH3 digest of its bytes, whose halves serve as two hashes that don't depend on
each other. All helpers work on bounded chunks of documents, see ``chunked``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that end a word of class [^\x20\x09-\x0D]+ .
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ .
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
U64 = np.uint64
WORD_SEED = 20240229


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of a chunk of documents: byte edges, and word ranges by document."""

    def __init__(self, texts: list[bytes | None], ends: np.ndarray, lower: bool = False):
        data = b" ".join([t or b"" for t in texts]) + b" "
        self.data = data.translate(LOWER) if lower else data
        self.bytes = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self._inside, self._numbered = ~ends[self.bytes], None
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[1:] = self._inside
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        #: words of document d are first[d] .. first[d + 1] - 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def numbered(self) -> tuple[np.ndarray, pa.LargeBinaryArray]:
        """The number of each word among the chunk's distinct words, and these."""
        if self._numbered is None:
            body = self.bytes[self._inside]
            offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
            coded = words.dictionary_encode()
            self._numbered = coded.indices.to_numpy(), coded.dictionary
        return self._numbered

    def local_hashes(self) -> np.ndarray:
        """64 bits for each word, equal for equal words of this chunk and for no others."""
        with np.errstate(over="ignore"):
            return mix(self.numbered()[0].astype(U64) + U64(1))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word's bytes, the same in every chunk."""
        numbers, words = self.numbered()
        both = word_hashes(words.to_pylist())
        return both[numbers, 0], both[numbers, 1]

    def grams(self, hashes: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which n words of one document start, and those n-grams' fingerprints."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        at = np.flatnonzero(room >= n)
        return at, gram_values(hashes, at, n, factor)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The digest of each word as a row of two 64-bit numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w, WORD_SEED) for w in words]), U64).reshape(-1, 2)


def gram_values(hashes: np.ndarray, at: np.ndarray, n: int, factor: int) -> np.ndarray:
    value = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            value = value * U64(factor) + hashes[at + k]
        return mix(value)


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the half-open spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 array over the word ranges of the documents."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def chunked(rows: Iterator[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    """Rows in lists of at most ``limit`` bytes; a larger row stands alone."""
    held, total = [], 0
    for row in rows:
        size = size_of(row)
        if held and total + size > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += size
    if held:
        yield held


def text_chunks(texts: list[bytes | None], limit: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """(index of the first text, texts) of each chunk."""
    at = 0
    for part in chunked(((t,) for t in texts), lambda r: len(r[0] or b"") + 1, limit):
        yield at, [r[0] for r in part]
        at += len(part)
