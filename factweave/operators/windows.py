"""Ratcliff-Obershelp likeness of quotes to the windows of their pages, for many pairs at once.

The likeness takes the longest common run of letters, the first in the quote and then in the window among equals, and does the
same left and right of it. Runs of two letters and more are followed level by level for all windows together, as arrays; between
them only single letters are alike, and there the rule comes to taking each letter's next place in turn.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Letters of quote times letters of page that are worked on at once; longer pairs go window by window.
CELLS, LETTERS = 1 << 21, 1 << 18
#: Letters are counted in classes by their last bits, which can only raise the bound.
CLASSES = 128
_PLACE = (1 << 21) - 1


def likeness(quote: str, window: str) -> float:
    """Ratcliff-Obershelp similarity, from the quote's side."""
    return difflib.SequenceMatcher(None, quote, window, False).ratio()


def best_window(quote: str, page: str, threshold: float, least: float = 0.0) -> float:
    """How well the quote fits the page: its likeness to the first window that reaches the threshold, else to the best, 0
    if that isn't above least. Windows have the quote's length and begin a quarter of it apart."""
    width, letters, best = len(quote), Counter(quote), 0.0
    for start in range(0, max(1, len(page) - width + 1), max(1, width // 4)):
        window = page[start : start + width]
        # No alignment matches more letters than both have in common.
        if 2 * (letters & Counter(window)).total() <= max(best, least) * (width + len(window)):
            continue
        best = max(best, likeness(quote, window))
        if best >= threshold:
            return best
    return best if best > least else 0.0


def best_windows(quotes: list[str | None], pages: list[str | None], threshold: float, least: list[float] | np.ndarray) -> list[float | None]:
    """best_window of each pair; null where either is null. least is below the threshold."""
    out: list[float | None] = [None] * len(quotes)
    least = np.asarray(least, np.float64)
    for part in _parts(quotes, pages, out, threshold, least):
        found = _best([quotes[i] for i in part], [pages[i] for i in part], threshold, least[part])
        for i, x in zip(part, found.tolist(), strict=True):
            out[i] = x
    return out


def _parts(quotes, pages, out, threshold, least) -> Iterator[list[int]]:
    """Places of pairs that fit into CELLS and LETTERS together; pairs that don't by themselves are answered here."""
    part, letters = [], 0
    # Quotes of like lengths together: the matrix of a part has its longest quote's height.
    for i in sorted((i for i, (q, p) in enumerate(zip(quotes, pages, strict=True)) if q is not None and p is not None), key=lambda i: len(quotes[i])):
        w, n = len(quotes[i]), len(pages[i]) + 1
        if not w or not n - 1 or w * n > CELLS or n > LETTERS:
            out[i] = best_window(quotes[i], pages[i], threshold, float(least[i]))
            continue
        if part and (w * (letters + n) > CELLS or letters + n > LETTERS):
            yield part
            part, letters = [], 0
        part.append(i)
        letters += n
    if part:
        yield part


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in it) of the members of groups of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _best(quotes: list[str], pages: list[str], threshold: float, least: np.ndarray) -> np.ndarray:
    width, length = np.array([len(q) for q in quotes]), np.array([len(p) for p in pages])
    q = _codes(quotes)
    q_at = np.cumsum(width) - width
    # A page ends with a letter that no text has.
    p = _codes([x for page in pages for x in (page, "\0")]).copy()
    p_at = np.cumsum(length + 1) - length - 1
    p[p_at + length] = 0xFFFFFFFF
    step = np.maximum(1, width // 4)
    pair, number = _ragged((np.maximum(1, length - width + 1) + step - 1) // step)
    begin, size = p_at[pair] + number * step[pair], np.minimum(width, length)[pair]
    total = width[pair] + size
    bound = 2.0 * _common(q, width, p, pair, begin, size) / total
    got = np.full(len(pair), -1.0)
    # The likeliest window first, and all that may reach the threshold.
    top = np.zeros(len(pair), bool)
    order = np.lexsort((-number, bound, pair))
    top[order[np.append(pair[order][1:] != pair[order][:-1], True)]] = True
    todo = (top & (bound > least[pair])) | (bound >= threshold)
    best = least.copy()
    for _ in range(2):
        at = np.flatnonzero(todo & (got < 0))
        if len(at):
            got[at] = 2.0 * _matched(q, q_at, width, p, pair[at], begin[at], size[at]) / total[at]
            np.maximum.at(best, pair[at], got[at])
        todo = bound > best[pair]
        todo &= best[pair] < threshold
    out = np.zeros(len(quotes))
    np.maximum.at(out, pair, got)
    hit = np.flatnonzero(got >= threshold)[::-1]
    out[out <= least] = 0.0
    out[pair[hit]] = got[hit]  # the first stays
    return out


def _common(q, width, p, pair, begin, size) -> np.ndarray:
    """At least the letters that each window has in common with its quote."""
    out = np.empty(len(pair), np.int64)
    owner, _ = _ragged(width)
    own = np.bincount(owner * CLASSES + q % CLASSES, minlength=len(width) * CLASSES).reshape(-1, CLASSES).astype(np.int32)
    p = (p % CLASSES).astype(np.int32)
    ends = np.cumsum(size)
    at = 0
    while at < len(pair):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS)))
        window, place = _ragged(size[at:to])
        counts = np.bincount(window * CLASSES + p[begin[at:to][window] + place], minlength=(to - at) * CLASSES).reshape(-1, CLASSES)
        out[at:to] = np.minimum(counts, own[pair[at:to]]).sum(1)
        at = to
    return out


def _matched(q, q_at, width, p, pair, begin, size) -> np.ndarray:
    """Letters matched in each window. Windows are sorted by pair."""
    high = int(width[pair].max())
    # The quote's letters beside each letter of its page, from the first to the last window that is looked at.
    looked, index = np.unique(pair, return_inverse=True)
    start = np.minimum.reduceat(begin, np.searchsorted(pair, looked))
    stop = np.maximum.reduceat(begin + size, np.searchsorted(pair, looked))
    owner, place = _ragged(stop - start + 1)  # with a letter that is like none after each
    letters = p[start[owner] + place]
    letters[np.append(owner[1:] != owner[:-1], True)] = 0xFFFFFFFF
    begin = begin - start[index] + (np.cumsum(stop - start + 1) - (stop - start + 1))[index]
    n = len(letters)
    grid = np.full((len(looked), high), 0xFFFFFFFE, np.uint32)
    o, c = _ragged(width[looked])
    grid[o, c] = q[q_at[looked][o] + c]
    grid = np.ascontiguousarray(grid.T)
    run = np.zeros((high + 1, n + 1), np.uint16 if high < 1 << 16 else np.uint32)  # of equal letters from here on
    after = np.empty((high, n + 1), np.int32)  # the next place of this letter of the quote
    places = np.arange(n, dtype=np.int32)
    for i in range(high - 1, -1, -1):
        same = np.repeat(grid[i], stop - start + 1) == letters
        np.multiply(run[i + 1, 1:] + 1, same, out=run[i, :n])
        here = np.where(same, places, np.int32(n))
        after[i, n] = n
        after[i, :n] = np.minimum.accumulate(here[::-1])[::-1]
    first = run[:high, :n] > 1
    first[1:, 1:] &= run[: high - 1, : n - 1] == 0
    a, b = np.nonzero(first)
    long = run[a, b].astype(np.int64)
    # Each run in all windows that it meets: those of its page that end after its start and start before its end.
    order = np.argsort(b, kind="stable")
    a, b, long = a[order], b[order], long[order]
    from_ = np.searchsorted(begin + size, b, "right")
    to = np.searchsorted(begin, b + long, "left")
    run_, k = _ragged(np.maximum(to - from_, 0))
    window = from_[run_] + k
    order = np.argsort(window, kind="stable")
    window, run_ = window[order], run_[order]
    a, b, long = a[run_], b[run_], long[run_]
    matched = np.zeros(len(pair), np.int64)
    # Rectangles that are still to be matched, and those without a run.
    rect = [np.arange(len(pair)), np.zeros(len(pair), np.int64), width[pair].astype(np.int64), begin.astype(np.int64), (begin + size).astype(np.int64)]
    of, rest = window, []
    while len(rect[0]):
        w, a0, a1, b0, b1 = rect
        skip = np.maximum(np.maximum(a0[of] - a, b0[of] - b), 0)
        left = np.minimum(np.minimum(a1[of] - a, b1[of] - b), long) - skip
        keep = np.flatnonzero(left > 1)
        a, b, of = a[keep] + skip[keep], b[keep] + skip[keep], of[keep]
        long = left[keep]
        if not len(of):
            rest.append(rect)
            break
        key = (long << 42) | ((_PLACE - a) << 21) | (_PLACE - b)
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        best, has = np.maximum.reduceat(key, heads), of[heads]
        none = np.ones(len(w), bool)
        none[has] = False
        rest.append([x[none] for x in rect])
        k, i, j = best >> 42, _PLACE - (best >> 21 & _PLACE), _PLACE - (best & _PLACE)
        w, a0, a1, b0, b1 = (x[has] for x in rect)
        np.add.at(matched, w, k)
        rank = np.empty(len(none), np.int64)
        rank[has] = np.arange(len(has))
        of = rank[of]
        # A run that isn't the longest lies in one of both rests at most.
        low = np.flatnonzero((a < i[of]) & (b < j[of]))
        up = np.flatnonzero((a + long > (i + k)[of]) & (b + long > (j + k)[of]))
        rect = [np.concatenate(x) for x in ((w, w), (a0, i + k), (i, a1), (b0, j + k), (j, b1))]
        of, pick = np.concatenate((of[low], of[up] + len(w))), np.concatenate((low, up))
        a, b, long = a[pick], b[pick], long[pick]
        full = (rect[2] > rect[1]) & (rect[4] > rect[3])
        if not full.all():
            rank = np.cumsum(full) - 1
            keep = np.flatnonzero(full[of])
            of, a, b, long = rank[of[keep]], a[keep], b[keep], long[keep]
            rect = [x[full] for x in rect]
    w, a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*rest, strict=True))
    order = np.argsort(a0 - a1, kind="stable")  # the tallest first
    w, a0, b0, b1, tall = w[order], a0[order], b0[order], b1[order], (a1 - a0)[order]
    met = np.zeros(len(w), np.int64)
    flat = after.ravel()
    for t in range(int(tall[0]) if len(tall) else 0):
        m = int(np.searchsorted(-tall, -t, "left"))
        nxt = flat[(a0[:m] + t) * (n + 1) + b0[:m]]
        ok = nxt < b1[:m]
        met[:m] += ok
        b0[:m] = np.where(ok, nxt + 1, b0[:m])
    np.add.at(matched, w, met)
    return matched
