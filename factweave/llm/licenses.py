"""License scans by conditional compression.

Candidate passages are held against each template, across line ends. A passage is a match if the words that must be put
in, taken out or replaced (a replaced word counts as two) to turn the template into it are few: max_difference of the
template's words. All matches that don't overlap a better one are returned. Fewest differences come first; equal ones are
ranked by compression: a passage is compressed alone and with the template as a zstandard raw dictionary, and the
template that saves more bytes wins.

Candidates follow from the given templates and lose no match: a match that may differ in d words holds at least one of
any d + 1 words of its template, so each template gives d + 1 cues, its longest words (figures and signs make a word as
rare as four letters more), and only words near a cue of a text are looked at.

Edge cases: null and empty texts have no notices; equal savings rank by template name; templates without words match
nothing; repeated rows give repeated results, an empty table none; other columns aren't looked at, so they may have any
names; texts and lines of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short license notices, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WORD = re.compile(r"[\w.+/&-]*\w")
BLOCK = 512  # bytes from which lines are numbered by their sentences, too
FOUND = "array<struct<block:int,license:string,reduction:double,n_different:int,differences:string,wording:string>>"


def block_starts(text: str) -> list[int]:
    """Where the numbered blocks begin: lines, and the sentences of long lines."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append(at)
        if len(line.encode("utf-8", "replace")) > BLOCK:
            out += [at + m.end() for m in re.finditer(r"(?<=[.!?:;])\s+", line, re.ASCII)]
        at += len(line) + 1
    return out


def _normal(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    """Compressors primed with each template."""

    def __init__(self, templates: dict[str, str], max_difference: float):
        level = zstandard.ZstdCompressionParameters.from_level(9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=level)
        self.words = {k: _normal(t) for k, t in sorted(templates.items())}
        self.most = {k: int(2 * max_difference * len(a)) for k, a in self.words.items()}
        self.cues: set[str] = set()
        for k, a in self.words.items():
            self.cues.update(sorted(a, key=lambda w: (-len(w) - 4 * (not w.isalpha()), w))[: self.most[k] + 1])
        self.primed = {k: zstandard.ZstdCompressor(compression_params=level, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}

    def sizes(self, name: str, passage: bytes) -> tuple[int, int]:
        """Compressed bytes of the passage alone and with the template."""
        return len(self.plain.compress(passage)), len(self.primed[name].compress(passage))


def regions(text: str, cues: set[str], reach: int) -> Iterator[list[tuple[str, int, int]]]:
    """(word, start, stop) of the words up to reach words away from a cue, in connected runs."""
    held, region, left = deque(maxlen=reach), None, 0
    for m in WORD.finditer(text):
        item = m[0].lower(), m.start(), m.end()
        if item[0] in cues:
            region, left = list(held) if region is None else region, reach + 1
        if region is None:
            held.append(item)
            continue
        region.append(item)
        left -= 1
        if not left:
            yield region
            held.extend(region[-reach:])
            region = None
    if region:
        yield region


def endings(a: list[str], b: list[str], most: float) -> Iterator[tuple[int, int, int]]:
    """(differences, start, stop) of the part of b, ending at each stop, that takes fewest words put in or out of a."""
    n = len(a)
    cost, begin = list(range(n + 1)), [0] * (n + 1)
    for stop, word in enumerate(b, 1):
        over, over_begin = cost[0], begin[0]
        begin[0] = stop
        for i in range(1, n + 1):
            was, was_begin = cost[i], begin[i]
            if a[i - 1] == word:
                c, s = over, over_begin
            else:
                c, s = was + 1, was_begin
                if (d := cost[i - 1] + 1) < c or (d == c and begin[i - 1] > s):
                    c, s = d, begin[i - 1]
            cost[i], begin[i] = c, s
            over, over_begin = was, was_begin
        if cost[n] <= most and begin[n] < stop:
            yield cost[n], begin[n], stop


def differences(a: list[str], b: list[str]) -> list[str]:
    """The fewest words to take out (-) and put in (+) to turn a into b, in order."""
    left = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            if i == len(a) or j == len(b):
                left[i][j] = len(a) - i + len(b) - j
            else:
                left[i][j] = left[i + 1][j + 1] if a[i] == b[j] else 1 + min(left[i + 1][j], left[i][j + 1])
    out, i, j = [], 0, 0
    while left[i][j]:
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i < len(a) and left[i][j] == left[i + 1][j] + 1:
            out.append(f"-{a[i]}")
            i += 1
        else:
            out.append(f"+{b[j]}")
            j += 1
    return out


def scan(text: bytes | None, templates: Templates) -> list[dict]:
    if not text:
        return []
    text = text.decode("utf-8", "replace")
    low = text.lower()
    if not any(cue in low for cue in templates.cues):
        return []
    most = templates.most
    reach = max((len(a) + most[k] for k, a in templates.words.items()), default=1)
    matches = []
    for region in regions(text, templates.cues, reach):
        b = [w for w, _, _ in region]
        for name, a in templates.words.items():
            # A match has at least so many words of the template's, among no more words than these.
            known, wide = set(a), len(a) + most[name]
            sums = np.concatenate([[0], np.cumsum([w in known for w in b])])
            if not a or (sums[min(wide, len(b)) :] - sums[: max(len(b) - wide, 0) + 1]).max() < len(a) - most[name]:
                continue
            for n, i, j in endings(a, b, most[name]):
                start, stop = region[i][1], region[j - 1][2]
                while stop < len(text) and not text[stop].isspace() and not WORD.match(text, stop):
                    stop += 1  # closing marks
                alone, primed = templates.sizes(name, text[start:stop].encode("utf-8", "replace"))
                matches.append((n, primed - alone, name, start, stop, 1 - primed / alone, i, j, b))
    taken, found = [], []
    for n, _, name, start, stop, reduction, i, j, b in sorted(matches, key=lambda m: m[:5]):
        at = bisect_right(taken, (start, stop))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < stop):
            continue
        taken.insert(at, (start, stop))
        found.append((start, name, n, stop, reduction, differences(templates.words[name], b[i:j])))
    if not found:
        return []
    starts = block_starts(text)
    return [
        {"block": bisect_right(starts, start) - 1, "license": name, "reduction": reduction, "n_different": n, "differences": " ".join(words), "wording": text[start:stop]}
        for start, name, n, stop, reduction, words in sorted(found, key=lambda f: f[:2])
    ]


def license_notices(text: Column, templates: dict[str, str] = TEMPLATES, max_difference: float = 0.15) -> Column:
    """Notices in each text, in order: block it starts in, license, size reduction, differing words, wording."""
    row = pa.list_(pa.struct([("block", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("n_different", pa.int32()), ("differences", pa.string()), ("wording", pa.string())]))

    @F.arrow_udf(FOUND)
    def noticed(col: pa.Array) -> pa.Array:
        primed = Templates(templates, max_difference)
        return pa.array([scan(t, primed) for t in col.cast(pa.binary()).to_pylist()], row)

    return noticed(text)
