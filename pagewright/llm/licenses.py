"""License scans: which license notice a text carries, by patience alignment with templates.

An alignment anchors on words that are unique on both sides, keeps the longest increasing run of anchors, and
aligns the gaps between them in the same way. Its coverage is the share of the template's words that found a place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.words import MARKS, chunks, flat, spans, word_hashes

#: Public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}
THRESHOLD = 0.75
FOUND = "license string, coverage double, n_matched long, first_word long, last_word long"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in rising order of the first part, whose second part rises too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_run(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps without unique words; both sides are short."""
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i] == b[j] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matching places of two word sequences, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        if lo >= hi or low >= high:
            continue
        ours, theirs = Counter(a[lo:hi]), Counter(b[low:high])
        place = {w: j for j, w in enumerate(b[low:high], low) if theirs[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[lo:hi], lo) if ours[w] == 1 and w in place])
        if not anchors:
            out += [(lo + i, low + j) for i, j in common_run(a[lo:hi], b[low:high])]
            continue
        out += anchors
        for (i, j), (k, m) in zip([(lo - 1, low - 1), *anchors], [*anchors, (hi, high)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def best_place(words: list[int], template: list[int], threshold: float) -> tuple[int, int, int] | None:
    """(matches, first word, last word) of the window that covers the template best, if it covers enough.

    Windows are twice as long as the template and overlap by half, so a copy of up to the template's length lies whole
    in one of them; one with inserted words may be cut by both and lose some of its matches. A window is aligned
    only if the words it shares with the template could cover enough.
    """
    need, size, wanted = threshold * len(template), len(template), Counter(template)
    best = None
    for lo in range(0, max(1, len(words) - size), size):
        window = words[lo : lo + 2 * size]
        if (Counter(w for w in window if w >= 0) & wanted).total() < need:
            continue
        pairs = patience(window, template)
        if len(pairs) >= need and (best is None or len(pairs) > best[0]):
            best = (len(pairs), lo + pairs[0][0], lo + pairs[-1][0])
    return best


def scan_licenses(df: DataFrame, text: str = "text", out: str = "found", *, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Add a struct with the best license of each whole text, its coverage and the words it spans.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. The best template has the highest
    coverage, then the most matched words, then the name that sorts first. Texts that no template covers by
    ``threshold``, empty and null texts give null. Repeated rows are judged alike, and no rows give none. A column
    already called ``out`` is replaced; others stay. A text is aligned with a template only if the words that both have
    could reach the threshold, which loses nothing.
    """

    def tokens(value: str) -> np.ndarray:
        buf, at = flat(pa.array([value]))
        start, end, _ = spans(buf, at, MARKS)
        return word_hashes(buf, start, end, lower=True)

    names = sorted(templates)
    hashed = [tokens(templates[n]) for n in names]
    vocabulary = np.unique(np.concatenate(hashed))
    coded = [np.searchsorted(vocabulary, h).tolist() for h in hashed]
    shape = pa.struct([(n, {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[k]) for n, k in (f.split() for f in FOUND.split(", "))])
    wanted = np.array([np.bincount(c, minlength=len(vocabulary)) for c in coded])

    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows: list[dict | None] = []
            for _, piece in chunks(column, 1 << 20):
                buf, at = flat(piece)
                start, end, first = spans(buf, at, MARKS)
                h = word_hashes(buf, start, end, lower=True)
                code = np.searchsorted(vocabulary, h)
                code[code == len(vocabulary)] = 0
                code = np.where(vocabulary[code] == h, code, -1)
                doc = np.repeat(np.arange(len(piece)), np.diff(first))
                known = code >= 0
                counts = np.bincount(doc[known] * len(vocabulary) + code[known], minlength=len(piece) * len(vocabulary)).reshape(len(piece), -1)
                bound = np.stack([np.minimum(counts, w).sum(1) for w in wanted], axis=1)
                hopeful = bound >= threshold * wanted.sum(1)
                for i in range(len(piece)):
                    best = None
                    words = code[first[i] : first[i + 1]].tolist() if hopeful[i].any() else []
                    for t in np.flatnonzero(hopeful[i]):
                        if place := best_place(words, coded[t], threshold):
                            rank = (place[0] / len(coded[t]), place[0], -int(t))
                            if best is None or rank > best[0]:
                                best = (rank, int(t), place)
                    rows.append(None if best is None else dict(zip((f.name for f in shape), (names[best[1]], best[0][0], *best[2]))))
            yield pa.array(rows, shape)

    ddl = "struct<" + ", ".join(f.replace(" ", ": ") for f in FOUND.split(", ")) + ">"
    return df.withColumn(out, F.arrow_udf(scan, ddl)(F.col(text)))
