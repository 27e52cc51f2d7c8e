"""License scans: winnowed fingerprints pick candidates, banded alignment reports them.

A template's runs of K words are hashed, and of every W runs in a row the
smallest is indexed. Texts are winnowed alike, so any K + W - 1 words that a
text shares with a template meet in the index. Hits near one diagonal make a
candidate; a local alignment within a band around it gives the matched words
and where they begin and end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.ragged import Words, sequences, slices
from schemaloom.llm.shared import text_of

K, W = 3, 2
COVERAGE = 0.8
MATCH, MISS = 2, -1
WORD = re.compile(r"[A-Za-z0-9]+")

# Wordings of public licenses and their usual notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-notice": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

FOUND = "id long, license string, coverage double, matched int, template_words int, start int, end int"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _runs(ids: np.ndarray) -> np.ndarray:
    """The hash of every run of K ids; the largest number where one of them is 0."""
    n = max(0, len(ids) - K + 1)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(K):
            own = ids[i : i + n]
            out = (out + own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
            known &= own > 0
    return np.where(known, out >> np.uint64(1), np.iinfo(np.uint64).max)


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every W in a row, of equals the last; fewer hashes are one window."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(W, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.unique(np.arange(len(windows)) + width - 1 - windows[:, ::-1].argmin(axis=1))
    return at[hashes[at] < np.iinfo(np.uint64).max]


def band_of(template_words: int) -> int:
    return min(16, max(1, template_words // 8))


def align(template: list[int], words: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last place in `words`) of the best local alignment near `words - template = diagonal`."""
    best, cells = (0, 0, 0, -1), {}
    for i, t in enumerate(template):
        low, high = max(0, i + diagonal - band), min(len(words) - 1, i + diagonal + band)
        for j in range(low, high + 1):
            same = t == words[j] and t > 0
            score, matched, first, last = cells.get((i - 1, j - 1), (0, 0, 0, -1))
            cell = (score + MATCH, matched + 1, first if matched else j, j) if same else (score + MISS, matched, first, last)
            for other in ((i - 1, j), (i, j - 1)):
                score, *rest = cells.get(other, (0, 0, 0, -1))
                if score + MISS > cell[0]:
                    cell = (score + MISS, *rest)
            if cell[0] > 0:
                cells[i, j] = cell
                if cell[0] > best[0]:
                    best = cell
    return best[1:]


class Index:
    """Templates as word numbers, and their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        split = [words_of(t) for t in templates.values()]
        if any(len(t) < K + W - 1 for t in split):
            raise ValueError(f"a template needs {K + W - 1} words")
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in split for w in t}))}
        self.words = [[self.number[w] for w in t] for t in split]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            hashes = _runs(np.array(ids))
            for at in winnowed(hashes):
                self.places[int(hashes[at])].append((t, int(at)))
        self.hashes = np.array(sorted(self.places), np.uint64)

    def ids_of(self, chunks: list[str]) -> list[list[int]]:
        return [[self.number.get(w, 0) for w in words_of(c)] for c in chunks]

    def candidates(self, ids: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(template, diagonal) of the hits (place, hash): one for those close to each other."""
        found = defaultdict(list)
        for place, h in hits:
            for t, at in self.places[h]:
                found[t].append((place - at, place))
        out = []
        for t, own in found.items():
            band, first = band_of(len(self.words[t])), None
            for diagonal, _ in sorted(own):
                if first is None or diagonal > first + band:
                    first = diagonal
                    out.append((t, diagonal))
        return out

    def scan(self, ids: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int, int]]:
        """(template, matched, first word, last word) of what is covered; of overlaps the best per template."""
        found = []
        for t, diagonal in self.candidates(ids, hits):
            template = self.words[t]
            band = band_of(len(template))
            low = max(0, diagonal - band)
            part = ids[low : max(0, diagonal) + len(template) + band + 1].tolist()
            matched, first, last = align(template, part, diagonal - low, band)
            if matched >= coverage * len(template):
                found.append((-matched, first + low, t, last + low))
        taken, out = defaultdict(list), []
        for negative, first, t, last in sorted(found):
            if all(last < a or first > b for a, b in taken[t]):
                taken[t].append((first, last))
                out.append((t, -negative, first, last))
        return sorted(out, key=lambda x: (x[2], x[0]))


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    coverage: float = COVERAGE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (`FOUND`): every place of a text that covers enough of a template.

    `coverage` is the share of the template's words that the alignment
    matches; `start` and `end` are code points of the text. Words are ASCII
    letters and digits without regard to case. Null and empty texts hold
    nothing; repeated rows are reported each; an empty table gives no rows.
    The templates are sent to every worker: they are few and given.
    """
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Words(index.ids_of)
        for batch in batches:
            for part in slices(batch.column("text")):
                yield _scanned(index, chunks, batch.column("id").slice(_offset(part, batch), len(part)), part, coverage)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, FOUND)


def _offset(part: pa.Array, batch: pa.RecordBatch) -> int:
    return part.offset - batch.column("text").offset


def _scanned(index: Index, chunks: Words, ids: pa.Array, texts: pa.Array, coverage: float) -> pa.RecordBatch:
    flat, starts = sequences(pc.ascii_split_whitespace(texts), chunks)
    hashes = _runs(flat)
    known = np.flatnonzero(np.isin(hashes, index.hashes))
    rows = []
    # Only texts that share a run with a template are winnowed.
    for row in np.unique(np.searchsorted(starts, known, side="right") - 1):
        own = flat[starts[row] : starts[row + 1]]
        local = _runs(own)
        at = winnowed(local)
        hits = [(int(a), int(local[a])) for a in at if int(local[a]) in index.places]
        found = index.scan(own, hits, coverage) if hits else []
        if found:
            spans = [m.span() for m in WORD.finditer(texts[int(row)].as_py())]
            for t, matched, first, last in found:
                n = len(index.words[t])
                rows.append((ids[int(row)].as_py(), index.names[t], matched / n, matched, n, spans[first][0], spans[last][1]))
    schema = pa.schema(
        [("id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
         ("template_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    )
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
