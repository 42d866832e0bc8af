"""License scans: find license notices in texts.

Texts are cut into overlapping word windows, one window length per class of
template length. A window's MinHash signature is compared to the templates'
by bands; a shared band retrieves the template, and the exact containment of
the template's five-word shingles in the window decides. The bands of a
class are set so that a window that holds a template with the least accepted
containment shares a band with it with probability 1 - miss or more.

Windows of a class are twice as long as its longest template and start every
half length, so a notice lies wholly inside some window. A window without
any template shingle cannot share a MinHash value with a template, so
signatures are computed only for windows that hold one.

Words are runs of letters and digits, lower-cased. Defined results for odd
input: null and empty texts match nothing; a template with fewer than five
words is one shingle of all its words; overlapping windows with the same
template are one match; of overlapping notices the best contained stands
(ties: the longer template, then the smaller license id); repeated rows each get a row; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices, tidy

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
HASHES = 128
MISS = 1e-6
SEED = 3

#: Notices by which licenses are commonly declared (their public wording), id -> texts.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles_of(words: list[str], k: int = SHINGLE_WORDS) -> list[str]:
    if not words:
        return []
    return [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]


def bands_for(jaccard: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``hashes``
    values that misses a pair of this similarity with probability miss at
    most; one row per band where even that is not enough."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        p = jaccard ** rows
        if p >= 1.0 or bands * math.log1p(-p) <= math.log(miss):
            return bands, rows
    return hashes, 1


class Scanner:
    """Templates with their signatures, by class of length."""

    def __init__(self, templates: dict[str, list[str]], *, shingle_words: int = SHINGLE_WORDS,
                 min_containment: float = MIN_CONTAINMENT, hashes: int = HASHES, miss: float = MISS, seed: int = SEED):
        self.k, self.min_containment = shingle_words, min_containment
        rng = np.random.default_rng(seed)
        self.mul = (rng.integers(1, 2**63, hashes, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 2**63, hashes, dtype=np.uint64)
        self.names: list[str] = []
        self.sets: list[frozenset] = []
        classes: dict[int, list[int]] = {}
        self.vocab: set[str] = set()
        for name, texts in templates.items():
            for t in texts:
                w = words_of(t)
                if not w:
                    continue
                classes.setdefault(max(8, 1 << (len(w) - 1).bit_length()), []).append(len(self.sets))
                self.names.append(name)
                self.sets.append(frozenset(shingles_of(w, self.k)))
                self.vocab.update(w)
        self.all_shingles = frozenset().union(*self.sets) if self.sets else frozenset()
        self.classes = []
        for size, members in sorted(classes.items()):
            length = 2 * size
            n_window = max(1, length - self.k + 1)
            # least Jaccard of a window holding min_containment of a template
            least = min(c / (len(self.sets[m]) + n_window - c) for m in members
                        for c in [max(1, math.ceil(min_containment * len(self.sets[m])))] )
            bands, rows = bands_for(least, hashes, miss)
            table: dict[tuple, list[int]] = {}
            for m in members:
                for b, key in enumerate(self._bands(self.signature(self.sets[m]), bands, rows)):
                    table.setdefault((b, key), []).append(m)
            self.classes.append((length, size, bands, rows, table))

    def signature(self, shingles) -> np.ndarray:
        h = np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), np.uint64)
        with np.errstate(over="ignore"):
            v = h[:, None] * self.mul + self.add
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
        return v.min(0)

    @staticmethod
    def _bands(sig: np.ndarray, bands: int, rows: int) -> list[bytes]:
        return [sig[b * rows:(b + 1) * rows].tobytes() for b in range(bands)]

    def scan(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(license, first word, end word, containment) of every match."""
        n = len(words)
        known = np.fromiter(map(self.vocab.__contains__, words), bool, n)
        if not known.any():
            return []
        # places where a template shingle starts
        k = self.k
        run = np.convolve(known, np.ones(k, dtype=np.int64), "valid") == k if n >= k else np.empty(0, bool)
        at = [i for i in np.flatnonzero(run).tolist() if " ".join(words[i:i + k]) in self.all_shingles]
        short = any(len(s.split(" ")) < k for s in self.all_shingles)
        if short:       # templates below k words are looked for as runs of their own length
            for s in (x for x in self.all_shingles if len(x.split(" ")) < k):
                m = len(s.split(" "))
                at += [i for i in np.flatnonzero(known[:max(0, n - m + 1)]).tolist() if " ".join(words[i:i + m]) == s]
        if not at:
            return []
        found: dict[tuple[int, int], float] = {}
        spans: dict[int, list[tuple[int, int, float]]] = {}
        for length, step, bands, rows, table in self.classes:
            starts = {s for i in at for s in range(max(0, (i - length) // step + 1) * step, i + 1, step)}
            for s in sorted(starts):
                w = words[s:s + length]
                sh = set(shingles_of(w, k))
                if short:
                    sh |= {x for x in self.all_shingles if len(x.split(" ")) < k and f" {x} " in f" {' '.join(w)} "}
                if sh.isdisjoint(self.all_shingles):
                    continue
                sig = self.signature(sh)
                got = {m for b, key in enumerate(self._bands(sig, bands, rows)) for m in table.get((b, key), ())}
                for m in sorted(got):
                    hit = self.sets[m] & sh
                    c = len(hit) / len(self.sets[m])
                    if c >= self.min_containment:
                        pos = [i for i in at if s <= i < s + length and any(" ".join(words[i:i + q]) in hit for q in range(1, k + 1))]
                        if not pos:
                            continue
                        first, last = min(pos), max(pos)
                        spans.setdefault(m, []).append((first, min(n, last + k), c))
        out = []
        for m, hits in spans.items():
            hits.sort()
            cur = list(hits[0])
            for f, e, c in hits[1:]:
                if f < cur[1]:
                    cur[1], cur[2] = max(cur[1], e), max(cur[2], c)
                else:
                    out.append((-cur[2], -len(self.sets[m]), self.names[m], cur[0], cur[1]))
                    cur = [f, e, c]
            out.append((-cur[2], -len(self.sets[m]), self.names[m], cur[0], cur[1]))
        # of notices that overlap, the best contained (then the longest) stands
        kept: list[tuple[str, int, int, float]] = []
        for c, _, name, f, e in sorted(set(out)):
            if all(e <= g or f >= h for _, g, h, _ in kept):
                kept.append((name, f, e, -c))
        return sorted(kept, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, id_col: str = "doc_id",
                  text_col: str = "text", **params) -> DataFrame:
    """One row per document: doc_id, n_matches and matches, an array of
    (license, first_word, end_word, containment). Templates are parameters
    (a bounded list of notices) and travel with the tasks."""
    ship(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, **params)
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"license": x, "first_word": f, "end_word": e, "containment": c} for x, f, e, c in scanner.scan(words_of(t))]
                     for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, kind)],
                                             names=["doc_id", "n_matches", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_matches long, matches array<struct<license:string,first_word:long,end_word:long,containment:double>>")
