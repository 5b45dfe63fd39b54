"""License scan: winnowed fingerprints pick candidates, banded alignment decides.

The templates' fingerprints (of the hashes of GRAM words in each WINNOW places the least) are an
inverted index to (template, place).  A text's hits in it point to places where a template may begin;
hits that agree on the place, within the band, make one candidate.  Template and text are then aligned
word by word in a band around that place.  The index is as large as the templates, and each text is
judged by itself: nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch.llm.tables import map_arrow, read
from graphsearch.llm.wordbytes import ALNUM_FOLDED, Words, grams, inside, pieces

#: Any GRAM + WINNOW - 1 words in a row that a text shares with a template are seen.
GRAM, WINNOW = 3, 2
BAND, LEAST_COVERAGE = 6, 0.8

#: Notices and license texts, as published.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


class Index:
    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        self.words = []
        entries = set()
        for t, text in enumerate(templates.values()):
            words = Words(pa.array([text], pa.large_string()), ALNUM_FOLDED).hash
            if len(words) < GRAM:
                raise ValueError(f"template {self.names[t]!r} has fewer than {GRAM} words")
            self.words.append(words)
            n = min(GRAM, len(words))
            g = grams(words, n) if n == GRAM else np.zeros(0, np.uint64)
            for k in range(max(1, len(g) - WINNOW + 1) if len(g) else 0):
                window = g[k : k + WINNOW]
                at = k + len(window) - 1 - int(np.argmin(window[::-1]))
                entries.add((int(g[at]), t, at))
        self.entries: dict[int, list[tuple[int, int]]] = {}
        for h, t, at in sorted(entries):
            self.entries.setdefault(h, []).append((t, at))
        self.keys = np.array(sorted(self.entries), np.uint64)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Words matched by the best alignment of template[i] with text[i + shift - band … i + shift + band], and the first and last matched word of text, plus one; the shortest span of the best ones that end first."""
    width = 2 * band + 1
    # score, and minus the beginning, packed so that more words win, then the later beginning.
    none = -(1 << 60)
    best = np.full(width, none, np.int64)
    top, top_end = none, 0
    big = np.int64(1) << 32
    for i, word in enumerate(template):
        at = i + shift - band + np.arange(width)
        ok = (at >= 0) & (at < len(text))
        same = ok & (text[np.clip(at, 0, len(text) - 1)] == word) if len(text) else ok
        start = np.where(same, big + at, none)
        go = np.where(same & (best > 0), best + big, none)
        skip = np.append(best[1:], none)  # the template's word has no partner
        now = np.maximum(np.maximum(start, go), np.where(skip > 0, skip, none))
        now = np.maximum.accumulate(now)  # words of text without partners
        matched = np.maximum(start, go)
        k = int(np.argmax(matched))
        if matched[k] >> 32 > (top >> 32 if top > 0 else 0) or (top > 0 and matched[k] >> 32 == top >> 32 and matched[k] - at[k] > top - (top_end - 1)):
            top, top_end = int(matched[k]), int(at[k]) + 1
        best = now
    return (top >> 32, top & (1 << 32) - 1, top_end) if top > 0 else (0, 0, 0)


def scan_words(index: Index, words: np.ndarray, hits: np.ndarray, values: np.ndarray, band: int, least: float) -> Iterator[tuple[str, int, int, int, float]]:
    """Matches in one text: name, words matched, [from, to) word numbers, coverage; hits are places of its grams that the index has."""
    starts: dict[int, list[int]] = {}
    for at, value in zip(hits.tolist(), values.tolist(), strict=True):
        for t, place in index.entries[value]:
            starts.setdefault(t, []).append(at - place)
    for t, shifts in sorted(starts.items()):
        template = index.words[t]
        shifts.sort()
        found: list[tuple[int, int, int]] = []
        k = 0
        while k < len(shifts):
            z = k
            while z < len(shifts) and shifts[z] - shifts[k] <= band:
                z += 1
            matched, begin, end = align(template, words, shifts[(k + z - 1) // 2], band)
            if matched >= least * len(template):
                found.append((matched, begin, end))
            k = z
        taken: list[tuple[int, int]] = []  # kept matches by place; they don't overlap
        for matched, begin, end in sorted(set(found), key=lambda m: (-m[0], m[1])):
            k = bisect.bisect_left(taken, (begin, end))
            if (k == 0 or taken[k - 1][1] <= begin) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (begin, end))
                yield index.names[t], matched, begin, end, matched / len(template)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, band: int = BAND, least: float = LEAST_COVERAGE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, license, n_matched, coverage, word_from, word_to: each place of a text that matches at least that part of a template's words.

    Words are letters and digits, A-Z folded; word_to is exclusive.  Null and empty texts match
    nothing, and texts without a match have no row; repeated rows are each answered.  Of matches of
    one template that overlap, those with most words (then the first) are reported.  A template of
    fewer than GRAM words has no fingerprint and raises an error.  No other column of docs is read.
    """
    index = Index(templates)
    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 16, bool)
        table[(index.keys >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"), ALNUM_FOLDED)
                g = grams(words.hash, GRAM)
                maybe = np.flatnonzero(table[(g >> np.uint64(48)).astype(np.int64)] & inside(words, GRAM))
                place = np.minimum(np.searchsorted(index.keys, g[maybe]), max(0, len(index.keys) - 1))
                hits = maybe[index.keys[place] == g[maybe]] if len(index.keys) else maybe[:0]
                cut = np.searchsorted(words.doc[hits], np.arange(len(piece) + 1))
                rows = []
                for d in np.flatnonzero(np.diff(cut)):
                    a, z = words.first[d], words.first[d + 1]
                    mine = hits[cut[d] : cut[d + 1]]
                    rows += [(int(d), *m) for m in scan_words(index, words.hash[a:z], mine - a, g[mine], band, least)]
                if rows:
                    d, name, matched, begin, end, coverage = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(d)), pa.array(name), pa.array(matched, pa.int64()), pa.array(coverage), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["id", "license", "n_matched", "coverage", "word_from", "word_to"])

    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("license string, n_matched bigint, coverage double, word_from bigint, word_to bigint").fields])
    return map_arrow(source, run, schema).withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
