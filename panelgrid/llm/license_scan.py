"""License scans: passages of a text compared with licence templates by the
Dice coefficient of their word bigrams.

Texts and templates are normalised to lower-case words of letters and digits.
A text falls into segments at line and sentence ends; every run of segments is
a passage.  Two bounds prune: a text must hold enough of a template's bigrams at
all, and a passage's number of bigrams must lie where the threshold can be
reached, between t / (2 - t) and (2 - t) / t times the template's.  What is left
is compared exactly, on distinct bigrams.

Plan: one pass over whole texts, no shuffle; the templates are a parameter and
travel with the task, as their hashes.

Defined results: null and empty texts have no licence; equal coefficients go to
the earlier and then the shorter passage; repeated rows are scanned each; a
template without a bigram never matches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.byte_bpe import slices
from panelgrid.llm.pretokens import mix64, span_hashes
from panelgrid.llm.shingles import _LOWER

DICE = 0.8

# Public notices of well-known licences.
TEMPLATES: dict[str, str] = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?;:\n"])


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, start bytes and end bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = _WORD[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    low = _LOWER[b[inside]]
    return span_hashes(low, np.cumsum(ends - starts) - (ends - starts), ends - starts), starts, ends


def _bigrams(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * np.uint64(3) + mix64(words[1:])) if len(words) > 1 else np.zeros(0, np.uint64)


def _segments(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first word of every segment, and the number of words at the end."""
    b = np.frombuffer(raw, np.uint8)
    stops = np.concatenate([[0], np.cumsum(_STOP[b])])
    blank = np.concatenate([[0], np.cumsum(b <= 32)])
    new = (stops[starts[1:]] > stops[ends[:-1]]) & (blank[starts[1:]] > blank[ends[:-1]])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(starts)]])


@functools.lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, np.ndarray]], np.ndarray]:
    sets = [(name, np.unique(_bigrams(_words(text.encode())[0]))) for name, text in templates]
    sets = [x for x in sets if len(x[1])]
    return sets, np.unique(np.concatenate([s for _, s in sets])) if sets else np.zeros(0, np.uint64)


def scan_text(raw: bytes, templates: tuple[tuple[str, str], ...], least: float) -> list[tuple[str, float, int, int]]:
    """(licence, coefficient, start byte, end byte) of the best passage for each licence that has one."""
    sets, every = _prepared(templates)
    words, starts, ends = _words(raw)
    grams = _bigrams(words)
    known = np.flatnonzero(np.isin(grams, every))
    if not len(known):
        return []
    first = None
    out = []
    for name, wanted in sets:
        hits = known[np.isin(grams[known], wanted)]
        low, high = least / (2 - least) * len(wanted), (2 - least) / least * len(wanted)
        if len(np.unique(grams[hits])) < low:
            continue
        if first is None:
            first = _segments(raw, starts, ends)
        best = None
        # A passage that starts without a hit in its first segment is beaten by the one that starts later.
        for s in np.unique(np.searchsorted(first, hits, "right") - 1).tolist():
            for e in range(s + 1, len(first)):
                own = np.unique(grams[first[s]:first[e] - 1])
                if len(own) > high:
                    break
                if len(own) < low:
                    continue
                dice = 2 * len(np.intersect1d(own, wanted, assume_unique=True)) / (len(own) + len(wanted))
                if dice >= least and (best is None or dice > best[1]):
                    best = (name, dice, int(starts[first[s]]), int(ends[first[e] - 1]))
        if best:
            out.append(best)
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = DICE, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id and licenses (array of name, dice, start and end byte, by name)."""
    fixed = tuple(sorted(templates.items()))
    kind = "array<struct<name:string,dice:double,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [[dict(zip(("name", "dice", "start", "end"), x, strict=True)) for x in scan_text(
                    (t or "").encode("utf-8", "surrogatepass"), fixed, least)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["doc_id", "licenses"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, licenses {kind}")
