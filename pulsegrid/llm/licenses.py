"""License texts in documents: winnowed fingerprints, an inverted index and banded alignment (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textbytes import LOWER, joined, raw, slices, span_hashes, word_spans

# Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "CC BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "Reserved line": "All rights reserved.",
}
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def templates(spark: SparkSession) -> DataFrame:
    """The built-in wordings as ``template, text``."""
    return spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string")


def _words(texts: list[bytes]):
    """Lowered words of letters and digits (hash, text, start, end in the text)."""
    buf, starts = joined(texts)
    buf = np.where(_WORD[buf], LOWER[buf], np.uint8(0x20))
    s, e = word_spans(buf)
    own = np.searchsorted(starts, s, "right") - 1
    return span_hashes(buf, s, e), own, s - starts[own], e - starts[own]


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        h = (h + words[i : i + len(h)]) * np.uint64(0xD1342543DE82EF95)
    return h


def winnow(prints: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest print of every ``window`` neighbours (rightmost if tied); all if there are fewer.

    A print found equal in two texts with its neighbours is chosen in both.
    """
    if len(prints) <= window:
        return np.arange(len(prints)) if len(prints) < window else np.array([len(prints) - 1 - int(prints[::-1].argmin())])
    tiles = np.lib.stride_tricks.sliding_window_view(prints[::-1], window)
    return np.unique(len(prints) - 1 - (tiles.argmin(1) + np.arange(len(tiles))))


def align(words: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Local alignment inside ``band`` words of a diagonal: matched words, first and end word of the text.

    A match counts 2, a replaced, missing or extra word -1.
    """
    size, width = len(template), 2 * band + 1
    best, at = (0, 0, 0, 0), {}
    above: dict[int, tuple[int, int, int]] = {}
    for i in range(size):
        row: dict[int, tuple[int, int, int]] = {}
        for k in range(width):
            j = i + diagonal - band + k
            if not 0 <= j < len(words):
                continue
            same = words[j] == template[i]
            score, matched, first = above.get(j - 1, (0, 0, j))
            options = [(score + 2, matched + 1, first if score else j) if same else (score - 1, matched, first)]
            for score, matched, first in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                options.append((score - 1, matched, first))
            top = max(options, key=lambda x: (x[0], x[1], -x[2]))
            if top[0] > 0:
                row[j] = top
                if (top[0], top[1], -top[2], -j) > best[:1] + best[1:2] + (-best[2], -best[3]):
                    best = (top[0], top[1], top[2], j)
        above = row
    return best[1], best[2], best[3] + 1


def rare_places(text: bytes, coverage: float) -> list[int]:
    """Places of the longest words of a template, one more than a match of ``coverage`` may lack: each match has one of them."""
    _, _, start, end = _words([text])
    n = len(start)
    lacks = int(n - np.ceil(coverage * n - 1e-9))
    return np.argsort(start - end, kind="stable")[: lacks + 1].tolist()


def _find(index: dict[int, list[tuple[str, int]]], singles: dict[int, list[tuple[str, int]]], wordings: dict[str, np.ndarray], size: int, window: int, band: int, coverage: float):
    keys, rare = np.array(sorted(index), np.uint64), np.array(sorted(singles), np.uint64)

    def run(batches):
        for batch in slices(batches, "text"):
            words, own, start, end = _words(raw(batch.column("text")))
            prints = _shingles(words, size)
            place = np.searchsorted(keys, prints)
            place[place == len(keys)] = 0
            hits = np.flatnonzero((keys[place] == prints) & (own[: len(prints)] == own[size - 1 :])) if len(keys) and len(prints) else np.empty(0, np.int64)
            lone = np.flatnonzero(np.isin(words, rare))
            out = []
            for doc in np.unique(np.concatenate([own[hits], own[lone]])).tolist():
                base, stop = np.searchsorted(own, [doc, doc + 1]).tolist()
                text, seeds = words[base:stop], {}
                for h in hits[np.searchsorted(hits, base) : np.searchsorted(hits, stop)].tolist():
                    for name, at in index[int(prints[h])]:
                        seeds.setdefault(name, set()).add(h - base - at)
                for h in lone[np.searchsorted(lone, base) : np.searchsorted(lone, stop)].tolist():
                    for name, at in singles[int(words[h])]:
                        seeds.setdefault(name, set()).add(h - base - at)
                for name in sorted(seeds):
                    wording, found, begin = wordings[name], [], 0
                    for diagonal in sorted(seeds[name]):
                        if diagonal + len(wording) + band <= begin:
                            continue
                        matched, first, final = align(text[begin:], wording, diagonal - begin, band)
                        if matched >= coverage * len(wording):
                            found.append((matched, first + begin, final + begin))
                            begin += final
                    for matched, first, final in found:
                        out.append((doc, name, matched / len(wording), first, final, int(start[base + first]), int(end[base + final - 1])))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]],
                ["id", "template", "coverage", "first_word", "end_word", "first_byte", "end_byte"])

    return run


def scan(
    docs: DataFrame, wordings: DataFrame | None = None, key: str = "doc_id", text: str = "text", size: int = 3, window: int = 4, band: int = 4,
    coverage: float = 0.8, max_templates: int = 10_000, short: int = 16,
) -> DataFrame:
    """One row per place of a template: ``id, template, coverage, first_word, end_word, first_byte, end_byte``.

    Template words (runs of letters and digits, A-Z lowered) are cut in shingles of ``size``; winnowing keeps the
    smallest of each ``window``, and an inverted index maps them to templates and places.  Any ``size + window - 1`` template words
    in a row hold an indexed shingle, and every shingle of a text is looked up.  Templates of fewer than ``short`` words are found
    by single words instead: so many of their longest words are indexed that each match holds one.  Around each hit's diagonal a local alignment
    within ``band`` words counts matched template words; ``coverage`` of them make a match.  Spans are half open, bytes are those of the text in UTF-8.

    The index goes to the tasks inside the function; it has at most one entry per template word, and more than
    ``max_templates`` templates raise ValueError (scan them in parts).  Texts are read whole where they lie, without a shuffle.  Null and empty
    texts and templates match nothing.  Null ids are kept.  Repeated rows repeat their matches.  An empty table gives an empty result.
    """
    wordings = wordings if wordings is not None else templates(docs.sparkSession)
    rows = wordings.select("template", "text").limit(max_templates + 1).collect()
    if len(rows) > max_templates:
        raise ValueError("too many templates for one scan")
    known, index, singles = {}, {}, {}
    for name, words in sorted((r.template, r.text) for r in rows if r.template is not None and r.text):
        hashes = _words([words.encode()])[0]
        known[name] = hashes
        if len(hashes) < short:
            for at in rare_places(words.encode(), coverage):
                singles.setdefault(int(hashes[at]), []).append((name, at))
            continue
        prints = _shingles(hashes, size)
        for at in winnow(prints, window).tolist():
            index.setdefault(int(prints[at]), []).append((name, at))
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(
        _find(index, singles, known, size, window, band, coverage),
        "id long, template string, coverage double, first_word long, end_word long, first_byte long, end_byte long")
