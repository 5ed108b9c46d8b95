"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs outside space and ASCII punctuation, ASCII-lower-cased. Each template's three-word hashes are winnowed
(the least of every WINDOW consecutive ones is kept) into an index; a text's hashes that meet it name the template
and the diagonal. Along that diagonal a banded longest-common-subsequence alignment counts the template's words that
the text holds in order; if the share reaches the threshold, the match is reported with its span. Where matches of
several templates overlap, those with the most matched words stay, then those with the most coverage: templates that
differ in one word share the rest, and a short form may stand inside a long notice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import pick
from .textbytes import CONTINUATION, LOWER, PUNCTUATION, SPACE, Hasher, blocks, column_bytes, windows, word_spans

_APART = SPACE | PUNCTUATION
WIDTH, WINDOW, BAND = 3, 2, 8

#: name -> words of a notice (fixed values: what licenses ask to put on a work, and the short forms in use)
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "BSD-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)"
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software."
    ),
}


def _words(data: np.ndarray, offsets: np.ndarray):
    data = LOWER[data]
    start, end, row = word_spans(data, offsets, _APART)
    return Hasher(data).spans(start, end), start, end, row


def winnow(key: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every ``window`` consecutive ones (the last of equal ones)."""
    if len(key) <= window:
        return np.array([len(key) - 1 - int(np.argmin(key[::-1]))]) if len(key) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(key, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


@dataclass(frozen=True)
class Index:
    names: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    key: np.ndarray  # sorted fingerprints
    template: np.ndarray
    place: np.ndarray  # word position in the template
    marked: np.ndarray  # which top 16 bits any fingerprint has
    widths: tuple[int, ...]  # words of a fingerprint: WIDTH, and fewer where a template has fewer

    @staticmethod
    def build(templates: dict[str, str]) -> Index:
        names, words, rows, widths = tuple(templates), [], [], {WIDTH}
        for t, text in enumerate(templates.values()):
            data, offsets = column_bytes(pa.array([text]))
            own, _, _, row = _words(data, offsets)
            width = min(WIDTH, max(1, len(own)))
            key, first = windows(own, row, width)
            words.append(own)
            if not len(own):
                continue
            widths.add(width)
            rows += [(key[p], t, first[p]) for p in winnow(key, WINDOW)]
        rows.sort()
        key = np.array([r[0] for r in rows], np.uint64)
        marked = np.zeros(1 << 16, bool)
        marked[(key >> np.uint64(48)).astype(np.int64)] = True
        return Index(names, tuple(words), key, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), marked, tuple(sorted(widths)))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last matched word of text) of the longest common subsequence that stays within
    ``band`` of text position = template position + diagonal: of equal ones that with the earliest end,
    and from there words as late as may be."""
    m, width = len(template), 2 * band + 1
    best = np.zeros((m + 1, width + 1), np.int32)  # cell k of row i: text words before i + diagonal - band + k
    for i in range(1, m + 1):
        at = i - 1 + diagonal - band + np.arange(width)
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, max(0, len(text) - 1))] == template[i - 1]) if len(text) else np.zeros(width, bool)
        above = np.append(best[i - 1, 1:], 0)[: width + 1]
        here = above.copy()
        here[1 : width + 1] = np.maximum(here[1 : width + 1], 0)
        # row i counts text words before i + diagonal - band + k, row i - 1 those before one less
        here[:width] = np.maximum(above[:width], np.where(same, best[i - 1, :width] + 1, 0))
        best[i] = np.maximum.accumulate(here)
    i, k = m, int(best[m].argmax())
    total, first, last = int(best[m, k]), -1, -1
    while i > 0 and best[i, k] > 0:
        at = i - 1 + diagonal - band + k
        if last >= 0 and k < width and 0 <= at < len(text) and text[at] == template[i - 1] and best[i - 1, k] + 1 == best[i, k]:
            first, i = at, i - 1
        elif k > 0 and best[i, k] == best[i, k - 1]:
            k -= 1
        elif k + 1 <= width and best[i - 1, k + 1] == best[i, k]:
            i, k = i - 1, k + 1
        else:
            first, last = at, at if last < 0 else last
            i -= 1
    return total, first, last


def strongest(index: Index, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without the matches that overlap a kept one of more matched words, or of as many and more coverage; equal ones
    all stay."""
    kept: list[tuple[int, int, int, int]] = []
    worth = [(n, n / len(index.words[t])) for t, n, _, _ in found]
    for k in sorted(range(len(found)), key=worth.__getitem__, reverse=True):
        _, _, a, b = found[k]
        if not any(a < d and c < b and (n, n / len(index.words[t])) > worth[k] for t, n, c, d in kept):
            kept.append(found[k])
    return kept


def block_licenses(index: Index, data: np.ndarray, offsets: np.ndarray, least: float) -> list[list[tuple[int, int, int, int]]]:
    """(template, matched words, start, end) for each text; start and end in code points, end exclusive."""
    words, start, end, row = _words(data, offsets)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    key, first = (np.concatenate(x) for x in zip(*[windows(words, row, w) for w in index.widths], strict=True))
    if len(index.widths) > 1:
        order = np.argsort(first, kind="stable")
        key, first = key[order], first[order]
    near = np.flatnonzero(index.marked[(key >> np.uint64(48)).astype(np.int64)])
    low, high = np.searchsorted(index.key, key[near], "left"), np.searchsorted(index.key, key[near], "right")
    edges = np.searchsorted(row, np.arange(len(offsets)))
    covered: dict[tuple[int, int], int] = {}
    tried: set[tuple[int, int, int]] = set()
    for p, a, b in zip(near[high > low], low[high > low], high[high > low], strict=True):
        r, at = int(row[first[p]]), int(first[p])
        for k in range(a, b):
            t, diagonal = int(index.template[k]), at - int(index.place[k])
            if covered.get((r, t), -1) >= at or (r, t, diagonal) in tried:
                continue
            tried.add((r, t, diagonal))
            template = index.words[t]
            base = max(int(edges[r]), covered.get((r, t), -1) + 1)  # a word counts for one match of a template
            matched, one, last = align(template, words[base : edges[r + 1]], diagonal - base)
            if matched >= least * len(template):
                one, last = one + base, last + base
                before = int((~CONTINUATION[data[offsets[r] : start[one]]]).sum())
                size = int((~CONTINUATION[data[start[one] : end[last]]]).sum())
                out[r].append((t, matched, before, before + size))
                covered[(r, t)] = last
    return [strongest(index, found) for found in out]


_FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index.build(dict(templates))


def finder(templates: dict[str, str], least: float):
    """A column function: text -> array of (license, coverage, start, end), by start."""

    @F.arrow_udf(_FOUND)
    def find(text: pa.Array) -> pa.Array:
        index, rows = _index(tuple(templates.items())), []
        for _, _, data, offsets in blocks(text):
            for found in block_licenses(index, data, offsets, least):
                hits = [{"license": index.names[t], "coverage": n / len(index.words[t]), "start": s, "end": e} for t, n, s, e in found]
                rows.append(sorted(hits, key=lambda h: (h["start"], h["license"], h["end"])))
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array(rows, kind)

    return find


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id and licenses (array of license, coverage, start, end) for every row of docs; null, empty and clean
    texts get an empty array. Templates without a word are never found."""
    find = finder(templates or TEMPLATES, least)
    return pick(docs, "doc_id", "text").select("doc_id", find("text").alias("licenses"))
