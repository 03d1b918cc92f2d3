"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Texts and templates become words (ASCII letters and digits and non-ASCII characters, A-Z lower-cased). A template's hashes
of GRAM words are winnowed: of each WINNOW neighbours the least is kept, and the kept ones make an inverted index from
hash to (template, place). All hashes of a text are looked up in it. Hits that go on next to each other are segments. Segments that come in the
template's order make chains, by the best sum of words in common less half the words that are passed over in between; so what is
inserted or missing, however long, joins two parts if they are worth it. A chain that hits the share HITS of the template's fingerprints (a
fifth of changed words leaves two fifths of all grams) is a candidate: between its segments, and beyond its ends, template and text are
aligned word against word within a band. A candidate is reported if the matched words are at least `least` of the template's: with its
coverage and the byte range from the first to the last matched word. Of reports that overlap, of whatever templates, the one with
the most words matched less words missed stays (then the longer, then the earlier): a text of two clauses isn't one of three, and a notice
inside a whole license text belongs to it.

Some words decide which license it is: numbers, and the names of variants. Those of a notice have to be matched, and its span may have no
others of these names; in the title of a whole text (its first TITLE words) there may be no others. So a notice of version 2 is none of version
3, and a license for libraries, for servers or for non-commercial use is not the one whose words it shares.

The templates are whole license texts (files in templates/, by SPDX name) and the notices below. The index is broadcast: it holds
the given templates alone (INDEX_BYTES at most, checked), whatever the input.

Defined results: null and empty texts have no match; repeated rows are scanned each; null doc_ids are kept as they are;
templates without words are ignored; one shorter than GRAM words is one fingerprint; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PUNCT, Words, doubled, each, texts_of, tune

GRAM, WINNOW, LEAST, HITS, INDEX_BYTES = 3, 2, 0.8, 1 / 5, 64 << 20
#: Templates of up to so many words are notices; words of a whole text's title; words on either side that a band has beyond what lengths differ by.
NOTICE, TITLE, BAND = 120, 14, 64
#: Names of variants, which decide.
VARIANTS = ["affero", "lesser", "library", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd"]

#: Notices of common public licenses, by SPDX name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def texts_of_licenses() -> list[tuple[str, str]]:
    """The whole license texts that come with this package."""
    return [(f.stem, f.read_text(encoding="utf-8").strip()) for f in sorted((Path(__file__).parent / "templates").glob("*.txt"))]


TEMPLATES = [*NOTICES, *texts_of_licenses()]


class Index:
    """Templates as word hashes, and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: list[tuple[str, str]]):
        w = Words([t.encode() for _, t in templates], PUNCT, lower=True)
        self.names = [n for n, _ in templates]
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.fewest = [0] * len(self.words)
        for k, words in enumerate(self.words):
            if not len(words):
                continue
            h = doubled(words, min(GRAM, len(words)))
            groups = max(1, len(h) - WINNOW + 1)
            kept = {i + int(np.argmin(h[i : i + WINNOW])) for i in range(groups)}
            self.fewest[k] = max(1, int(HITS * len(kept)))
            for at in kept:
                self.places.setdefault(int(h[at]), []).append((k, at))
        self.lengths = sorted({min(GRAM, len(x)) for x in self.words if len(x)})
        self.keys = np.array(sorted(self.places), dtype=np.uint64)
        names = Words([b" ".join(v.encode() for v in VARIANTS)], PUNCT).hash
        self.variants = np.unique(names)
        numbers = np.unique(w.hash[[w.buffer[a:z].isdigit() for a, z in zip(w.start.tolist(), w.stop.tolist(), strict=True)]]) if len(w.start) else names[:0]
        #: Places of each notice's deciding words, and of the words in which names of variants would tell another license.
        self.deciding = [np.flatnonzero(np.isin(x, numbers) | np.isin(x, names)) if len(x) <= NOTICE else np.zeros(0, dtype=np.int64) for x in self.words]


def aligned(template: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """The matched places (template, text) of a best alignment of two short stretches from end to end: a match counts 2, a word without partner or
    with another one -1. The band is as wide as the lengths differ and BAND more on either side; wider stretches' middles may lie outside."""
    n, m = len(template), len(text)
    if not n or not m:
        return []
    low, high = min(0, m - n) - BAND, max(0, m - n) + BAND
    width = high - low + 1
    worst = -(1 << 30)
    d = np.arange(width)
    row = np.where((d + low >= 0) & (d + low <= m), -(d + low), worst)  # no word of the template, j of the text
    came = np.zeros((n, width), dtype=np.int8)
    for i in range(n):
        j = d + low + i + 1  # text words used after this row
        inside = (j >= 0) & (j <= m)
        same = np.zeros(width, dtype=bool)
        use = inside & (j >= 1)
        same[use] = text[j[use] - 1] == template[i]
        met = np.where(use, row + np.where(same, 2, -1), worst)
        alone = np.append(row[1:], worst) - 1
        best = np.where(inside, np.maximum(met, alone), worst)
        reach = best + d  # words of the text alone go from left to right
        top = np.maximum.accumulate(reach)
        row = np.where(inside, top - d, worst)
        came[i] = np.where(row > best, 2, np.where(met >= alone, np.where(same, 3, 0), 1))
    out, i, k = [], n - 1, m - n - low
    while i >= 0:
        step = came[i, k]
        if step == 2:
            k -= 1
        elif step == 1:
            i, k = i - 1, k + 1
        else:
            if step == 3:
                out.append((i, i + k + low))
            i -= 1
        if not 0 <= k < width:
            break
    return out[::-1]


def segments(hits: list[tuple[int, int]], gram: int) -> np.ndarray:
    """(place in the text, place in the template) of the hits of one template -> rows (text, template, words) of hits that follow each other
    at one distance, without a gap of words."""
    h = np.array(hits)
    shift = h[:, 0] - h[:, 1]
    h = h[np.lexsort((h[:, 0], shift))]
    shift = h[:, 0] - h[:, 1]
    new = np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(h[:, 0]) > gram)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    out = np.stack([h[first, 0], h[first, 1], h[last, 0] + gram - h[first, 0]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def chains(parts: np.ndarray, length: int) -> list[list[int]]:
    """Rows of segments -> chains of rows that go up in the text and in the template, the best first; no row is in two.

    A chain's worth is twice its words less the words passed over in the text or in the template, whichever are more. What is passed over at
    once in the text is at most what the whole template is worth."""
    i, p, n = parts.T
    best, back = (2 * n).astype(np.int64), np.full(len(parts), -1)
    for s in range(1, len(parts)):
        a = int(np.searchsorted(i, i[s] - 3 * length))
        t = np.arange(a, s)
        t = t[(i[t] < i[s]) & (p[t] < p[s])]
        if not len(t):
            continue
        over = np.maximum(0, np.maximum(i[t] + n[t] - i[s], p[t] + n[t] - p[s]))
        gap = np.maximum(np.maximum(0, i[s] - i[t] - n[t]), np.maximum(0, p[s] - p[t] - n[t]))
        worth = best[t] - gap - 2 * over + 2 * n[s]
        k = int(np.argmax(worth))
        if over[k] < n[s] and worth[k] > best[s]:
            best[s], back[s] = worth[k], t[k]
    used, out = np.zeros(len(parts), dtype=bool), []
    for s in np.argsort(-best, kind="stable").tolist():
        one = []
        while s >= 0 and not used[s]:
            used[s] = True
            one.append(s)
            s = int(back[s])
        if one:
            out.append(one[::-1])
    return out


def matched(template: np.ndarray, text: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The matched places (template, text) of a chain of segments: its own words, and those of alignments between and beyond them."""
    pairs: list[tuple[int, int]] = []
    at, place = None, None
    for i, p, n in chain.tolist():
        if at is None:
            room = min(i, p + BAND)
            begin = i - room
            pairs += [(x, begin + y) for x, y in aligned(template[:p], text[begin:i])]
        else:
            over = max(0, at - i, place - p)
            i, p, n = i + over, p + over, n - over
            pairs += [(place + x, at + y) for x, y in aligned(template[place:p], text[at:i])]
        same = np.flatnonzero(template[p : p + max(0, n)] == text[i : i + max(0, n)])
        pairs += [(p + int(x), i + int(x)) for x in same]
        at, place = i + max(0, n), p + max(0, n)
    rest = len(template) - place
    pairs += [(place + x, at + y) for x, y in aligned(template[place:], text[at : at + rest + BAND])] if rest else []
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def decides(index: Index, k: int, pairs: np.ndarray, text: np.ndarray) -> bool:
    """Whether the words that tell a license from its siblings are there, and no others of them."""
    words, of = index.words[k], pairs[:, 0]
    if not np.isin(index.deciding[k], of).all():
        return False
    head = pairs if len(words) <= NOTICE else pairs[of < TITLE]
    if not len(head):
        return True
    inside = np.ones(int(head[-1, 1] - head[0, 1]) + 1, dtype=bool)
    inside[head[:, 1] - head[0, 1]] = False
    return not np.isin(text[head[0, 1] : head[-1, 1] + 1][inside], index.variants).any()


def scan_texts(texts: list[bytes], index: Index, least: float = LEAST) -> list[list[dict]]:
    w = Words(texts, PUNCT, lower=True)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n in index.lengths:
        at = w.inside(n)
        h = doubled(w.hash, n)[at]
        hit = np.isin(h, index.keys)
        for i, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
            for k, place in index.places[x]:
                if min(GRAM, len(index.words[k])) == n:
                    found.setdefault((int(w.text[i]), k), []).append((i, place))
    reports: list[list[tuple]] = [[] for _ in texts]
    for (t, k), hits in sorted(found.items()):
        words, first_word = index.words[k], int(w.first[t])
        if len({p for _, p in hits}) < index.fewest[k]:
            continue
        gram = min(GRAM, len(words))
        text = w.hash[first_word : int(w.first[t + 1])]
        parts = segments([(i - first_word, p) for i, p in hits], gram)
        for chain in chains(parts, len(words)):
            if int(parts[chain, 2].sum()) < index.fewest[k]:
                continue
            pairs = matched(words, text, parts[chain])
            if len(pairs) >= least * len(words) and decides(index, k, pairs, text):
                reports[t].append((len(words) - 2 * len(pairs), -len(words), first_word + int(pairs[0, 1]), first_word + int(pairs[-1, 1]), k, len(pairs) / len(words)))
    out: list[list[dict]] = [[] for _ in texts]
    for t, some in enumerate(reports):
        begin, taken = int(w.text_start[t]), np.zeros(int(w.count[t]), dtype=bool) if some else None
        for _, _, first, last, k, cover in sorted(some):
            mine = taken[first - int(w.first[t]) : last - int(w.first[t]) + 1]
            if not mine.any():
                mine[:] = True
                out[t].append({"license": index.names[k], "template": k, "coverage": cover, "start": int(w.start[first]) - begin, "stop": int(w.stop[last]) - begin})
    return [sorted(x, key=lambda r: (r["start"], r["stop"], r["template"])) for x in out]


_MATCHES = "array<struct<license:string,template:int,coverage:double,start:bigint,stop:bigint>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, matches: license, template number, coverage and byte range of each report, in order of place."""
    templates = TEMPLATES if templates is None else templates
    if sum(len(t) for _, t in templates) > INDEX_BYTES:
        raise ValueError("the templates are beyond the bound of the broadcast index")
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Index(templates))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(scan_texts(texts_of(b), shared.value, least), _ARROW)], names=["doc_id", "matches"]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, matches {_MATCHES}")
