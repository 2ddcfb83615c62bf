"""License scans by patience alignment.

A template is aligned with every stretch of a text that may cover it, and the best place counts: words that occur once in both are anchors, the
longest increasing run of anchors is kept, and the gaps between them are aligned in the same way, down to
a plain longest common subsequence where no word is unique. Coverage is the share of the template's words
that the alignment matches; the phrases that name license and version must be among them, unbroken.

Texts that can't reach the coverage are passed over by an exact bound, the words that text and template
have in common counted with repetition, for all texts and templates of a slice at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, slices

COVERAGE = 0.8

#: Notices by which works are put under well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

#: Phrases that name license and version. All must match, word after word and with no other word between:
#: "GNU Lesser General Public License" isn't the "GNU General Public License".
NAMING = {
    "Apache-2.0": ("Apache License", "2.0"),
    "Apache-2.0-header": ("Apache License", "2.0"),
    "MIT": ("MIT License",),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "GPL-header": ("GNU General Public License",),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0",),
}


def plain(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}“”„«»")


def split(texts: pa.Array) -> pa.ListArray:
    return pc.utf8_split_whitespace(pc.fill_null(texts, ""))


def words_of(text: str) -> list[str]:
    return [w for w in map(plain, split(pa.array([text], pa.string()))[0].as_py()) if w]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, ascending in both lists, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i >= j or p >= q:
            continue
        anchors = _anchors(a, i, j, b, p, q)
        if not anchors:
            out += _common(a, i, j, b, p, q)
            continue
        for x, y in [*anchors, (j, q)]:
            todo.append((i, x, p, y))
            i, p = x + 1, y + 1
        out += anchors
    return sorted(out)


def _anchors(a: list, i: int, j: int, b: list, p: int, q: int) -> list[tuple[int, int]]:
    """Words unique in both stretches, and of these the longest run ascending in both (by patience)."""
    in_a, in_b = Counter(a[i:j]), Counter(b[p:q])
    place = {w: k for k, w in enumerate(b[p:q], p) if in_b[w] == 1}
    both = [(k, place[w]) for k, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place]
    tops: list[int] = []  # the smallest end of a run of each length
    ends: list[int] = []
    before: list[int] = []
    for n, (_, y) in enumerate(both):
        pile = bisect_left(tops, y)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            ends.append(n)
        else:
            tops[pile], ends[pile] = y, n
    run, n = [], ends[-1] if ends else -1
    while n >= 0:
        run.append(both[n])
        n = before[n]
    return run[::-1]


def _common(a: list, i: int, j: int, b: list, p: int, q: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two stretches without a word unique in both."""
    rows, columns = j - i, q - p
    best = np.zeros((rows + 1, columns + 1), np.int32)
    for x in range(rows - 1, -1, -1):
        for y in range(columns - 1, -1, -1):
            best[x, y] = best[x + 1, y + 1] + 1 if a[i + x] == b[p + y] else max(best[x + 1, y], best[x, y + 1])
    out, x, y = [], 0, 0
    while x < rows and y < columns:
        if a[i + x] == b[p + y]:
            out.append((i + x, p + y))
            x, y = x + 1, y + 1
        elif best[x + 1, y] >= best[x, y + 1]:
            x += 1
        else:
            y += 1
    return out


def phrases_in(template: list[str], phrases: str | tuple[str, ...]) -> list[tuple[int, int]]:
    """Where each phrase is in a template: first word and number of words. A plain string names single words."""
    found = []
    for phrase in (tuple(phrases.split()) if isinstance(phrases, str) else phrases):
        run = words_of(phrase)
        at = [k for k in range(len(template) - len(run) + 1) if template[k : k + len(run)] == run]
        if run and not at and not isinstance(phrases, str):
            raise ValueError(f"{phrase!r} is no phrase of its template")
        found += [(at[0], len(run))] if run and at else []
    return found


def scan_words(
    words: list[str], template: list[str], least: float = 1, exact: frozenset = frozenset(), runs: tuple = ()
) -> tuple[int, int, int]:
    """Start, end and matched words of a template's best place in a text; of equal places the first.

    A stretch is half as long again as the template. Every stretch is aligned that has at least ``least`` of
    the template's words, each counted as often as the template has it at most, and all words of ``exact``.
    Of stretches that hold the same of these words one is aligned, so that each word is followed once.
    An alignment that leaves out a word of ``exact`` doesn't count, nor one that breaks one of the ``runs``
    (first word and length in the template).
    """
    size = len(template) + len(template) // 2 + 2
    need, have = Counter(template), Counter()
    must = [k for k, w in enumerate(template) if w in exact]
    score, best = 0, (0, 0, 0)
    seen: set[tuple[int, ...]] = set()
    inside: deque[int] = deque()
    for k, w in enumerate(words):
        if w in need:
            have[w] += 1
            score += have[w] <= need[w]
            inside.append(k)
        if k >= size and (old := words[k - size]) in need:
            score -= have[old] <= need[old]
            have[old] -= 1
            inside.popleft()
        # the stretch ends in a word of the template; one that ends later holds no more
        if w not in need or score < max(least, best[2] + 1) or any(have[x] < need[x] for x in exact):
            continue
        places = list(inside)
        key = tuple(words[x] for x in places)
        # where runs count, so does which of the words are neighbours
        known = (key, tuple(map(sub, places[1:], places[:-1]))) if runs else key
        if known in seen:
            continue
        seen.add(known)
        pairs = align(list(key), template)
        matched = {y: places[x] for x, y in pairs}
        whole = all(matched.get(y + j, -1) == matched.get(y, -2) + j for y, n in runs for j in range(n))
        if len(pairs) > best[2] and whole and all(y in matched for y in must):
            best = places[pairs[0][0]], places[pairs[-1][0]] + 1, len(pairs)
            if best[2] == len(template):
                break
    return best


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], coverage: float, naming: dict[str, str]):
    wanted = {name: words_of(text) for name, text in templates.items()}
    wanted = {name: words for name, words in wanted.items() if words}
    names = list(wanted)
    runs = {name: tuple(phrases_in(wanted[name], naming.get(name, ""))) for name in names}
    exact = {name: frozenset(w for y, n in runs[name] for w in wanted[name][y : y + n]) for name in names}
    known = {w: k for k, w in enumerate(sorted({w for words in wanted.values() for w in words}))}
    need = np.zeros((len(names), max(len(known), 1)), np.int64)
    for t, name in enumerate(names):
        for w in wanted[name]:
            need[t, known[w]] += 1
    least = coverage * need.sum(1)
    for batch in slices(batches, "text"):
        texts = batch.column("text")
        lists = split(texts)
        flat = lists.flatten().dictionary_encode()
        codes = [known.get(plain(w), -1) for w in flat.dictionary.to_numpy(zero_copy_only=False).tolist()]
        code = np.array(codes, np.int64)[flat.indices.to_numpy(zero_copy_only=False)] if codes else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        owner, code = owner[code >= 0], code[code >= 0]
        cells, counts = np.unique(owner * need.shape[1] + code, return_counts=True)
        at, word = cells // need.shape[1], cells % need.shape[1]
        rows = []
        for t, name in enumerate(names):
            shared = np.bincount(at, np.minimum(counts, need[t][word]), batch.num_rows)
            for d in np.flatnonzero(shared >= least[t]).tolist():
                start, end, matched = scan_words(words_of(texts[d].as_py()), wanted[name], least[t], exact[name], runs[name])
                if matched >= least[t]:
                    rows.append((d, name, matched / len(wanted[name]), start, end, matched))
        rows.sort()
        found = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(found, types, strict=True)]
        arrays[0] = batch.column("doc_id").take(arrays[0])
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "license", "coverage", "start_word", "end_word", "n_matched"])


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    naming: dict[str, str | tuple[str, ...]] = NAMING,
) -> DataFrame:
    """One row per row of ``docs`` and template that it covers: doc_id, license, coverage, start_word,
    end_word, n_matched (places count words with a character other than punctuation).

    ``templates`` is a small dictionary of names and texts, sent with the job; templates without words are
    passed over. ``naming`` has, by name, the phrases of a template that must match unbroken, or a string of
    single words that must. Null and empty texts match none; null ids and repeated rows are scanned like others.
    Whole texts are scanned; the best place of each template is given. Other columns aren't read.
    """
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return narrow.mapInArrow(
        lambda it: _scan(it, templates, coverage, naming),
        "doc_id bigint, license string, coverage double, start_word bigint, end_word bigint, n_matched bigint",
    )
