"""Licence scan: a generalised suffix automaton over licence template tokens.

The automaton holds every substring of every template. Each file is streamed
through it token by token, which gives the matching statistics: the longest
substring of any template that ends at each token. A base phrase stands where
the matched substring ends with it. Matches that cannot be extended and have
at least ``min_match`` words are chained per template by dynamic programming
into covered spans: a match continues the best chain that ends at most
``max_gap`` words before it and has covered only earlier parts of the template, or,
for parts in another order, only later ones. A chain pays ``_GAP`` words for each foreign
word between its matches and for each word of the template that it leaves
out, and ``_TURN`` words for a turn back. Every chain that holds ``min_cover`` of its
template after these charges is a span and gives its label: copies of a notice
are spans of their own. Of spans with different labels over the same words, the
one that holds the larger share of its template stays.

A word that is in no template resets the automaton, so only runs of known
words are streamed. The automaton depends on the templates alone and is built
once per Python worker; a file is one row of any length, held alone.

Null and empty texts have no words. Repeated rows and null ids each get their
row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from shiftwise.llm.common import id_and_text, map_arrow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licence notices, by label.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software.",
    ),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    (
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Automaton:
    """Generalised suffix automaton of token lists.

    ``ends[state]`` lists the (template, end) places where the state's
    substrings end; ``phrases[state]`` the base phrases that are suffixes of
    the state's longest substring, as (length, index).
    """

    def __init__(self, templates: list[list[str]], phrases: list[list[str]]):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        lists = [[self.ids.setdefault(w, len(self.ids)) for w in t] for t in [*templates, *phrases]]
        for n, tokens in enumerate(lists):
            state = 0
            for end, token in enumerate(tokens):
                state = self._extend(state, token)
                if n < len(templates):
                    self.ends[state].add((n, end))
        # a substring that ends at a place has all its suffixes ending there
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state] if self.link[state] else set()
        self.ends = [sorted(x) for x in self.ends]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        own: dict[int, list[tuple[int, int]]] = {}
        for k, tokens in enumerate(lists[len(templates) :]):
            state = 0
            for token in tokens:
                state = self.next[state][token]
            own.setdefault(state, []).append((len(tokens), k))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.phrases[state] = (self.phrases[up] if up > 0 else []) + own.get(state, [])

    def _clone(self, p: int, q: int, token: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.ends.append(set())
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # the substring is known from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.ends.append(set())
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) at each of the known tokens."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            else:
                state = size = 0
            yield state, size


@lru_cache(maxsize=4)
def _built(templates: tuple, phrases: tuple) -> tuple[Automaton, tuple[int, ...], int]:
    texts = [words_of(t) for _, t in templates]
    base = [words_of(p) for p, _ in phrases]
    return Automaton(texts, base), tuple(map(len, texts)), min(map(len, base), default=1)


_GAP, _TURN = 0.25, 5.0


def _chains(
    matches: list[tuple[int, int, int]], auto: Automaton, sizes: tuple[int, ...], max_gap: int, min_cover: float
) -> list[tuple[int, int, int, int]]:
    """Chains that hold ``min_cover`` of their template after charges, (template,
    covered words, first word, last word), from maximal matches (end in the
    text, length, state) in the order of the text."""
    per: dict[int, list[tuple[int, int, int]]] = {}
    for end, size, state in matches:
        for template, at in auto.ends[state]:
            per.setdefault(template, []).append((end, size, at))
    out = []
    for template, own in sorted(per.items()):
        # a chain by its last match: score, covered words, template words from and to, match before
        chains: list[tuple[float, int, int, int, int]] = []
        first = 0
        for j, (end, size, at) in enumerate(own):
            begin, low = end - size + 1, at - size + 1
            best = (float(size), size, low, at, -1)
            while first < j and own[first][0] < begin - 1 - max_gap:
                first += 1
            for i in range(first, j):
                before, (score, covered, low_i, at_i, _) = own[i][0], chains[i]
                over = max(0, before - begin + 1)  # words that the chain has already
                if over and before == end:
                    continue  # another place of the same words
                charge = _GAP * max(0, begin - before - 1)
                if at > at_i:  # further on in the template
                    over = max(over, at_i - low + 1)
                    found = (score + size - over - charge - _GAP * max(0, low - at_i - 1), covered + size - over, low_i, at, i)
                elif low < low_i:  # parts in another order
                    over = max(over, at - low_i + 1)
                    found = (score + size - over - charge - _TURN, covered + size - over, low, at_i, i)
                else:
                    continue
                if over < size and found[0] > best[0]:
                    best = found
            chains.append(best)
        used: set[int] = set()
        least = min_cover * sizes[template]
        for j in sorted(range(len(chains)), key=lambda j: (-chains[j][0], j)):
            if chains[j][0] < least:
                break
            path, i = [], j
            while i >= 0:
                path.append(i)
                i = chains[i][4]
            if used.isdisjoint(path):
                used.update(path)
                out.append((template, chains[j][1], own[path[-1]][0] - own[path[-1]][1] + 1, own[j][0]))
    return sorted(out)


def _strongest(spans: list[dict]) -> list[dict]:
    """Spans without those that mostly share their words with a span of another
    label that holds more of its template: notices of a family read alike."""
    order = sorted(range(len(spans)), key=lambda i: spans[i]["first"])
    weak: set[int] = set()
    active: list[int] = []
    for i in order:
        a = spans[i]
        active = [j for j in active if spans[j]["last"] >= a["first"]]
        for j in active:
            b = spans[j]
            shared = min(a["last"], b["last"]) - a["first"] + 1
            if a["label"] != b["label"] and 2 * shared > min(a["last"] - a["first"], b["last"] - b["first"]) + 1:
                if a["share"] != b["share"]:
                    weak.add(i if a["share"] < b["share"] else j)
        active.append(i)
    return [s for i, s in enumerate(spans) if i not in weak]


def scan(
    text: str | None, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, min_match: int = 4, max_gap: int = 40,
    min_cover: float = 0.6,
) -> dict:
    """The licences of one text: n_words, base places (start, phrase), and
    covered spans (label, share of the template, first word, last word)."""
    auto, sizes, shortest = _built(templates, phrases)
    words = words_of(text)
    ids = list(map(auto.ids.get, words))
    places, matches = [], []
    at, n, need = 0, len(ids), min(min_match, shortest)
    while at < n:
        if ids[at] is None:
            at += 1
            continue
        end = at
        while end < n and ids[end] is not None:
            end += 1
        if end - at >= need:
            before = (0, 0)
            for i, now in enumerate(auto.statistics(ids[at:end]), at):
                for size, k in auto.phrases[now[0]]:
                    if size <= now[1]:
                        places.append((i - size + 1, k))
                if before[1] >= min_match and now[1] <= before[1]:
                    matches.append((i - 1, before[1], before[0]))
                before = now
            if before[1] >= min_match:
                matches.append((end - 1, before[1], before[0]))
        at = end
    spans = [
        {"label": templates[template][0], "share": min(1.0, covered / sizes[template]), "first": first, "last": last}
        for template, covered, first, last in _chains(matches, auto, sizes, max_gap, min_cover)
    ]
    return {"n_words": n, "places": places, "spans": _strongest(spans)}


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, share: double, first: long, last: long>>"
)


def scan_documents(
    docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, min_match: int = 4, max_gap: int = 40,
    min_cover: float = 0.6,
) -> DataFrame:
    """A row per document: word and base counts, labels, score (the largest
    covered share; 1 where a base phrase stands) and the covered spans."""

    def row(doc_id: int | None, text: str | None) -> dict:
        found = scan(text, templates, phrases, min_match, max_gap, min_cover)
        starts = [s for s, _ in found["places"]]
        base = {phrases[k][1] for _, k in found["places"]}
        return {
            "doc_id": doc_id,
            "n_words": found["n_words"],
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s["label"] for s in found["spans"]})),
            "score": max([1.0 if base else 0.0, *(s["share"] for s in found["spans"])]),
            "spans": found["spans"],
        }

    arrow = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct(
                [("label", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]
            ))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(i.as_py(), t.as_py()) for i, t in zip(batch.column("doc_id"), batch.column("text"))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return map_arrow(id_and_text(docs), run, _SCHEMA)
