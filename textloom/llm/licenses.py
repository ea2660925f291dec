"""License scans by patience alignment.

A template is aligned with a stretch of text: words that occur once in both are anchors, the longest
increasing run of anchors is kept, and the gaps between them are aligned in the same way after their
common beginnings and endings. The share of the template's words that are aligned is its coverage.

Stretches are found by the words that a template needs to reach the least coverage: without one of
them the rest of its words cannot, so a text that holds none is done with.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from textloom.llm.common import doc_columns, map_columns

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# Customary license notices and opening passages.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, of pairs sorted by the first place, whose second places increase."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(ends, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words of two lists, both increasing."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = longest_run([(k, place[a[k]]) for k in range(i, m) if in_a[a[k]] == 1 and a[k] in place])
        x, y = i, j
        for p, q in anchors:
            out.append((p, q))
            todo.append((x, p, y, q))
            x, y = p + 1, q + 1
        if anchors:
            todo.append((x, m, y, n))
    return sorted(out)


class Scanner:
    """Templates with the words that each needs."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.words = {k: words_of(t) for k, t in (templates or TEMPLATES).items()}
        self.words = {k: w for k, w in self.words.items() if w}
        in_templates = Counter(w for t in self.words.values() for w in set(t))
        self.needed: dict[str, dict[str, list[int]]] = {}
        for name, words in self.words.items():
            held = 0
            needed: dict[str, list[int]] = {}
            for w, n in sorted(Counter(words).items(), key=lambda x: (-in_templates[x[0]], len(x[0]), x[0])):
                held += n
                if held >= coverage * len(words):
                    needed[w] = [k for k, v in enumerate(words) if v == w]
            self.needed[name] = needed
        self.gate = set().union(*self.needed.values())

    def found(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, end word) of each stretch that reaches the least coverage."""
        words = words_of(text)
        if self.gate.isdisjoint(words):
            return []
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.gate:
                places.setdefault(w, []).append(k)
        held, out = set(words), []
        for name, template in self.words.items():
            if sum(w in held for w in template) < self.coverage * len(template):
                continue
            slack, done = max(2, len(template) // 4), 0
            begins = sorted({p - o for w, offsets in self.needed[name].items() for p in places.get(w, ()) for o in offsets})
            for begin in begins:
                lo, hi = max(done, begin - slack), min(len(words), begin + len(template) + slack)
                pairs = align(template, words[lo:hi]) if hi > lo else []
                if len(pairs) >= self.coverage * len(template):
                    # once more where the ends of what was aligned say that the stretch lies
                    at = max(done, lo + pairs[0][1] - pairs[0][0] - slack)
                    to = lo + pairs[-1][1] + len(template) - pairs[-1][0] + slack
                    again = align(template, words[at:to])
                    if len(again) > len(pairs):
                        pairs, lo = again, at
                    done = lo + pairs[-1][1] + 1
                    out.append((name, len(pairs) / len(template), lo + pairs[0][1], done))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """License notices in every whole text, one row for each stretch:
    ``doc_id, license, coverage, first_word, end_word``.

    Null and empty texts have none; a null doc_id stays null; repeated rows give repeated rows; a notice
    that a text repeats is found each time; an empty table gives an empty result; other columns play no
    part. A map over rows: nothing is shuffled, and the templates are few and fixed."""
    scanner = Scanner(templates, coverage)

    def run(ids: list, rows: list) -> list[list]:
        out = [(i, *f) for i, t in zip(ids, rows) for f in scanner.found(t)]
        return [list(c) for c in zip(*out)] if out else [[] for _ in range(5)]

    return map_columns(doc_columns(docs), run, "doc_id bigint, license string, coverage double, first_word int, end_word int")
