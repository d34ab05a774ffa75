"""License scans by patience alignment.

A template is laid over a stretch of text by anchors: words that occur once in both,
kept as far as their order agrees (the longest increasing subsequence).  The gaps
between anchors are aligned in the same way, down to gaps without such words, whose
equal ends are matched.  A notice is found where the aligned words cover enough of the
template and hold the words that tell it from others, with no words between them that
name another licence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

#: Least share of a template's words that must be aligned; all of them in templates of fewer words than ONE_LINE.
COVERAGE = 0.8
ONE_LINE = 16
#: A stretch may be longer than its template by this share (and a few words).
_SLACK, _FEW = 0.25, 4

# Notices as their licences or their stewards word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: Words of longer templates that must be aligned, at their first place: names, versions, what is granted.
TELLING: dict[str, tuple[str, ...]] = {
    "MIT": ("charge", "person", "sublicense", "sell", "included"),
    "Apache-2.0": ("apache", "version", "2", "0"),
    "GPL-3.0": ("gnu", "general", "public", "version", "3"),
    "GPL-2.0": ("gnu", "general", "public", "version", "2"),
    "BSD-2-Clause": ("redistribution", "source", "binary", "modification", "retain", "reproduce"),
    "MPL-2.0": ("mozilla", "public", "2", "0"),
    "ISC": ("use", "copy", "modify", "distribute", "purpose", "fee", "granted", "provided"),
}
_TERMS = ("nc", "sa", "nd", "noncommercial", "commercial", "sharealike", "alike", "noderivatives", "noderivs", "derivatives", "derivs")
#: Words that make another licence of a notice when they stand among its words.
OTHER: dict[str, frozenset[str]] = {
    "MIT": frozenset(("modified",)),
    "GPL-3.0": frozenset(("lesser", "library", "affero")),
    "GPL-2.0": frozenset(("lesser", "library", "affero")),
    "CC-BY-4.0": frozenset(_TERMS),
    "CC-BY-NC-4.0": frozenset(_TERMS),
    "ISC": frozenset(("documentation", "supporting")),
}
#: Words that make another licence of it among the next _NEXT words: a further clause.
FURTHER: dict[str, frozenset[str]] = {
    "BSD-2-Clause": frozenset(("neither", "endorse", "advertising")),
    "ISC": frozenset(("documentation", "advertising")),
}
_NEXT = 16

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both, by patience alignment."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        # Equal ends go without saying; the rest is cut at its anchors.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        once = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [once[k] for k in rising([j for _, j in once])]
        if not anchors:
            continue
        matched += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


@dataclass(frozen=True)
class Notice:
    """A notice found: licence, span in code points (end exclusive), share of the template aligned."""

    license: str
    start: int
    end: int
    coverage: float


def scanner(templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = COVERAGE) -> Callable[[str | None], list[Notice]]:
    """Kernel: the notices of a whole text, by start; none overlap, larger and fuller ones go first."""
    prepared = [(name, words(t), Counter(words(t))) for name, ts in templates.items() for t in ts]
    known = frozenset(w for _, t, _ in prepared for w in t)

    def share(t: list[str]) -> float:
        return 1.0 if len(t) < ONE_LINE else least

    def telling(name: str, t: list[str]) -> list[int]:
        return [t.index(w) for w in TELLING.get(name, ()) if w in t] if len(t) >= ONE_LINE else []

    def holds(name: str, t: list[str], content: list[str], a: int, matched: list[tuple[int, int]]) -> bool:
        """Whether the words aligned from place ``a`` on are a notice of this licence and not of one like it."""
        if len(matched) < share(t) * len(t) or not {j for _, j in matched}.issuperset(telling(name, t)):
            return False
        first, last = a + matched[0][0], a + matched[-1][0]
        aligned = {a + i for i, _ in matched}
        inserted = [content[p] for p in range(first, last + 1) if p not in aligned]
        if any(w in OTHER.get(name, ()) or (w.isdigit() and len(t) < ONE_LINE) for w in inserted):
            return False
        return not FURTHER.get(name, frozenset()).intersection(content[last + 1 : last + 1 + _NEXT])

    def stretches(where: dict[str, list[int]], template: list[str], total: int) -> list[tuple[int, int]]:
        """Stretches of the text that hold enough of the template's words near the places they would have.

        Each occurrence of a template word names a start; starts that agree up to
        the slack are counted together, and a stretch is kept if it could reach the
        least coverage.
        """
        n = len(template)
        slack = int(_SLACK * n) + _FEW
        starts = sorted(p - q for q, w in enumerate(template) for p in where.get(w, ()))
        found, i = [], 0
        need = max(1, int(share(template) * n))
        for j, s in enumerate(starts):
            while s - starts[i] > slack:
                i += 1
            if j - i + 1 >= need:
                a, b = max(0, starts[i] - slack), min(total, s + n + slack)
                if found and a <= found[-1][1]:
                    found[-1] = (found[-1][0], max(b, found[-1][1]))
                else:
                    found.append((a, b))
        return found

    def copies(name: str, t: list[str], content: list[str], a: int, b: int) -> list[tuple[int, int, float]]:
        """First and last place and coverage of the copies of a template between two places; none overlap.

        Every occurrence of a word names a start.  Starts that most words name come
        first and are aligned within the template's length, then with a few words
        and with the slack around it, between the copies found so far, so words of
        other copies do not hide the anchors.  What lies between the copies found
        is searched again, until nothing more is found.
        """
        n = len(t)
        slack = int(_SLACK * n) + _FEW
        places: dict[str, list[int]] = {}
        for q, w in enumerate(t):
            places.setdefault(w, []).append(q)
        found: list[tuple[int, int, float]] = []
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if b - a < share(t) * n:
                continue
            votes = Counter(p - q for p in range(a, b) for q in places.get(content[p], ()))
            hits: list[tuple[int, int, float]] = []
            missed: set[int] = set()  # starts without a copy, with those nearer than a few words
            for s, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
                if s in missed:
                    continue
                # The free words about the middle of the copy that would start here.
                k = bisect_left(hits, (s + n // 2 + 1,))
                low = hits[k - 1][1] + 1 if k else a
                high = hits[k][0] if k < len(hits) else b
                if high - low < share(t) * n:
                    continue
                best = None
                for wide in (0, _FEW, slack):
                    at, to = max(low, s - wide), min(high, s + n + wide)
                    if to - at < share(t) * n:
                        continue
                    matched = _dense(align(content[at:to], t), n)
                    if holds(name, t, content, at, matched) and (best is None or len(matched) > best[2] * n):
                        best = (at + matched[0][0], at + matched[-1][0], len(matched) / n)
                    if best and best[2] == 1:
                        break
                if best:
                    insort(hits, best)
                else:
                    missed.update(range(s - _FEW // 2, s + _FEW // 2 + 1))
            if hits:
                edges = [a - 1, *(x for h in hits for x in h[:2]), b]
                todo += [(edges[i] + 1, edges[i + 1]) for i in range(0, len(edges), 2)]
            found += hits
        return found

    def scan(text: str | None) -> list[Notice]:
        if not text:
            return []
        lower = text.lower()
        if len(lower) != len(text):  # a few letters change their number when lowered; places must hold
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        present = known.intersection(_WORD.findall(lower))
        # A template can't be covered where too few of its words, or not all telling ones, occur at all.
        likely = [
            (name, t)
            for name, t, count in prepared
            if sum(count[w] for w in count.keys() & present) >= share(t) * len(t)
            and present.issuperset(t[q] for q in telling(name, t))
        ]
        if not likely:
            return []
        spans = [m.span() for m in _WORD.finditer(lower)]
        content = [lower[a:b] for a, b in spans]
        where: dict[str, list[int]] = {}
        for p, w in enumerate(content):
            if w in present:
                where.setdefault(w, []).append(p)
        found = []
        for name, t in likely:
            for a, b in stretches(where, t, len(content)):
                for first, last, coverage in copies(name, t, content, a, b):
                    found.append((-len(t) * coverage, spans[first][0], spans[last][1], name, coverage))
        taken: list[tuple[int, int, Notice]] = []
        for _, start, end, name, coverage in sorted(found):
            k = bisect_left(taken, (start,))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end, Notice(name, start, end, coverage)))
        return [x for _, _, x in taken]

    return scan


def _dense(matched: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The matches whose spread in the text is near that in the template: the longest run without a wide gap."""
    best: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for m in matched:
        if run and (m[0] - run[-1][0]) - (m[1] - run[-1][1]) > int(_SLACK * n) + _FEW:
            run = []
        run.append(m)
        if len(run) > len(best):
            best = list(run)
    return best


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_notices, licenses, notices`` for every row; null and empty texts have none.

    ``licenses`` are the different names, sorted; ``notices`` is
    license:start:end:coverage, by start; both comma-joined.
    """

    def make():
        scan = scanner()

        def kernel(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts, strict=True):
                found = scan(t)
                names = ",".join(sorted({x.license for x in found}))
                yield i, len(found), names, ",".join(f"{x.license}:{x.start}:{x.end}:{x.coverage:.3f}" for x in found)

        return kernel

    plain = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("t"))
    return arrow_map(plain, make, "doc_id long, n_notices long, licenses string, notices string")


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
