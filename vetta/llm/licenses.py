"""License scans by patience alignment.

Text and template are word lists (lower-cased letters and digits). Words unique to both are
anchors; the longest increasing subsequence of the anchors is kept, and the gaps between
them are aligned the same way, recursively. Coverage is the share of the template's words
that the alignment matches.

Where to align is found without loss: a template of n words that is covered to ``COVERAGE``
misses at most (1 - COVERAGE) n words, so one of its ((1 - COVERAGE) n + 1) longest words is
matched; every occurrence of such a key word gives a window of text that an alignment
through it can reach. Texts without any key word are settled by one pattern scan.

The templates are a fixed argument of a few kilobytes, the only thing sent to the workers.

Cases: null or word-less texts have no license; several licenses in one text are all
reported where they do not overlap, the best one first (coverage, then template length, then
name); a text is worked
through whole, window by window; repeated rows get equal results; other columns are never
read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

COVERAGE = 0.85
SLACK = 0.25                            # how much longer than the template a matched stretch may be
WORD = re.compile(r"[^\W_]+")
# License notices by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 3 of the License, or "
        "(at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def increasing(values: list[int]) -> list[int]:
    """Indexes of one longest strictly increasing subsequence (patience piles)."""
    tops, ends, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
        before.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in where]
        if not pairs:
            continue
        at = (a0, b0)
        for k in increasing([j for _, j in pairs]):
            i, j = pairs[k]
            out.append((i, j))
            todo.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        todo.append((at[0], a1, at[1], b1))
    return sorted(out)


class Scanner:
    """Templates with their key words."""

    def __init__(self, templates: dict[str, list[str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words_of(t)) for name, texts in sorted(templates.items()) for t in texts]
        self.keys: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.templates):
            spare = int((1 - coverage) * len(words) + 1e-9)
            rare = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i], i))[:spare + 1]
            for i in rare:
                self.keys.setdefault(words[i], []).append((k, i))

    def pattern(self) -> str:
        """For texts worth a closer look; words are letters and digits, so need no quoting."""
        return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(self.keys)) + r")(?![\p{L}\p{N}])"

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of the covered templates: of all places
        the better ones first, none that overlaps a better one; one row a license, its best."""
        words = words_of(text)
        windows: dict[int, list[list[int]]] = {}
        for p, w in enumerate(words):
            for k, i in self.keys.get(w, ()):
                n = len(self.templates[k][1])
                reach = int(n * SLACK) + 1
                a, b = max(0, p - i - reach), min(len(words), p + n - i + reach)
                spans = windows.setdefault(k, [])
                if spans and spans[-1][0] == a and spans[-1][1] >= b:
                    continue
                spans.append([a, b])
        found: set[tuple[float, int, str, int, int]] = set()
        for k, spans in windows.items():
            name, own = self.templates[k]
            for a, b in spans:
                pairs = patience(words[a:b], own)
                share = len(pairs) / len(own)
                if share < self.coverage - 1e-9:
                    continue
                first, end = a + pairs[0][0], a + pairs[-1][0] + 1
                if end - first > len(own) * (1 + SLACK) + 1:
                    continue
                found.add((-share, -len(own), name, first, end))
        taken: list[tuple[int, int]] = []                           # disjoint, ascending
        out: dict[str, tuple[str, float, int, int]] = {}
        for share, _, name, first, end in sorted(found):
            at = bisect_left(taken, (first, end))
            if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
                continue                                            # a part of a better match
            taken.insert(at, (first, end))
            out.setdefault(name, (name, round(-share, 6), first, end))
        return list(out.values())


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document: ``doc_id, n_licenses, license, coverage, begin, stop, licenses``;
    ``begin`` and ``stop`` are word positions of the best match."""
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            rows = []
            for text in frame["text"]:
                got = own.scan(text) if text else []
                top = got[0] if got else (None, None, None, None)
                rows.append((len(got), *top, [g[0] for g in got]))
            made = pd.DataFrame(rows, columns=["n_licenses", "license", "coverage", "begin", "stop", "licenses"])
            for c in ("begin", "stop"):
                made[c] = made[c].astype("Int64")
            made.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield made

    texts = id_and_text(docs, id_col, text_col)
    if scanner.keys:
        texts = texts.withColumn("text", F.when(F.col("text").rlike(scanner.pattern()), F.col("text")).otherwise(""))
    return texts.mapInPandas(
        work, "doc_id string, n_licenses long, license string, coverage double, begin long, stop long, "
              "licenses array<string>").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
