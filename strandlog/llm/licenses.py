"""Operator 5: license scans by patience alignment.

A text is searched for license templates. Words that occur once in the text part and once in the
template are anchors; the longest increasing subsequence of their places is kept, and the gaps
between anchors are aligned in the same way, after common words at their borders. A template's
coverage is the share of its words that are aligned.

A template is aligned with the whole text. As a word that a text repeats elsewhere is no anchor then,
a template of n words is also aligned with windows of 2n words, one from every word of the text, and
the best of all these alignments counts, of equal ones the first. Windows that hold too few of the template's words to reach the threshold, or
to beat the best window so far, are not aligned, which loses none. The whole text is searched.

Words are lower-cased (A-Z) with marks at their borders taken off. Defined results: null and
empty texts and templates match nothing; repeated rows are reported each; a null doc_id is kept;
an empty table gives no rows; further columns are ignored. Templates are a parameter, held by
every task, so their number is the caller's bound.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import small_batches

# Short notices by which public licenses are commonly stated.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
MARKS = b".,;:!?\"'()[]{}<>*#|-/\\"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without marks at their borders; words of marks only are left out."""
    return [w for w in (x.strip(MARKS) for x in (text or "").encode().lower().split()) if w]


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles as in the card game."""
    tops: list[int] = []
    pile: list[int] = []
    below: list[int] = []
    for i, p in enumerate(places):
        at = bisect_left(tops, p)
        below.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(p)
            pile.append(i)
        else:
            tops[at], pile[at] = p, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[bytes, int] = {}
        for i in range(a0, a1):
            place[a[i]] = -1 if a[i] in place else i
        once: dict[bytes, int] = {}
        for j in range(b0, b1):
            once[b[j]] = -1 if b[j] in once else j
        anchors = [(place[w], j) for w, j in once.items() if j >= 0 and place.get(w, -1) >= 0]
        anchors = [anchors[i] for i in increasing([i for i, _ in anchors])]
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], num: int, den: int):
        self.templates = {name: w for name, t in sorted(templates.items()) if (w := words(t))}
        self.need = {name: -(-len(w) * num // den) for name, w in self.templates.items()}
        self.vocabulary = {w for t in self.templates.values() for w in t}

    def scan(self, text: str | None):
        """(template, aligned words, template's words, first word's place in the text) of every template that covers enough; of equal coverage the first place."""
        lowered = words(text)
        if not lowered:
            return
        common = [i for i, w in enumerate(lowered) if w in self.vocabulary]
        for name, t in self.templates.items():
            n, own, need, best = len(t), Counter(t), self.need[name], (0, 0)
            places = [i for i in common if lowered[i] in own]
            if sum((Counter(lowered[i] for i in places) & own).values()) < need:
                continue
            whole = align(lowered, t)
            if whole:
                best = len(whole), whole[0][0]
            for i, p in enumerate(places[: max(0, len(places) - need + 1)]):
                # starts of the windows whose first word of the template is this one
                for s in range(max(places[i - 1] + 1 if i else 0, places[i + need - 1] - 2 * n + 1), p + 1):
                    held = Counter(lowered[q] for q in places[i : bisect_left(places, s + 2 * n)])
                    most = sum((held & own).values())
                    if most < max(need, best[0] + (s > best[1])):
                        continue
                    found = align(lowered[s : s + 2 * n], t)
                    if found:
                        best = max(best, (len(found), s + found[0][0]), key=lambda x: (x[0], -x[1]))
            if best[0] >= self.need[name]:
                yield name, best[0], n, best[1]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, license, n_aligned, n_template, first_word) of every template that a document covers to num/den or more."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Scanner(templates, num, den))

    def run(batches):
        scanner = shared.value
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for hit in scanner.scan(text):
                    rows.append(i)
                    found.append(hit)
            name, aligned, n, first = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(name, pa.string()), pa.array(aligned, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["doc_id", "license", "n_aligned", "n_template", "first_word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, n_aligned long, n_template long, first_word long")
