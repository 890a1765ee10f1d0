"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds the word sequences of all templates. Streaming a text
through it gives, after each word, the longest run of words ending there that
occurs in some template (its matching statistic). Base phrases are found from
the same states. Runs of ``LEAST`` words or more become matches; for each
template the matches are chained in order of both text and template, so that a
chain covers as many words as can be (dynamic programming, not greedily), into
covered spans, and a template whose chain covers enough of it gives a label.

A run that one template holds doesn't hide a shorter one of another: each
template's longest match is noted at every place, down the suffix links.

Defined results: null and empty texts have no words, no label and score 0; an
empty table gives no rows; repeated rows are documents of their own; other columns are ignored; texts of
any length are streamed whole.
"""

from __future__ import annotations

import bisect
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lazy, by_block, mapped

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a match, share of a template that a chain must cover, words skipped between chained matches at most.
LEAST, COVERED, GAP = 5, 0.6, 12

# Phrases with the labels they give.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices that the public licences ask for or consist of.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over word numbers (from 1)."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.sources = [(label, words(t.encode())) for label, own in templates.items() for t in own]
        phrase_words = [(label, words(p.encode())) for p, label in phrases.items()]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, position after) of each state
        for t, (_, sequence) in enumerate(self.sources):
            self._add(sequence, t)
        for _, sequence in phrase_words:
            self._add(sequence, None)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state] if self.link[state] else set()
        #: Phrases (number, words) that end where a state is reached with at least that many words.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        self.labels = [label for label, _ in phrase_words]
        own: dict[int, list[tuple[int, int]]] = {}
        for p, (_, sequence) in enumerate(phrase_words):
            state = 0
            for w in sequence:
                state = self.next[state][self.number[w]]
            own.setdefault(state, []).append((p, len(sequence)))
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrases[state] = own.get(state, []) + self.phrases[self.link[state]]

    def _add(self, sequence: list[bytes], template: int | None) -> None:
        last = 0
        for position, w in enumerate(sequence, 1):
            last = self._extend(last, self.number.setdefault(w, len(self.number) + 1))
            if template is not None:
                self.ends[last].add((template, position))

    def _extend(self, last: int, c: int) -> int:
        there = self.next[last].get(c)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, c, there)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def statistics(self, numbers: list[int]) -> list[tuple[int, int]]:
        """(state, words matched) after each word."""
        out, state, held = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for c in numbers:
            there = following[state].get(c)
            while there is None and state:
                state = link[state]
                held = length[state]
                there = following[state].get(c)
            if there is None:
                held = 0
            else:
                state, held = there, held + 1
            out.append((state, held))
        return out


def chained(matches: list[tuple[int, int, int]], gap: int) -> tuple[list[int], list[int]]:
    """For each of the sorted matches (text start, template start, words): words of the best chain that ends with it, and the match before it (-1: none).

    A match may follow another that ends before it in text and template, with
    at most ``gap`` words between them in either; words of an overlap count
    once, and the later match must add some. Only matches that end near enough
    in the text are looked at, and the template bounds how many those are.
    """
    score, before = [], []
    reach = max((size for _, _, size in matches), default=0) + gap
    low = 0
    for i, (s, t, size) in enumerate(matches):
        while matches[low][0] < s - reach:
            low += 1
        most, link = size, -1
        for j in range(low, i):
            ls, lt, lsize = matches[j]
            over = max(0, ls + lsize - s, lt + lsize - t)
            if over < size and s + over - (ls + lsize) <= gap and t + over - (lt + lsize) <= gap and score[j] + size - over > most:
                most, link = score[j] + size - over, j
        score.append(most)
        before.append(link)
    return score, before


class Scanner:
    def __init__(self, least: int = LEAST, covered: float = COVERED, gap: int = GAP, templates: tuple[tuple[str, tuple[str, ...]], ...] | None = None):
        self.automaton = Automaton(TEMPLATES if templates is None else dict(templates), PHRASES)
        self.least, self.covered, self.gap = least, covered, gap

    def scan(self, text: bytes) -> dict:
        """n_words; places (start word, phrase); spans (label, start word, end word, share of the template)."""
        own = words(text)
        get = self.automaton.number.get
        numbers = [get(w, 0) for w in own]
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        at, n = 0, len(numbers)
        while at < n:
            if not numbers[at]:
                at += 1
                continue
            end = at + 1
            while end < n and numbers[end]:
                end += 1
            if end - at > 1:
                self._run(numbers[at:end], at, places, matches)
            at = end + 1
        spans = []
        for template, found in matches.items():
            spans += self._chains(template, found)
        return {"n_words": n, "places": sorted(places), "spans": sorted(spans, key=lambda s: (s[1], s[2], s[0]))}

    def _run(self, numbers: list[int], base: int, places: list, matches: dict) -> None:
        """Stream a run of known words; note phrases, and for each template the matches that neither side extends."""
        automaton, least = self.automaton, self.least
        held_before: dict[tuple[int, int], int] = {}
        for i, (state, held) in enumerate([*automaton.statistics(numbers), (0, 0)]):
            for phrase, size in automaton.phrases[state]:
                if size <= held:
                    places.append((base + i + 1 - size, phrase))
            # The longest run ending here for each place of a template: those of the state, then of its suffixes.
            ending: dict[tuple[int, int], int] = {}
            while state and held >= least:
                for place in automaton.ends[state]:
                    ending.setdefault(place, held)
                state = automaton.link[state]
                held = automaton.length[state]
            for (template, end), size in held_before.items():
                if (template, end + 1) not in ending:
                    matches.setdefault(template, []).append((base + i - size, end - size, size))
            held_before = ending

    def _chains(self, template: int, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches (text start, template start, words) that cover the most, best first and apart in the text."""
        label, sequence = self.automaton.sources[template]
        matches = sorted(set(found))
        score, before = chained(matches, self.gap)
        least = self.covered * len(sequence)
        heap = [(-n, i) for i, n in enumerate(score) if n >= least]
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []
        out = []

        def free(start: int, end: int) -> bool:
            at = bisect.bisect_left(taken, (end, 0))
            return not at or taken[at - 1][1] <= start

        while heap:
            n, i = heapq.heappop(heap)
            end = matches[i][0] + matches[i][2]
            if not free(matches[i][0], end):
                continue
            first = i
            while before[first] >= 0 and free(matches[before[first]][0], end):
                first = before[first]
            # A chain that runs into a taken span is cut there and waits for its turn.
            held = score[i] - (score[first] - matches[first][2])
            if held < -n:
                if held >= least:
                    heapq.heappush(heap, (-held, i))
                continue
            start = matches[first][0]
            bisect.insort(taken, (start, end))
            out.append((label, start, end, held / len(sequence)))
        return out

    def digest(self, texts: list[bytes]) -> dict[str, pa.Array]:
        rows = []
        for text in texts:
            got = self.scan(text)
            places, spans = got["places"], got["spans"]
            base = sorted({self.automaton.labels[p] for _, p in places})
            labels = sorted({*base, *(s[0] for s in spans)})
            starts = [s for s, _ in places]
            score = max([1.0] * bool(places) + [min(1.0, s[3]) for s in spans], default=0.0)
            rows.append((got["n_words"], len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [{"label": s[0], "start": s[1], "end": s[2], "share": s[3]} for s in spans]))
        columns = list(zip(*rows))
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))}
        return {k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)}


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end, share).

    score is 1 where a base phrase stands, else the largest covered share of a template. ``templates`` are whole
    licences or notices by label, in place of ``TEMPLATES``; they go to all tasks, each of which makes one automaton.
    """
    own = None if templates is None else tuple((label, tuple(texts)) for label, texts in templates.items())
    scanner = Lazy(Scanner, LEAST, COVERED, GAP, own)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.transform(mapped, by_block(lambda texts: scanner.get().digest(texts)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>")
