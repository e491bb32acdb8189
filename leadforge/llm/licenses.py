"""Licence scan: matching statistics against a generalised suffix automaton.

The words of all licence templates go into one generalised suffix automaton.
A file's words are streamed through it: after each word the automaton's state
and match length are the longest suffix of the text read so far that occurs in
some template (the matching statistics). From them come

* the *base places*: a phrase ends at a word when its state lies on the suffix
  links of the current state and the match is long enough;
* the *covered spans*: matches of ``MIN_MATCH`` words or more that cannot be
  extended are anchors (text place, template place, length); anchors of one
  template that follow each other in both within ``MAX_GAP`` words are chained,
  and a chain that covers ``MIN_COVER`` of its template and overlaps no better
  chain of it is a span and adds the label.

Only words that stand beside a neighbour they also have in a template can be in
a match of two words or more, so the stream skips all others in whole-array
steps (their statistic is 0 or 1) and walks the rest.

``score`` is the largest covered share of a template, base phrases included.
The automaton depends on the templates alone and travels with the task; nothing
is shuffled.

Defined cases: null and empty texts have no words, labels '' and score 0;
repeated rows are scanned each; a null id is kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import bounded_batches, text_of
from .text import Words, buffers, chunks, hash_spans, word_hashes, words

MIN_MATCH = 4
MAX_GAP = 16
MIN_COVER = 0.6
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: (phrase, label)
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Customary notices and opening clauses of well-known public licences.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
               "implied. See the License for the specific language governing permissions and limitations under the "
               "License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see "
            "https://www.gnu.org/licenses/"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
            "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
)

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,cover:double>>")


def split_words(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])  # (sequence, end) of the state's longest string

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.step[clone] = dict(self.step[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # another sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, number: int, sequence: Sequence[int]) -> None:
        last = 0
        for i, c in enumerate(sequence):
            last = self._extend(last, c)
            self.ends[last].append((number, i + 1))

    def finish(self) -> None:
        """Hand every state the end places of the states below it."""
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def statistics(self, sequence: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, match length) after each item."""
        v, n = 0, 0
        for c in sequence:
            while v and c not in self.step[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.step[v]:
                v, n = self.step[v][c], n + 1
            else:
                v, n = 0, 0
            yield v, n


class Scanner:
    """The automaton of a set of templates with what the stream needs."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = BASE_PHRASES):
        texts = [split_words(t) for _, t in templates] + [split_words(p) for p, _ in phrases]
        self.labels = [label for label, _ in templates] + [label for _, label in phrases]
        self.first_phrase = len(templates)
        self.sizes = [len(t) for t in texts]
        self.vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.automaton = SuffixAutomaton()
        pairs = np.zeros((len(number) + 1, len(number) + 1), dtype=bool)
        for k, t in enumerate(texts):
            ids = [number[w] for w in t]
            self.automaton.add(k, ids)
            pairs[ids[:-1], ids[1:]] = True
        self.automaton.finish()
        self.pairs = pairs  # the last row and column stand for unknown words
        self.base_pairs = np.zeros_like(pairs)
        # phrases that end at a state: those whose end is a place of the state and that fit into the match
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in self.automaton.step]
        for state in range(1, len(self.automaton.step)):
            v = state
            while v > 0:
                self.phrases_at[state] += [(k, self.sizes[k]) for k, e in self.automaton.ends[v]
                                           if k >= self.first_phrase and e == self.sizes[k]
                                           and self.automaton.length[self.automaton.link[v]] < e <= self.automaton.length[v]]
                v = self.automaton.link[v]
            self.phrases_at[state] = sorted(set(self.phrases_at[state]))
        for k in range(self.first_phrase, len(texts)):
            ids = [number[w] for w in texts[k]]
            self.base_pairs[ids[:-1], ids[1:]] = True
        raw = [w.encode() for w in self.vocabulary]
        joined = np.frombuffer(b"".join(raw) + bytes(8), dtype=np.uint8)
        end = np.cumsum([len(r) for r in raw])
        hashes = hash_spans(joined, end - [len(r) for r in raw], end)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, w: Words) -> np.ndarray:
        """Vocabulary number of each word, or the vocabulary's size."""
        h = word_hashes(w)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], len(self.vocabulary))

    def places(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(row, first word in the row, word numbers) of the stretches that can hold a phrase or an anchor."""
        ids = self.numbers(w)
        if len(ids) < 2:
            return
        joined = self.pairs[ids[:-1], ids[1:]]
        inner = w.row_first[1:-1]
        joined[inner[(inner > 0) & (inner < len(ids))] - 1] = False
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        base = np.concatenate([[0], np.cumsum(joined & self.base_pairs[ids[:-1], ids[1:]])])
        wanted = (stop - begin >= MIN_MATCH) | (base[stop - 1] > base[begin])
        for b, s in zip(begin[wanted].tolist(), stop[wanted].tolist()):
            row = int(np.searchsorted(w.row_first, b, "right")) - 1
            numbers = ids[b:s].tolist()
            if all(self.vocabulary[n] == w.text(b + i) for i, n in enumerate(numbers)):
                yield row, b - int(w.row_first[row]), numbers

    def scan(self, first: int, numbers: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places (phrase, first word) and anchors (template, text place, template place, length)."""
        base, anchors = [], []
        stats = list(self.automaton.statistics(numbers))
        for i, (state, n) in enumerate(stats):
            base += [(k, first + i + 1 - size) for k, size in self.phrases_at[state] if size <= n]
            if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                anchors += [(k, first + i + 1 - n, e - n, n) for k, e in self.automaton.ends[state]
                            if k < self.first_phrase and e >= n]
        return base, anchors

    def chain(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Covered spans (label, first word, last word, share of the template).

        Of each template all chains that reach ``MIN_COVER`` and do not overlap a
        better one of it; a stretch without any has its best chain.
        """
        spans = []
        by_template = defaultdict(list)
        for k, at, place, n in anchors:
            by_template[k].append((at, place, n))
        for k, found in by_template.items():
            found.sort()
            for stretch in self._stretches(found):
                chosen = self._apart(stretch, MIN_COVER * self.sizes[k])
                spans += [(self.labels[k], start, end - 1, min(1.0, covered / self.sizes[k])) for end, _, covered, start in chosen]
        return spans

    @staticmethod
    def _stretches(found: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """Runs of anchors (text place, template place, length) within ``MAX_GAP`` words of those before."""
        stretch: list[tuple[int, int, int]] = []
        reach = -1
        for at, place, n in found:
            if stretch and at > reach + MAX_GAP:
                yield stretch
                stretch = []
            stretch.append((at, place, n))
            reach = max(reach, at + n)
        if stretch:
            yield stretch

    @staticmethod
    def _chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """The best chain that ends with each anchor: (text end, template end, words covered, text start); of equal ones the shortest."""
        chains: list[tuple[int, int, int, int]] = []
        near: list[tuple[int, int, int, int]] = []
        for at, place, n in found:
            near = [c for c in near if at - c[0] <= MAX_GAP]
            best = (at + n, place + n, n, at)
            for end, stop, covered, start in near:
                gain = n - max(0, end - at, stop - place)
                if gain > 0 and place - stop <= MAX_GAP and place + n > stop and (covered + gain, start) > (best[2], best[3]):
                    best = (at + n, place + n, covered + gain, start)
            near.append(best)
            chains.append(best)
        return chains

    def _apart(self, stretch: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
        """The chains of a stretch that cover ``least`` words and overlap no better one, by place; the best chain if none does."""
        taken: list[tuple[int, int, int, int]] = []
        open_parts = [stretch]
        while open_parts:
            again = []
            for part in open_parts:
                chains = sorted(set(self._chains(part)), key=lambda c: (-c[2], c[0], -c[3]))
                if not taken and chains[0][2] < least:
                    return [chains[0]]
                own: list[tuple[int, int]] = []    # taken places
                held: list[tuple[int, int]] = []   # places of chains that overlap a better one: a shorter chain may be hidden there
                for c in chains:
                    if c[2] < least:
                        break
                    if not _meets(own, c[3], c[0]) and not _meets(held, c[3], c[0]):
                        insort(own, (c[3], c[0]))
                        taken.append(c)
                    else:
                        held = _joined(held, c[3], c[0])
                if held:
                    again += self._left(part, own)
            open_parts = again
        return sorted(taken, key=lambda c: c[3])

    @staticmethod
    def _left(part: list[tuple[int, int, int]], own: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        """The anchors of ``part`` between the taken places."""
        left: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for at, place, n in part:
            if not _meets(own, at, at + n):
                left[bisect_left(own, (at, at))].append((at, place, n))
        return [left[i] for i in sorted(left)]


def _meets(places: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted disjoint places (start, end) overlaps this one."""
    i = bisect_left(places, (end, end))
    return i > 0 and places[i - 1][1] > start


def _joined(places: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The sorted disjoint places with this one, overlapping ones united."""
    hi = bisect_left(places, (end, end))
    lo = hi
    while lo > 0 and places[lo - 1][1] > start:
        lo -= 1
    if lo < hi:
        start, end = min(start, places[lo][0]), max(end, places[hi - 1][1])
    places[lo:hi] = [(start, end)]
    return places


_SCANNERS: dict[tuple, Scanner] = {}


def _scan(templates: tuple, phrases: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (templates, phrases)
        scanner = _SCANNERS.setdefault(key, _SCANNERS.get(key) or Scanner(templates, phrases))
        for batch in batches:
            rows = batch.num_rows
            n_words = np.zeros(rows, dtype=np.int64)
            base: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
            anchors: list[list[tuple[int, int, int, int]]] = [[] for _ in range(rows)]
            for lo, data, offsets in chunks(*buffers(batch.column(1))):
                w = words(data, offsets)
                n_words[lo:lo + len(offsets) - 1] = np.diff(w.row_first)
                for row, first, numbers in scanner.places(w):
                    b, a = scanner.scan(first, numbers)
                    base[lo + row] += b
                    anchors[lo + row] += a
            spans = [[s for s in scanner.chain(a) if s[3] >= MIN_COVER] if a else [] for a in anchors]
            own = [{scanner.labels[k] for k, _ in b} for b in base]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words), pa.array([len(b) for b in base], pa.int64()),
                pa.array([min(p for _, p in b) if b else None for b in base], pa.int64()),
                pa.array([max(p for _, p in b) if b else None for b in base], pa.int64()),
                pa.array([",".join(sorted(o)) for o in own]),
                pa.array([",".join(sorted(o | {s[0] for s in found})) for o, found in zip(own, spans)]),
                pa.array([1.0 if b else max((s[3] for s in scanner.chain(a)), default=0.0) if a else 0.0
                          for b, a in zip(base, anchors)]),
                pa.array([[{"label": x, "first_word": f, "last_word": e, "cover": c} for x, f, e, c in found] for found in spans], span),
            ], names=[c.strip().split()[0] for c in SCHEMA.split(", ")])

    return run


def scan_licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  phrases: Sequence[tuple[str, str]] = BASE_PHRASES) -> DataFrame:
    """One row per row of ``docs``; see the module text for the columns."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return narrow.mapInArrow(_scan(tuple(templates), tuple(phrases)), SCHEMA)
