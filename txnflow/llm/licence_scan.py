"""Licence scans by a generalised suffix automaton of licence texts.

All templates go into one suffix automaton, whose states stand for the word sequences that occur in any of them. A document is
streamed through it once: after each word the automaton knows the longest sequence ending there that some template holds
(the document's matching statistics). From these come

* whole occurrences of short templates, of fewer than ``LEAST_WORDS`` words, and
* long matches with a longer template: runs of at least ``LEAST_WORDS`` consecutive words that stand in both, as long as they go.

Long matches with one template are chained in the order of both texts, with gaps of ``MAX_GAP`` words at most and overlaps
counted once. A chain is a span of the template; its coverage is the share of the template's words in its matches. A span of
``COVERED`` or more gives the document the template's label.

Words are runs of anything but ASCII other than letters and digits, A-Z in lower case. Whole texts are read; a missing or empty
text has no words and no spans. Rows are independent of each other: repeated rows give repeated results, and no row leaves its task.
Words are known by 64-bit hashes.
"""

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from txnflow.llm.rows import map_texts
from txnflow.llm.text import is_ascii_break, runs, words

#: Words of a long match, and the length from which templates are matched in pieces.
LEAST_WORDS = 4
#: Words of a document between two matches of one span, at most.
MAX_GAP = 40
#: Share of a template's words that a span must cover to give the label.
COVERED = 0.75

# Phrases of the base labels.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Short notices and bodies of public licences. Several texts may have one label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


class Span(NamedTuple):
    """A stretch of words ``start`` to ``end`` (exclusive) in which ``covered`` words of a template stand."""

    template: int
    start: int
    end: int
    covered: int


class Automaton:
    """Suffix automaton of sequences of small numbers."""

    def __init__(self, sequences: list[list[int]], least: int):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []  # (state, sequence, position of its last word)
        for k, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._extended(state, word)
                ends.append((state, k, place))
        self._mark(sequences, ends, least)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        """The part of ``state`` whose sequences are no longer than one word more than ``before``, as a state of its own."""
        part = self._state(self.length[before] + 1, self.link[state], dict(self.step[state]))
        self.link[state] = part
        while before >= 0 and self.step[before].get(word) == state:
            self.step[before][word] = part
            before = self.link[before]
        return part

    def _extended(self, last: int, word: int) -> int:
        """The state of the sequence of ``last`` with ``word`` after it; another template may have made it before."""
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, before = self._state(self.length[last] + 1, 0, {}), last
        while before >= 0 and word not in self.step[before]:
            self.step[before][word] = new
            before = self.link[before]
        if before >= 0:
            known = self.step[before][word]
            self.link[new] = known if self.length[known] == self.length[before] + 1 else self._split(before, word, known)
        return new

    def _mark(self, sequences: list[list[int]], ends: list[tuple[int, int, int]], least: int) -> None:
        """For each state: ``whole``, the short templates its sequences end with, and ``piece``, the state of their last
        ``least`` words, with the places of these in long templates under ``places``."""
        n = len(self.length)
        self.whole: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.piece = [-1] * n
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, sequence in enumerate(sequences):
            if 0 < len(sequence) < least:
                state = 0
                for word in sequence:
                    state = self.step[state][word]
                self.whole[state].append((k, len(sequence)))
        for state in sorted(range(1, n), key=self.length.__getitem__):
            parent = self.link[state]
            self.whole[state] = self.whole[parent] + self.whole[state]
            if self.length[state] >= least:
                self.piece[state] = state if self.length[parent] < least else self.piece[parent]
        for state, k, place in ends:
            if self.piece[state] >= 0 and len(sequences[k]) >= least:
                self.places[self.piece[state]].append((k, place))


class Scanner:
    """Templates ready to be looked for; ``labels`` says what each stands for."""

    def __init__(self, templates, least: int = LEAST_WORDS, max_gap: int = MAX_GAP):
        self.labels = [label for label, _ in templates]
        self.least, self.max_gap = least, max_gap
        hashed = [words(text, breaks=is_ascii_break)[0] for _, text in templates]
        self.lengths = [len(h) for h in hashed]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        numbered = [np.searchsorted(self.vocabulary, h) for h in hashed]
        pairs = [s[:-1] * len(self.vocabulary) + s[1:] for s in numbered if len(s)]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.singles = any(n == 1 for n in self.lengths)
        self.automaton = Automaton([s.tolist() for s in numbered], least)

    def _stretches(self, hashes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Start and word numbers of the stretches in which some template holds every pair of neighbours: no match reaches
        beyond one."""
        if not len(self.vocabulary) or not len(hashes):
            return
        numbers = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(numbers, len(self.vocabulary) - 1)] == hashes
        linked = known[:-1] & known[1:]
        if len(self.pairs):
            both = numbers[:-1] * len(self.vocabulary) + numbers[1:]
            at = np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)
            linked &= self.pairs[at] == both
        else:
            linked[:] = False
        for s, e in zip(*runs(linked), strict=True):
            yield int(s), numbers[s:e + 1].tolist()
        if self.singles:
            alone = known.copy()
            alone[:-1] &= ~linked
            alone[1:] &= ~linked
            for s in np.flatnonzero(alone):
                yield int(s), [int(numbers[s])]

    def matches(self, hashes: np.ndarray) -> tuple[list[Span], dict[int, list[list[int]]]]:
        """Whole occurrences of short templates, and by long template its matches [start, start in it, words]."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        whole, piece, places = self.automaton.whole, self.automaton.piece, self.automaton.places
        shorts: list[Span] = []
        longs: dict[int, list[list[int]]] = defaultdict(list)
        growing: dict[tuple[int, int], list[int]] = {}  # the latest match on each diagonal of a template
        for first, numbers in self._stretches(hashes):
            state = matched = 0
            for at, word in enumerate(numbers, first):
                while state and word not in step[state]:
                    state = link[state]
                    matched = length[state]
                state = step[state].get(word, 0)
                matched = matched + 1 if state else 0
                for k, n in whole[state]:
                    if n <= matched:
                        shorts.append(Span(k, at + 1 - n, at + 1, n))
                if matched >= self.least:
                    for k, place in places[piece[state]]:
                        match = growing.get((k, at - place))
                        if match is not None and match[0] + match[2] == at:
                            match[2] += 1
                        else:
                            match = growing[k, at - place] = [at + 1 - self.least, place + 1 - self.least, self.least]
                            longs[k].append(match)
            growing.clear()
        return shorts, longs

    def chains(self, template: int, matches: list[list[int]]) -> list[Span]:
        """Spans of the template: chains of its matches, those that cover most first, each match in one of them."""
        matches = sorted(matches)
        covered, before = [m[2] for m in matches], [-1] * len(matches)
        near = 0
        for i, (at, place, n) in enumerate(matches):
            # What starts more than a gap and a template before can't end near enough.
            while matches[near][0] < at - self.max_gap - self.lengths[template]:
                near += 1
            for j in range(near, i):
                shared = max(matches[j][0] + matches[j][2] - at, matches[j][1] + matches[j][2] - place, 0)
                if (shared < n and matches[j][1] < place and at - matches[j][0] - matches[j][2] <= self.max_gap
                        and covered[j] + n - shared > covered[i]):
                    covered[i], before[i] = covered[j] + n - shared, j
        used, found = [False] * len(matches), []
        for last in sorted(range(len(matches)), key=lambda i: (-covered[i], matches[i])):
            i, chain = last, []
            while i >= 0 and not used[i]:
                chain.append(i)
                i = before[i]
            if i >= 0 or not chain:
                continue  # part of it belongs to a chain that covers more
            for j in chain:
                used[j] = True
            found.append(Span(template, matches[chain[-1]][0], matches[last][0] + matches[last][2], covered[last]))
        return found

    def spans(self, hashes: np.ndarray) -> list[Span]:
        """All spans of a text's words, by place."""
        shorts, longs = self.matches(hashes)
        return sorted([*shorts, *(s for k, m in longs.items() for s in self.chains(k, m))], key=lambda s: (s[1:], s[0]))

    def coverage(self, span: Span) -> float:
        return span.covered / self.lengths[span.template]


def licence_spans(docs: DataFrame, templates=BASE + TEMPLATES, covered: float = COVERED, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns, then label, start, end (in words, exclusive), covered and coverage of each span found.

    ``templates`` are (label, text) pairs. Rows without a span don't appear; spans that cover less than ``covered`` aren't listed.
    """
    held: list[Scanner] = []

    def made(texts: list[str | None]) -> Iterator:
        if not held:
            held.append(Scanner(templates))
        for k, t in enumerate(texts):
            spans = [s for s in held[0].spans(words(t, breaks=is_ascii_break)[0]) if held[0].coverage(s) >= covered]
            yield [k] * len(spans), {
                "label": [held[0].labels[s.template] for s in spans], "start": [s.start for s in spans], "end": [s.end for s in spans],
                "covered": [s.covered for s in spans], "coverage": [held[0].coverage(s) for s in spans]}

    fields = {"label": "string", "start": "bigint", "end": "bigint", "covered": "bigint", "coverage": "double"}
    return map_texts(docs, text, made, fields, keep).select("row.*", *fields)


def report(docs: DataFrame, templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """Per document: doc_id, n_words; of the base phrases n_base, first_word, last_word, base_labels; labels with those
    of covered templates; score, the coverage of the best covered text, phrases included, and n_spans, the spans of covered templates.

    Without words, or without any match, counts are 0, label lists empty, places null and the score 0.
    """
    held: list[Scanner] = []

    def judged(text: str | None) -> tuple:
        hashes = words(text, breaks=is_ascii_break)[0]
        spans = held[0].spans(hashes)
        base = [s for s in spans if s.template < len(BASE)]
        held_labels = {held[0].labels[s.template] for s in base}
        other = [s for s in spans if s.template >= len(BASE) and held[0].coverage(s) >= covered]
        return (len(hashes), len(base), min((s.start for s in base), default=None), max((s.start for s in base), default=None),
                ",".join(sorted(held_labels)), ",".join(sorted(held_labels | {held[0].labels[s.template] for s in other})),
                max((held[0].coverage(s) for s in spans), default=0.0), len(other))

    def made(texts: list[str | None]) -> Iterator:
        if not held:
            held.append(Scanner(BASE + tuple(templates)))
        yield None, dict(zip(fields, zip(*map(judged, texts), strict=True), strict=True))

    fields = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
              "labels": "string", "score": "double", "n_spans": "bigint"}
    return map_texts(docs, "text", made, fields).select("row.*", *fields)
