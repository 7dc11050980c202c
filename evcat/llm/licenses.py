"""License scans with a generalised suffix automaton of licence texts.

The automaton accepts every run of words of every template. A document is streamed through it once; at each word it knows the longest
run that ends there and stands in some template (matching statistics). Runs that cannot grow and are long enough are
chained per template, in the order of both texts; a chain that covers enough of its template is a finding.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evcat.llm import words as W

# Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Usual wordings of notices and public licence texts (openings and distinctive paragraphs), by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3": (
        "licensed under the GNU Affero General Public License version 3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "all-rights-reserved": ("all rights reserved",),
    "apache-2": (
        "licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "licensed under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by": ("licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("released under CC0 1.0", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    "gpl-2": (
        "licensed under the GNU General Public License, version 2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "gpl-3": (
        "licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",),
    "lgpl-3": (
        "licensed under the GNU Lesser General Public License, version 3",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "mit": (
        "released under the MIT License",
        "licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}

MIN_MATCH = 3  # words a run needs to be a link of a chain
MAX_GAP = 6  # words between two links, in the document and in the template
MIN_COVER, SHORT_TEMPLATE = 0.6, 8  # share of a template to cover; shorter templates must be covered whole


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the places where each state's longest run ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, place after the last word)
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._extend(state, word)
                self.ends[state].add((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, word: int) -> int:
        """State of exactly the run of ``parent`` and one word, cloned out of the state it shares if need be."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._new(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word)
        return state

    def runs(self, words: list[int], minimum: int) -> list[tuple[int, int, int]]:
        """Runs of at least ``minimum`` words that cannot grow to the right: (place after the run, length, state)."""
        found, state, length = [], 0, 0
        for place, word in enumerate(words):
            edges = self.next[state]
            if word not in edges and length >= minimum:
                found.append((place, length, state))
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
        if length >= minimum:
            found.append((len(words), length, state))
        return found


@dataclass(frozen=True)
class Finding:
    label: str
    start: int  # first and past-the-end word of the document
    end: int
    covered: int  # words of the template
    share: float


class Scanner:
    """Templates, phrases and their automaton; word numbers are places in the vocabulary."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [(label, W.alnum_words(text.encode())) for label, several in templates.items() for text in several]
        self.labels = [label for label, _ in texts]
        self.phrases = [(W.alnum_words(p.encode()), label) for p, label in phrases.items()]
        vocabulary = sorted({w for _, words in texts for w in words} | {w for words, _ in self.phrases for w in words})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[self.number[w] for w in words] for _, words in texts]
        self.phrase_numbers = [(np.array([self.number[w] for w in words]), label) for words, label in self.phrases]
        self.automaton = SuffixAutomaton(self.sequences)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def places(self, numbers: np.ndarray) -> list[tuple[int, str]]:
        """Start and label of every place of a phrase."""
        found = []
        for phrase, label in self.phrase_numbers:
            count = len(numbers) - len(phrase) + 1
            if count > 0:
                hit = np.flatnonzero(numbers[:count] == phrase[0])
                for k in range(1, len(phrase)):
                    hit = hit[numbers[hit + k] == phrase[k]]
                found += [(int(p), label) for p in hit]
        return found

    def findings(self, numbers: np.ndarray) -> list[Finding]:
        """Chains that cover enough of a template; where two overlap in the document, the one that covers more words."""
        edges = np.diff(np.concatenate([[0], (numbers >= 0).astype(np.int8), [0]]))
        chains: dict[int, list[int]] = {}  # template -> [document start, end, template end, covered]
        closed: list[tuple[int, list[int]]] = []
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if b - a < MIN_MATCH:
                continue
            for end, length, state in self.automaton.runs(numbers[a:b].tolist(), MIN_MATCH):
                for template, place in sorted(self.automaton.ends[state]):
                    self._chain(chains, closed, template, a + end - length, a + end, place - length, place)
        closed += chains.items()
        found = []
        for template, (start, end, _, covered) in closed:
            size = len(self.sequences[template])
            if covered >= (size if size < SHORT_TEMPLATE else MIN_COVER * size):
                found.append(Finding(self.labels[template], start, end, covered, covered / size))
        kept: list[Finding] = []
        taken = np.zeros(len(numbers), bool)
        for f in sorted(found, key=lambda f: (-f.covered, -f.share, f.label, f.start)):
            if not taken[f.start : f.end].any():
                taken[f.start : f.end] = True
                kept.append(f)
        return kept

    @staticmethod
    def _chain(chains: dict, closed: list, template: int, start: int, end: int, first: int, last: int) -> None:
        """Append a run to its template's chain if it follows within the gap in both texts, else begin a new chain."""
        chain = chains.get(template)
        if chain:
            overlap = max(0, chain[1] - start, chain[2] - first)
            if end > chain[1] and last > chain[2] and start - chain[1] <= MAX_GAP and first - chain[2] <= MAX_GAP and overlap < last - first:
                chain[1], chain[2], chain[3] = end, last, chain[3] + last - first - overlap
                return
            if end <= chain[1] and last - first <= chain[3]:
                return  # a shorter run inside what the chain has
            closed.append((template, chain))
        chains[template] = [start, end, last, last - first]


_FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
    "score": pa.float64(),
}


def scan(text: Column) -> Column:
    """Struct of n_words, n_base, first_word, last_word, base_labels, labels, score, spans for a text column.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null is read as empty. n_base counts the places of the fixed phrases,
    first_word and last_word are their smallest and largest start, null without one. labels adds the labels of the automaton's
    findings to those of the phrases; both lists are distinct, sorted and comma-joined, '' if empty. score is 1 with a phrase,
    else the largest share of a template that was covered, else 0. spans lists the findings: label, start, end (words), share.
    """

    def scanned(texts: pa.Array) -> pa.Array:
        scanner = W.worker_object("licences", None, Scanner)
        out: dict[str, list] = {name: [] for name in [*_FIELDS, "spans"]}
        for text in W.utf8(texts):
            words = W.alnum_words(text)
            numbers = scanner.numbers(words)
            places, found = scanner.places(numbers), scanner.findings(numbers)
            starts, base = [p for p, _ in places], {label for _, label in places}
            values = (
                len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {f.label for f in found})), 1.0 if places else max((f.share for f in found), default=0.0),
                [{"label": f.label, "start": f.start, "end": f.end, "share": f.share} for f in sorted(found, key=lambda f: f.start)],
            )
            for name, value in zip(out, values):
                out[name].append(value)
        span = pa.list_(pa.struct({"label": pa.string(), "start": pa.int64(), "end": pa.int64(), "share": pa.float64()}))
        return W.struct_array({name: (values, _FIELDS.get(name, span)) for name, values in out.items()})

    schema = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label: string, start: bigint, end: bigint, share: double>>"
    )
    return F.arrow_udf(scanned, schema)(text)
