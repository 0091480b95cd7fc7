"""License scans by a generalised suffix automaton over word numbers.

The automaton holds every run of words of the licence templates and of the base phrases. A text is
streamed through it word by word, which gives its matching statistics: the longest run of words ending
at each word that some template has. Long maximal matches are chained, in the order of both text and
template, into spans; a template of which enough is covered gives its label. Words outside the
templates' vocabulary reset the automaton, so only runs of known words are streamed, and a run that was
seen before is not streamed again.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .langid import chunks, joined

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Labels and the wordings that stand for them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]

SHORTEST = 3
COVERED = 0.6
GAP = 40
#: In templates of over LONG words shorter matches than SHORTEST_IN_LONG stand in many places and say nothing.
LONG = 100
SHORTEST_IN_LONG = 8
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint64)
_BASE_POWER = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE_POWER, -1, 1 << 64)
_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,coverage:double>>"


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, a-z and characters beyond ASCII."""
    data = _FOLD[np.frombuffer(text.encode(), np.uint8)].astype(np.uint8).tobytes()
    return [w for w in data.split(b"\0") if w]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, and where each text's words start."""
    data, offsets = joined(texts)
    folded = _FOLD[data]
    powers = np.full((2, len(folded) + 1), _BASE_POWER, np.uint64)
    powers[1] = _BASE_INVERSE
    powers[:, :1] = 1
    powers = np.cumprod(powers, axis=1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * powers[0, :-1])))
    inner = folded > 0
    edge = np.zeros(len(folded) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inner & (~np.concatenate(([False], inner[:-1])) | edge[:-1]))
    end = np.flatnonzero(inner & (~np.concatenate((inner[1:], [False])) | edge[1:])) + 1
    h = (total[end] - total[start]) * powers[1, start]
    return h ^ h >> np.uint64(31), np.searchsorted(start, offsets)


@dataclass
class Automaton:
    """A generalised suffix automaton; `ends` has (sequence, place after its last word) of each state's strings."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The strings of q that end in p's longest and a word, as a state of their own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for place, word in enumerate(sequence, 1):
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            self.ends[last].append((number, place))

    def close(self) -> None:
        """Gives each state the ends of all states below it in the tree of links."""
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])
        self.ends = [sorted(set(e)) for e in self.ends]

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest known run that ends with it."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


@lru_cache(None)
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(label, text) of the whole licences."""
    files = sorted((f.name, f) for f in (resources.files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt"))
    return tuple((name.removesuffix(".txt"), f.read_text("utf-8")) for name, f in files)


@lru_cache(1)
def scanner(whole: tuple[tuple[str, str], ...]) -> Scanner:
    """A scanner for the short wordings and these whole licences, made once in a Python worker."""
    return Scanner([*TEMPLATES, *whole], n_short=len(TEMPLATES))


class Scanner:
    """Finds the base phrases and the templates; those from n_short on are whole licences, of which the best fitting version stays."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE, n_short: int | None = None):
        self.n_short = len(templates) if n_short is None else n_short
        self.names = [label for label, _ in templates] + list(base.values())
        self.sequences = [words(text) for _, text in templates] + [words(p) for p in base]
        self.n_templates = len(templates)
        vocabulary = sorted({w for s in self.sequences for w in s})
        hashes, _ = word_hashes([b" ".join(vocabulary)])
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], (np.arange(len(vocabulary)) + 1)[order]
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.automaton = Automaton()
        for i, s in enumerate(self.sequences):
            self.automaton.add(i, [number[w] for w in s])
        self.automaton.close()
        numbers = [[number[w] for w in s] for s in self.sequences]
        self.pairs = np.unique([a << 16 | b for s in numbers for a, b in zip(s, s[1:])])
        self.brief = [[e for e in ends if len(self.sequences[e[0]]) <= LONG] for ends in self.automaton.ends]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for v, ends in enumerate(self.automaton.ends):
            self.phrases[v] = [(i, len(self.sequences[i])) for i, place in ends if i >= self.n_templates and place == len(self.sequences[i])]
        self.seen: dict[bytes, tuple[list, list]] = {}

    def _run(self, run: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of a run of known words: base phrases (first word, phrase) and maximal matches (end, length, state)."""
        key = run.tobytes()
        if key not in self.seen:
            base, matches, before = [], [], (0, 0)
            for i, (state, length) in enumerate(self.automaton.stream(run.tolist())):
                v = state
                found = set()
                while v > 0:
                    found.update((p, n) for p, n in self.phrases[v] if n <= length)
                    v = self.automaton.link[v]
                base += [(i - n + 1, p) for p, n in found if self._ends_with(run, i, p)]
                if before[1] >= SHORTEST and length != before[1] + 1:
                    matches.append((i, before[1], before[0]))
                before = state, length
            if before[1] >= SHORTEST:
                matches.append((len(run), before[1], before[0]))
            if len(run) > 64:
                return base, matches
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = base, matches
        return self.seen[key]

    def _ends_with(self, run: np.ndarray, i: int, phrase: int) -> bool:
        sequence = self._phrase_numbers(phrase)
        return i + 1 >= len(sequence) and run[i + 1 - len(sequence) : i + 1].tolist() == sequence

    def _phrase_numbers(self, phrase: int) -> list[int]:
        if not hasattr(self, "_numbers"):
            self._numbers: dict[int, list[int]] = {}
        if phrase not in self._numbers:
            hashes, _ = word_hashes([b" ".join(self.sequences[phrase])])
            self._numbers[phrase] = self.numbers[np.searchsorted(self.hashes, hashes)].tolist()
        return self._numbers[phrase]

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, end word, share of the template covered) of enough of a template."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for template, place in self.automaton.ends[state] if length >= SHORTEST_IN_LONG else self.brief[state]:
                if template < self.n_templates:
                    by.setdefault(template, []).append((end, length, place))
        spans = {t: self._spans(sorted(pieces), len(self.sequences[t])) for t, pieces in by.items()}
        whole = {t: mine for t, mine in spans.items() if t >= self.n_short and mine}
        return sorted(((self.names[t], *span) for t, mine in spans.items() for span in mine if not self._beaten(t, *span, whole)), key=lambda s: (s[1], s[2], s[0]))

    def _spans(self, pieces: list[tuple[int, int, int]], total: int) -> list[tuple[int, int, float]]:
        """Spans of one template's matches (end, words, end in the template): chains that cover the most words, in order in both."""
        enough = max(COVERED * total, SHORTEST)
        if sum(length for _, length, _ in pieces) < enough:
            return []
        best, before = [length for _, length, _ in pieces], [-1] * len(pieces)
        for i, (end, length, place) in enumerate(pieces):
            start, begin, j = end - length, place - length, i - 1
            while j >= 0 and pieces[j][0] >= start - GAP:
                e, n, p = pieces[j]
                if e - n < start and p - n < begin and e < end and p < place:
                    gain = best[j] + length - max(0, e - start, p - begin)
                    if gain > best[i]:
                        best[i], before[i] = gain, j
                j -= 1
        out: list[tuple[int, int, float]] = []
        used: set[int] = set()
        for i in sorted(range(len(pieces)), key=lambda i: -best[i]):
            if best[i] < enough:
                break
            k, chain = i, []
            while k >= 0 and k not in used:
                chain.append(k)
                k = before[k]
            covered = best[i] - (best[k] if k >= 0 else 0)
            first, end = (pieces[chain[-1]][0] - pieces[chain[-1]][1], pieces[i][0]) if chain else (0, 0)
            at = bisect(out, (first, end, 2.0))
            if covered >= enough and (at == 0 or out[at - 1][1] <= first) and (at == len(out) or end <= out[at][0]):
                insort(out, (first, end, min(1.0, covered / total)))
                used.update(chain)
        return out

    def _beaten(self, template: int, first: int, end: int, share: float, whole: dict[int, list[tuple[int, int, float]]]) -> bool:
        """Whether over half of a whole licence's span another whole licence covers more words: of versions the one that fits stays.

        A licence's spans are in order and apart, so of each only the one over the middle can share so much.
        """
        if template < self.n_short:
            return False
        mine, middle = share * len(self.sequences[template]), (first + end) / 2
        for t, spans in whole.items():
            at = bisect(spans, (middle, float("inf"), 2.0)) - 1
            if at >= 0:
                a, b, c = spans[at]
                if 2 * (min(end, b) - max(first, a)) > end - first and c * len(self.sequences[t]) > mine:
                    return True
        return False

    def scan(self, texts: list[bytes]) -> list[tuple]:
        hashes, first = word_hashes(texts)
        maybe = np.flatnonzero(self.flags[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        known = self.hashes[at] == hashes[maybe]
        place, number = maybe[known], self.numbers[at[known]].astype(np.uint16)
        owner = np.searchsorted(first, place, "right") - 1
        pair = number[:-1].astype(np.int64) << 16 | number[1:]
        joins = (place[1:] == place[:-1] + 1) & (owner[1:] == owner[:-1])
        joins[joins] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair[joins]), len(self.pairs) - 1)] == pair[joins]
        heads = np.flatnonzero(np.append(True, ~joins)[: len(place)])
        tails = np.append(heads[1:], len(place))
        base: list[list] = [[] for _ in texts]
        matches: list[list] = [[] for _ in texts]
        for i, j in zip(*(x[(tails - heads) > 1].tolist() for x in (heads, tails))):
            hit, long = self._run(number[i:j])
            if hit or long:
                start = int(place[i] - first[owner[i]])
                base[owner[i]] += [(start + k, p) for k, p in hit]
                matches[owner[i]] += [(start + end, length, state) for end, length, state in long]
        out = []
        for k in range(len(texts)):
            spans = self._chains(matches[k]) if matches[k] else []
            mine = {self.names[p] for _, p in base[k]}
            places = [x for x, _ in base[k]]
            score = 1.0 if mine else max([0.0, *(s[3] for s in spans)])
            out.append((int(first[k + 1] - first[k]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(mine)), ",".join(sorted(mine | {s[0] for s in spans})), score, [{"label": a, "start": b, "end": c, "coverage": d} for a, b, c, d in spans]))
        return out


def scan(text: Column) -> Column:
    """Struct of what the licence scan finds in a text (whole; null is empty)."""
    small_batches()
    whole = whole_texts()

    @F.pandas_udf(_RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan_ = scanner(whole)
        names = [x.split()[0] for x in _RESULT.split(", ")]
        for batch in batches:
            rows = [r for part in chunks(list(batch)) for r in scan_.scan(part)]
            frame = pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})
            yield frame.astype({"n_words": "int64", "n_base": "int64", "score": "float64", "first_word": "Int64", "last_word": "Int64"})

    return of(utf8(text))


def scanned(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest
    word at which one starts (null where there is none). labels adds those of covered templates, whose
    spans are in words of the text. score is 1 with a base phrase, else the best share of a template
    covered; of whole licences that share over half of a span only the one that covers most words gives its
    label, so versions are told apart. A null or wordless text has no words, empty labels and score 0. Rows alike in doc_id each
    have their row; an empty table gives none.
    """
    return docs.select("doc_id", scan(F.col("text")).alias("found")).select("doc_id", "found.*")
