"""Licence scan: a generalised suffix automaton of licence texts streams over the words of every file.

The automaton (Blumer et al.) holds every run of words of all templates. Walking it with a text gives its matching
statistics: at each word, the longest run ending there that some template contains. Runs that cannot be lengthened
and have at least ``SEED`` words are chained per template, in order in both text and template and with gaps of at
most ``GAP`` words; a chain's covered template words give its score. The automaton is built from the templates in
each task, in time linear in their size, and does not grow with the corpus.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from risklane.llm.licence_texts import TITLES, WHOLE

# The phrases of the base scan and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Openings of public licence texts and usual notices, with the label each one stands for. Whole texts and titles
# are in ``licence_texts``.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the "
            "following conditions"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "distributed under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to "
                 "in writing software distributed under the license is distributed on an as is basis without "
                 "warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met redistributions of source code must retain the above copyright "
            "notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
              "mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "creative commons attribution share alike"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
SEED = 3
GAP = 6
# Least share of a template's words that a chain must cover to give the template's label.
COVERED = 0.8

# Letters A-Z become a-z, other ASCII characters that cannot be in a word become spaces, all else stays.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


class Match(NamedTuple):
    start: int          # in the text, in words
    length: int
    template: int
    at: int             # in the template


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(templates):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.longest[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _new(self, longest: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the run that ends in ``word`` after ``state``, cut off from longer runs if need be."""
        target = self.next[state][word]
        if self.longest[target] == self.longest[state] + 1:
            return target
        copy = self._new(self.longest[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        made, state = self._new(self.longest[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        self.link[made] = self._split(state, word) if state >= 0 else 0
        return made

    def statistics(self, words: Iterator[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run ending here) at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield state, length


class Scanner:
    """Templates that need a share of ``COVERED``, and titles, of which every word must be there."""

    def __init__(self, templates=TEMPLATES + WHOLE, phrases=PHRASES, titles=TITLES) -> None:
        self.labels = [label for label, _ in (*templates, *titles)]
        self.least = [COVERED] * len(templates) + [1.0] * len(titles)
        self.number: dict[bytes, int] = {}
        self.templates = [self._numbers(text) for _, text in (*templates, *titles)]
        self.phrases = [(self._numbers(text), label) for text, label in phrases]
        self.automaton = Automaton(self.templates)
        self.held: dict[int, list[tuple[int, int, int]]] = {}       # per state of the automaton, filled as states are met

    def _numbers(self, text: str) -> list[int]:
        return [self.number.setdefault(word, len(self.number)) for word in words_of(text)]

    def base(self, found: np.ndarray) -> list[tuple[int, str]]:
        """(place, label) of every phrase in the text."""
        places = []
        for phrase, label in self.phrases:
            count = len(found) - len(phrase) + 1
            if count > 0:
                here = found[:count] == phrase[0]
                for i, word in enumerate(phrase[1:], 1):
                    here &= found[i:count + i] == word
                places += [(int(at), label) for at in np.flatnonzero(here)]
        return places

    def places(self, state: int) -> list[tuple[int, int, int]]:
        """(template, place, words) of every template place that shares at least ``SEED`` last words with the state's runs.

        The suffix links lead to ever shorter runs with ever more places; each place counts with the longest. 0 words stand for
        the whole run.
        """
        if state not in self.held:
            out, seen, at, words = [], set(), state, 0
            while at > 0 and self.automaton.longest[at] >= SEED:
                out += [(template, end, words) for template, end in sorted(self.automaton.ends[at] - seen)]
                seen |= self.automaton.ends[at]
                at = self.automaton.link[at]
                words = self.automaton.longest[at]
            self.held[state] = out
        return self.held[state]

    def matches(self, found: np.ndarray) -> list[Match]:
        """Runs of at least ``SEED`` words that go no further at a template place, at every place they have.

        A run that one template carries on hides none that ends in another.
        """
        known = np.concatenate([[False], found >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        out = []
        for start, stop in zip(edges[::2], edges[1::2]):
            if stop - start < SEED:
                continue
            words = found[start:stop].tolist()
            for i, (state, length) in enumerate(self.automaton.statistics(words)):
                if length < SEED:
                    continue
                after = words[i + 1] if i + 1 < len(words) else None
                for template, end, shared in self.places(state):
                    text = self.templates[template]
                    if end + 1 == len(text) or text[end + 1] != after:
                        run = shared or length
                        out.append(Match(int(start) + i - run + 1, run, template, end - run + 1))
        return out

    def spans(self, matches: list[Match]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, covered share) of the best chain that ends in each match."""
        out = []
        for template in sorted({m.template for m in matches}):
            own = sorted(m for m in matches if m.template == template)
            words = len(self.templates[template])
            reach, best = [m.start + m.length for m in own], []
            starts = [m.start for m in own]
            for i, m in enumerate(own):
                score, first = m.length, m.start
                # Chains of a template reach back no further than its words and the gaps between them.
                for j in range(bisect.bisect_left(starts, m.start - words - GAP), i):
                    p = own[j]
                    if m.start - reach[j] <= GAP and p.start + p.length <= m.start + m.length and p.at < m.at \
                            and m.at - (p.at + p.length) <= GAP:
                        shared = max(0, reach[j] - m.start, p.at + p.length - m.at)
                        if best[j][0] + m.length - shared > score:
                            score, first = best[j][0] + m.length - shared, best[j][1]
                best.append((score, first))
                out.append((template, first, m.start + m.length, min(1.0, score / words)))
        return out

    def scan(self, text: str | None) -> dict:
        """Counts, labels, score and spans of one file."""
        words = words_of(text)
        found = np.fromiter((self.number.get(word, -1) for word in words), np.int32, len(words))
        places = self.base(found)
        spans = [s for s in self.spans(self.matches(found)) if s[3] > 0]
        covered = [s for s in spans if s[3] >= self.least[s[0]]]
        base = {label for _, label in places}
        given = []
        taken = {}      # per template the spans given so far, which do not overlap, by their first words
        for template, first, stop, share in sorted(covered, key=lambda s: (-s[3], s[1])):
            held = taken.setdefault(template, [])
            at = bisect.bisect(held, (first, stop))
            if (at == 0 or held[at - 1][1] <= first) and (at == len(held) or held[at][0] >= stop):
                held.insert(at, (first, stop))
                given.append((first, template, stop, share))
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min((at for at, _ in places), default=None),
            "last_word": max((at for at, _ in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {self.labels[t] for t in taken})),
            "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
            "spans": [{"label": self.labels[t], "first_word": f, "stop_word": s, "covered": c}
                      for f, t, s, c in sorted(given)],
        }


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label:string,first_word:bigint,stop_word:bigint,covered:double>>")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``, repeated rows included.

    A null text counts as empty: no words, no labels (empty strings), null places, score 0. ``spans`` holds the
    covered spans of each template, the best first chosen and none overlapping another of its template, by first word. Other columns of ``df`` are ignored.
    """
    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            rows = pd.DataFrame([scanner.scan(text) for text in batch["text"]],
                                columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            rows.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield rows.astype({"first_word": "Int64", "last_word": "Int64", "doc_id": "Int64"})

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scanned, SCHEMA)
