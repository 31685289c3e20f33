"""Licence scans: a positional index of rare words finds where a notice stands, and its key phrases confirm it.

The index holds the notices below: for each word its inverse document frequency over the notices, and for words that few
notices have, postings of notice and place. In a file, the rarest of its notice words are looked up; a posting's place taken
from the word's place tells where the notice would begin. Beginnings that agree within SLACK words (names and years come
between) are intersected, and a notice is a candidate where they hold enough of its rare words' weight. It counts if every
one of its key phrases stands there too. The base phrases are searched beside this, in every text.

The index is a fixed table of a few hundred words: nothing is gathered from the documents, no rows are shuffled, and each
document is one pass. Every rare word of a file is looked up; there is no limit of words, places or candidates.

Defined cases: null or wordless text has no places, no labels and score 0; equal places of one label are told once; a
document that repeats, or that has no doc_id, gives a row each time; texts of any length are read in pieces cut between
words. score is the largest share of a confirmed notice's weight that was found, or BASE_SCORE for a base phrase alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame

from harborscan.llm.common import documents, map_arrow

# The phrases and labels that every scan tells.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of public licences, as their owners word them, with the phrases that must stand in each.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT license. See LICENSE file in the project root", ["mit license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ["bsd style license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "version 2 of the license"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "version 3 of the license"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["unencumbered software released into the public domain"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["as is without any express or implied warranty", "arising from the use of this software"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", ["waived all copyright"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
    ("proprietary", "This document is confidential and proprietary. Unauthorized copying, distribution or disclosure is strictly prohibited", ["confidential and proprietary"]),
]

#: Words that stand between those of a notice, at most; notices that may share a rare word; weight that must be found.
SLACK, SHARED, ENOUGH, BASE_SCORE = 12, 4, 0.6, 0.5
PIECE = 1 << 20
#: Lower-cases A-Z; what is no word byte (0-9, a-z, 0x80 and above) becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACES = re.compile(rb" {2,}")


class Match(NamedTuple):
    label: str
    first: int
    last: int
    score: float


def spaced(text: bytes | None) -> bytes:
    """The text's words with one space before, between and after them; empty without words."""
    words = _SPACES.sub(b" ", b" " + text.translate(_FOLD) + b" ") if text else b" "
    return words if words != b" " else b""


def places_of(phrase: bytes, words: bytes) -> list[int]:
    """Numbers of the words at which the phrase stands, overlapping places included."""
    out, at, known, before = [], 0, 0, 0
    wanted = b" " + phrase + b" "
    while (at := words.find(wanted, at)) >= 0:
        before += words.count(b" ", known, at)
        known = at
        out.append(before)
        at += 1
    return out


class Index:
    """Rare words with their weight and postings, and the key phrases of each notice."""

    def __init__(self, notices=NOTICES, shared: int = SHARED, slack: int = SLACK, enough: float = ENOUGH):
        self.slack, self.enough = slack, enough
        texts = [spaced(text.encode()).split() for _, text, _ in notices]
        frequency = Counter(w for t in texts for w in set(t))
        self.labels, self.lengths = [n[0] for n in notices], [len(t) for t in texts]
        self.phrases = [[spaced(p.encode()).strip() for p in n[2]] for n in notices]
        self.weight = {w: math.log((1 + len(texts)) / f) for w, f in frequency.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.total = []
        for i, t in enumerate(texts):
            # A notice whose words are all common is looked up by its rarest ones.
            limit = max(shared, sorted(frequency[w] for w in set(t))[min(2, len(set(t)) - 1)])
            rare = {w for w in t if frequency[w] <= limit}
            self.total.append(sum(self.weight[w] for w in rare))
            for place, w in enumerate(t):
                if w in rare:
                    self.postings[w].append((i, place))

    def rare_places(self, words: bytes) -> list[tuple[int, bytes]]:
        """Places of the rare words, piece by piece."""
        out, at, before, known = [], 1, 0, self.postings
        while at < len(words):
            end = words.find(b" ", at + PIECE)
            end = len(words) if end < 0 else end
            part = words[at:end].split()
            out += [(before + i, w) for i, w in enumerate(part) if w in known]
            before += len(part)
            at = end + 1
        return out

    def matches(self, words: bytes) -> list[Match]:
        begins: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for place, w in self.rare_places(words):
            for notice, at in self.postings[w]:
                begins[notice].append((place - at, w))
        found: dict[bytes, list[int]] = {}
        out = set()
        for notice, votes in begins.items():
            for begin, share in self._agreeing(notice, votes):
                for phrase in self.phrases[notice]:
                    if phrase not in found:
                        found[phrase] = places_of(phrase, words)
                low, high = begin - self.slack, begin + self.lengths[notice] + self.slack
                if all(self._between(found[p], low, high) for p in self.phrases[notice]):
                    out.add(Match(self.labels[notice], max(begin, 0), begin + self.lengths[notice] - 1, share))
        return sorted(out, key=lambda m: (m.first, m.last, m.label, m.score))

    def _agreeing(self, notice: int, votes: list[tuple[int, bytes]]) -> list[tuple[int, float]]:
        """Beginnings that hold enough of the notice's weight within ``slack`` words (the one that most agree on), and the share."""
        votes.sort()
        out, left, weight, have = [], 0, 0.0, Counter()
        best: tuple[int, int, float] | None = None  # the window of votes with the largest share
        told = lambda a, b, share: (Counter(v for v, _ in votes[a : b + 1]).most_common(1)[0][0], share)
        for right, (begin, word) in enumerate(votes):
            have[word] += 1
            weight += self.weight[word] * (have[word] == 1)
            while votes[left][0] < begin - self.slack:
                gone = votes[left][1]
                have[gone] -= 1
                weight -= self.weight[gone] * (have[gone] == 0)
                left += 1
            share = min(1.0, weight / self.total[notice])
            if best and left > best[1]:
                out.append(told(*best))
                best = None
            if share >= self.enough and (best is None or share > best[2] + 1e-9):
                best = (left, right, share)
        return [*out, told(*best)] if best else out

    @staticmethod
    def _between(places: list[int], low: int, high: int) -> bool:
        i = bisect_left(places, low)
        return i < len(places) and places[i] <= high


def licensed(docs: DataFrame, notices=NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the notices found
    (label, first and last word, score)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first:long,last:long,score:double>>"

    def each(batches):
        index, phrases = Index(notices), [(p.encode(), label) for p, label in base.items()]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = spaced(text)
                places = [(at, label) for p, label in phrases for at in places_of(p, words)]
                told = index.matches(words)
                own = {label for _, label in places}
                score = max([m.score for m in told] + [BASE_SCORE] * bool(own), default=0.0)
                spots = [at for at, _ in places]
                rows.append((max(words.count(b" ") - 1, 0), len(places), min(spots, default=None), max(spots, default=None), ",".join(sorted(own)), ",".join(sorted(own | {m.label for m in told})), score, [m._asdict() for m in told]))
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")
            yield {"doc_id": batch.column(0)} | dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in ("doc_id", *names)}

    return map_arrow(documents(docs), each, schema)
