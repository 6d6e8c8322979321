"""License scan: MinHash bands over text windows retrieve templates, containment verifies.

Texts and templates are sequences of word shingles. Every window of 1, 2, 4, ... up to
``LARGEST`` shingles has a MinHash signature; the minima of a size follow from those of
half the size. A template is cut into overlapping windows of the largest size it holds.
A text window that shares one of ``BANDS`` bands of ``ROWS`` minima with a template
window retrieves the template: windows with a Jaccard similarity of 0.8 do so with
probability 1 - (1 - 0.8**2)**8 = 0.9997. All windows are taken, so one is always
aligned with a template's. Retrieved templates are then held against the text, shingle
by shingle.

Tasks share nothing but the templates, a fixed list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from solvenza.llm.common import map_rows

SHINGLE = 5
CONTAINED = 0.8
LARGEST = 16                # shingles of a window, a power of two
BANDS, ROWS = 8, 2
AT_ONCE = 1 << 16           # words whose windows are hashed at a time
CACHED = 500_000            # words whose hash is kept
_WORD = re.compile(r"\w+")

# Grants and notices of public licenses.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT (line)": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ),
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i: i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


class Scanner:
    """Finds the templates that a stretch of texts may hold, and verifies them."""

    def __init__(self, templates: dict[str, str]):
        random = np.random.default_rng(11)
        self.steps = random.integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
        self.turns = random.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
        self.names = list(templates)
        self.hashes: dict[str, int] = {}
        words = [words_of(t) for t in templates.values()]
        short = [n for n, w in zip(self.names, words) if len(w) < SHINGLE]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.sets = [frozenset(shingles(w)) for w in words]
        found: dict[tuple[int, int], dict[int, set[int]]] = {}
        for t, w in enumerate(words):
            hashed = self.hashed(w)
            count = len(w) - SHINGLE + 1
            size = min(LARGEST, 1 << (count.bit_length() - 1))
            starts = [*range(0, count - size, max(1, size // 2)), count - size]
            for (s, band), keys in self.bands(hashed):
                if s == size:
                    for at in starts:
                        found.setdefault((s, band), {}).setdefault(int(keys[at]), set()).add(t)
        self.tables = found
        # A bit for the leading digits of each key settles nearly all windows.
        self.leading = {}
        for where, keys in found.items():
            table = np.zeros(1 << 16, bool)
            table[[k >> 48 for k in keys]] = True
            self.leading[where] = table
        self.sizes = {s for s, _ in found}

    def hashed(self, words: list[str]) -> np.ndarray:
        known = self.hashes
        if len(known) > CACHED:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[words[i]] = xxh64_intdigest(words[i])
        return np.array(out, np.uint64)

    def bands(self, words: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """((size, band), key of the window at each shingle) over a sequence of words."""
        n = len(words) - SHINGLE + 1
        if n <= 0:
            return
        base = np.zeros(n, np.uint64)
        for j, step in enumerate(self.steps):
            base += _mixed(words[j: j + n] * step)
        base = _mixed(base)
        for band in range(BANDS):
            minima = [_mixed(base * t) for t in self.turns[band * ROWS: (band + 1) * ROWS]]
            size = 1
            while True:
                key = minima[0]
                for m in minima[1:]:
                    key = key * np.uint64(0xD6E8FEB86659FD93) + m
                yield (size, band), _mixed(key)
                if size == LARGEST or len(minima[0]) <= size:
                    break
                minima = [np.minimum(m[:-size], m[size:]) for m in minima]
                size *= 2

    def candidates(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(place of a window, template) of all collisions in a sequence of words."""
        found = set()
        for where, keys in self.bands(words):
            if where in self.leading:
                for at in np.flatnonzero(self.leading[where][keys >> np.uint64(48)]):
                    for t in self.tables[where].get(int(keys[at]), ()):
                        found.add((int(at), t))
        return found

    def verified(self, words: list[str], template: int) -> tuple[float, int, int] | None:
        """(containment, first word, end) of a template in a text, if it is contained."""
        wanted = self.sets[template]
        places: dict[str, int] = {}
        last = 0
        for i, s in enumerate(shingles(words)):
            if s in wanted:
                places.setdefault(s, i)
                last = i
        share = len(places) / len(wanted)
        return (share, min(places.values()), last + SHINGLE) if share >= CONTAINED else None


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word, end_word of each template in each text.

    A template is reported when at least 0.8 of its distinct five-word shingles are in
    the text; the words run from the first of them to the last. Words are runs of letters,
    digits and underscores in lower case. NULL and empty texts, and those of fewer than
    five words, hold none. NULL and repeated doc_ids are handed on, so a repeated row
    reports again. Only doc_id and text are read; an empty table gives an empty result.
    """
    fixed = tuple((TEMPLATES if templates is None else templates).items())

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        scan = scanner(fixed)

        def found(held: list[tuple]) -> Iterator[tuple]:
            # Windows that reach over the end of a text retrieve, if anything, too much.
            starts = np.cumsum([0] + [len(w) for _, w in held])
            hits = scan.candidates(scan.hashed([x for _, w in held for x in w]))
            pairs = {(int(np.searchsorted(starts, at, "right")) - 1, t) for at, t in hits}
            for d, t in sorted(pairs):
                doc_id, words = held[d]
                if match := scan.verified(words, t):
                    yield doc_id, scan.names[t], *match

        held, size = [], 0
        for doc_ids, texts in batches:
            for doc_id, text in zip(doc_ids, texts):
                words = words_of(text)
                if len(words) >= SHINGLE:
                    held.append((doc_id, words))
                    size += len(words)
                    if size >= AT_ONCE:
                        yield from found(held)
                        held, size = [], 0
        if held:
            yield from found(held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, license string, containment double, first_word int, end_word int"
    return map_rows(docs.select("doc_id", "text"), schema, rows)
