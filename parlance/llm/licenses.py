"""Licence scan: the Dice coefficient over word bigrams between passages and templates.

Text is normalised to runs of ASCII letters and digits, A-Z lowered, and of all
characters beyond ASCII.  A document is held
against the templates line by line, paragraph by paragraph and as a whole.  With
threshold t, a passage of a distinct bigrams can reach a template of b only if
t / (2 - t) <= a / b <= (2 - t) / t, so templates are sorted by size and all others
are pruned; passages without any template's bigram have a coefficient of 0.

Notices that fill no such passage are found by windows of words: the best window
for a template begins and ends with one of its bigrams, so those between its
occurrences, up to the number of distinct bigrams that the bound allows, are all
there is to try.  A window counts if no passage or window of at least its
coefficient overlaps it, and adds licences that no passage gave.

The templates are short public notices given as a parameter; they are broadcast,
being bounded by what the caller passes.  Texts that are null, empty or have fewer
than two words in every passage match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._bytes import mix, text_slices, word_hashes, words

WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """A-Z in lower case."""
    return text.translate(UPPER)


# Notices as their licences give or recommend them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def bigrams(text: str) -> frozenset:
    """Distinct pairs of neighbouring normalised words."""
    found = WORDS.findall(lower(text))
    return frozenset(zip(found, found[1:], strict=False))


class Templates:
    """Templates by number of bigrams, with the bounds that a threshold sets."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        rows = sorted(((len(b), name, b) for name, texts in templates.items() for t in texts if (b := bigrams(t))), key=lambda r: r[:2])
        self.sizes, self.threshold = [r[0] for r in rows], threshold
        self.rows = [(name, b) for _, name, b in rows]
        data, offsets = self._joined([f"{a} {b}" for a, b in frozenset().union(*(b for _, b in self.rows))])
        self.holders: dict[tuple, list[int]] = {}
        for k, (_, b) in enumerate(self.rows):
            for pair in b:
                self.holders.setdefault(pair, []).append(k)
        self.pairs = np.unique(self.pair_hashes(data, offsets)[0])
        self.bloom = np.zeros(1 << 18, bool)
        self.bloom[(self.pairs & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    @staticmethod
    def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    @staticmethod
    def pair_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each pair of neighbouring words."""
        start, end, doc = words(data, offsets, BETWEEN)
        h = word_hashes(data, start, end)
        same = doc[1:] == doc[:-1]
        return mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same], doc[:-1][same]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The documents that hold any template's bigram."""
        hashed, doc = self.pair_hashes(data, offsets)
        at = np.flatnonzero(self.bloom[(hashed & np.uint64((1 << 18) - 1)).astype(np.int64)])
        return np.unique(doc[at[np.isin(hashed[at], self.pairs)]])

    def best(self, own: frozenset) -> tuple[float, str] | None:
        """(coefficient, licence) of the best template at the threshold; ties: the first name."""
        t, a = self.threshold, len(own)
        low = np.searchsorted(self.sizes, a * t / (2 - t) - 1e-9, "left")
        high = np.searchsorted(self.sizes, a * (2 - t) / t + 1e-9, "right")
        scored = [(2 * len(own & b) / (a + len(b)), name) for name, b in self.rows[low:high]]
        return min((s for s in scored if s[0] >= t), key=lambda s: (-s[0], s[1]), default=None)

    def windows(self, low: str) -> list[tuple[float, str, int, int]]:
        """(coefficient, licence, start, end) of the best window from each place of each template, best first."""
        t, found = self.threshold, WORDS.findall(low)
        pairs = list(zip(found, found[1:], strict=False))
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for k in self.holders.get(pair, ()):
                places.setdefault(k, []).append(i)
        out, spans = [], None
        for k, at in places.items():
            name, b = self.rows[k]
            least, most = len(b) * t / (2 - t) - 1e-9, len(b) * (2 - t) / t + 1e-9
            if len(at) < least or len({pairs[i] for i in at}) < least:
                continue
            for n, i in enumerate(at):
                if len(at) - n < least:
                    break
                own, hits, best = set(), 0, (0.0, 0)
                for j in range(i, at[-1] + 1):
                    pair = pairs[j]
                    if pair in own:
                        continue
                    own.add(pair)
                    if len(own) > most:
                        break
                    if pair in b:
                        hits += 1
                        best = max(best, (2 * hits / (len(own) + len(b)), -j))
                if best[0] >= t:
                    spans = spans or [m.span() for m in WORDS.finditer(low)]
                    out.append((best[0], name, spans[i][0], spans[1 - best[1]][1]))
        return sorted(out, key=lambda w: (-w[0], w[1], w[2]))

    def scan(self, text: str) -> list[tuple[str, float, str]]:
        """(licence, coefficient, passage) of each licence's best passage."""
        low = lower(text)
        passages = [*low.split("\n"), *(p for p in re.split(r"\n\s*\n", low) if "\n" in p), low]
        found: dict[str, tuple[float, str]] = {}
        matched = []
        for passage in dict.fromkeys(passages):
            if (own := bigrams(passage)) and (hit := self.best(own)):
                matched.append((hit[0], passage))
                if hit[0] > found.get(hit[1], (0.0, ""))[0]:
                    found[hit[1]] = (hit[0], passage)
        taken = None
        for dice, name, start, end in self.windows(low):
            if taken is None:
                taken = [(d, *m.span()) for d, passage in matched for m in re.finditer(re.escape(passage), low)]
            if any(d >= dice and a < end and start < b for d, a, b in taken):
                continue
            taken.append((dice, start, end))
            if name not in found:
                found[name] = (dice, low[start:end])
        return [(name, dice, passage) for name, (dice, passage) in sorted(found.items())]


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, dice, passage: a row for each document and licence found in it."""
    held = Templates(templates, threshold)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("passage", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], 0
            for ids, data, offsets in text_slices(batch.column(0), batch.column(1)):
                for d in held.candidates(data, offsets).tolist():
                    rows += [(ids[d], *hit) for hit in held.scan(batch.column(1)[at + d].as_py())]
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, license string, dice double, passage string")
