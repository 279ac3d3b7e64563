"""Licence scan by a trained paragraph classifier: sparse word n-grams, logistic regression, template comparison.

The model is trained here, on paragraphs made from TEMPLATES: whole, with words dropped, inside other text; paragraphs
without a licence, some with its vocabulary; and notices of other licences, for the class "unknown". Features are hashed
words and pairs of neighbours. A first logistic model says whether a paragraph holds a licence notice; a softmax over the
families and the unknown class says which.

A named family must be confirmed: enough of a template's word pairs stand in the paragraph, and so does one of the family's
KEYS, the words that tell it from its neighbours: names, versions, numbers of clauses. A passage that several licences
share has no key and names none of them. The least probability to name a family is calibrated on made paragraphs that
were not trained on, among them notices of whole licences and versions that training has never seen (HELD_NOTICES), so
that at most 1 in 100 named families is wrong; below it, or unconfirmed, the family is "unknown".

Lines are read, and paragraphs of several lines between blank ones, joined, as notices are often wrapped. What has more
than WINDOW words is read in windows of WINDOW words that overlap by half, so a notice within a long line is seen as well as
one that stands alone, and every word is read. A notice of a paragraph is told at the line where it begins, in place of
unknown pieces that its lines gave; a paragraph adds an unknown notice only where its lines gave nothing. Rows are scored in one pass, without
a shuffle; memory is bounded by the batch.

Defined cases: null, empty and blank texts have no paragraph and give no row; repeated rows give repeated results; empty
tables give none. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm import shingles

SLOTS = 1 << 16
WINDOW = 40
#: Share of a template's word pairs that confirms its family.
CONFIRM = 0.6
LINE_FEED = "\x01"
UNKNOWN = "unknown"

#: Short notices and characteristic passages of public licences, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "ISC": ("Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense"),
}
FAMILIES = tuple(TEMPLATES)
#: For each family phrases of which one must be there, word for word; several of a tuple must all be.
KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "Apache-2.0": (("apache license version 2 0",), ("apache org licenses license 2 0",), ("apache license 2 0",), ("identifier apache 2 0",)),
    "MIT": (("mit license",), ("free of charge to any person obtaining a copy of this software",), ("identifier mit",)),
    "BSD-3-Clause": (("bsd 3 clause",), ("neither the name of", "endorse or promote products")),
    "GPL-3.0": (("gnu general public license version 3",), ("gnu general public license as published by", "version 3 of the license"), ("identifier gpl 3 0",)),
    "GPL-2.0": (("gnu general public license version 2",), ("gnu general public license as published by", "version 2 of the license"), ("identifier gpl 2 0",)),
    "LGPL-3.0": (("gnu lesser general public license version 3",), ("gnu lesser general public license as published by", "version 3 of the license"), ("identifier lgpl 3 0",)),
    "AGPL-3.0": (("gnu affero general public license",), ("identifier agpl 3 0",)),
    "MPL-2.0": (("mozilla public license v 2 0",), ("mozilla public license version 2 0",), ("mozilla public license 2 0",), ("identifier mpl 2 0",)),
    "CC-BY-4.0": (("cc by 4 0",), ("creative commons attribution 4 0",)),
    "CC-BY-SA-4.0": (("cc by sa 4 0",), ("creative commons attribution sharealike 4 0",)),
    "CC-BY-NC-4.0": (("cc by nc 4 0",), ("creative commons attribution noncommercial 4 0",)),
    "CC0-1.0": (("cc0 1 0",), ("waived all copyright and related or neighboring rights",)),
    "ISC": (("isc license",), ("with or without fee is hereby granted provided that the above copyright notice",), ("identifier isc",)),
    "Unlicense": (("the unlicense",), ("free and unencumbered software released into the public domain",), ("identifier unlicense",)),
}
#: Notices of no template's licence, to train on, and others that only calibration sees; and plain sentences with like words.
OTHER_NOTICES = (
    "Licensed under the {} License, version {}", "This work is licensed under the {} Public License", "Released under the terms of the {} licence", "Use of this file is governed by the {} End User License Agreement", "All rights reserved by {}; licensed material, do not redistribute", "Distributed under the {} Community License {}",
    "Licensed under the GNU Lesser General Public License, version 2.1", "Licensed under the BSD 4-Clause License", "Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under the Artistic License 2.0", "Distributed under the Boost Software License, Version 1.0",
)
HELD_NOTICES = (
    "Licensed under the Apache License, Version 1.1", "Apache Software License, version 1.0", "The contents of this file are subject to the Mozilla Public License Version 1.1", "Licensed under the Mozilla Public License 1.1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the BSD 2-Clause License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under CC BY 3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", "Licensed under CC BY-SA 3.0", "This work is licensed under the GNU General Public License, version 1",
    "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", "Licensed under the Common Development and Distribution License 1.0", "Licensed under the Academic Free License version 3.0", "Released under the Python Software Foundation License Version 2", "Licensed under the zlib License",
)
ORDINARY = (
    "She renewed her driving licence at the public office last week", "The version of the story in the public library differs from this copy", "Free of charge, the museum is open to the public on Sundays", "The work was granted an award in source and form",
    "He had permission to use the general store under the bridge", "No licence is needed to fish from the public pier", "The software was released in April and the third version in May", "Copyright law was the subject of the lecture", "He studied at MIT before he joined the foundation", "The Apache people lived in the southwest",
    "The commons are open to sheep under an old attribution of rights", "You may not use this door except on holidays", "The following conditions were met by the weather", "A new clause was put into the contract by the holder", "The restaurant is licensed to serve wine", "They modify the terms of the rental every year",
)

#: Frequent words of plain text in four languages.
FREQUENT = "the of and to in a is that it was for on are as with his they at be this have from or had by but not what all were when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see no way could people than first been call who its now find long down day did get come made may part over new sound take only work know place year live back give most very le la les de des du un une et en dans que qui pour par sur au aux est pas avec ce der die das und ist nicht mit ein eine von zu auf im den dem sich als auch el los las y que en por con para una del se no su lo".split()


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def word_hashes(text: Column) -> Column:
    """64-bit hashes of words of letters and digits, lower-cased, with the line feed as a word of its own."""
    lined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\n", f" {LINE_FEED} ")
    return F.transform(F.array_remove(F.split(lined, rf"[^\p{{L}}\p{{N}}{LINE_FEED}]+"), ""), lambda w: F.xxhash64(w))


def hash_of(words: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for each word."""
    import xxhash

    return np.asarray([xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words], np.uint64)


def _pairs(h: np.ndarray) -> np.ndarray:
    return shingles.mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word, and of each word with the next (half of the table each)."""
    half = np.uint64(SLOTS // 2 - 1)
    return (h & half).astype(np.int64), ((_pairs(h) & half) + np.uint64(SLOTS // 2)).astype(np.int64) if len(h) > 1 else np.zeros(0, np.int64)


class Classifier:
    def __init__(self) -> None:
        rng = np.random.default_rng(20240901)
        train, held = self._made(rng, 5000, OTHER_NOTICES), self._made(rng, 2500, HELD_NOTICES)
        self.is_notice = np.zeros((SLOTS + 1, 1), np.float32)
        self.family = np.zeros((SLOTS + 1, len(FAMILIES) + 1), np.float32)  # the last is the unknown class
        self._fit(self.is_notice, [t for t, _ in train], np.asarray([[float(y != -1)] for _, y in train]))
        named = [(t, y) for t, y in train if y != -1]
        self._fit(self.family, [t for t, _ in named], np.eye(len(FAMILIES) + 1)[[y if y >= 0 else len(FAMILIES) for _, y in named]])
        self.keys = [[[hash_of(_words(phrase)) for phrase in key] for key in KEYS[f]] for f in FAMILIES]
        self.templates = [(i, np.unique(_pairs(hash_of(_words(t))))) for i, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
        self.least = self._calibrate([(t, y) for t, y in held if y != -1])
        none = np.sort([self.probabilities(t)[0] for t, y in held if y == -1])
        cut = min(0.99, max(0.9, float(none[-1 - len(none) // 500])))
        self.cut = float(np.log(cut / (1 - cut)))

    @staticmethod
    def _made(rng: np.random.Generator, n: int, others: tuple[str, ...]) -> list[tuple[np.ndarray, int]]:
        """Paragraphs and classes: a family's number, -2 for another licence, -1 for none."""
        sounds = ("an", "er", "in", "on", "re", "th", "ion", "es", "la", "de", "que", "ung", "sch", "eau", "os", "ado", "ver", "ment")
        made_up = lambda k: ["".join(rng.choice(sounds, rng.integers(1, 4))) for _ in range(k)]
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.45:
                y = int(rng.integers(len(FAMILIES)))
                w = _words(str(rng.choice(TEMPLATES[FAMILIES[y]])))
                if rng.random() < 0.3:
                    w = [x for x in w if rng.random() > 0.08] or w
            elif kind < 0.6:
                y, name = -2, "".join(made_up(2))
                w = _words(str(rng.choice(others)).format(name, int(rng.integers(1, 9))))
            else:
                y = -1
                w = _words(str(rng.choice(ORDINARY))) if rng.random() < 0.3 else made_up(int(rng.integers(1, WINDOW)))
                often = rng.random()
                w = [str(rng.choice(FREQUENT)) if rng.random() < often else x for x in w] if rng.random() < 0.8 else w
                if rng.random() < 0.25:
                    some = _words(str(rng.choice(ORDINARY)))
                    w = w + [some[i] for i in rng.permutation(len(some))]
            if rng.random() < 0.5:
                room = max(1, WINDOW - len(w))
                plain = lambda k: [x if rng.random() < 0.6 else str(rng.choice(FREQUENT)) for x in made_up(k)]
                w = plain(int(rng.integers(0, room))) + w + plain(int(rng.integers(0, room)))
            out.append((hash_of(w[: 2 * WINDOW]), y))
        return out

    @staticmethod
    def _rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.concatenate(slots(h)) for h in texts]
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    def _fit(self, weights: np.ndarray, texts: list[np.ndarray], y: np.ndarray, rounds: int = 100) -> None:
        """Gradient steps with momentum on the slots that occur; one column is logistic, more are a softmax."""
        at, row = self._rows(texts)
        scale = 1 / np.sqrt(np.bincount(row, minlength=len(texts)))[:, None]
        used, at = np.unique(at, return_inverse=True)
        w, b = np.zeros((len(used), y.shape[1])), np.zeros(y.shape[1])
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):
            z = np.stack([np.bincount(row, w[at, k], len(texts)) for k in range(w.shape[1])], 1) * scale + b
            p = 1 / (1 + np.exp(-z)) if w.shape[1] == 1 else np.exp(z - z.max(1, keepdims=True))
            p = p if w.shape[1] == 1 else p / p.sum(1, keepdims=True)
            g = (p - y) / len(texts)
            gs = (g * scale)[row]
            gw = np.stack([np.bincount(at, gs[:, k], len(used)) for k in range(w.shape[1])], 1) + 1e-6 * w
            vw, vb = 0.9 * vw - 30 * gw, 0.9 * vb - 3 * g.sum(0)
            w, b = w + vw, b + vb
        weights[used], weights[SLOTS] = w, b

    def probabilities(self, h: np.ndarray) -> tuple[float, np.ndarray]:
        """(of a notice, of each family and of none if it is one) for one window of words."""
        at = np.concatenate(slots(h))
        s = 1 / np.sqrt(max(1, len(at)))
        notice = 1 / (1 + np.exp(-(self.is_notice[at].sum() * s + self.is_notice[SLOTS, 0])))
        z = self.family[at].sum(0) * s + self.family[SLOTS]
        z = np.exp(z - z.max())
        return float(notice), z / z.sum()

    def _calibrate(self, held: list[tuple[np.ndarray, int]]) -> float:
        """The least probability from which at most one in a hundred confirmed families of held-out notices is wrong."""
        said = []
        for h, y in held:
            p = self.probabilities(h)[1]
            best = int(p.argmax())
            if self.confirmed(best, h)[1]:
                said.append((float(p[best]), best == y))
        wrong, least = 0, 1.0
        for k, (p, right) in enumerate(sorted(said, reverse=True), 1):
            wrong += not right
            if wrong * 100 <= k:
                least = p
        return least

    def confirmed(self, family: int, h: np.ndarray) -> tuple[float, bool]:
        """(likeness to the family's templates, whether it is enough and a key of the family is there)."""
        if family == len(FAMILIES):
            return 0.0, False

        def has(phrase: np.ndarray) -> bool:
            at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0]) if len(h) >= len(phrase) else ()
            return any(np.array_equal(h[i : i + len(phrase)], phrase) for i in at)

        alike = self.likeness(family, h)
        return alike, alike >= CONFIRM and any(all(map(has, key)) for key in self.keys[family])

    def likeness(self, family: int, h: np.ndarray) -> float:
        """The largest share of a template's word pairs that the window has."""
        own = np.unique(_pairs(h)) if len(h) > 1 else np.zeros(0, np.uint64)
        return max(shingles.common(t, own) / max(1, len(t)) for i, t in self.templates if i == family)

    def extent(self, family: int, h: np.ndarray) -> tuple[int, int]:
        """First and last word of where the window is like the family's templates."""
        every = np.concatenate([t for i, t in self.templates if i == family])
        top, total, start, found = 0.0, 0.0, 0, (0, len(h) - 1)
        for k, hit in enumerate(np.isin(_pairs(h), every).tolist()):
            if total <= 0:
                total, start = 0.0, k
            total += 1 if hit else -0.5
            if total > top:
                top, found = total, (start, k + 1)
        return found

    def evidence(self, h: np.ndarray) -> np.ndarray:
        """What each word and the pair that it begins add to the score of a notice."""
        one, two = slots(h)
        out = self.is_notice[one, 0].astype(np.float64)
        out[: len(two)] += self.is_notice[two, 0]
        return out

    def windows(self, h: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the windows: lines without their breaks, long ones cut with overlap."""
        edge = np.concatenate(([-1], np.flatnonzero(breaks), [len(h)]))
        starts, ends = edge[:-1] + 1, edge[1:]
        full = ends > starts
        starts, ends = starts[full], ends[full]
        parts = np.maximum(1, -(-(ends - starts - WINDOW) // (WINDOW // 2)) + 1)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a = np.repeat(starts, parts) + step * (WINDOW // 2)
        return a, np.minimum(a + WINDOW, np.repeat(ends, parts))

    def notices(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Windows (a, b) of the word hashes h that hold a notice, by sums over running totals."""
        one, two = slots(h)
        s1 = np.concatenate(([0], np.cumsum(self.is_notice[one, 0].astype(np.float64))))
        s2 = np.concatenate(([0], np.cumsum(self.is_notice[two, 0].astype(np.float64))))
        n = 2 * (b - a) - 1
        z = (s1[b] - s1[a] + s2[np.maximum(a, b - 1)] - s2[a]) / np.sqrt(n) + float(self.is_notice[SLOTS, 0])
        return np.flatnonzero(z >= self.cut)


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line: from 0, family or "unknown", probability, likeness, confirmed) for each line on which a notice begins; of its windows, the best of each family."""
    model = classifier()
    mark = hash_of([LINE_FEED])[0]
    source = docs.select(F.col(id_col), word_hashes(F.col(text_col)).alias("_w"))
    names = [id_col, "line", "family", "probability", "likeness", "confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.pieces(batches, "_w"):
            h, offsets = shingles.flat(batch.column("_w"))
            feed = h == mark
            line = np.cumsum(feed)
            breaks = feed.copy()
            # a text's first word starts a line too: windows are cut there without losing the word
            starts, ends = [], []
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if y > x:
                    a, b = model.windows(h[x:y], breaks[x:y])
                    starts.append(a + x), ends.append(b + x)
            rows: dict[tuple[int, int, str], tuple[float, float, bool]] = {}

            def judged(window: np.ndarray) -> tuple[int, float, float, bool]:
                _, p = model.probabilities(window)
                best = int(p.argmax())
                alike, sure = model.confirmed(best, window)
                return best, float(p[best]), float(alike), bool(sure and p[best] >= model.least)

            def put(doc: int, at: int, family: str, p: float, alike: float, sure: bool) -> None:
                if (doc, at, family) not in rows or rows[doc, at, family][0] < p:
                    rows[doc, at, family] = (p, alike, sure)

            def line_of(doc: int, word: int) -> int:
                return int(line[word] - (line[offsets[doc] - 1] if offsets[doc] else 0))

            if starts:
                a, b = np.concatenate(starts), np.concatenate(ends)
                for i in model.notices(h, a, b).tolist():
                    best, p, alike, sure = judged(h[a[i] : b[i]])
                    doc = int(np.searchsorted(offsets, a[i], side="right")) - 1
                    put(doc, line_of(doc, a[i]), FAMILIES[best] if sure else UNKNOWN, p, alike, sure)
            # paragraphs: without the line feeds that stand alone; those of blank lines end them
            alone = feed.copy()
            alone[1:] &= ~feed[:-1]
            alone[:-1] &= ~feed[1:]
            word = np.flatnonzero(~alone)
            joined, limits = h[word], np.searchsorted(word, offsets)
            starts, ends = [], []
            for x, y in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                if y > x:
                    a, b = model.windows(joined[x:y], feed[word[x:y]])
                    starts.append(a + x), ends.append(b + x)
            if starts:
                a, b = np.concatenate(starts), np.concatenate(ends)
                several = line[word[a]] != line[word[b - 1]]
                a, b = a[several], b[several]
                open_ = []
                named = {k[:2] for k in rows if k[2] != UNKNOWN}
                begun: dict[tuple[int, int, str], int] = {}  # for the lines of a paragraph's notice the one that it begins on
                for i in model.notices(joined, a, b).tolist():
                    doc = int(np.searchsorted(offsets, word[a[i]], side="right")) - 1
                    window = joined[a[i] : b[i]]
                    best, p, alike, sure = judged(window)
                    if not sure:
                        open_.append((doc, a[i], b[i], p, alike))
                        continue
                    first, last = (line_of(doc, word[a[i] + k]) for k in model.extent(best, window))
                    if first == last and (doc, first) in named:
                        continue  # within one line, which its own windows have judged
                    mine = [(doc, k, FAMILIES[best]) for k in range(first, last + 1)]
                    at = next((begun.get(k, k[1]) for k in mine if k in begun or k in rows), first)
                    put(doc, at, FAMILIES[best], p, alike, sure)
                    for k in mine:
                        rows.pop((doc, k[1], UNKNOWN), None)
                        begun[k] = at
                told = {k[:2] for k in rows} | {k[:2] for k in begun}
                for doc, x, y, p, alike in open_:
                    lines = range(line_of(doc, word[x]), line_of(doc, word[y - 1]) + 1)
                    if not any((doc, k) in told for k in lines):
                        weight = np.bincount(line[word[x:y]] - line[word[x]], model.evidence(joined[x:y]))
                        at = lines[0] + int(weight.argmax())
                        put(doc, at, UNKNOWN, p, alike, False)
                        told.add((doc, at))
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([rows[k][0] for k in keys], pa.float64()), pa.array([rows[k][1] for k in keys], pa.float64()), pa.array([rows[k][2] for k in keys], pa.bool_())], names)

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, line int, family string, probability double, likeness double, confirmed boolean")
