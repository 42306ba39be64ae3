"""Licence scan by a trained paragraph classifier.

Sparse word n-grams (single words and neighbouring pairs) of licence notices, but for a fixed list of function words, are the features of a
multinomial logistic regression over licence families and a class for other licence-like wording. Families are trained on varied copies of
template notices, the unknown class on mixtures of them and on passages of the corpus that agree with none; the temperature is fitted on
templates and passages held out. What it predicts counts as confirmed if the passage agrees with a template of that family.

A passage is a run of template words within a paragraph, that is between blank lines, whatever its line breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec
from .common import bounded, hashed_sample, small_batches

OTHER = "unknown"
#: A corpus passage that agrees less than this with every template is an example of the unknown class.
STRANGE = 0.35
# Short public notices of each licence family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "Released into the public domain under CC0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "Proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "Confidential and proprietary. All rights reserved."],
}
#: Words of the templates that any English text has, and so no terms. Fixed, as counts of the corpus would take a frequent notice's words for the corpus's own.
FUNCTION = frozenset(
    "a above all along an and any are as at be by can either for from has have if in into is it later may must no not of on or should that the "
    "this to under unless was with without you your".split()
)
#: Letters, digits and what is not ASCII make words here.
_APART = np.array([not (b > 127 or chr(b).isalnum()) for b in range(256)])
_WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
SCHEMA = "doc_id long, line long, family string, probability double, similarity double, confirmed boolean"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Classifier:
    families: list[str]
    terms: np.ndarray
    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    weights: np.ndarray
    temperature: float
    templates: dict[str, list[set[str]]]

    def vector(self, said: list[str]) -> np.ndarray:
        x = np.zeros(len(self.words) + len(self.pairs) + 1)
        for i in {self.words[w] for w in said if w in self.words} | {self.pairs[p] for p in zip(said, said[1:], strict=False) if p in self.pairs}:
            x[i] = 1
        x[:-1] /= max(1.0, np.sqrt(x.sum()))
        x[-1] = 1
        return x

    def agreement(self, family: str, own: set[str]) -> float:
        """The best agreement of a passage's words with a template of the family."""
        return max(len(own & t) / max(1, min(len(own), len(t))) * min(1.0, 2 * len(own) / len(t)) ** 0.5 for t in self.templates[family])

    def judge(self, said: list[str], agree: float = 0.6) -> tuple[str, float, float, bool]:
        """Family, its probability, the best agreement with one of its templates, and whether that confirms it."""
        z = self.vector(said) @ self.weights / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        if self.families[k] == OTHER:
            return OTHER, float(p[k]), 0.0, False
        like = self.agreement(self.families[k], set(said))
        return (self.families[k] if like >= agree else OTHER), float(p[k]), float(like), like >= agree


def _varied(rng: np.random.Generator, said: list[str], noise: list[str]) -> list[str]:
    keep = [w for w in said if rng.random() > rng.choice([0, 0.05, 0.15])]
    if len(keep) > 12 and rng.random() < 0.5:
        n = int(len(keep) * rng.uniform(0.5, 1))
        at = rng.integers(0, len(keep) - n + 1)
        keep = keep[at : at + n]
    pad = lambda: [noise[i] for i in rng.integers(0, len(noise), rng.integers(0, 4))]
    return [*pad(), *keep, *pad()]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int) -> np.ndarray:
    """Weights (features by classes) by Adam on the multinomial likelihood; classes weigh the same, whatever their numbers."""
    target, each = np.eye(classes)[y], (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y][:, None]
    each = each / each.sum()
    w = np.zeros((x.shape[1], classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = x.T @ ((_softmax(x @ w) - target) * each) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def mined(docs: DataFrame, terms: np.ndarray, sample: int) -> list[list[str]]:
    """The passages, as words, of about `sample` documents chosen by a hash of doc_id."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            yield pa.RecordBatch.from_arrays([pa.array([t for _, _, t in passages(batch.column("text").to_pylist(), terms)], pa.string())], names=["passage"])

    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    picked = hashed_sample(known, sample, known.count(), "doc_id")
    return [tokens(r["passage"]) for r in picked.select("text").mapInArrow(run, "passage string").distinct().orderBy("passage").toLocalIterator()]


def train(docs: DataFrame | None = None, copies: int = 40, steps: int = 300, sample: int = 1000) -> Classifier:
    """Learns families from varied copies of the templates, all of whose words are terms but FUNCTION, and the unknown class from mixtures of these words
    and from the corpus: passages of about `sample` documents that agree with no template. No notice, however frequent, is taken for the corpus's own, as
    agreement and not frequency decides. The temperature is fitted on templates and passages that a first fit hasn't seen."""
    rng = np.random.default_rng(5)
    said = {k: [tokens(t) for t in v] for k, v in TEMPLATES.items()}
    terms = {w for v in said.values() for t in v for w in t if w not in FUNCTION}
    words = {w: i for i, w in enumerate(sorted(terms))}
    both = sorted({p for v in said.values() for t in v for p in zip(t, t[1:], strict=False) if p[0] in terms or p[1] in terms})
    pairs = {p: len(words) + i for i, p in enumerate(both)}
    families = [*sorted(said), OTHER]
    noise = sorted(FUNCTION)
    model = Classifier(families, np.sort(np.array([textvec.bytes_hash(w.encode()) for w in terms], np.uint64)), words, pairs, np.zeros((len(words) + len(pairs) + 1, len(families))), 1.0, {k: [set(t) for t in v] for k, v in said.items()})
    x, y, held = [], [], []
    for k, v in said.items():
        for i, t in enumerate(v):
            for _ in range(copies):
                x.append(model.vector(_varied(rng, t, noise)))
                y.append(families.index(k))
                held.append(i > 0 and i == len(v) - 1)  # the last of several templates
    every = sorted(terms)
    for _ in range(6 * copies):  # licence words without a licence's order or company
        pick = [every[i] for i in rng.integers(0, len(every), rng.integers(2, 9))]
        x.append(model.vector(_varied(rng, pick, noise)))
        y.append(len(families) - 1)
        held.append(rng.random() < 0.2)
    for said_there in mined(docs, model.terms, sample) if docs is not None else ():
        if max(model.agreement(k, set(said_there)) for k in said) < STRANGE:
            x.append(model.vector(said_there))
            y.append(len(families) - 1)
            held.append(rng.random() < 0.5)
    x, y, held = np.array(x), np.array(y), np.array(held)
    w = _fit(x[~held], y[~held], len(families), steps)
    loss = lambda t: -np.log(np.maximum(_softmax(x[held] @ w / t)[np.arange(held.sum()), y[held]], 1e-12)).mean()
    model.temperature = min((0.5, 0.75, 1, 1.5, 2, 3, 4), key=loss)
    model.weights = _fit(x, y, len(families), steps)
    return model


def passages(texts: list[str | None], terms: np.ndarray, gap: int = 12, edge: int = 4) -> list[tuple[int, int, str]]:
    """(text, line, passage): runs of words of one paragraph with two different terms or more, no two terms in a row over `gap` words apart, with `edge`
    words of their lines on either side, and the line (from 0) of the first term. Terms further apart are in passages of their own."""
    w = textvec.words([(t or "").lower() for t in texts], _APART, lower=False)
    sieve = np.zeros(1 << 16, bool)
    sieve[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
    maybe = maybe[terms[np.minimum(np.searchsorted(terms, w.hash[maybe]), len(terms) - 1)] == w.hash[maybe]]
    if not len(maybe):
        return []
    ends = np.flatnonzero(w.buf == 10)
    blank = np.zeros(len(ends), bool)  # lines of white space alone: line i ends at ends[i]
    inked = np.concatenate([[0], np.cumsum(~textvec.SPACES[w.buf])])
    blank[:] = inked[ends] == inked[np.concatenate([[0], ends[:-1] + 1])]
    blank[np.searchsorted(ends, w.at[1:] - 1)] = True  # a text's end parts too
    part = np.concatenate([[0], np.cumsum(blank)])  # of each line, blank ones counting as ends
    line = np.searchsorted(ends, w.start[maybe])
    doc = np.searchsorted(w.at, w.start[maybe], "right") - 1
    paragraph = part[line]
    cuts = np.flatnonzero((np.diff(paragraph) != 0) | (np.diff(doc) != 0) | (np.diff(maybe) > gap)) + 1
    out = []
    for run in np.split(np.arange(len(maybe)), cuts):
        hit = maybe[run]
        if len(run) < 2 or len(np.unique(w.hash[hit])) < 2:
            continue
        d, n = int(doc[run[0]]), int(line[run[0]])
        a, b = max(0, hit[0] - edge), min(len(w.start) - 1, hit[-1] + edge)
        first, last = (int(ends[n - 1]) + 1 if n else 0), int(ends[line[run[-1]]])
        lo, hi = max(first, int(w.start[a])), min(last, int(w.end[b]))
        out.append((d, n - int(np.searchsorted(ends, w.at[d])), w.buf[lo:hi].tobytes().decode("utf-8", "replace")))
    return out


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """Licence passages in docs (doc_id, text): doc_id, line (from 0), family, probability, similarity, confirmed.

    A passage that no family explains, or whose family's templates it doesn't agree with, is `unknown` and not confirmed. Null and empty texts have none;
    texts are taken whole, and long paragraphs in passages. Repeated rows give their passages each; a null doc_id is kept; other columns are ignored;
    no rows give no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, float, float, bool]] = {}
        for batch in bounded(rows):
            found = passages(batch.column("text").to_pylist(), model.terms)
            ids = batch.column("doc_id").to_pylist()
            out = []
            for doc, line, text in found:
                if text not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[text] = model.judge(tokens(text))
                out.append((ids[doc], line, *known[text]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], names=["doc_id", "line", "family", "probability", "similarity", "confirmed"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
