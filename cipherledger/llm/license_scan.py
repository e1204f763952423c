"""Operator 5. License scans by a trained paragraph classifier.

A paragraph is a run of lines without a blank one. It is scored by a multinomial logistic regression over word unigrams and
bigrams with an L1 penalty, so common words get no weight; its classes are the licence families of ``TEMPLATES``,
``unknown`` and ordinary prose. A paragraph of several lines is scored line by line and as a whole: a family that only the
whole shows, as of a notice wrapped over lines, is reported for the paragraph, others for their lines.

Training, on the driver: variants of the templates (words dropped, neighbouring prose added, parts of a notice); the
families' names (``CALLED``) in the frames of notices in four languages; names that no family has in the same frames; everyday uses of the
same words; ``UNKNOWN`` and ``ORDINARY`` sentences; and at most ``SAMPLE`` different paragraphs of at most ``SAMPLE`` different texts of
the corpus without licence words, a documented bound (those with the smallest hashes). The temperature that calibrates the
probabilities is fitted on families that were left out of training, one third at a time: their variants count as unknown
there. A prediction of a family holds if its probability reaches ``CERTAIN`` and comparison with the family's templates
confirms it: a template's n-grams, weighed by how few families share them, are covered to ``CONFIRM`` or more. Otherwise
what isn't ordinary is ``unknown``: it speaks of rights or a licence, but of none that is known; its probability is that of
not being ordinary prose. Lines whose n-grams can't outweigh the bias towards ordinary prose, whatever their combination,
are known to be ordinary by one set lookup a word (``Scanner._strong``); no other is skipped.

Odd input: null and empty texts have no paragraphs. Very long texts and paragraphs are read whole; work is linear in the
text. Of equally certain paragraphs the first one names the row's family. Repeated rows get equal answers and teach once.
Only doc_id and text are read, so other columns can't clash. An empty table gives no rows, and a model of the templates
alone. Rows are independent: no shuffle but of the sample.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut, table
from .packed import tidy

SAMPLE = 3_000
VOCABULARY = 1_500  # n-grams of the training texts, besides those of the templates and names
CERTAIN = 0.7
CONFIRM = 0.5
WORD = re.compile(r"[^\W_]+")
CAPITALS = re.compile(r"\b[A-Z]{2}[A-Z0-9]*\b")

#: Short notices of licence families as their authors publish them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Licensed under the BSD 3-Clause License", "distributed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "licensed under the Mozilla Public License 2.0"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC0": ["dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "EPL": ["made available under the terms of the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0"],
    "Zlib": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
#: Sentences that speak of rights without naming a known family, and everyday uses of such words.
UNKNOWN = [
    "Licensed under the terms of the agreement between the parties", "See the license file for the terms", "This work is licensed under the Example Public License, version 7.",
    "Released under the Acme License.", "Licensed under the terms that follow", "used under license", "Copyright by the authors",
    "Distributed under the Foobar Community License, Version 9", "SPDX-License-Identifier: LicenseRef-Internal", "Use is subject to the license terms of the vendor",
    "This file is available under the Example Source License", "Licensed to the customer under a separate agreement", "See LICENSE for details of the copyright",
]
ORDINARY = [
    "He has a driver's license and a public version of the file", "The software was released last week", "All the rights of the people are general and free",
    "The version of the work that you have is a copy of the original", "A general public meeting is free of charge for any person", "she reserved a table under the name of the foundation",
    "the pilot lost the license and the permission to fly", "licensed doctors and nurses work in the public hospital",
    "the source of the river is in the public park", "no warranty comes with the used car", "the copyright office is open to the public on Monday", "the rights of the workers were granted by the new law",
    "the conditions of the form are met by the school", "the gnu is a general kind of antelope", "the foundation gives free meals to any person in the street", "he distributed copies of the book without charge",
    "the apache helicopter flew over the creative commons of the town", "the boost to the software industry was large", "the eclipse was visible to the public in the north", "a version of the song was released under a new name",
]


#: How the families are called in notices.
CALLED = {
    "MIT": ["MIT", "MIT License", "MIT/X11", "Expat license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "ASL 2.0", "Apache Software License, version 2"],
    "GPL-3.0": ["GPLv3", "GPL-3.0", "GPL 3", "GPL v3", "GNU GPL version 3", "GNU General Public License v3.0", "General Public License version 3"],
    "GPL-2.0": ["GPLv2", "GPL-2.0", "GPL 2", "GPL v2", "GNU GPL version 2", "GNU General Public License v2.0", "General Public License version 2"],
    "LGPL": ["LGPL", "LGPLv2.1", "LGPLv3", "LGPL-3.0", "GNU LGPL version 2.1", "GNU Lesser General Public License", "Lesser GPL"],
    "AGPL-3.0": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL version 3", "GNU Affero General Public License", "Affero GPL"],
    "BSD": ["BSD", "BSD License", "3-clause BSD license", "2-clause BSD", "New BSD License", "Simplified BSD", "BSD-2-Clause"],
    "MPL-2.0": ["MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "ISC": ["ISC", "ISC License", "ISC licence"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "BSL-1.0": ["Boost Software License 1.0", "BSL-1.0", "Boost License", "Boost Software License"],
    "EPL": ["EPL", "EPL 2.0", "EPL-1.0", "Eclipse Public License", "Eclipse Public License v2.0"],
    "Zlib": ["zlib", "zlib License", "zlib/libpng license"],
    "CC-BY": ["CC BY 4.0", "CC-BY", "CC BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution license"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons ShareAlike"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons NonCommercial"],
}
#: How notices begin and end in four languages; ``{}`` is the family's name.
FRAMES = [
    "Released under the {}", "Licensed under {}", "licensed under the terms of the {}", "License: {}", "Licence: {}", "license = {}", "This project is available under the {}", "The source code is distributed under {}", "{} licensed", "This library is covered by the {}",
    "You may use it under the conditions of the {}", "Copyright the authors. {}", "published under {}", "see LICENSE ({})", "It may be redistributed under the {}, see the file COPYING", "@license {}", "subject to the {}", "(c) the contributors, {}", "SPDX-License-Identifier: {}",
    "Lizenziert unter {}", "Lizenz: {}", "steht unter der {}", "Dieses Programm wird unter der {} veröffentlicht", "unter den Bedingungen der {}", "freigegeben unter {}", "unter der {}-Lizenz",
    "Sous licence {}", "Licence : {}", "Ce logiciel est distribué sous la {}", "selon les termes de la {}", "diffusé sous {}", "sous la licence {}",
    "Bajo licencia {}", "Licencia: {}", "Este programa se distribuye bajo la {}", "según los términos de la {}", "publicado con licencia {}", "con la licencia {}",
]
LATER = ["", "", "", ".", " or later", " or any later version", " only", "+", ".", " and others"]
#: Words from which names of licences that nobody knows, and everyday uses of licence words, are made.
_ODD = "Acme Northwind Contoso Foobar Sunrise Harbor Meridian Granite Willow Copper Zenith Polar European Artistic Academic Open Common Internal Vendor Sample Quill Fjord Python PHP Ruby Zope Educational Beerware Sleepycat".split()
_KIND = ["Public License", "Community License", "License", "Source License", "Shared License", "License 3.1", "Software Agreement", "Licence 1.2", "End User License", "PL"]
_WHO = "The driver|A nurse|The teacher|His uncle|The captain|A young doctor|The shop|Every hunter|The electrician|My neighbour|The airline|The city|A broker|The family|Some students".split("|")
_DOES = "applied for a|renewed the|was given a|lost the|asked about a|paid for the|showed the|had no|needed a new|returned the".split("|")
_WHAT = "driving license|fishing licence|trade license|marriage license|pilot licence|hunting license|taxi license|radio licence|music license|dog licence|license plate|licensed guide|copyright lawyer|building permission|public permission|warranty of the car".split("|")
_WHEN = "last week|in the north of the town|under the new rules|before the trial|at the public office|for two years|with the help of a friend|in version two of the form|free of charge|by the terms of the contract".split("|")
_THING = "apache|eclipse|boost|mozilla|python|gnu|free software|public domain|creative commons|foundation|artistic|general public|open source|source code|public".split("|")
_SEEN = "was seen over the|made the news in the|is the topic of the|comes back every spring to the|was painted on the wall of the|helped the people of the|is older than the|met the".split("|")
_WHERE = "town hall|library|school|market|harbour|museum|park|city council|evening paper|garden".split("|")


def _made(rng, many: int) -> list[tuple[str, str]]:
    """``(class, sentence)``: names of families in frames, names that no family has, and everyday uses of the same words."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    out = []
    for family, names in CALLED.items():
        for _ in range(many):
            text = pick(FRAMES).format(pick(names)) + pick(LATER)
            if rng.random() < 0.1:  # a second one beside it; the first names the line
                text += f" / {pick(CALLED[pick(list(CALLED))])}"
            out.append((family, text))
    for _ in range(6 * many):
        name = f"{pick(_ODD)} {pick(_ODD)} {pick(_KIND)}" if rng.random() < 0.3 else f"{pick(_ODD)} {pick(_KIND)}"
        out.append(("unknown", pick(FRAMES).format(name) + pick(LATER)))
        out.append(("unknown", pick(["placed in the public domain", "dedicated to the public domain by its authors", "usage terms: see the LICENSE file", "license to be decided", "copyright holders grant a license", "permission is granted to copy this page"])))
    for _ in range(10 * many):
        out.append(("ordinary", f"{pick(_WHO)} {pick(_DOES)} {pick(_WHAT)} {pick(_WHEN)}"))
        out.append(("ordinary", f"the {pick(_THING)} {pick(_SEEN)} {pick(_WHERE)} {pick(_WHEN)}"))
    return out


def _capitals(paragraph: str, words: int) -> list[str]:
    """Words of capitals, which are names unless the paragraph is written that way."""
    found = CAPITALS.findall(paragraph)
    return found if 2 * len(found) <= words + 1 else []


def grams(paragraph: str) -> list[str]:
    """Words and word pairs in small letters, and names in capitals as they are: MIT is a name, mit a German word."""
    w = WORD.findall(paragraph.lower())
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:])), *_capitals(paragraph, len(w))]


def _variants(rng, prose: list[list[str]], many: int) -> tuple[list[str], list[int], list[str]]:
    names = [*TEMPLATES, "unknown", "ordinary"]
    texts, classes = [], []
    for y, name in enumerate(names):
        for s in TEMPLATES.get(name) or (UNKNOWN if name == "unknown" else ORDINARY):
            for k in range(many):
                w = s.split()
                if k and len(w) > 12:
                    at = int(rng.integers(0, len(w) - 11))
                    w = w[at : at + int(rng.integers(12, len(w) - at + 1))]
                if k > 1 and len(w) > 5:
                    w = [x for x in w if rng.random() > 0.04]
                if k > 2 and prose:
                    a, b = prose[rng.integers(len(prose))], prose[rng.integers(len(prose))]
                    w = a[: rng.integers(0, 12)] + w + b[: rng.integers(0, 12)]
                texts.append(" ".join(w))
                classes.append(y)
    for name, text in _made(rng, 2 * many):
        w = text.split()
        if prose and rng.random() < 0.3:
            w = prose[rng.integers(len(prose))][: rng.integers(0, 10)] + w + prose[rng.integers(len(prose))][: rng.integers(0, 10)]
        texts.append(" ".join(w))
        classes.append(names.index(name))
    for p in prose:
        texts.append(" ".join(p))
        classes.append(len(names) - 1)
    return texts, classes, names


class Scanner:
    def __init__(self, names: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, heat: float):
        self.names, self.weights, self.bias, self.heat = names, weights, bias.copy(), heat
        o = names.index("ordinary")
        self.bias[o] = max(self.bias[o], np.delete(self.bias, o).max() + 0.5)  # a line that says nothing is prose
        self.strong = self._strong()
        share: dict[str, int] = {}
        sets = {n: [set(grams(t)) for t in (*ts, *CALLED.get(n, ()))] for n, ts in TEMPLATES.items()}
        for ts in sets.values():
            for g in set().union(*ts):
                share[g] = share.get(g, 0) + 1
        self.templates = {n: [{g: 1 / share[g] for g in t} for t in ts] for n, ts in sets.items()}

    def _strong(self) -> set[str]:
        """Words of which every paragraph that isn't ordinary has one: the n-grams left out can't outweigh the bias towards
        ordinary prose even together, as each counts once a paragraph."""
        o = self.names.index("ordinary")
        rest = np.arange(len(self.names)) != o
        gain = {g: max(0.0, float((w[rest] - w[o]).max())) for g, w in self.weights.items()}
        left = float(self.bias[o] - self.bias[rest].max())
        out: set[str] = set()
        for g in sorted(gain, key=lambda g: (gain[g], g)):
            left -= gain[g]
            if left <= 0 and out.isdisjoint(g.lower().split(" ")):
                out.add(max(g.split(" "), key=len).lower())
        return out

    def classify(self, paragraph: str) -> tuple[str, float] | None:
        """``(family or unknown, probability)``, or None for ordinary prose."""
        w = WORD.findall(paragraph.lower())
        if self.strong.isdisjoint(w):
            return None
        known, z = self.weights, self.bias.copy()
        found = {*w, *map(" ".join, zip(w, w[1:])), *_capitals(paragraph, len(w))}
        for g in sorted(found & known.keys()):
            z += known[g]
        z = z / self.heat
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        name = self.names[best]
        if name == "ordinary":
            return None
        if name != "unknown" and p[best] >= CERTAIN and self.confirmed(name, found) >= CONFIRM:
            return name, float(p[best])
        return "unknown", float(1 - p[self.names.index("ordinary")])

    def confirmed(self, name: str, found: set[str]) -> float:
        """The greatest weighed share of one of the family's templates that the n-grams cover; of long templates, of as
        many n-grams as the paragraph has."""
        best = 0.0
        for t in self.templates[name]:
            hit = sum(v for g, v in t.items() if g in found)
            need = sum(sorted(t.values(), reverse=True)[: max(7, len(found))])
            best = max(best, hit / need)
        return best

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """``(start, end, family, probability)`` of what isn't ordinary, in code points: lines, or whole paragraphs."""
        out: list = []
        lines: list = []
        at = 0
        for line in (text or "").split("\n"):
            if line.strip():
                lines.append((at, line))
            elif lines:
                out += self._paragraph(lines)
                lines = []
            at += len(line) + 1
        return out + self._paragraph(lines) if lines else out

    def _paragraph(self, lines: list[tuple[int, str]]) -> list[tuple[int, int, str, float]]:
        found = [(a, a + len(p), *got) for a, p in lines if (got := self.classify(p))]
        if len(lines) > 1 and (whole := self.classify("\n".join(p for _, p in lines))):
            if whole[0] != "unknown" and whole[0] not in {f[2] for f in found}:
                return [(lines[0][0], lines[-1][0] + len(lines[-1][1]), *whole)]
        return found


def _sampled(docs: DataFrame, text: str, sample: int) -> list[str]:
    """At most ``sample`` different ordinary paragraphs of at most ``sample`` different texts. Hashes are chosen first, texts
    and paragraphs joined to them after, so a task meets ``sample`` rows of one hash from each other one at most."""
    mention = r"(?i)licen[sc]|copyright|\brights\b|permission|warrant|spdx|public domain"
    rows = docs.select(F.col(text).cast("string").alias("t")).where("length(t) > 0").withColumn("h", F.xxhash64("t"))
    some = F.broadcast(cut(rows.select("h").distinct().orderBy("h").limit(sample)))
    texts = cut(rows.join(some, "h", "left_semi").dropDuplicates(["h"]))
    parts = texts.select(F.explode(F.split("t", r"\n\s*\n|\n")).alias("p")).where(~F.col("p").rlike(mention) & (F.length("p") > 0)).withColumn("h", F.xxhash64("p"))
    picked = F.broadcast(cut(parts.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(sample)))
    return [r.p for r in sorted(parts.join(picked, "h", "left_semi").dropDuplicates(["h"]).collect(), key=lambda r: r.h)]


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, many: int = 24, seed: int = 11) -> Scanner:
    """Fits the classifier; only the bounded sample of paragraphs and the templates meet the driver."""
    rng = np.random.default_rng(seed)
    texts, classes, names = _variants(rng, [p.split() for p in _sampled(docs, text, sample)], many)
    y = np.array(classes)
    sets = [set(grams(t)) for t in texts]
    seen = Counter(g for s in sets for g in s)
    own = {g for ts in (*TEMPLATES.values(), *CALLED.values()) for t in ts for g in grams(t)}
    often = [g for g, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY]
    vocab = {g: i for i, g in enumerate(sorted(own.union(often)))}
    x = np.zeros((len(texts), len(vocab)), np.float32)
    for i, s in enumerate(sets):
        for g in s & vocab.keys():
            x[i, vocab[g]] = 1
    unknown, thirds = names.index("unknown"), np.arange(len(names)) % 3
    third = np.where(y < len(TEMPLATES), thirds[y], rng.integers(0, 3, len(y)))
    scores, truth = [], []
    for k in range(3):  # families that the model hasn't seen are unknown to it
        held = third == k
        w, b = _fit(x[~held], y[~held], len(names), steps=150)
        gone = [j for j in range(len(TEMPLATES)) if thirds[j] == k]
        z = x[held] @ w + b
        z[:, gone] = -30
        scores.append(z)
        truth.append(np.where(y[held] < len(TEMPLATES), unknown, y[held]))
    z, t = np.concatenate(scores), np.concatenate(truth)
    z = z - z.max(1, keepdims=True)
    heats = np.exp(np.linspace(-1.5, 1.5, 31))
    loss = [float(np.mean(np.log(np.exp(z / h).sum(1)) - (z / h)[np.arange(len(t)), t])) for h in heats]
    w, b = _fit(x, y, len(names))
    weights = {g: w[i].astype(float) for g, i in vocab.items() if np.abs(w[i]).max() > 1e-3}
    return Scanner(names, weights, b.astype(float), float(heats[int(np.argmin(loss))]))


def _fit(x: np.ndarray, y: np.ndarray, k: int, l1: float = 2e-4, steps: int = 300, rate: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """L1-penalised multinomial logistic regression by accelerated proximal gradient steps, classes weighed alike."""
    n = len(y)
    share = np.bincount(y, minlength=k).astype(np.float32)
    each = (1 / np.maximum(share, 1))[y] * n / k
    each = (each / each.mean()).astype(np.float32)
    one = np.eye(k, dtype=np.float32)[y]
    zero = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    w, b, v, vb, t = *zero, *zero, 1.0
    for _ in range(steps):
        z = x @ v + vb
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one) * each[:, None] / n
        new = v - np.float32(rate) * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - np.float32(rate * l1), 0)
        nb = vb - np.float32(rate) * g.sum(0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        on = np.float32((t - 1) / t2)
        v, vb = new + on * (new - w), nb + on * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def scanned(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, family`` (that of the most certain paragraph, ``unknown`` if none is known, null for none at all),
    ``probability, n_paragraphs`` and ``paragraphs`` (start:end:family of each, comma-joined) for every row."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(scanner)  # the templates' n-grams

    @tidy
    def run(batches):
        s = known.value
        for b in batches:
            found = [s.scan(t) for t in b.column(1).to_pylist()]
            top = [max(f, key=lambda x: (x[2] != "unknown", x[3], -x[0]), default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([t and t[2] for t in top], pa.string()),
                    pa.array([t and round(t[3], 6) for t in top], pa.float64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(f"{a}:{e}:{n}" for a, e, n, _ in f) for f in found], pa.string()),
                ],
                ["doc_id", "family", "probability", "n_paragraphs", "paragraphs"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, family string, probability double, n_paragraphs bigint, paragraphs string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, train(docs))
