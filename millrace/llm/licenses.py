"""Licence scan: a trained paragraph classifier confirmed by templates.

Paragraphs are classified into licence families, or none, by a multinomial
logistic regression on sparse word 1- to 3-grams. Its training paragraphs are
made from the families' notices below, varied at random; the unknown class from
notices of other licences, of made-up ones in the same wording, and from a
bounded sample of the documents' own paragraphs. A temperature fitted on notices
that a first model was not trained on calibrates the probabilities; a family is
predicted from a calibrated probability of ``CERTAIN`` on. A prediction stands if
the paragraph holds ``OVERLAP`` of the word pairs of some notice of that family,
and ``OWN`` of those pairs that no other licence's notices hold.

Lines are classified one by one; besides, where consecutive lines with words hold
a notice between them, the words it spans are classified together.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Paragraphs of the documents, and the documents they come from, used in training at most.
BACKGROUND, BACKGROUND_DOCS = 3_000, 400
VARIANTS = 30
CERTAIN, OVERLAP, OWN = 0.5, 0.6, 0.5
#: Words of a paragraph that are classified together; longer ones are cut into overlapping runs.
RUN = 60
STEPS, RATE, RIDGE = 120, 0.3, 1e-4

#: Wordings that name each family.
NOTICES = {
    "MIT": [
        "released under the MIT license",
        "licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "the MIT license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    ],
    "Apache-2.0": [
        "licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses LICENSE-2.0",
        "released under the Apache License 2.0",
        "Apache License Version 2.0",
    ],
    "GPL": [
        "this work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "licensed under the GNU GPL version 2 or later",
        "GNU General Public License version 3",
        "GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU Lesser General Public License version 3",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "this library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "released under the BSD 3-clause license",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "the BSD license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License version 2.0",
    ],
    "ISC": [
        "released under the ISC license",
        "SPDX-License-Identifier: ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": [
        "licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
        "this work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA": [
        "licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "CC-BY-NC": [
        "licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-ND": [
        "licensed under CC BY-ND 4.0",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
        "this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
    "CC0": [
        "released under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "this work has been dedicated to the public domain",
        "this is free and unencumbered software released into the public domain",
    ],
    "Proprietary": [
        "all rights reserved",
        "no part of this publication may be reproduced distributed or transmitted in any form without the prior written permission of the publisher",
        "confidential and proprietary unauthorized copying of this file via any medium is strictly prohibited",
    ],
}
#: Names and identifiers of other licences, which are unknown here.
OTHERS = [
    ("Eclipse Public License", "EPL-2.0"),
    ("European Union Public Licence", "EUPL-1.2"),
    ("Boost Software License", "BSL-1.0"),
    ("zlib License", "Zlib"),
    ("SIL Open Font License", "OFL-1.1"),
    ("Artistic License", "Artistic-2.0"),
    ("Python Software Foundation License", "PSF-2.0"),
    ("Common Development and Distribution License", "CDDL-1.0"),
    ("Microsoft Public License", "MS-PL"),
    ("PostgreSQL License", "PostgreSQL"),
    ("Open Database License", "ODbL-1.0"),
    ("Server Side Public License", "SSPL-1.0"),
]
#: Wordings in which a licence is named: by its name, by its identifier.
NAMED = ["licensed under the {}, version {}", "released under the {}", "this work is licensed under the {}, version {}", "{}, version {}", "{} {}", "subject to the terms of the {}, v. {}"]
IDENTIFIED = ["SPDX-License-Identifier: {}", "licensed under {}", "released under {}"]
#: Temperatures tried.
HEATS = (0.5, 0.7, 1.0, 1.4, 2.0)
#: Made-up licences among the training paragraphs.
MADE_UP = 300
#: Sentences near the notices in wording that license nothing.
ORDINARY = [
    "he got his driving license renewed in version two of the form",
    "the general public was free to enter the library",
    "the commons voted on the attribution of rights",
    "she was released under the terms of the agreement last year",
    "the software is provided to schools free of charge every year",
    "all rights and duties pass to the new owner",
    "permission to use the hall is granted by the office",
    "the public domain of the city was reserved for walkers",
    "the apache helicopter landed at noon",
    "students at MIT published a new version of the work",
    "the license plate was copied from another car",
    "the foundation published a general report on public works",
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]

_WORD = re.compile(r"[^\W_]+")


def paragraphs(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def runs(words: list[str]) -> list[list[str]]:
    if len(words) <= RUN:
        return [words]
    return [words[k : k + RUN] for k in range(0, len(words) - RUN // 2, RUN // 2)]


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:])), *map(" ".join, zip(words, words[1:], words[2:]))}


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


_TEMPLATES = {f: [_pairs(_words(x)) for x in some] for f, some in NOTICES.items()}


def _named(name: str, label: str, version: str, r: random.Random) -> str:
    return r.choice(NAMED).format(name, version) if r.random() < 0.5 else r.choice(IDENTIFIED).format(label)


def _own_pairs() -> dict[str, list[set[tuple[str, str]]]]:
    """The pairs of each notice that notices of no other licence hold."""
    of_others = [_pairs(_words(w.format(name, 2))) for name, _ in OTHERS for w in NAMED] + [_pairs(_words(w.format(label))) for _, label in OTHERS for w in IDENTIFIED]
    common = set().union(*of_others)
    of_family = {f: set().union(*some) for f, some in _TEMPLATES.items()}
    return {f: [t - common - set().union(*(p for g, p in of_family.items() if g != f)) for t in some] for f, some in _TEMPLATES.items()}


_OWN = _own_pairs()


def overlap(words: list[str], family: str) -> float:
    """The largest share of a notice's word pairs that ``words`` hold."""
    own = _pairs(words)
    return max(len(t & own) / len(t) for t in _TEMPLATES[family])


def confirmed(words: list[str], family: str) -> bool:
    """Whether ``words`` hold a notice of the family, and what is its own in it."""
    pairs = _pairs(words)
    return any(len(t & pairs) >= OVERLAP * len(t) and len(own & pairs) >= OWN * len(own) for t, own in zip(_TEMPLATES[family], _OWN[family], strict=True))


#: The notices that hold each word pair, and the pairs a notice needs.
_HOLDERS: dict[tuple[str, str], list[int]] = {}
_NEEDED: list[float] = []
for _own in (t for some in _TEMPLATES.values() for t in some):
    for _pair in _own:
        _HOLDERS.setdefault(_pair, []).append(len(_NEEDED))
    _NEEDED.append(OVERLAP * len(_own))


def spans(words: list[str]) -> list[tuple[int, int]]:
    """Disjoint spans of ``words`` that hold ``OVERLAP`` of a notice's word pairs within ``RUN`` words."""
    pairs = list(zip(words, words[1:], strict=False))
    if _HOLDERS.keys().isdisjoint(pairs):
        return []
    hits: dict[int, list[int]] = {}
    for at, pair in enumerate(pairs):
        for t in _HOLDERS.get(pair, ()):
            hits.setdefault(t, []).append(at)
    found = []
    for t, places in hits.items():
        if len(places) < _NEEDED[t]:
            continue
        k = 0
        while k < len(places):
            best = (0, 0, 0, k)
            for i in range(k, len(places)):
                if places[i] > places[k] + RUN:
                    break
                seen: set[tuple[str, str]] = set()
                for j in range(i, len(places)):
                    if places[j] + 2 > places[i] + RUN:
                        break
                    if pairs[places[j]] not in seen:
                        seen.add(pairs[places[j]])
                        best = max(best, (len(seen), places[i] - places[j], -places[i], j))
            count, length, start, last = best
            if count >= _NEEDED[t]:
                found.append((-start, -start - length + 2))
                k = last + 1
            else:
                k += 1
    out: list[tuple[int, int]] = []
    for at, to in sorted(found):
        if out and at < out[-1][1]:
            out[-1] = (out[-1][0], max(to, out[-1][1]))
        else:
            out.append((at, to))
    return out


def wrapped(lines: list[list[str]]) -> list[tuple[int, int, list[str]]]:
    """(first line, last line, words) of each span that holds a notice across consecutive lines with words."""
    out, at = [], 0
    while at < len(lines):
        to = at
        while to < len(lines) and lines[to]:
            to += 1
        if to > at + 1:
            owner = [k for k in range(at, to) for _ in lines[k]]
            words = [w for line in lines[at:to] for w in line]
            out += [(owner[a], owner[b - 1], words[a:b]) for a, b in spans(words) if owner[a] < owner[b - 1]]
        at = to + 1
    return out


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    heat: float

    def chances(self, words: list[str]) -> np.ndarray:
        z = self.bias.copy()
        get = self.weights.get
        for g in grams(words):
            w = get(g)
            if w is not None:
                z += w
        z = np.exp((z - z.max()) / self.heat)
        return z / z.sum()

    def find(self, words: list[str]) -> list[tuple[str, float, bool]]:
        """(family, chance, confirmed) of each run of ``words`` that is predicted to be a notice."""
        out = []
        for run in runs(words):
            p = self.chances(run)
            best = int(p.argmax())
            if best and p[best] >= CERTAIN:
                out.append((FAMILIES[best], float(p[best]), confirmed(run, FAMILIES[best])))
        return out


def made_up(n: int, r: random.Random) -> list[str]:
    """Notices of licences that don't exist."""
    part = lambda: "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiouy") for _ in range(r.randint(1, 3))) + r.choice(["", "n", "x", "th"])
    kinds = ["Public License", "License", "Software License", "General License", "Free License", "Licence", "Source License", "Community License"]
    out = []
    for _ in range(n):
        version = r.choice(["1.0", "1.1", "2", "2.0", "3", "3.0", "4.0"])
        name = " ".join([*(part() for _ in range(r.randint(1, 2))), r.choice(kinds)])
        out.append(_named(name, "-".join([part(), *([version] if r.random() < 0.7 else []), *([r.choice(["only", "or-later"])] if r.random() < 0.2 else [])]), version, r))
    return out


def examples(background: list[str], seed: int = 11, notices: dict[str, list[str]] = NOTICES, others: list[tuple[str, str]] = OTHERS) -> list[tuple[list[str], int]]:
    """Training paragraphs with their classes."""
    r = random.Random(seed)
    plain = [w for w in map(_words, background) if w and all(overlap(w, f) < OVERLAP for f in NOTICES)]
    plain += [_words(x) for x in ORDINARY]
    out = [(run, 0) for w in plain for run in runs(w)]
    pool = [w for w in plain if len(w) > 3]

    def varied(notice: str, v: int) -> list[str]:
        words = _words(notice)
        if v % 3 == 1 and len(words) > 6:
            del words[r.randrange(len(words))]
        if v % 3 == 2:
            around = r.choice(pool)
            cut = r.randint(0, min(20, len(around)))
            words = around[:cut] + words + r.choice(pool)[: r.randint(0, 12)]
        if r.random() < 0.3:
            words = ["copyright", str(r.randint(1990, 2024)), *r.choice(pool)[:2], *words]
        return words

    for k, family in enumerate(NOTICES, 1):
        for notice in notices.get(family, ()):
            out += [(varied(notice, v), k) for v in range(VARIANTS)]
            for _ in range(VARIANTS // 3):  # pieces of a notice are not the notice
                words = _words(notice)
                at = r.randint(0, max(0, len(words) - 2))
                piece = words[at : at + 2]
                if overlap(piece, family) < OVERLAP / 2:
                    out.append((r.choice(pool)[:8] + piece + r.choice(pool)[:8], 0))
    for name, label in others:
        out += [(varied(_named(name, label, r.choice(["1.0", "2.0", "3"]), r), v), 0) for v in range(VARIANTS // 2)]
    out += [(varied(x, v), 0) for v, x in enumerate(made_up(MADE_UP, r))]
    r.shuffle(out)
    return out


def _weights(data: list[tuple[list[str], int]]) -> Model:
    """The regression's weights for the paragraphs ``data``."""
    seen: dict[str, int] = {}
    for words, _ in data:
        for g in grams(words):
            seen[g] = seen.get(g, 0) + 1
    names = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    rows, cols = [], []
    for i, (words, _) in enumerate(data):
        own = [names[g] for g in grams(words) if g in names]
        rows += [i] * len(own)
        cols += own
    rows, cols, y = np.array(rows, np.int64), np.array(cols, np.int64), np.array([k for _, k in data])
    n, classes = len(data), len(FAMILIES)
    w, b = np.zeros((classes, len(names))), np.zeros(classes)
    b[0] = 2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    truth = np.eye(classes)[y]
    for step in range(1, STEPS + 1):
        z = np.stack([np.bincount(rows, weights=w[c][cols], minlength=n) for c in range(classes)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pull = (p - truth) / n
        g = np.stack([np.bincount(cols, weights=pull[rows, c], minlength=len(names)) for c in range(classes)]) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE / (1 + step / 40) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.1 * pull.sum(0)
    return Model({g: w[:, k].copy() for g, k in names.items() if np.abs(w[:, k]).max() > 1e-4}, b, 1.0)


def heated(background: list[str]) -> float:
    """The temperature that suits notices, and licences, that a model was not trained on."""
    held = {f: some[-1:] for f, some in NOTICES.items() if len(some) > 2}
    known = {f: some[:-1] if f in held else some for f, some in NOTICES.items()}
    model = _weights(examples(background[0::2], 12, known, OTHERS[0::2]))
    data = [x for x in examples(background[1::2], 13, held, OTHERS[1::2]) if x[1] or len(x[0]) < 40]
    losses = {}
    for heat in HEATS:
        trial = Model(model.weights, model.bias, heat)
        losses[heat] = -sum(np.log(max(trial.chances(words)[k], 1e-12)) for words, k in data)
    return min(losses, key=losses.get)


def fit(background: list[str]) -> Model:
    model = _weights(examples(background))
    return Model(model.weights, model.bias, heated(background))


def _plain_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The lines with words, without those of notices over several lines, which aren't ordinary text."""
    rows = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        lines = paragraphs(text)
        words = [_words(x) for x in lines]
        taken = {k for at, to, _ in wrapped(words) for k in range(at, to + 1)}
        rows += [(doc_id, k, x) for k, x in enumerate(lines) if words[k] and k not in taken]
    ids, places, kept = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(kept, pa.string())], names=["doc_id", "at", "line"])


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most ``BACKGROUND`` paragraphs of the ``BACKGROUND_DOCS`` documents with the smallest hashes of their ids."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    chosen = own.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("licence")), "doc_id").limit(BACKGROUND_DOCS)
    lines = map_slices(own.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "text"), "text", _plain_lines, "doc_id long, at int, line string")
    rows = lines.orderBy(F.xxhash64("doc_id", "at", "line"), "doc_id", "at", "line").limit(BACKGROUND).collect()  # bounded
    return [r["line"] for r in rows]


SCHEMA = "doc_id long, licensed boolean, families array<string>, places array<int>, chances array<double>, n_unconfirmed int"


def scan_with(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, licensed, families, the paragraphs' places and chances, n_unconfirmed.

    ``families``, ``places`` and ``chances`` list the confirmed findings in page
    order, a notice over several lines at its first; ``n_unconfirmed`` counts
    predictions in lines that no template confirms, but for lines of such a notice. Null
    and empty texts hold none. Equal rows give equal rows, an empty table an
    empty result; further columns are not looked at.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        families, places, chances, others = [], [], [], []
        for text in batch.column(1).to_pylist():
            found, loose = [], []
            lines = [_words(line) for line in paragraphs(text)]
            for at, words in enumerate(lines):
                seen: set[str] = set()
                for family, p, sure in model.find(words):
                    if not sure:
                        loose.append((family, at))
                    elif family not in seen:
                        seen.add(family)
                        found.append((family, at, p))
            for at, to, words in wrapped(lines):
                for family, p, sure in model.find(words):
                    if sure:
                        part = next((x for x in found if x[0] == family and at <= x[1] <= to), None)
                        if part:  # one of its lines alone is confirmed too
                            found.remove(part)
                        found.append((family, at, p))
                        loose = [x for x in loose if not at <= x[1] <= to]
            found.sort(key=lambda x: x[1])
            families.append([f for f, _, _ in found])
            places.append([a for _, a, _ in found])
            chances.append([p for _, _, p in found])
            others.append(len(loose))
        return pa.record_batch([batch.column(0), pa.array([bool(f) for f in families]), pa.array(families, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), pa.array(chances, pa.list_(pa.float64())), pa.array(others, pa.int32())], names=["doc_id", "licensed", "families", "places", "chances", "n_unconfirmed"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(own, "text", one, SCHEMA)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the bounded sample, then scan every whole text."""
    return scan_with(docs, fit(sample(docs, id_col, text_col)), id_col, text_col)
