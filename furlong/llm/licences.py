"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Every line of a text is a paragraph. A sparse logistic regression over word 1- and 2-grams gives the probabilities
of the licence families and of ``unknown``; it is trained on the driver from the templates below, whole, cut and
with words left out, against mixtures of their words and plain sentences. Its temperature is set on held-out
variants, and a family whose calibrated probability is below ``least`` counts as unknown. A family holds if the
paragraph also has ``overlap`` of the word 3-grams of one of the family's templates.

Notices run over several lines, so blocks between blank lines (or lines of comment marks alone) are compared too, with
the templates and the licences' own notices, by overlap. Of templates that are much alike (GPL 2 and 3) those found
best hold. A family that a line of the block already has is not counted again. The probability of such a hit is its overlap.

Scoring uses column functions alone, without a shuffle. Only paragraphs with a telling word are scored: the words are
chosen so that the 3-grams without any of them are fewer than a template must share, so no paragraph without such a word
can be confirmed. The weights are a constant of the plan, whose size is that of the templates.

Defined results: null and empty texts have no licence. Repeated rows and null doc_ids are kept and scored alike. An
empty table gives an empty result. Further columns are passed through; one named ``hits`` is replaced, and names that
begin with ``__lc_`` are reserved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual notices of each licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
# Words that are taken first to tell a template by.
PREFERRED = ("apache", "bsd", "cc", "cc0", "copyright", "gnu", "isc", "license", "licensed", "mit", "mozilla", "permission", "unencumbered", "unlicense")
# Sentences that speak of licences without granting one.
PLAIN = (
    "You need a driving license to rent this car.", "The driver was licensed in this state.", "Please ask for permission before you enter.",
    "The general public is free to visit the work in version two of the show.", "He studied at MIT and works on the source code of this form.",
    "All copyright questions go to the author.", "The license of the restaurant was not renewed.", "A copy of the file was released to any person.",
    "The terms of the contract are subject to law.", "We thank the Apache people for the documentation.", "The software may not be used by the public.",
)
# The notices that the licences give to be put into files, and their first sentences.
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
NOTICES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (_GNU.format(what="program", name="Affero General Public License", n=3),),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "GPL-2.0": (_GNU.format(what="program", name="General Public License", n=2),),
    "GPL-3.0": (_GNU.format(what="program", name="General Public License", n=3),),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": (_GNU.format(what="library", name="Lesser General Public License", n=3), _GNU.format(what="program", name="Lesser General Public License", n=3)),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Config:
    least: float = 0.5
    overlap: float = 0.75
    variants: int = 60
    rounds: int = 300
    rate: float = 2.0
    decay: float = 1e-4
    seed: int = 5


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]


def grams(w: list[str]) -> set[str]:
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


@dataclass
class Model:
    config: Config
    families: list[str]
    features: list[str]
    weights: np.ndarray  # (features, families)
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, text: str) -> np.ndarray:
        at = {f: i for i, f in enumerate(self.features)}
        z = self.bias + sum((self.weights[at[g]] for g in grams(tokens(text)) if g in at), np.zeros(len(self.bias)))
        p = np.exp((z - z.max()) / self.temperature)
        return p / p.sum()


def train(config: Config = Config()) -> Model:
    rng = np.random.default_rng(config.seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows: list[tuple[list[str], int]] = []
    pool = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)} | {w for t in PLAIN for w in tokens(t)})
    for k, family in enumerate(families[:-1]):
        for t in TEMPLATES[family]:
            w = tokens(t)
            rows.append((w, k))
            for _ in range(config.variants):
                # the name of a licence stays whole: other words around it come and go
                extra = [str(x) for x in rng.choice(pool, rng.integers(0, 6))]
                rows.append((extra[: len(extra) // 2] + w + extra[len(extra) // 2 :], k))
    for _ in range(config.variants * 12):
        rows.append(([str(x) for x in rng.choice(pool, rng.integers(1, 20))], len(families) - 1))
    rows += [(tokens(t), len(families) - 1) for t in PLAIN for _ in range(config.variants // 4)]
    features = sorted({g for k in TEMPLATES.values() for t in k for g in grams(tokens(t))})
    at = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(rows), len(features)))
    for i, (w, _) in enumerate(rows):
        x[i, [at[g] for g in grams(w) if g in at]] = 1
    y = np.array([k for _, k in rows])
    held = rng.random(len(rows)) < 0.2
    model = Model(config, families, features, np.zeros((len(features), len(families))), np.zeros(len(families)))
    fx, fy = x[~held], y[~held]
    weight = (1 / np.bincount(fy, minlength=len(families)))[fy]
    weight /= weight.sum()
    for _ in range(config.rounds):
        z = fx @ model.weights + model.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(fy)), fy] -= 1
        p *= weight[:, None]
        model.weights -= config.rate * (fx.T @ p + config.decay * model.weights)
        model.bias -= config.rate * p.sum(axis=0)
    z = x[held] @ model.weights + model.bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.1, 4, 40)), key=loss)
    return model


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, "[^0-9a-z]+"), lambda w: w != "")


def _runs(w: Column, n: int) -> Column:
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *(w[i + j] for j in range(n))))


def _literal(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def notices() -> list[tuple[str, int, set[str]]]:
    """Family, group of templates much alike, and 3-grams of every template and notice of three 3-grams and more."""
    found = []
    for family in sorted(TEMPLATES):
        for t in (*TEMPLATES[family], *NOTICES.get(family, ())):
            w = tokens(t)
            if len(w) >= 5 and "spdx" not in w:
                found.append((family, {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}))
    group = list(range(len(found)))
    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if 2 * len(a & b) >= min(len(a), len(b)):
                group = [group[j] if g == group[i] else g for g in group]
    return [(family, g, s) for (family, s), g in zip(found, group, strict=True)]


def telling(sets: list[set[str]], overlap: float) -> str:
    """A pattern of words, one of which is in every paragraph that has ``overlap`` of the 3-grams of any of the sets."""
    words: set[str] = set()
    for s in sets:
        grams_ = [set(g.split()) for g in s]
        left = [w for g in grams_ for w in g]
        order = sorted(set(left), key=lambda w: (w not in words, w not in PREFERRED, -len(w), w))
        for w in order:
            # strictly more than may be missing
            if sum(bool(g & words) for g in grams_) > (1 - overlap) * len(grams_) + 1e-9:
                break
            words.add(w)
    return r"\b(" + "|".join(sorted(words)) + r")\b"


def _block_hits(config: Config) -> Column:
    """Hits of the blocks of ``text``, each with the last line of its block."""
    words_ = telling([s for _, _, s in notices()], config.overlap)
    # a block starts with the blank lines before it
    blocks = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"(?<=\n)(?=[^\p{L}\p{N}\n]*\n)")
    at = F.filter(F.transform(blocks, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"].rlike(words_))
    own = notices()
    # one pass over a block's 3-grams; all comparisons are with the few that any template has
    every = _literal(sorted(set().union(*(s for _, _, s in own))))
    words = F.transform(at, lambda x: F.struct(x["i"].alias("i"), _words(x["t"]).alias("w")))
    three = F.transform(words, lambda x: F.struct(x["i"].alias("i"), F.array_intersect(_runs(x["w"], 3), every).alias("three")))
    three = F.filter(three, lambda x: F.size(x["three"]) >= 3)

    def shares(x: Column) -> Column:
        return F.array(*(F.size(F.array_intersect(x["three"], _literal(sorted(s)))) / F.lit(float(len(s))) for _, _, s in own))

    scored = F.transform(three, lambda x: F.struct(x["i"].alias("i"), shares(x).alias("o")))
    scored = F.filter(scored, lambda x: F.array_max(x["o"]) >= config.overlap)

    def held(x: Column) -> Column:
        out = []
        for family in sorted(TEMPLATES):
            best = F.lit(0.0)
            for k, (f, g, _) in enumerate(own):
                if f == family:
                    alike = [x["o"][j] for j, (_, h, _) in enumerate(own) if h == g]
                    top = F.greatest(*alike) if len(alike) > 1 else alike[0]
                    best = F.greatest(best, F.when(x["o"][k] >= top, x["o"][k]).otherwise(0.0))
            out.append(F.struct(F.lit(family).alias("family"), best.alias("overlap")))
        return F.filter(F.array(*out), lambda h: h["overlap"] >= config.overlap)

    def lines(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda n, t: n + F.size(F.split(t, "\n")) - 1)

    return F.flatten(F.transform(scored, lambda x: F.transform(held(x), lambda h: F.struct(
        lines(F.slice(blocks, 1, x["i"])).alias("line"),
        lines(F.slice(blocks, 1, x["i"] + 1)).alias("last"),
        h["family"].alias("family"),
        h["overlap"].alias("overlap"),
    ))))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``hits``: an array of (line, family, probability, overlap), one for each confirmed paragraph.
    ``line`` of a block is its first."""
    c = model.config
    sets = [[{" ".join(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(tokens, TEMPLATES.get(f, ()))] for f in model.families]
    words_ = telling([s for own in sets for s in own if s], c.overlap)
    lines = F.transform(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "\n"), lambda t, i: F.struct(i.alias("line"), t.alias("t")))
    lines = F.filter(lines, lambda x: x["t"].rlike(words_))
    words = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), _words(x["t"]).alias("w")))
    table = F.create_map(*(v for f, row in zip(model.features, model.weights / model.temperature, strict=True) for v in (F.lit(f), F.array(*(F.lit(round(float(z), 6)) for z in row)))))
    bias = F.array(*(F.lit(round(float(z), 6)) for z in model.bias / model.temperature))
    # a paragraph's n-grams that the model knows, then its sums, then its best family
    known = F.transform(words, lambda x: F.struct(
        x["line"].alias("line"),
        F.array_intersect(F.concat(x["w"], _runs(x["w"], 2)), _literal(model.features)).alias("g"),
        F.array_distinct(_runs(x["w"], 3)).alias("three"),
    ))
    summed = F.transform(F.col("__lc_known"), lambda x: F.struct(
        x["line"].alias("line"),
        x["three"].alias("three"),
        F.aggregate(x["g"], bias, lambda s, g: F.zip_with(s, F.col("__lc_weights")[g], lambda a, b: a + b)).alias("z"),
    ))
    scored = F.transform(F.col("__lc_summed"), lambda x: F.struct(
        x["line"].alias("line"),
        x["three"].alias("three"),
        (F.array_position(x["z"], F.array_max(x["z"])) - 1).cast("int").alias("k"),
        (F.lit(1.0) / F.aggregate(x["z"], F.lit(0.0), lambda s, z: s + F.exp(z - F.array_max(x["z"])))).alias("p"),
    ))

    def overlap(x: Column) -> Column:
        cases = F.lit(0.0)
        for k, own in enumerate(sets):
            if own:
                best = F.greatest(F.lit(0.0), F.lit(0.0), *(F.size(F.array_intersect(x["three"], _literal(sorted(s)))) / F.lit(float(len(s))) for s in own if s))
                cases = F.when(x["k"] == k, best).otherwise(cases)
        return cases

    found = F.transform(F.col("__lc_scored"), lambda x: F.struct(
        x["line"].cast("long").alias("line"),
        F.element_at(_literal(model.families), x["k"] + 1).alias("family"),
        x["p"].alias("probability"),
        overlap(x).alias("overlap"),
    ))
    kept = F.filter(F.col("__lc_found"), lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= c.least) & (x["overlap"] >= c.overlap))
    stages = docs.withColumn("__lc_known", known).withColumn("__lc_weights", F.when(F.size("__lc_known") > 0, table))
    stages = stages.withColumn("__lc_summed", summed).withColumn("__lc_scored", scored).withColumn("__lc_found", found).withColumn("hits", kept).withColumn("__lc_blocks", _block_hits(c))
    more = F.filter("__lc_blocks", lambda b: ~F.exists("hits", lambda h: (h["family"] == b["family"]) & (h["line"] >= b["line"]) & (h["line"] <= b["last"])))
    # the BSD texts share their opening; the third clause tells them apart
    three = F.exists("__lc_blocks", lambda b: b["family"] == "BSD-3-Clause")
    more = F.filter(more, lambda b: ~((b["family"] == "BSD-2-Clause") & three))
    more = F.transform(more, lambda b: F.struct(b["line"].alias("line"), b["family"].alias("family"), b["overlap"].alias("probability"), b["overlap"].alias("overlap")))
    stages = stages.withColumn("hits", F.when(F.size("__lc_blocks") > 0, F.concat("hits", more)).otherwise(F.col("hits")))
    return stages.drop(*(f"__lc_{x}" for x in ("known", "weights", "summed", "scored", "found", "blocks")))
