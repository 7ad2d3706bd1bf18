"""Licence notices in texts: a trained paragraph classifier whose predictions a template comparison confirms.

A multinomial logistic regression over sparse word n-grams (one or two words) is trained on the driver, from notices
below and a bounded sample of other paragraphs, and pruned to few hundred weights. Scoring uses DataFrame functions
only; nothing but the found notices is shuffled. Paragraphs are blocks between blank lines. Of each line that holds a
weighted word two readings are scored, the line alone and the lines around it joined, so that notices on one line and
notices wrapped over several are both met. The least probability that counts as known is calibrated on paragraphs kept
out of training. A prediction is confirmed when the template that fits best, of all families, is one of its own.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

# Usual short notices of licence families, in plain text.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ofl-1.1": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
    ),
}
_SPLIT = r"[^a-z0-9.]+"


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_SPLIT, text.lower())) if w]


def _grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


@dataclass
class LicenceModel:
    """Weights by n-gram and family (``families[0]`` is "unknown"), intercepts, and the least probability of a family."""

    families: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    least: float
    telling: set[str]

    @property
    def hints(self) -> list[str]:
        """Words of letters one of which every weighted n-gram holds."""
        words = {w for g in self.weights for w in g.split(" ")}
        return sorted(w for w in words if w in self.telling)


def train(other: list[str], seed: int = 3, rounds: int = 300, sparsity: float = 2e-3, per_notice: int = 24,
          most_words: int = 200) -> LicenceModel:
    """Proximal gradient with an L1 penalty. Notices are varied by dropping words and by words of other paragraphs around them.
    Of each of those the first ``most_words`` words count."""
    rng = np.random.default_rng(seed)
    families = ["unknown", *sorted(NOTICES)]
    background = [_words(t)[:most_words] for t in other]
    background = [b for b in background if b] or [["the", "a", "of"]]
    rows, labels = [], []
    for k, family in enumerate(families[1:], 1):
        for notice in NOTICES[family]:
            words = _words(notice)
            for v in range(per_notice):
                kept = [w for w in words if v < 4 or rng.random() > 0.12] or words
                near = background[rng.integers(len(background))]
                if v % 2:
                    kept = near[: rng.integers(0, 6)] + kept + near[-rng.integers(1, 6) :]
                rows.append(kept)
                labels.append(k)
    # Parts of notices that name no licence belong to unknown, as ordinary paragraphs do.
    vague = ["all rights reserved", "license", "licensed under", "version 2.0", "released under the terms", "public", "general terms",
             "free software", "copy of this work", "see the license file for details", "this work is licensed under the usual terms"]
    for b in [_words(v) for v in vague] * 6 + background:
        rows.append(b)
        labels.append(0)
    labels = np.array(labels)
    notice_words = {g for ns in NOTICES.values() for n in ns for g in _grams(_words(n))}
    common = {g for g in notice_words if sum(g in b for b in map(set, background)) > 0.002 * len(background)}
    # A pair counts through a word of letters that is not common, so that such words find all paragraphs with features.
    telling = {g for g in notice_words - common if " " not in g and g.isalpha()}
    names = sorted(telling | {g for g in notice_words - common if " " in g and set(g.split(" ")) & telling})
    at = {g: j for j, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, words in enumerate(rows):
        for g in _grams(words):
            if g in at:
                x[i, at[g]] = 1
    held = rng.random(len(rows)) < 0.25
    fit = ~held
    y = np.eye(len(families), dtype=np.float32)[labels]
    share = 1 / np.maximum(1, np.bincount(labels[fit], minlength=len(families)))
    weight = share[labels[fit]] / share[labels[fit]].sum()
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)

    def chances(x):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    rate = 2.0
    for _ in range(rounds):
        d = (chances(x[fit]) - y[fit]) * weight[:, None]
        w -= rate * (x[fit].T @ d)
        b -= rate * d.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity / len(families), 0)
    # Calibration: the least chance at which no held-out unknown paragraph passes for a family, from 0.3 up. Which of two
    # alike families a mutilated notice belongs to is left to the templates.
    top = chances(x[held])[:, 1:].max(axis=1)
    least = float(np.clip(top[labels[held] == 0].max(initial=0.0) + 0.02, 0.3, 0.9))
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    return LicenceModel(families, {names[j]: [round(float(v), 6) for v in w[j]] for j in used}, [float(v) for v in b], least, telling)


def background_sample(docs: DataFrame, text: str = "text", most_rows: int = 300, per_text: int = 40, most_paragraphs: int = 5000) -> list[str]:
    """Paragraphs of at most ``most_rows`` different texts, in an order of hashed texts, without words that name licences.

    At most ``per_text`` of a text and ``most_paragraphs`` in all, picked by a hash of paragraph and text. The bounds do not
    grow with the data; only training and calibration see the sample, the scan covers every paragraph.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), F.col(text).alias("t"))
    # Copies are one text: hashes are made distinct before the order and the bound, texts looked up afterwards.
    chosen = [tuple(r) for r in rows.select("h", "n").distinct().orderBy("h", "n").limit(most_rows).collect()]
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "h bigint, n int"))
    texts = {(r["h"], r["n"]): r["t"] for r in rows.join(wanted, ["h", "n"]).groupBy("h", "n").agg(F.min("t").alias("t")).collect()}
    parts = []
    for h, n in chosen:
        own = [p for p in re.split(_LINE, texts[h, n]) if p and not re.search(r"licen[sc]e|copyright|creative commons|spdx", p, re.I)]
        parts += sorted((xxhash.xxh64_intdigest(p.encode("utf-8", "ignore"), h & (1 << 64) - 1), p) for p in own)[:per_text]
    return [p for _, p in sorted(parts)[:most_paragraphs]]


_BLANK = r"(?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))+"  # atomic: a CR LF is one line end
_LINE = r"\r\n|\r|\n"
_BEFORE, _AFTER = 4, 8


def scan(docs: DataFrame, model: LicenceModel, text: str = "text", doc_id: str = "doc_id", overlap: float = 0.5) -> DataFrame:
    """(doc_id, paragraph, family, line, lines, probability, similarity, confirmed): the known families of every paragraph.

    Paragraphs are numbered from 0, as are their lines; ``lines`` is how many were joined for the reading that fits best.
    ``similarity`` is the largest share of a notice of the family, by n-grams, that this reading holds; ``confirmed`` from
    ``overlap`` up, if no notice of another family is held to a larger share. Null and empty texts have no paragraphs;
    rows that repeat a document whole give its notices once.
    """
    # Constant tables are single literals once folded, which keeps the plan small.
    strings = lambda names: F.split(F.lit("\t".join(names)), "\t")
    clean = lambda c: F.filter(F.transform(F.split(F.lower(c), _SPLIT), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")
    # A text, paragraph or line without a hint is unknown: skipping it changes nothing.
    hinted = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), strings(model.hints))
    pieces = docs.filter(F.col(text).isNotNull() & hinted(F.col(text)))
    pieces = pieces.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, _BLANK)).alias("paragraph", "block"))
    pieces = pieces.filter(hinted(F.col("block"))).withColumn("all", F.split("block", _LINE))
    pieces = pieces.select("doc_id", "copy", "paragraph", "all", F.posexplode("all").alias("line", "body")).filter(hinted(F.col("body")))
    start = F.greatest(F.col("line") - _BEFORE, F.lit(0))
    around = F.slice("all", start + 1, F.col("line") + _AFTER - start)
    readings = F.array(
        F.struct(F.col("line").alias("line"), F.lit(1).alias("lines"), F.col("body").alias("body")),
        F.struct(start.alias("line"), F.size(around).alias("lines"), F.array_join(around, " ").alias("body")))
    own = ("doc_id", "copy", "paragraph")
    pieces = pieces.select(*own, F.inline(readings)).filter((F.col("lines") == 1) | (F.length("body") > 0))
    keep = (*own, "line", "lines")
    # explode of a single array: a row as before, but later filters stay above it and compute nothing again.
    once = lambda c: F.explode(F.array(c))
    pieces = pieces.select(*keep, once(clean(F.col("body"))).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    pieces = pieces.select(*keep, once(F.array_distinct(F.concat("w", pairs))).alias("g"))
    names = sorted(model.weights)
    # Places of the weighted n-grams, then one sum of weights per family.
    places = F.transform(F.array_intersect("g", strings(names)), lambda g: F.array_position(strings(names), g).cast("int") - 1)
    table = F.from_json(F.lit(json.dumps([model.weights[g] for g in names])), "array<array<double>>")
    first = F.from_json(F.lit(json.dumps(model.intercepts)), "array<double>")
    added = lambda z, i: F.zip_with(z, F.get(table, i), lambda a, b: a + b)
    scored = pieces.select(*keep, "g", once(F.aggregate(places, first, added)).alias("z"))
    known = F.slice("z", 2, len(model.families) - 1)
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("z")))
    scored = scored.withColumns({
        "family": F.get(strings(model.families), F.array_position(known, F.array_max(known)).cast("int")),
        "probability": F.exp(F.array_max(known) - F.array_max("z")) / total, "above": F.array_max(known) > F.get("z", F.lit(0))})
    scored = scored.filter((F.col("probability") >= model.least) & F.col("above"))
    share = lambda notice: F.size(F.array_intersect("g", strings(_grams(_words(notice))))) / float(len(_grams(_words(notice))))
    fits = F.array(*(F.struct(F.greatest(*(share(n) for n in ns), F.lit(0.0)).alias("similarity"), F.lit(f).alias("family")) for f, ns in sorted(NOTICES.items())))
    scored = scored.select(*keep, "family", "probability", once(fits).alias("fits"))
    similarity = F.get(F.filter("fits", lambda x: x["family"] == F.col("family")), F.lit(0))["similarity"]
    best = F.array_max(F.transform("fits", lambda x: x["similarity"]))
    scored = scored.withColumns({"similarity": similarity, "confirmed": (similarity >= overlap) & (similarity >= best)})
    # The reading that fits best, of equal ones the shortest and first. A paragraph has few known families.
    chosen = F.max(F.struct("confirmed", "similarity", (-F.col("lines")).alias("short"), (-F.col("line")).alias("early"), "probability")).alias("b")
    found = scored.groupBy(*own, "family").agg(chosen)
    return found.select("doc_id", "paragraph", "family", (-F.col("b.early")).alias("line"), (-F.col("b.short")).alias("lines"),
                        F.col("b.probability").alias("probability"), F.col("b.similarity").alias("similarity"), F.col("b.confirmed").alias("confirmed"))
