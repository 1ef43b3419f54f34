"""License scans: a trained paragraph classifier, its predictions confirmed against templates.

The classifier reads lines with a word. Softmax regression over hashed word n-grams, sparse by an L1 step,
tells licence families, notices of licences unknown to it, and other text apart; a temperature fitted to
examples kept aside calibrates it. A family stands only if the line holds a template of it, or
has a part in one together with the lines around it up to a blank one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm import ngrams
from evidara.llm.runtime import ship, table

#: Notices by SPDX family, as public licences word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under the Creative Commons Attribution License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
}
#: Short identifiers of the families, as they stand in source files.
SPDX = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "GPL": ("GPL-2.0", "GPL-3.0"), "LGPL": ("LGPL-2.1", "LGPL-3.0"), "AGPL": ("AGPL-3.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "MPL-2.0": ("MPL-2.0",), "CC-BY": ("CC-BY-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",), "CC0": ("CC0-1.0",), "ISC": ("ISC",),
}
TEMPLATES = {f: (*n, *(f"SPDX-License-Identifier: {x}" for x in SPDX[f])) for f, n in TEMPLATES.items()}
#: Notices of no family, to which a made-up name is given.
UNKNOWN = (
    "Released under the {} License.", "Licensed under the {} License, version {}.", "This work is licensed under the {} Public License, version {}.",
    "Use of this software is governed by the {} licence agreement.", "All rights reserved under the terms of the {} license.",
    "SPDX-License-Identifier: {}-{}.0", "Licensed under {} {}.0.", "Copyright (c) {} {}.",
)

#: Words of notices: a line of the corpus with one may be a notice that no template holds, so it is no example of other text.
CUES = re.compile(r"licen[sc]e|spdx|copyright|\(c\)|©|\bcc[ -](by|0)|public domain|hereby granted|redistribut|warrant", re.I)
#: Lines that are notices whatever the classifier says of words it hasn't met.
NOTICE = re.compile(r"spdx-license-identifier|\blicen[sc]ed under\b|\breleased under the\b.*\blicen[sc]e\b|\bcopyright (\(c\)|©|\d{4})|\bcc[ -]by\b", re.I)

NONE, OTHER = "none", "unknown"
CLASSES = (NONE, OTHER, *TEMPLATES)
BITS = 18
ORDERS = ((0,), (0, 1), (0, 1, 2))
#: The sample that the classifier learns other text from: documents, lines in all, and bytes of those; lines are whole ones, drawn by a
#: hash wherever they stand. It bounds what is learned from, and nothing of what is scanned.
DOCUMENTS, LINES, LINE_BYTES = 2_000, 20_000, 32 << 20
EXAMPLES, STEPS, RATE, L1 = 120, 150, 0.5, 2e-4
SIMILARITY = 0.8
SURE = 0.5
#: The share of any class of notice that a paragraph needs, besides more than other text has.
LIKELY = 0.2


@dataclass
class Model:
    """Weights of features (ascending) by class, intercepts, and the temperature that log odds are divided by."""

    feature: np.ndarray
    weight: np.ndarray
    base: np.ndarray
    temperature: float = 1.0

    def log_odds(self, line: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(self.base, (n, 1))
        at = np.minimum(np.searchsorted(self.feature, found), max(len(self.feature) - 1, 0))
        if len(self.feature):
            hit = self.feature[at] == found
            line, found = ngrams.distinct(line[hit], at[hit], BITS)
            for c in range(out.shape[1]):
                out[:, c] += np.bincount(line, self.weight[found, c], n)
        return out / self.temperature


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where lines begin in documents that begin at offsets, and the end; every document has a line."""
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[1:][data == 10] = True
    cuts[offsets] = True
    cuts[-1] = True
    return np.flatnonzero(cuts)


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of texts that are each one paragraph: (text, feature) in pieces."""
    out, at = [], 0
    for data, offsets in ngrams.lowered(pa.array(texts, pa.string())):
        line, found = ngrams.grams(data, offsets, BITS, ORDERS)
        out.append((line + at, found))
        at += len(offsets) - 1
    return out


def examples(lines: list[str], seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Texts and classes to learn from: notices set in other text, made-up licences, other text with words of notices, and lines of the corpus.

    Lines of the corpus that hold a template are examples of its family, others without a word of notices of no licence.
    """
    draw = np.random.default_rng(seed)
    plain = [x.split() for x in lines if x.split()] or [["text"]]
    texts, classes = [], []

    def set_in(words: list[str]) -> str:
        before, after = (plain[draw.integers(len(plain))] for _ in range(2))
        a, b = draw.integers(0, 12, 2) * draw.integers(0, 2, 2)
        return " ".join([*before[:a], *words, *after[:b]])

    for family, notices in TEMPLATES.items():
        for k in range(EXAMPLES):
            texts.append(set_in(notices[k % len(notices)].split()))
            classes.append(CLASSES.index(family))
    # Long notices as they are wrapped: a line has a part of one.
    for family, notices in TEMPLATES.items():
        long = [w for w in (t.split() for t in notices) if len(w) > 12]
        for k in range(EXAMPLES // 2 if long else 0):
            words = long[k % len(long)]
            at = int(draw.integers(0, len(words) - 6))
            texts.append(" ".join(words[at : at + int(draw.integers(6, 13))]))
            classes.append(CLASSES.index(family))
    for k in range(3 * EXAMPLES):
        name = " ".join("".join(draw.choice(list("abcdefghilmnoprstuvz"), draw.integers(3, 9))).capitalize() for _ in range(draw.integers(1, 3)))
        texts.append(set_in(UNKNOWN[k % len(UNKNOWN)].format(name, draw.integers(1, 5)).split()))
        classes.append(CLASSES.index(OTHER))
    # Other text that shares a few words with notices, so that words alone don't make one.
    spoken = [w for n in (*TEMPLATES.values(), UNKNOWN) for t in n for w in t.split() if w not in ("{}", "{}.")]
    for _ in range(6 * EXAMPLES):
        some = list(draw.choice(spoken, draw.integers(0, 5)))
        words = list(plain[draw.integers(len(plain))][:12])
        for w in some:
            words.insert(int(draw.integers(0, len(words) + 1)), str(w))
        texts.append(" ".join(words))
        classes.append(CLASSES.index(NONE))
    for line in lines:
        share, family = surest(line)
        if share >= SIMILARITY or not CUES.search(line):
            texts.append(line)
            classes.append(CLASSES.index(family) if share >= SIMILARITY else 0)
    return texts, np.array(classes)


def triples(text: str) -> list[tuple[str, ...]]:
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []


def shingles(text: str) -> set[tuple[str, ...]]:
    return set(triples(text))


#: The words of the longest template.
LONGEST = max(len("".join(c if c.isalnum() else " " for c in t).split()) for n in TEMPLATES.values() for t in n)
FAMILIES = pa.list_(pa.struct([("family", pa.string()), ("line", pa.int32()), ("probability", pa.float64())]))

_shingles = {f: [shingles(t) for t in notices] for f, notices in TEMPLATES.items()}


def contained(text: str, family: str) -> float:
    """The largest share of a template's word triples that the text has, over the family's templates."""
    own = shingles(text)
    return max(len(own & t) / len(t) for t in _shingles[family])


def surest(text: str) -> tuple[float, str]:
    """The family of which the text holds the largest share of a template, of equals the longest template, and that share."""
    own = shingles(text)
    share, _, family = max((len(own & t) / len(t), len(t), f) for f, n in _shingles.items() for t in n)
    return share, family


def families_in(text: str) -> list[str]:
    """Every family of which the text holds a template, the surest first: word triples that one template has taken aren't another's, as often as they stand there."""
    own, out = Counter(triples(text)), []
    while +own:
        held = (+own).keys()
        share, _, family, k = max((len(held & t) / len(t), len(t), f, i) for f, n in _shingles.items() for i, t in enumerate(n))
        if share < SIMILARITY:
            break
        out.append(family)
        own -= Counter(_shingles[family][k])
    return list(dict.fromkeys(out))


def fit(lines: list[str]) -> Model:
    """The classifier, from the templates and lines of the corpus (which may be none)."""
    texts, y = examples(lines)
    pieces = grams(texts)
    line, found = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    line, found = ngrams.distinct(line, found, BITS)
    known = np.unique(np.concatenate([p[1] for p in grams([t for n in TEMPLATES.values() for t in n] + [u.replace("{}", "") for u in UNKNOWN])]))
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hit = known[at] == found
    line, at = line[hit], at[hit]
    aside = np.random.default_rng(9).random(len(texts)) < 0.25
    c = len(CLASSES)
    weight, base, seen, seen_base = np.zeros((len(known), c)), np.zeros(c), np.full((len(known), c), 1e-6), np.full(c, 1e-6)
    right = np.eye(c)[y]
    learn = np.flatnonzero(~aside[line])

    def odds() -> np.ndarray:
        out = np.tile(base, (len(texts), 1))
        for k in range(c):
            out[:, k] += np.bincount(line, weight[at, k], len(texts))
        return out

    share = (~aside)[:, None] / max(1, (~aside).sum())
    for _ in range(STEPS):
        slope = (softmax(odds()) - right) * share
        g = np.stack([np.bincount(at[learn], slope[line[learn], k], len(known)) for k in range(c)], axis=1)
        seen += g * g
        step = RATE / np.sqrt(seen)
        weight -= step * g
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * L1, 0)
        g = slope.sum(0)
        seen_base += g * g
        base -= RATE / np.sqrt(seen_base) * g
    out = odds()[aside]
    loss = [(-np.log(np.maximum(softmax(out / t)[np.arange(len(out)), y[aside]], 1e-12)).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)]
    used = np.abs(weight).sum(1) > 0
    return Model(known[used], weight[used], base, min(loss)[1])


def learn(docs: DataFrame, documents: int = DOCUMENTS, lines: int = LINES, most: int = LINE_BYTES) -> Model:
    """Fit on at most `lines` different lines of about `documents` documents, both drawn by hashes; on as many of them, in the order of their hash, as have `most` bytes.

    Lines are learned whole. An empty table, or one of null and empty texts, leaves the templates to learn from.
    """
    ship(docs.sparkSession)
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * min(1, documents / max(n, 1))))
    some = drawn.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) <> ''").distinct()
    first = some.withColumn("h", F.xxhash64("line")).orderBy("h", "line").limit(lines)
    # The bytes of the lines before each: at most `lines` rows.
    before = F.coalesce(F.sum(F.octet_length("line")).over(Window.orderBy("h", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = first.withColumn("before", before).where((F.col("before") + F.octet_length("line")) <= most).select("line").collect()
    return fit(sorted(r.line for r in got))


def scan(model: Model) -> Column:
    """For the column text: struct of family, probability, confirmed, line (from 0), lines that look like notices, and families.

    families: each confirmed family with its first line and its probability there, by line; a line may hold several.
    """

    @F.arrow_udf("struct<family: string, probability: double, confirmed: boolean, line: int, notices: int, families: array<struct<family: string, line: int, probability: double>>>")
    def scanned(text: pa.Array) -> pa.Array:
        seen = np.zeros(1 << BITS, dtype=bool)
        seen[model.feature] = True
        rows = []
        for data, offsets in ngrams.lowered(text):
            starts = lines_of(data, offsets)
            line, found = ngrams.grams(data, starts, BITS, ORDERS)
            hit = np.flatnonzero(seen[found])
            some, which = np.unique(line[hit], return_inverse=True)
            odds = softmax(model.log_odds(which, found[hit], len(some))) if len(some) else np.zeros((0, len(CLASSES)))
            doc = np.searchsorted(offsets, starts[some], "right") - 1
            home = np.searchsorted(offsets, starts, "right") - 1
            best: dict[int, tuple] = {}
            sure_lines: dict[int, dict[str, tuple[int, float]]] = {}

            def text_of(s: int, data: np.ndarray = data, starts: np.ndarray = starts) -> str:
                return data[starts[s] : starts[s + 1]].tobytes().decode("utf-8", "replace")

            def around(s: int, step: int, text_of: Callable[[int], str] = text_of, home: np.ndarray = home) -> str:
                """The lines of the paragraph before or after a line that a template may reach over."""
                got, n = [], 0
                k = s + step
                while n < LONGEST and 0 <= k < len(home) - 1 and home[k] == home[s]:
                    line = text_of(k)
                    words = sum(any(c.isalnum() for c in w) for w in line.split())
                    if not words:
                        break
                    got.append(line)
                    n += words
                    k += step
                return " ".join(got[::step])

            top = odds[:, 1:].max(axis=1, initial=0)
            likely = (odds[:, 0] < SURE) & (top > odds[:, 0]) & (top >= LIKELY)
            for i in np.flatnonzero(~likely):
                likely[i] = bool(NOTICE.search(data[starts[some[i]] : starts[some[i] + 1]].tobytes().decode("utf-8", "replace")))
            for i in np.flatnonzero(likely):
                d, s = int(doc[i]), int(some[i])
                own = text_of(s)
                k = int(np.argmax(odds[i, 1:])) + 1
                family, sure = CLASSES[k], False
                if family != OTHER:
                    sure = odds[i, k] >= SURE and contained(own, family) >= SIMILARITY
                if not sure:
                    share, family = surest(own)
                    if share < SIMILARITY:  # perhaps a notice that is wrapped over lines
                        before, after = around(s, -1), around(s, 1)
                        share, family = surest(f"{before} {own} {after}")
                        if share <= max(contained(before, family), contained(after, family)):
                            share = 0.0  # the notice of other lines
                    sure = share >= SIMILARITY
                    k = CLASSES.index(family if sure else OTHER)
                family = CLASSES[k]
                number = s - int(np.searchsorted(starts, offsets[d]))
                for f in dict.fromkeys([family, *families_in(own)]) if sure else ():
                    sure_lines.setdefault(d, {}).setdefault(f, (number, float(odds[i, CLASSES.index(f)])))
                held = best.get(d)
                n = held[1] + 1 if held else 1
                now = (sure, float(odds[i, k]), -number, family)
                best[d] = (max(now, held[0]) if held else now, n)
            for d in range(len(offsets) - 1):
                (sure, p, number, family), n = best.get(d, ((False, 0.0, 1, NONE), 0))
                rows.append({"family": family, "probability": p, "confirmed": bool(sure), "line": -number, "notices": n, "families": [{"family": f, "line": at, "probability": q} for f, (at, q) in sure_lines.get(d, {}).items()]})
        return pa.array(rows, pa.struct([("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("line", pa.int32()), ("notices", pa.int32()), ("families", FAMILIES)]))

    return scanned(F.col("text"))


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, family, probability, confirmed, line, notices, families), one for each of docs (doc_id, text).

    family: the surest confirmed family among the paragraphs, "unknown" if only unconfirmed notices are found,
    "none" (probability 0, line -1, notices 0) without any, as for null and empty texts. Repeated
    rows keep a row each; an empty table gives none.
    """
    model = model or learn(docs.select("text"))
    return docs.select("doc_id", scan(model).alias("s")).select("doc_id", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: licence notices in all documents."""
    return scanned(table(spark, sf_dir, "documents"))
