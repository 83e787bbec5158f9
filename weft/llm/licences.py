"""Licence scans: a paragraph classifier whose predictions templates confirm; DataFrame functions only on the main path."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by which licences are declared, as (family, text).
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Copyright. All rights reserved."),
)
#: Sentences that speak of licences or rights without declaring any, for the unknown class.
OTHERS = (
    "The driver lost his license after the accident.",
    "All seats in the front row are reserved for members.",
    "She was granted permission to leave the building.",
    "The rights of workers are the subject of public debate.",
    "Version 3 of the program was released in the summer.",
    "The foundation published a general report on free software.",
    "You may not use this entrance without permission.",
    "The terms of the agreement were subject to approval.",
)
#: The least share of a template's word pairs that a paragraph must have.
OVERLAP = 0.6
#: A notice is wrapped over parts with so many words at most between its first and its last one: half as many again as the longest has.
WRAPPED = 3 * max(len(re.findall("[A-Za-z0-9]+", t)) for _, t in NOTICES) // 2


def grams(text: str) -> list[str]:
    """Distinct words and pairs of adjacent words, of runs of a-z and 0-9 after A-Z became a-z."""
    w = _words(text)
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _pairs(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g}


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    anchors: tuple[str, ...]

    def probabilities(self, text: str) -> dict[str, float]:
        """The same as the columns of :func:`scan`, of one paragraph."""
        z = np.array(self.bias)
        for g in grams(text):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        e = np.exp((z - z.max()) / self.temperature)
        return dict(zip(self.classes, (e / e.sum()).tolist(), strict=True))


def _examples(seed: int, n: int) -> list[tuple[str, str]]:
    """Notices with words lost, added before and after, or run together with others; and paragraphs without one."""
    r = random.Random(seed)
    common = sorted({w for _, t in NOTICES for w in _words(t)} | {w for t in OTHERS for w in _words(t)})
    filler = ["".join(r.choice("aeinrstlou") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda low, high: [r.choice(filler) for _ in range(r.randint(low, high))]
    out = list(NOTICES)
    for _ in range(n):
        family, text = r.choice(NOTICES)
        w = [x for x in _words(text) if r.random() > r.choice((0, 0, 0.05))]
        out.append((family, " ".join([*say(0, 6), *w, *say(0, 12)])))
        kind = r.random()
        if kind < 0.3:
            out.append((UNKNOWN, " ".join(say(1, 40))))
        elif kind < 0.6:
            out.append((UNKNOWN, " ".join([*say(0, 5), *_words(r.choice(OTHERS)), *say(0, 15)])))
        else:
            w = r.sample(common, r.randint(1, 12)) + say(0, 20)
            r.shuffle(w)
            out.append((UNKNOWN, " ".join(w)))
    return out


def _anchors() -> tuple[str, ...]:
    """Words of six letters or more, and pairs, one of which is in every paragraph with a share OVERLAP of some notice's pairs.

    For each notice those chosen are in more of its pairs than a paragraph with that share can lack.
    """
    often: dict[str, int] = {}
    for _, t in NOTICES:
        for w in set(_words(t)):
            often[w] = often.get(w, 0) + 1
    chosen: set[str] = set()
    for _, t in sorted(NOTICES, key=lambda x: (len(x[1]), x[1])):
        pairs = sorted(_pairs(t))
        left = [p for p in pairs if p not in chosen and not chosen & set(p.split())]
        while len(pairs) - len(left) <= (1 - OVERLAP) * len(pairs):
            words = [w for p in left for w in p.split() if len(w) >= 6]
            new = max(words, key=lambda w: (words.count(w), often[w], len(w), w)) if words else max(left, key=lambda p: (len(p), p))
            chosen.add(new)
            left = [p for p in left if p != new and new not in p.split()]
    return tuple(sorted(chosen))


@lru_cache(maxsize=1)
def fitted(seed: int = 17, n: int = 1500, rounds: int = 250, ridge: float = 1e-4) -> Model:
    """Multinomial logistic regression on made-up examples of the notices; its temperature is set on others than it was fitted on."""
    classes = (*sorted({f for f, _ in NOTICES}), UNKNOWN)
    vocab = {g: i for i, g in enumerate(sorted({g for _, t in NOTICES for g in grams(t)} | {g for t in OTHERS for g in grams(t)}))}

    def matrix(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocab) + 1))
        x[:, -1] = 1
        for i, (_, t) in enumerate(rows):
            x[i, [vocab[g] for g in grams(t) if g in vocab]] = 1
        return x, np.array([classes.index(f) for f, _ in rows])

    x, y = matrix(_examples(seed, n))
    target = np.eye(len(classes))[y]
    w, speed = np.zeros((x.shape[1], len(classes))), np.zeros((x.shape[1], len(classes)))
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.8 * (x.T @ (p - target) / len(x) + ridge * w)
        w += speed
    z, y = (lambda m: (m[0] @ w, m[1]))(matrix(_examples(seed + 1, n // 2)))

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    temperature = min((0.3 * 1.1**k for k in range(30)), key=loss)
    weights = {g: tuple(float(v) for v in w[i]) for g, i in vocab.items()}
    return Model(classes, weights, tuple(float(v) for v in w[-1]), float(temperature), _anchors())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", least: float = 0.5, model: Model | None = None) -> DataFrame:
    """(id_col, paragraph, family, probability, overlap): the paragraphs that declare a licence.

    Paragraphs are the parts of the text between separators (a regular
    expression), numbered from 0. Words and word pairs of each are weighed by the classifier;
    the most likely family counts if its calibrated probability is ``least`` or more, it isn't the
    unknown class, and the paragraph has a share OVERLAP of the word pairs of one of that family's
    notices; ``overlap`` is the greatest share. Only paragraphs with an anchor word, without which
    that share can't be reached, are weighed at all. A notice may be wrapped: runs of adjacent parts, none of them
    without words and with at most ``WRAPPED`` words between the first and the last, are weighed like a paragraph. Where runs of one family
    intersect, the greatest overlap counts, in the fewest parts, under the number of its first part; none counts that meets
    a part which counts by itself. The model is a table of about a
    thousand word pairs, whatever the input. Null and empty texts declare
    nothing; null ids stay null; repeated rows are reported once; other columns are not read.
    """
    m = model or fitted()
    spark = docs.sparkSession
    rows = [(g, c, -1, float(x)) for g, w in m.weights.items() for c, x in zip(m.classes, w, strict=True)]
    rows += [(g, f, i, 1.0 / len(p)) for i, (f, p) in enumerate((f, _pairs(t)) for f, t in NOTICES) for g in sorted(p)]
    table = F.broadcast(spark.createDataFrame(rows, "gram string, family string, notice int, x double").coalesce(1))
    bias = F.create_map(*[F.lit(x) for c, b in zip(m.classes, m.bias, strict=True) for x in (c, b)])
    found = F.lit("(?i)" + "|".join(a.replace(" ", "[^a-z0-9]+") for a in m.anchors))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.rlike("text", found))
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda x: F.regexp_extract_all(lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    parts = text.select("id", F.xxhash64("text").alias("line"), F.transform(F.split("text", separator), words).alias("parts"))
    # Each part goes on with the beginnings of the few after it that a run can reach, not with the whole text.
    ahead = lambda k: F.transform(F.slice("parts", k + 2, WRAPPED + 2), lambda y: F.slice(y, 1, WRAPPED + 1))
    near = F.transform("parts", lambda x, k: F.struct(k.alias("paragraph"), x.alias("here"), ahead(k).alias("next")))
    parts = parts.select("id", "line", F.explode(near).alias("x")).select("id", "line", "x.*").where(F.size("here") > 0)
    tail = F.slice("here", F.greatest(F.size("here") - WRAPPED + 1, F.lit(1)), WRAPPED)
    around = F.array_join(F.concat(tail, F.flatten("next")), " ")
    parts = parts.where(F.rlike(F.array_join("here", " "), found) | F.rlike(around, found))

    def further(run, part):
        stop = (F.size(part) == 0) | (run["between"] > WRAPPED) | run["ended"]
        ends = F.when(stop, run["ends"]).otherwise(run["ends"] + 1)
        return F.struct(ends.alias("ends"), (run["between"] + F.size(part)).alias("between"), stop.alias("ended"))

    start = F.struct(F.lit(0).alias("ends"), F.lit(0).alias("between"), F.lit(False).alias("ended"))
    reach = F.aggregate("next", start, further, lambda run: run["ends"])
    parts = parts.select("id", "line", "here", "next", "paragraph", F.explode(F.sequence(F.lit(0), reach)).alias("more"))
    run = F.concat(tail, F.flatten(F.slice("next", 1, F.greatest(F.col("more") - 1, F.lit(0)))), F.slice(F.get("next", F.col("more") - 1), 1, WRAPPED))
    par = parts.select("id", "line", "paragraph", "more", F.when(F.col("more") == 0, F.col("here")).otherwise(run).alias("words"))
    par = par.where(F.rlike(F.array_join("words", " "), found))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    each = par.select("id", "paragraph", "more", "line", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram")).distinct()
    at = ["id", "paragraph", "more", "line"]
    sums = each.join(table, "gram").groupBy(*at, "family", "notice").agg(F.sum("x").alias("x"))
    own = F.col("notice") < 0
    families = sums.groupBy(*at, "family").agg(
        ((F.sum(F.when(own, F.col("x")).otherwise(0.0)) + bias[F.col("family")]) / m.temperature).alias("z"),
        F.coalesce(F.max(F.when(~own, F.col("x"))), F.lit(0.0)).alias("overlap"),
    )
    best = families.groupBy(*at).agg(F.collect_list("z").alias("zs"), F.max(F.struct("z", "family", "overlap")).alias("best"))
    total = F.aggregate("zs", F.lit(0.0), lambda t, z: t + F.exp(z - F.col("best.z")))
    out = best.select(
        "id", "line", F.col("paragraph").cast("long").alias("paragraph"), (F.col("paragraph") + F.col("more")).alias("end"), "more", "best.family",
        F.round(1 / total, 6).alias("probability"), F.round("best.overlap", 6).alias("overlap"),
    )
    out = out.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least) & (F.col("overlap") >= OVERLAP))
    # Runs that can meet a run begin within its reach, so each is compared with those only, however many a text has.
    reached = Window.partitionBy("id", "line", "family").orderBy("paragraph").rangeBetween(-WRAPPED - 3, WRAPPED + 3)
    one = F.struct("paragraph", "end", "more", "probability", "overlap")
    inside = lambda y: (y["more"] < F.col("more")) & (y["paragraph"] >= F.col("paragraph")) & (y["end"] <= F.col("end"))
    loose = lambda near: F.exists(near, lambda y: inside(y) & ((y["more"] == 0) | (y["overlap"] >= F.col("overlap"))))
    alone = F.min(F.when(F.col("more") == 0, F.col("paragraph"))).over(Window.partitionBy("id", "line", "family").orderBy("paragraph").rangeBetween(0, WRAPPED + 3))
    out = out.withColumn("alone", alone).where((F.col("more") == 0) | F.col("alone").isNull() | (F.col("alone") > F.col("end"))).drop("alone")
    out = out.withColumn("near", F.collect_list(one).over(reached)).where((F.col("more") == 0) | ~loose("near")).drop("near")
    rank = lambda more, overlap, paragraph: F.struct((more == 0).alias("alone"), overlap.alias("overlap"), (-more).alias("short"), (-paragraph).alias("early"))
    mine = rank(F.col("more"), F.col("overlap"), F.col("paragraph"))
    meets = lambda y: (y["paragraph"] <= F.col("end")) & (F.col("paragraph") <= y["end"])
    beaten = lambda near: F.exists(near, lambda y: meets(y) & (rank(y["more"], y["overlap"], y["paragraph"]) > mine))
    out = out.withColumn("near", F.collect_list(one).over(reached)).where((F.col("more") == 0) | ~beaten("near"))
    return out.select(F.col("id").alias(id_col), "paragraph", "family", "probability", "overlap")
