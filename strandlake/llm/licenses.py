"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is what lies between blank lines; its lines are joined, so a notice may be wrapped. Long
ones are looked at in windows of ``WIDTH`` words, each ``STEP`` after the one before, so that a notice
of up to ``WIDTH - STEP`` words lies in one of them whole. Features are hashed word pairs and triples; a
softmax over the licence families and ``none`` has a sparse weight for each. It is fitted on variants
of the families' notices (``NOTICES``: words dropped, words of other text put before and after)
against a bounded sample of the table's own windows (``MAX_WINDOWS`` of ``MAX_DOCS`` documents, the first by a
hash; those that hold a notice are left out).

Calibration: variants kept aside set the temperature of the softmax (least log loss). Then the model is
fitted anew without some of the families at a time, in ``FOLDS``; the least chance that names a family (``sure``) is
the one that best parts the left-out families' notices, which must stay unnamed, from those of families that the
model knows. (Left out one family at a time, 7 of the 24 notices get another's name, most of them of
siblings such as gpl and lgpl, against 20 without ``sure``.) A window is of a family if its chance is ``sure`` or more, and ``unknown`` if ``none`` is below one half but no
family reaches that.

A prediction is confirmed when the window holds ``CONFIRM`` of the word pairs of one of the family's
notices. Of windows that overlap, an unconfirmed one doesn't count beside a confirmed one, nor an
unknown one beside one of a family; neighbours of one family are one passage.

Scoring is DataFrame functions only: words' features are looked up in the model's (a literal set, at
most ``MOST_FEATURES`` and the notices' pairs), and only those found become rows, so plain text costs one scan and is
never joined. Windows without a feature of the model are ``none``.

Defined cases: a null text counts as empty, with one empty paragraph; repeated rows each get their
result; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import joined, let, staged, text_or_empty

MAX_WINDOWS, MAX_DOCS, MOST_FEATURES, CONFIRM, SEED = 4000, 400, 2000, 0.6, 17
WIDTH, STEP, FOLDS, LONG_WORD = 64, 32, 4, 40
NOT_WORD, BLANK = "[^a-z0-9]+", r"\n[ \t\r\f]*\n\s*"
# Usual short notices of each family.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced or distributed without prior written permission.", "All rights reserved."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under CC0 1.0."],
}
FAMILIES = sorted(NOTICES)


def _words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def _hash(parts: list[str]) -> int:
    """What Spark's xxhash64 of the strings gives."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def features(words: list[str]) -> list[int]:
    return sorted({_hash(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)})


def _pairs() -> dict[tuple[str, int], list[int]]:
    """The word pairs of every notice, by family and number."""
    return {(f, i): sorted({_hash(list(p)) for p in zip(n, n[1:], strict=False)}) for f, ns in NOTICES.items() for i, n in enumerate(map(_words, ns))}


@dataclass
class Model:
    names: list[int]
    weights: np.ndarray  # features x (families + none), already divided by the temperature
    bias: np.ndarray
    sure: float

    def chances(self, words: list[str]) -> np.ndarray:
        """Of the families and ``none``, for one window."""
        at = {f: i for i, f in enumerate(self.names)}
        z = self.bias + sum((self.weights[at[f]] for f in features(words) if f in at), np.zeros(len(self.bias)))
        p = np.exp(z - z.max())
        return p / p.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


class _Sparse:
    """Rows of features as one list of (row, feature), by row and by feature."""

    def __init__(self, rows: list[list[int]], names: list[int]):
        at = {f: i for i, f in enumerate(names)}
        own = [[at[f] for f in fs if f in at] for fs in rows]
        self.size = len(rows)
        self.r = np.repeat(np.arange(len(rows)), [len(x) for x in own])
        self.c = np.array([i for x in own for i in x], np.int64)
        self.by = np.argsort(self.c, kind="stable")
        self.row_ids, self.row_at = np.unique(self.r, return_index=True)
        self.col_ids, self.col_at = np.unique(self.c[self.by], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, w.shape[1]))
        if len(self.r):
            out[self.row_ids] = np.add.reduceat(w[self.c], self.row_at)
        return out

    def turned(self, d: np.ndarray, features_: int) -> np.ndarray:
        out = np.zeros((features_, d.shape[1]))
        if len(self.c):
            out[self.col_ids] = np.add.reduceat(d[self.r[self.by]], self.col_at)
        return out


def _solved(rows: list[list[int]], y: np.ndarray, names: list[int], steps: int = 200, rate: float = 0.3, l1: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the softmax, by proximal Adam. A class without rows gets no chance."""
    alike: dict[tuple, int] = {}  # rows that agree in class and features, as plain ones do, are one
    known = set(names)
    for fs, k in zip(rows, y.tolist(), strict=True):
        own = (k, *[f for f in fs if f in known])
        alike[own] = alike.get(own, 0) + 1
    share = np.array(list(alike.values()))[:, None] / len(rows)
    x, classes = _Sparse([list(r[1:]) for r in alike], names), len(FAMILIES) + 1
    n = len(names)
    w, b, hot = np.zeros((n, classes)), np.zeros(classes), np.eye(classes)[[r[0] for r in alike]]
    m, v = np.zeros((n + 1, classes)), np.zeros((n + 1, classes))
    for t in range(1, steps + 1):
        d = (_softmax(x.times(w) + b) - hot) * share
        g = np.vstack([x.turned(d, n), d.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


def _names(rows: list[list[int]], y: np.ndarray) -> list[int]:
    """Only what notices have several times over; ties by the hash."""
    seen: dict[int, int] = {}
    for fs, k in zip(rows, y, strict=True):
        if k < len(FAMILIES):
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    return sorted(sorted((f for f in seen if seen[f] >= 8), key=lambda f: (-seen[f], f))[:MOST_FEATURES])


def fit(windows: list[list[str]]) -> Model:
    """The model from the notices and plain windows of words; the same for the same windows."""
    rng = np.random.default_rng(SEED)
    pairs = [set(p) for p in _pairs().values()]
    own = [(w, set(features(w))) for w in windows if w]
    plain = [w for w, fs in own if not any(len(p & fs) >= CONFIRM * len(p) for p in pairs)]
    pool = [x for w in plain[:500] for x in w] or ["text"]
    rows, y = [], []
    for k, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            own_words = _words(notice)
            for i in range(60):
                kept = [w for w in own_words if i == 0 or rng.random() > 0.08]
                side = lambda: [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 25))] if i % 3 else []  # noqa: B023, E731
                rows.append(side() + kept + side())
                y.append(k)
    rows += plain
    y += [len(FAMILIES)] * len(plain)
    order = rng.permutation(len(rows))
    x, y = [features(rows[i]) for i in order], np.array(y)[order]
    told = {f for fs, k in zip(x, y, strict=True) if k < len(FAMILIES) for f in fs}
    x = [[f for f in fs if f in told] for fs in x]
    cut = len(x) * 4 // 5
    names = _names(x, y)
    w, b = _solved(x[:cut], y[:cut], names)
    z, aside = _Sparse(x[cut:], names).times(w) + b, y[cut:]

    def loss(t: float) -> float:
        return float(-np.log(_softmax(z / t)[np.arange(len(z)), aside] + 1e-300).mean())

    t = min((2.0 ** (i / 4) for i in range(-8, 17)), key=loss) if len(z) else 1.0
    on = (w != 0).any(axis=1)
    return Model([f for f, k in zip(names, on, strict=True) if k], w[on] / t, b / t, _sure(x, y, cut, t))


def _sure(x: list[list[int]], y: np.ndarray, cut: int, t: float) -> float:
    """The least chance that names a family: it best parts families that a model doesn't know from those it does."""
    none, known, new = len(FAMILIES), [], []
    for fold in range(FOLDS):
        out = np.isin(y, range(fold, none, FOLDS))
        inside = [i for i in range(cut) if not out[i]]
        names = _names([x[i] for i in inside], y[inside])
        w, b = _solved([x[i] for i in inside], y[inside], names)
        b[fold:none:FOLDS] = -1e3
        for rows, into in (([i for i in range(len(x)) if out[i]], new), ([i for i in range(cut, len(x)) if not out[i] and y[i] < none], known)):
            p = _softmax((_Sparse([x[i] for i in rows], names).times(w) + b) / t)
            best = p[:, :none].argmax(axis=1)
            # of a new family any name is wrong; of a known one another name is
            into += [(p[k, none] < 0.5) * p[k, best[k]] * (1 if into is new or best[k] == y[i] else 0) for k, i in enumerate(rows)]
    known, new = np.array(known), np.array(new)
    grid = [i / 20 for i in range(8, 20)]
    return max(grid, key=lambda s: ((known >= s).mean() if len(known) else 1) - ((new >= s).mean() if len(new) else 0))


def _blocks(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), BLANK), lambda b: F.array_remove(F.split(b, NOT_WORD), ""))


def _last(n: Column) -> Column:
    """Number of the last window of n words, from 0."""
    return F.when(n > WIDTH, F.ceil((n - WIDTH) / STEP)).otherwise(0).cast("int")


def train(docs: DataFrame) -> Model:
    """Fits on windows of ``MAX_DOCS`` documents of ``docs`` (words of over ``LONG_WORD`` letters as one) and the notices."""
    order = F.xxhash64("doc_id", F.lit(5))
    # ids alone are ranked; texts are only taken of the few that are chosen
    ids = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_DOCS)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    blocks = some.select(F.explode(_blocks(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    blocks = blocks.select(F.transform("w", lambda x: F.when(F.length(x) > LONG_WORD, "long").otherwise(x)).alias("w"))
    cut = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), _last(F.size(w))), lambda j: F.slice(w, j * STEP + 1, WIDTH)))
    windows = blocks.select(F.explode(cut).alias("w")).orderBy(F.xxhash64("w"), "w").limit(MAX_WINDOWS)
    return fit([r["w"] for r in windows.collect()])


def _found(text: Column, known: list[int]) -> Column:
    """struct(n, ps): how many paragraphs, and of those with known features their number, how many words they have,
    and the features' hashes with the first and last window that holds them."""

    def hits(w: Column) -> Column:
        n, parts = F.size(w), []
        for k in (2, 3):
            places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
            every = F.transform(places, lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))  # noqa: B023
            first = lambda i: F.greatest(F.ceil((i + k - WIDTH) / STEP), F.lit(0)).cast("int")  # noqa: B023, E731
            last = lambda i: F.least(F.floor(i / STEP).cast("int"), _last(n))
            some = lambda hs: F.transform(F.filter(places, lambda i: hs[i].isin(known)), lambda i: F.struct(hs[i].alias("h"), first(i).alias("a"), last(i).alias("z")))  # noqa: B023, E731
            parts.append(let(every, some))
        return F.array_distinct(F.concat(*parts))

    blocks = F.transform(_blocks(text), lambda w, i: F.struct(i.alias("paragraph"), hits(w).alias("f")))
    return let(blocks, lambda b: F.struct(F.size(b).cast("long").alias("n"), F.filter(b, lambda p: F.size(p["f"]) > 0).alias("ps")))


def _scored(found: DataFrame, model: Model) -> DataFrame:
    """found (row, ps; one row a text) -> row, paragraph, window, family, chance, confirmed of windows that aren't ``none``."""
    pairs, k = _pairs(), len(FAMILIES) + 1
    each = found.select("row", F.explode("ps").alias("p")).select("row", "p.paragraph", F.explode("p.f").alias("f"))
    each = each.select("row", "paragraph", "f.h", F.explode(F.sequence("f.a", "f.z")).alias("window")).distinct()
    weights = each.sparkSession.createDataFrame([(n, [float(x) for x in ws]) for n, ws in zip(model.names, model.weights, strict=True)] or [(0, [0.0] * k)], "h long, w array<double>")
    met = each.join(F.broadcast(weights), "h", "left")
    # weights are added up as whole numbers, so that sums don't depend on the order
    part = lambda i: F.coalesce(F.sum(F.round(F.col("w")[i] * 1e9).cast("long")), F.lit(0)) / 1e9 + float(model.bias[i])
    sums = met.groupBy("row", "paragraph", "window").agg(F.collect_set("h").alias("f"), *[part(i).alias(f"z{i}") for i in range(k)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(k)])
    shares = [F.exp(F.col(f"z{i}") - top) for i in range(k)]
    total = sum(shares[1:], shares[0])
    best = F.array_max(F.array(*[F.struct((shares[i] / total).alias("p"), F.lit(FAMILIES[i]).alias("family")) for i in range(k - 1)]))
    scored = sums.select("row", "paragraph", "window", "f", best.alias("b"), (shares[k - 1] / total).alias("none"))

    def confirmed(family: Column) -> Column:
        tests = [(family == f) & (F.size(F.array_intersect(F.col("f"), F.array(*[F.lit(h) for h in hs]))) >= CONFIRM * len(hs)) for (f, _), hs in pairs.items() if hs]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    named = F.when(F.col("b.p") >= model.sure, F.col("b.family")).otherwise("unknown")
    picked = scored.filter("none < 0.5").select("row", "paragraph", "window", named.alias("family"), F.col("b.p").alias("chance"), confirmed(F.col("b.family")).alias("confirmed"))
    return picked.withColumn("confirmed", F.col("confirmed") & (F.col("family") != "unknown"))


def passages(found: DataFrame, model: Model) -> DataFrame:
    """found (row, ps; one row a text) -> row, family, chance, confirmed of every licence passage."""
    # windows of one paragraph, in order: they are few, as plain ones have no row
    w = Window.partitionBy("row", "paragraph").orderBy("window")
    rank = F.when(F.col("confirmed"), 2).when(F.col("family") != "unknown", 1).otherwise(0)
    beside = lambda step: F.when(F.abs(F.lag("window", step).over(w) - F.col("window")) == 1, F.lag("rank", step).over(w))
    ranked = _scored(found, model).withColumn("rank", rank)
    ranked = ranked.withColumn("more", F.coalesce(F.greatest(beside(1), beside(-1)), F.lit(0)))
    # what a neighbour shows better doesn't count: unconfirmed beside confirmed, unknown beside named
    kept = ranked.filter((F.col("rank") == 2) | (F.col("more") <= F.col("rank")))
    new = F.coalesce((F.lag("family").over(w) != F.col("family")) | (F.lag("window").over(w) != F.col("window") - 1), F.lit(True))
    runs = kept.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    return runs.groupBy("row", "paragraph", "run").agg(F.first("family").alias("family"), F.max("chance").alias("chance"), F.max("confirmed").alias("confirmed")).drop("run", "paragraph")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_licence, n_confirmed, families (sorted, comma-joined) and chance (the
    greatest) for every row of ``docs``. Equal texts are looked at once."""
    known = sorted({*model.names, *[h for hs in _pairs().values() for h in hs]})
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("s", _found(F.col("text"), known))
    rows = rows.select("doc_id", F.col("s.n").alias("n_paragraphs"), F.when(F.size("s.ps") > 0, F.sha2("text", 256)).alias("row"), "s.ps")
    rows = staged(rows, "licences")
    some = rows.filter(F.col("row").isNotNull())
    per = staged(passages(some.select("row", "ps").dropDuplicates(["row"]), model).groupBy("row").agg(
        F.count("*").alias("n_licence"), F.count_if("confirmed").alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("chance").alias("chance")), "passages")
    met = joined(some.select("doc_id", "n_paragraphs", "row"), per, ["row"], "left")
    zero, none = F.lit(0).cast("long"), [F.lit(None).cast(t) for t in ("long", "long", "string", "double")]
    plain = rows.filter(F.col("row").isNull()).select("doc_id", "n_paragraphs", *[x.alias(c) for x, c in zip(none, ("n_licence", "n_confirmed", "families", "chance"), strict=True)])
    out = met.drop("row").unionByName(plain)
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("chance", F.lit(0.0)).alias("chance"))
