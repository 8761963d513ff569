"""Licence scan: paragraphs are classified into licence families, on DataFrame operations only.

A sparse multinomial logistic regression over word n-grams is trained on two kinds of paragraphs: variants of
known notices (words left out, other numbers, words of ordinary text around them), and ordinary
paragraphs of the corpus for the class ``unknown``. A prediction counts only if most of a notice's words are
there, so a paragraph without any of the ``anchors`` is dropped by plain substring tests. The temperature
of the scores is fitted on paragraphs held back. A prediction counts once the notice of its family
confirms it: most of the notice's words must be there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import keep

#: Usual short notices by family.
NOTICES = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc": ("Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-only"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "mozilla": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
UNKNOWN = "unknown"
FAMILIES = (*sorted(NOTICES), UNKNOWN)
#: words that tell a notice from other text: lines with one of them are always candidates
ANCHORS = ("licen", "redistribut", "free of charge", "free software")
#: usual words that tell little: a notice is recognised by its others
COMMON = frozenset("0 a and any are as be by following for from in is it met not of or person provided s that the this to under use v with without work you".split())
#: ordinary paragraphs used for training, at most: those with the smallest hash
TRAIN_PARAGRAPHS = 4_000
VARIANTS = 60
CONFIRM = 0.6


def words(col: Column) -> Column:
    """Lower-cased words; numbers become one sign, so versions do not matter."""
    return F.filter(F.split(F.regexp_replace(F.lower(col), "[0-9]+(?:[.][0-9]+)*", "0"), "[^\\p{L}0-9]+"), lambda w: w != "")


def ngrams(w: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, pairs))


def anchors(confirm: float) -> list[str]:
    """Substrings of which every confirmed paragraph holds one.

    A notice's telling words are taken until fewer are left than a confirmed paragraph shares with it, so a paragraph
    without all of them cannot reach ``confirm``. Words are compared as parts of the text, which finds them all.
    """
    found = set(ANCHORS)
    for own in _notice_words():
        telling = sorted((w for w in own if w != "0"), key=lambda w: (not any(a in w for a in ANCHORS), w in COMMON, -len(w), w))
        excess = len(own) - max(math.ceil(confirm * len(own) - 1e-9), 1) + 1
        # 0 stands for any number
        found.update(telling[:excess] if excess <= len(telling) else [*telling, *"0123456789"])
    return sorted(w for w in found if not any(v != w and v in w for v in found))


def _notice_words() -> list[list[str]]:
    """Distinct words of every notice, as ``words`` gives them; notices are plain ASCII."""
    plain = [re.sub("[0-9]+(?:[.][0-9]+)*", "0", t.lower()) for ts in NOTICES.values() for t in ts]
    return [list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", t) if w)) for t in plain]


def _holds(c: str, parts: Sequence[str]) -> Column:
    low = F.lower(F.col(c))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in parts])


def paragraphs(docs: DataFrame, id_col: str, text_col: str, confirm: float = CONFIRM) -> DataFrame:
    """(id, paragraph, body) of the lines that may be notices: those with one of ``ANCHORS``, and all that share enough words
    with a notice to be confirmed. Any other line cannot be confirmed and is left out."""
    held = anchors(confirm)
    lines = docs.where(_holds(text_col, held)).select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "body"))
    lines = lines.where(_holds("body", held)).withColumn("w", F.when(~_holds("body", ANCHORS), words(F.col("body"))))
    shared = [F.size(F.array_intersect(F.array(*[F.lit(w) for w in own]), "w")) >= max(math.ceil(confirm * len(own) - 1e-9), 1) for own in _notice_words()]
    return lines.where(F.col("w").isNull() | reduce(lambda a, b: a | b, shared)).drop("w")


class Model(NamedTuple):
    vocabulary: list[str]
    weights: list[list[float]]  # one row per family
    intercepts: list[float]
    temperature: float


def _variants(spark: SparkSession) -> DataFrame:
    """(family, w): the notices, and copies with every word left out by the chance of a hash."""
    notices = [(f, t) for f, ts in NOTICES.items() for t in ts]
    df = spark.createDataFrame(notices, "family string, text string").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    df = df.withColumn("w", words(F.col("text")))
    keep_word = F.filter("w", lambda x, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(F.col("text"), F.col("v"), i), F.lit(100)) >= F.pmod(F.col("v"), F.lit(5)) * 8))
    return df.select("family", "v", keep_word.alias("w")).where(F.size("w") > 1)


def fit(docs: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_PARAGRAPHS, folds: int = 5) -> Model:
    """Train on notices and on at most ``rows`` paragraphs of the corpus that hold no anchor."""
    spark = docs.sparkSession
    known = _variants(spark)
    low = F.lower("body")
    plain = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text")).orderBy("h").limit(rows).repartition(32, "h")
    plain = plain.select("h", F.explode(F.slice(F.split("text", "\n"), 1, 3)).alias("body")).where(~low.contains("licen") & (F.length("body") > 0))
    # every other ordinary paragraph also talks about a licence, without being a notice
    talk = F.when(F.pmod("h", F.lit(2)) == 0, F.concat_ws(" ", "body", F.lit("license"))).otherwise(F.col("body"))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), F.pmod("h", F.lit(1000)).cast("int").alias("v"), words(F.substring(talk, -300, 300)).alias("w"))
    vocabulary = [r.g for r in known.where("v = 0").select(F.explode(ngrams(F.col("w"))).alias("g")).distinct().orderBy("g").collect()]
    literal = F.array(*[F.lit(g) for g in vocabulary])
    # dealt out once n-grams are known, so that they are not worked out again for every word of the vocabulary
    data = known.unionByName(plain).withColumn("g", ngrams(F.col("w"))).repartition(32, "g")
    data = data.withColumn("x", F.transform(literal, lambda g: F.array_contains("g", g).cast("double")))
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    data = keep(data.select(label.alias("label"), "x", (F.pmod(F.col("v"), F.lit(folds)) == folds - 1).alias("held")))
    lr = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, featuresCol="features", labelCol="label", standardization=False)
    fitted = lr.fit(data.where("not held").select("label", array_to_vector("x").alias("features")))
    model = Model(vocabulary, fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist(), 1.0)
    logits = data.where("held").select("label", F.array(*[_dot(F.col("x"), w) + b for w, b in zip(model.weights, model.intercepts)]).alias("z"))
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    losses = logits.agg(*[F.avg(-F.log(F.greatest(F.element_at(_softmax(F.col("z"), t), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    best = min(range(len(grid)), key=lambda i: (losses[i] if losses[i] is not None else 0, grid[i]))
    return model._replace(temperature=grid[best])


def _dot(x: Column, w: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _softmax(z: Column, t: float) -> Column:
    e = F.transform(z, lambda v: F.exp((v - F.array_max(z)) / t))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def scan(docs: DataFrame, id_col: str, text_col: str, model: Model, confirm: float = CONFIRM) -> DataFrame:
    """(id, paragraph, body, family, probability, overlap, confirmed) of every paragraph that may be a notice.

    ``unknown`` is a family like the others. Null and empty texts have no paragraphs.
    """
    # n-grams without weight take no part
    live = [(g, [w[i] for w in model.weights]) for i, g in enumerate(model.vocabulary) if any(abs(w[i]) > 1e-9 for w in model.weights)]
    table = F.create_map(*[c for g, w in live for c in (F.lit(g), F.array(*[F.lit(float(v)) for v in w]))]) if live else F.create_map(F.lit(""), F.array(*[F.lit(0.0)] * len(FAMILIES)))
    start = F.array(*[F.lit(float(b)) for b in model.intercepts])
    out = paragraphs(docs, id_col, text_col, confirm).withColumn("w", words(F.col("body")))
    out = out.withColumn("f", F.filter(F.transform(ngrams(F.col("w")), lambda g: F.try_element_at(table, g)), lambda x: x.isNotNull()))
    out = out.withColumn("z", F.aggregate("f", start, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))
    out = out.withColumn("p", _softmax(F.col("z"), model.temperature)).withColumn("probability", F.array_max("p"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    out = out.withColumn("family", F.element_at(names, F.array_position("p", F.col("probability")).cast("int")))
    shares = []
    for family, notices in NOTICES.items():
        for text in notices:
            own = F.array_distinct(words(F.lit(text)))
            shares.append(F.when(F.col("family") == family, F.size(F.array_intersect(own, "w")) / F.size(own)))
    out = out.withColumn("overlap", F.coalesce(F.greatest(*shares), F.lit(0.0)))
    return out.select("id", "paragraph", "body", "family", "probability", "overlap", ((F.col("family") != UNKNOWN) & (F.col("overlap") >= confirm)).alias("confirmed"))


def per_document(docs: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """(id, n_candidates, n_confirmed, families) per row of ``docs``; families sorted and comma-joined."""
    mine = found.groupBy("id").agg(
        F.count("*").alias("n_candidates"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("families"),
    )
    out = docs.select(F.col(id_col).cast("long").alias("id")).join(mine, "id", "left")
    return out.select("id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))
