"""Licence notices in documents, paragraph by paragraph.

A multinomial logistic regression over word 1- and 2-grams tells the licence
family of a paragraph or that it is none. It is trained on variants of known
notices and on a sample of the corpus, with an L1 penalty: most n-grams get no
weight, and a paragraph without any n-gram that has one is no licence. How sure
it must be is set on held-out paragraphs. A prediction is then confirmed by
comparing the paragraph with the notices of its family.

Fitting uses Spark's DataFrame-based machine learning; paragraphs are scored by
SQL expressions alone, within the row of their document, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.session import materialize

UNKNOWN = "unknown"
#: Paragraphs of the corpus that the classifier is fitted on, at most about.
SAMPLE = 3000
#: Held-out paragraphs that are no licence and may be taken for one, as a share.
FALSE_ALARMS = 0.001
#: Part of a notice's 2-grams, or of the paragraph's own, that confirms it.
CONFIRMED = 0.6

# Notices of licence families.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is available under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0, for non-commercial use only.",
    ],
    "cc-by-sa": [
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL v3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Distributed under the terms of the MIT License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This material is proprietary and confidential; unauthorized copying is prohibited.",
    ],
}

# Sentences near the subject that are no notice.
NO_NOTICES = [
    "He lost his driving license two years ago.",
    "The band released its second album under a new label.",
    "The new version was released in May and is available for download.",
    "The work was distributed to all members of the committee.",
    "Permission to enter the building is granted by the guard.",
    "The software is used by many public libraries.",
    "They applied for a license to sell food in the public park.",
    "The contract gives the publisher the rights to the text.",
    "A copy of the letter was found in the file.",
    "Creative work in common rooms is open to the public.",
    "Version 2.0 of the program is available at the site.",
    "You can use the form to modify the terms of the order.",
]

FRAMES = ["{}", "Note: {}", "{} See the file for details.", "This document and its sources: {}", "Notice. {}"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct 1- and 2-grams, by their hashes."""
    ones = F.transform(words, lambda w: F.xxhash64(w))
    return F.array_distinct(F.concat(ones, _pairs(words)))


def _pairs(words: Column) -> Column:
    return F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))),
    ).otherwise(F.array().cast("array<bigint>"))


def paragraphs(documents: DataFrame, document: str, text: str) -> DataFrame:
    """(d, paragraph, line): non-empty lines of all texts, numbered from 0
    among all lines of their text."""
    lines = documents.select(F.col(document).alias("d"), F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "line"))
    return lines.where(F.trim("line") != "")


@dataclass
class LicenceModel:
    """Families (the last one is no licence), n-grams with weight, their
    weights per family, and the least probability of a licence."""

    families: list[str]
    grams: list[int]
    weights: list[list[float]]
    bias: list[float]
    temperature: float
    least: float
    notices: dict[str, list[list[int]]]


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _doubles(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _with_logits(rows: DataFrame, model: LicenceModel, grams: str) -> DataFrame:
    """Adds ``z``, scores of the families from known n-grams of a paragraph."""
    at = F.transform(grams, lambda g: F.array_position(_longs(model.grams), g).cast("int") - 1)

    def logit(weights: list[float], bias: float) -> Column:
        return F.aggregate("at", F.lit(float(bias)), lambda s, i: s + F.get(_doubles(weights), i))

    placed = rows.withColumn("at", at)
    return placed.withColumn("z", F.array(*[logit(w, b) for w, b in zip(model.weights, model.bias)])).drop("at")


def _shares(temperature: float) -> Column:
    """What each family's score ``z`` weighs among all, before the sum is made 1."""
    return F.transform("z", lambda x: F.exp(x / temperature))


def _sum(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _settled(rows: DataFrame, keep: list[str], made: dict[str, Column], condition) -> DataFrame:
    """Rows with columns ``made`` that meet ``condition``, a function of the
    struct of them. Made by a generator: a filter after it is not moved before
    it, where each use would compute these columns anew."""
    one = F.array(F.struct(*[c.alias(n) for n, c in made.items()]))
    return rows.select(*keep, F.explode(F.filter(one, condition)).alias("_s")).select(*keep, "_s.*")


def _variants(spark: SparkSession) -> DataFrame:
    """Notices as they are met: framed, cut at either end, in part."""
    rows = [(family, f.format(n)) for family, ns in NOTICES.items() for n in ns for f in FRAMES]
    rows += [(UNKNOWN, f.format(n)) for n in NO_NOTICES for f in FRAMES]
    whole = spark.createDataFrame(rows, "family string, line string").withColumn("w", words_of(F.col("line")))
    # Parts keep three quarters of the words, begun at each of three places.
    n = F.size("w")
    part = F.greatest(F.ceil(n * 0.75).cast("int"), F.lit(1))
    cuts = F.array(F.col("w"), F.slice("w", 1, part), F.slice("w", n - part + 1, part))
    return whole.select("family", F.explode(cuts).alias("w"))


def _notice_pairs(spark: SparkSession) -> dict[str, list[list[int]]]:
    """Hashed 2-grams of the notices of each family."""
    rows = [(family, n) for family, ns in NOTICES.items() for n in ns]
    pairs = spark.createDataFrame(rows, "family string, line string").withColumn("w", words_of(F.col("line")))
    out: dict[str, list[list[int]]] = {}
    for r in pairs.select("family", F.array_distinct(_pairs(F.col("w"))).alias("g")).collect():
        out.setdefault(r["family"], []).append(r["g"])
    return out


def _with_similarity(rows: DataFrame, notices: dict[str, list[list[int]]], families: list[str], family: Column | None) -> DataFrame:
    """Adds ``similarity``: how well a paragraph (words ``w``) matches a notice
    of its family, or of any: the larger part of 2-grams shared, of the
    notice's or of the paragraph's."""

    def match(theirs: list[int]) -> Column:
        shared = F.size(F.array_intersect("own", _longs(theirs)))
        return shared / F.greatest(F.least(F.size("own"), F.lit(len(theirs))), F.lit(1))

    best = {name: F.array_max(F.array(*[match(n) for n in notices[name]])) for name in families}
    if family is None:
        chosen = F.array_max(F.array(*best.values()))
    else:
        chosen = F.lit(0.0)
        for name in families:
            chosen = F.when(family == name, best[name]).otherwise(chosen)
    owned = _settled(rows, rows.columns, {"own": F.array_distinct(_pairs(F.col("w")))}, lambda s: s["own"].isNotNull())
    return owned.withColumn("similarity", chosen).drop("own")


def fit_licences(documents: DataFrame, document: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> LicenceModel:
    """Fit on variants of the notices and about ``sample`` paragraphs of the
    corpus, chosen by a hash, that no notice resembles. An empty corpus leaves
    the notices and what is near them."""
    spark = documents.sparkSession
    families = [*NOTICES, UNKNOWN]
    last = len(families) - 1
    notices = _notice_pairs(spark)
    n = documents.select(F.sum(F.size(F.split(F.col(text), "\n")))).first()[0] or 0
    share = min(1.0, sample / n) if n else 1.0
    lines = paragraphs(documents, document, text).withColumn("h", F.xxhash64("d", "paragraph", "line"))
    chosen = lines.where(F.pmod("h", F.lit(10_000_019)) < F.lit(10_000_019.0 * share))
    cut = _settled(chosen, ["h"], {"w": words_of(F.col("line"))}, lambda s: F.size(s["w"]) > 0)
    strange = _with_similarity(cut, notices, [*NOTICES], None).where("similarity < 0.5")
    corpus = strange.select(F.lit(UNKNOWN).alias("family"), "w", "h")
    rows = _variants(spark).withColumn("h", F.xxhash64("family", "w")).unionByName(corpus)
    label = F.array_position(F.split(F.lit(",".join(families)), ","), F.col("family")) - 1
    two = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    grams = F.array_distinct(F.when(F.size("w") > 1, F.concat("w", two)).otherwise(F.col("w")))
    train = rows.select(label.cast("double").alias("label"), grams.alias("grams"), "w", "h")
    # The sample is bounded: one partition, read again by every step.
    train = materialize(train.repartition(1).sortWithinPartitions("h", "label"), "licence-sample")

    # A fifth of the paragraphs sets the probabilities, the rest the weights.
    held = F.pmod("h", F.lit(5)) == 0
    seen = train.where(~held)
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(seen.where(F.col("label") < last))
    learner = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=80, standardization=False)
    fitted = learner.fit(vocabulary.transform(seen).coalesce(1))
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    used = [i for i in range(weights.shape[1]) if abs(weights[:, i]).max() > 1e-6]
    split = spark.createDataFrame([(k, vocabulary.vocabulary[i].split(" ")) for k, i in enumerate(used)], "k int, w array<string>")
    one, pair = F.xxhash64(F.get("w", F.lit(0))), F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1)))
    hashed = split.select("k", F.when(F.size("w") == 1, one).otherwise(pair).alias("h")).orderBy("k").collect()
    model = LicenceModel(
        families, [r["h"] for r in hashed], [[float(weights[c, i]) for i in used] for c in range(len(families))],
        [float(b) for b in bias], 1.0, 0.0, notices,
    )

    # The temperature under which held-out paragraphs are likeliest, and the
    # probability that hardly any of those without a licence reaches.
    known = train.where(held).select("label", F.array_intersect(grams_of(F.col("w")), _longs(model.grams)).alias("g"))
    scored = materialize(_with_logits(known, model, "g").select("label", "z"), "licence-scores")
    likeliest = None
    for temperature in (0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0, 3.0):
        sure = scored.select("label", _shares(temperature).alias("e")).select("label", "e", _sum("e").alias("sum"))
        p = F.get("e", F.col("label").cast("int")) / F.col("sum")
        facts = sure.agg(
            F.sum(F.log(F.greatest(p, F.lit(1e-9)))).alias("fit"),
            F.percentile(F.when(F.col("label") == last, 1 - p), 1 - FALSE_ALARMS).alias("least"),
        ).first()
        if facts["fit"] is not None and (likeliest is None or facts["fit"] > likeliest):
            likeliest, model.temperature, model.least = facts["fit"], temperature, facts["least"] or 0.0
    model.least = max(0.5, min(0.95, model.least))
    return model


def scan_licences(documents: DataFrame, model: LicenceModel, document: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that is taken for a licence notice: ``document``,
    ``paragraph`` (number of its line), ``family``, ``probability``,
    ``similarity`` to the nearest notice of the family and ``confirmed``.

    Paragraphs are non-empty lines; null and empty texts have none. Repeated
    rows give repeated results; a null id is kept as it is. Equal probabilities
    go to the family first in order. Other columns are ignored, whatever their
    names.
    """
    if max(range(len(model.bias)), key=lambda i: model.bias[i]) != len(model.families) - 1:
        raise ValueError("without any known n-gram a paragraph must be no licence")
    last = len(model.families) - 1
    lines = paragraphs(documents, document, text).select("d", "paragraph", words_of(F.col("line")).alias("w"))
    known = _settled(
        lines, ["d", "paragraph", "w"], {"g": F.array_intersect(grams_of(F.col("w")), _longs(model.grams))}, lambda s: F.size(s["g"]) > 0
    )
    scored = _with_logits(known, model, "g").select("d", "paragraph", "w", _shares(model.temperature).alias("e"))
    licences = _settled(
        scored,
        ["d", "paragraph", "w"],
        {"e": F.slice("e", 1, last), "sum": _sum("e")},
        lambda s: _sum(s["e"]) >= model.least * s["sum"],
    )
    family = F.get(F.split(F.lit(",".join(model.families)), ","), F.array_position("e", F.array_max("e")).cast("int") - 1)
    named = licences.select("d", "paragraph", "w", family.alias("family"), (F.array_max("e") / F.col("sum")).alias("probability"))
    compared = _with_similarity(named, model.notices, model.families[:-1], F.col("family"))
    return compared.select(
        F.col("d").alias(document),
        F.col("paragraph").cast("long").alias("paragraph"),
        "family",
        "probability",
        "similarity",
        (F.col("similarity") >= CONFIRMED).alias("confirmed"),
    )
