"""License scan: a trained paragraph classifier with template confirmation, all native.

Paragraphs (lines of a text) become hashed counts of word uni- and bigrams; a multinomial
logistic regression over the licence families and an ``unknown`` class is fitted with
Spark ML. Training rows are word spans of the public notice texts below and all paragraphs
of the corpus, without those that share a word trigram with a notice: one half (by a hash of
the paragraph, so equal ones stay together) is fitted on, the other calibrates the acceptance
threshold, which at most ``FALSE_ACCEPTS`` of it may reach. However many there are, the
fitted paragraphs weigh as much as ``NEGATIVES`` / 2 rows, so the few spans keep their part.
A prediction counts if one of the
family's notices confirms it: at least ``CONFIRM`` of the shorter side's word trigrams are
shared. Every paragraph of every document is classified. Features are made once (``vectors``)
and staged, so neither a filter nor another pass computes them anew; a call that is given
them as ``lines`` reads them back.

Defined cases: null and empty texts have no licence; ties between families go to the first
by name; equal rows get equal results; fewer than three words share no trigram and are never
confirmed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stocklens.llm.common import let, staged, text_of

UNKNOWN = "unknown"
FEATURES = 1 << 13
NEGATIVES = 4_000          # twice the most that all fitted corpus paragraphs weigh together
STEPS = 10_000             # grid of the calibrated threshold
FALSE_ACCEPTS = 0.01
CONFIRM = 0.5
SPAN = 8                   # words of a training span

# Notice texts of public licences (fixed values, shortened to their characteristic sentences)
NOTICES = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.", "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. No part of this publication may be reproduced without prior written permission.",
    ],
}
FAMILIES = [UNKNOWN, *sorted(NOTICES)]


def tokens(paragraph: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens inside a word."""
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.\-]+|\.(?=\s|$)"), "")


def grams(words: Column, n: int) -> Column:
    """Word n-grams, joined by a space; none if there are fewer words."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    ).otherwise(F.array().cast("array<string>")))


def features(df: DataFrame) -> DataFrame:
    """Adds ``features`` from the ``words`` of a paragraph: hashed uni- and bigrams."""
    pairs = F.transform("words", lambda w, i: F.concat(w, F.lit(" "), F.coalesce(F.get("words", i + 1), F.lit("$"))))
    with_grams = df.withColumn("__grams", F.concat(F.col("words"), pairs))
    return HashingTF(numFeatures=FEATURES, inputCol="__grams", outputCol="features").transform(with_grams).drop("__grams")


def notices(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f in sorted(NOTICES) for t in NOTICES[f]]
    return spark.createDataFrame(rows, "family string, notice string").withColumn("words", tokens(F.col("notice")))


def paragraphs(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Non-empty lines of every text, with their place."""
    return df.select(*keep, F.posexplode(F.split(text_of(text), r"[\r\n]+")).alias("place", "paragraph")).filter(
        F.trim("paragraph") != "")


def numbered_rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and ``row``, a number that equal rows share."""
    return df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn(
        "row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))


def half_of(paragraph: str) -> Column:
    """0: fitted on, 1: calibrates."""
    return F.pmod(F.xxhash64(paragraph), F.lit(2))


def near_notice(spark: SparkSession) -> Column:
    """Whether ``words`` share a word trigram with a notice. A trigram is made only of words that
    stand first, second and third in some notice's trigram."""
    ours = sorted(r["g"] for r in notices(spark).select(F.explode(grams(F.col("words"), 3)).alias("g")).distinct().collect())
    first, second, third = (sorted(set(ws)) for ws in zip(*(g.split(" ") for g in ours)))
    after = lambda i, k: F.get("words", i + k)
    hits = F.transform("words", lambda w, i: w.isin(first) & after(i, 1).isin(second) & after(i, 2).isin(third)
                       & F.concat_ws(" ", w, after(i, 1), after(i, 2)).isin(ours))
    return F.coalesce(F.array_contains(hits, True), F.lit(False))


def vectors(df: DataFrame, text: str, *keep: str, near: bool = True) -> DataFrame:
    """(keep, place, half, paragraph, features) of every paragraph, staged. ``paragraph`` is kept
    only where it is near a notice; with ``near=False`` those paragraphs are left out."""
    rows = paragraphs(df, text, *keep).withColumn("words", tokens(F.col("paragraph"))).withColumn("__near", near_notice(df.sparkSession))
    rows = features(rows if near else rows.filter(~F.col("__near")))
    return staged(rows.select(*keep, "place", half_of("paragraph").alias("half"), F.when(F.col("__near"), F.col("paragraph")).alias("paragraph"),
                              "features"), "paragraphs")


def document_vectors(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``lines`` for both ``train`` and ``scan`` of the same table."""
    return vectors(numbered_rows(df, doc_id, text), "text", "row")


class Scanner:
    def __init__(self, model: LogisticRegressionModel, threshold: float):
        self.model, self.threshold = model, threshold


def calibrated(probe: DataFrame) -> float:
    """The least threshold from 0.5 up, on a grid of ``STEPS``, that at most ``FALSE_ACCEPTS`` of
    the paragraphs reach. ``probe``: column p, how far each is from unknown."""
    steps = probe.groupBy(F.floor(F.col("p") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    most, above = FALSE_ACCEPTS * sum(r["n"] for r in steps), 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        above += r["n"]
        if above > most or 2 * r["step"] < STEPS:
            return max(0.5, (r["step"] + 1) / STEPS)
    return 0.5


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", negatives: int = NEGATIVES,
          lines: DataFrame | None = None) -> Scanner:
    """Fit on notice spans and one half of the corpus paragraphs, calibrate on the other.
    ``lines``: the table's ``document_vectors``, if they are there already."""
    spark = df.sparkSession
    known = notices(spark)
    spans = known.select("family", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (SPAN - 1), F.lit(1)), F.lit(2))).alias("i"), "words")
    spans = spans.select("family", F.slice("words", F.col("i"), SPAN).alias("words")).unionByName(known.select("family", "words"))
    label = F.lit(0.0)
    for k, f in enumerate(FAMILIES):
        label = F.when(F.col("family") == f, F.lit(float(k))).otherwise(label)
    spans = features(spans.coalesce(1)).select("features", label.alias("label"), F.lit(1.0).alias("weight"))

    if lines is None:
        halves, lines = paragraphs(df, text).select(half_of("paragraph").alias("half")), vectors(df, text, near=False)
    else:
        halves = lines
    plain = lines.filter(F.col("paragraph").isNull())          # without a notice's trigram
    n = halves.filter(F.col("half") == 0).count()
    weight = F.lit(min(1.0, negatives / 2 / max(1, n)))
    corpus = plain.filter(F.col("half") == 0).select("features", F.lit(0.0).alias("label"), weight.alias("weight"))
    fitted = LogisticRegression(maxIter=25, regParam=0.002, family="multinomial", weightCol="weight").fit(spans.unionByName(corpus))
    probe = fitted.transform(plain.filter(F.col("half") == 1).select("features"))
    return Scanner(fitted, calibrated(probe.select((F.lit(1.0) - vector_to_array("probability")[0]).alias("p"))))


def scan_paragraphs(df: DataFrame, scanner: Scanner, text: str, *keep: str, lines: DataFrame | None = None) -> DataFrame:
    """(keep, place, paragraph, family, probability) of each confirmed licence paragraph."""
    spark = df.sparkSession
    judged = scanner.model.transform(vectors(df, text, *keep) if lines is None else lines).withColumns({
        "family": F.array(*[F.lit(f) for f in FAMILIES])[F.col("prediction").cast("int")],
        "probability": F.array_max(vector_to_array("probability"))})
    likely = judged.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= scanner.threshold)).select(
        *keep, "place", "paragraph", "family", "probability").withColumn("words", tokens(F.col("paragraph")))  # null: nothing shared
    forms = notices(spark).select("family", F.array_distinct(grams(F.col("words"), 3)).alias("form"))
    forms = forms.groupBy("family").agg(F.collect_list("form").alias("forms"))
    shared = lambda own, f: F.size(F.array_intersect(own, f)) / F.greatest(
        F.least(F.size(own), F.size(f)), F.lit(1))
    confirmed = let(F.array_distinct(grams(F.col("words"), 3)), lambda own: F.exists("forms", lambda f: shared(own, f) >= CONFIRM))
    return (likely.join(F.broadcast(forms), "family").filter(confirmed).select(*keep, "place", "paragraph", "family", "probability"))


def scan(df: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, licenses (families, sorted), n_paragraphs and the best probability.
    ``lines``: the table's ``document_vectors``, if they are there already."""
    rows = numbered_rows(df, doc_id, text)
    found = scan_paragraphs(rows, scanner, "text", "row", lines=lines)
    per_row = staged(found.groupBy("row").agg(       # equal rows share their hits: places count once
        F.array_sort(F.collect_set("family")).alias("licenses"), F.size(F.collect_set("place")).cast("long").alias("n_paragraphs"),
        F.max("probability").alias("probability")), "licensed")
    return rows.select("doc_id", "row").join(per_row, "row", "left").select(
        "doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"))
