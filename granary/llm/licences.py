"""Licence scan by a trained paragraph classifier, with DataFrame and MLlib operations only (operator 9).

Paragraphs are single lines, and runs of lines between blank ones (a notice is often wrapped). A sparse (L1) multinomial
logistic regression over hashed word uni- and bigrams tells licence families from everything else (``unknown``). It is
trained on altered copies of public notices, on scraps of them (hard negatives, labelled ``unknown``) and on paragraphs
of at most ``NEGATIVE_DOCS`` documents (those with the smallest hash of id and text); its probabilities are calibrated by
a temperature fitted on held-out copies, and a prediction only stands if the paragraph holds at least
``MIN_SIMILARITY`` of the word pairs of a notice of that family.

Which paragraphs need a score follows from that threshold: a paragraph that holds 0.6 of a notice's m word pairs lacks
at most 0.4 m of them, so of any 0.4 m + 1 pairs it holds one. For each notice the longest words that cover so many pairs
are looked for; a paragraph with none of these words, and no cue word, can be neither confirmed nor ``unknown``.

Edge cases: a null or empty text has no paragraphs and family ``none``; a paragraph with cue words
that no notice confirms is ``unknown``; ties go to the likelier, then the first family by name; rows
that share a ``doc_id`` are scanned together, rows without one as well; a very long line or paragraph is judged whole,
like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import bound

from .quality import text_of
from .staging import read_table, staged

NEGATIVE_DOCS = 300
NEGATIVE_LINES = 3000
VARIANTS = 24
FEATURES = 1 << 13
SCRAPS = 6
MIN_SIMILARITY = 0.6
MIN_PROBABILITY = 0.5
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
CUES = (
    "licence", "license", "copyright", "rights reserved", "warrant", "redistribut", "permission", "creative commons", "public domain",
    "spdx", "cc by", "cc0",
)

#: Public notices by family.
NOTICES = (
    ("agpl", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("agpl", "GNU Affero General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("artistic", "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "GNU General Public License, Version 2, June 1991."),
    ("gpl", "GNU General Public License, Version 3, 29 June 2007."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("lgpl", "GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
FAMILIES = ("unknown", *sorted({f for f, _ in NOTICES}))


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != F.lit(""))


def pairs_of(words: Column) -> Column:
    """Adjacent words."""

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))

    return bound(words, of)


def grams(words: Column) -> Column:
    """Word uni- and bigrams."""
    return bound(words, lambda w: F.concat(w, pairs_of(w)))


def sought(threshold: float = MIN_SIMILARITY) -> list[str]:
    """Words of which every paragraph that a notice confirms has one."""
    found: set[str] = set()
    for _, text in NOTICES:
        words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
        pairs = set(zip(words, words[1:], strict=False))
        needed = int(len(pairs) * (1 - threshold) + 1e-9) + 1
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(bool(found & set(p)) for p in pairs) >= needed:
                break
            found.add(word)
    return sorted(found)


def cued(text: Column) -> Column:
    """Whether a lower-case text has a cue word: plain searches, as an alternation is tried anew at every character."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in CUES])


def worth_a_score(text: Column) -> Column:
    """Whether a lower-case text has a cue word or one of the words looked for, which is tried only where a word begins."""
    by_letter: dict[str, list[str]] = {}
    for word in sought():
        by_letter.setdefault(word[0], []).append(word[1:])
    words = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items())
    word = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"
    return bound(text, lambda t: cued(t) | t.rlike(word))


def notices(spark: SparkSession) -> DataFrame:
    rows = [(i, f, t) for i, (f, t) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "notice int, family string, notice_text string").withColumn(
        "notice_pairs", F.array_distinct(pairs_of(word_list(F.col("notice_text"))))
    )


def sample_texts(docs: DataFrame, rows: int) -> DataFrame:
    """``text`` of at most ``rows`` documents, those with the smallest hash; texts are fetched after the choice."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), text_of().alias("text"))
    chosen = [r["key"] for r in keyed.select("key").distinct().orderBy("key").limit(rows).collect()]
    return keyed.where(F.col("key").isin(chosen)).groupBy("key").agg(F.first("text").alias("text")).select("text")


def training_set(docs: DataFrame) -> DataFrame:
    """``words, label, held``: altered notices, scraps of notices and corpus paragraphs; bounded by the constants above."""
    spark = docs.sparkSession
    lines = sample_texts(docs, NEGATIVE_DOCS)
    lines = lines.select(F.explode(F.split("text", "\n")).alias("line")).where(~cued(F.lower("line")))
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVE_LINES)
    other = lines.select(word_list(F.col("line")).alias("words"), F.lit(0.0).alias("label"), F.xxhash64("line").alias("key"))
    number = F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(i)))])
    copies = notices(spark).select("notice", "notice_text", number[F.col("family")].alias("label"), F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    words = word_list(F.col("notice_text"))
    # variant 0 is the notice itself; others lose words by hash, up to three in ten
    kept = F.filter(words, lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(20)) >= F.col("variant") % 7)
    # scraps keep three words in ten: licence words without a notice
    scrap = F.filter(words, lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variant"), F.lit("scrap")), F.lit(10)) < 3)
    scraps = copies.where((F.col("variant") < SCRAPS) & (F.size(words) > 8)).select(
        scrap.alias("words"), F.lit(0.0).alias("label"), F.xxhash64("notice", "variant", F.lit("scrap")).alias("key")
    )
    copies = copies.select(kept.alias("words"), "label", F.xxhash64("notice", "variant").alias("key"))
    every = other.unionByName(copies).unionByName(scraps)
    return every.where(F.size("words") > 0).withColumn("held", F.pmod("key", F.lit(5)) == 0).drop("key")


def softened(raw: Column, temperature: float) -> Column:
    """Class probabilities from raw scores."""

    def of(most: Column) -> Column:
        powers = F.transform(raw, lambda x: F.exp((x - most) / F.lit(float(temperature))))
        return bound(powers, lambda p: bound(F.aggregate(p, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(p, lambda x: x / total)))

    return bound(F.array_max(raw), of)


def chance(temperature: float) -> Column:
    """Probability of the true label."""
    return F.element_at(softened(F.col("raw"), temperature), F.col("label").cast("int") + 1)


class LicenceModel:
    """The fitted classifier and its temperature."""

    def __init__(self, model: LogisticRegressionModel, temperature: float):
        self.model, self.temperature = model, temperature

    @staticmethod
    def features(df: DataFrame) -> DataFrame:
        table = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features")
        return table.transform(df.withColumn("_grams", grams(F.col("words"))))

    @classmethod
    def fit(cls, docs: DataFrame) -> LicenceModel:
        rows = staged(training_set(docs), "licence-training").coalesce(1)
        rows = cls.features(rows).cache()
        try:
            learner = LogisticRegression(maxIter=40, regParam=2e-3, elasticNetParam=1.0, family="multinomial")
            model = learner.fit(rows.where("NOT held"))
            held = model.transform(rows.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
            losses = [F.avg(-F.log(F.greatest(chance(t), F.lit(1e-12)))).alias(str(t)) for t in TEMPERATURES]
            found = held.agg(*losses).first().asDict()
            best = min(TEMPERATURES, key=lambda t: (found[str(t)] if found[str(t)] is not None else 0.0, t))
        finally:
            rows.unpersist()
        return cls(model, best)

    def classify(self, paragraphs: DataFrame) -> DataFrame:
        """Adds ``predicted``, ``probability`` (calibrated) and ``_grams`` to rows with ``words``."""
        out = self.model.transform(self.features(paragraphs)).withColumn("_raw", vector_to_array("rawPrediction"))
        out = out.withColumn("_p", softened(F.col("_raw"), self.temperature))
        place = F.array_position("_p", F.array_max("_p")).cast("int")
        names = F.array(*[F.lit(f) for f in FAMILIES])
        return (
            out.withColumn("predicted", F.element_at(names, place))
            .withColumn("probability", F.array_max("_p"))
            .drop("_raw", "_p", "rawPrediction", "prediction", "features")
        )


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, cued``: single lines, and runs of two or more lines, that are worth a score."""
    rows = docs.select("doc_id", text_of().alias("text"))
    lines = F.split("text", "\n")
    runs = F.filter(F.split("text", r"\n(?:[^\S\n]*\n)+"), lambda x: F.instr(x, "\n") > 0)
    units = F.filter(F.concat(lines, runs), lambda x: worth_a_score(F.lower(x)))
    rows = rows.where(worth_a_score(F.lower("text")))
    return rows.select("doc_id", F.explode(units).alias("paragraph")).withColumn("cued", bound(F.lower("paragraph"), cued))


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row a paragraph worth a score: ``doc_id, paragraph, licence, probability, similarity``.

    ``licence`` is a family, ``unknown`` where nothing is confirmed but a cue word stands, else ``none``.
    """
    model = model or LicenceModel.fit(docs)
    scored = model.classify(paragraphs(docs).withColumn("words", word_list(F.col("paragraph"))))
    n = notices(docs.sparkSession).select(F.col("family").alias("predicted"), "notice_pairs")
    by_family = n.groupBy("predicted").agg(F.collect_list("notice_pairs").alias("_notices"))
    by_family = by_family.withColumn("_any", F.array_distinct(F.flatten("_notices")))
    both = scored.join(F.broadcast(by_family), "predicted", "left")
    # of a paragraph's words and pairs only the pairs that some notice of the family has matter; single words hold no blank
    share = bound(F.array_intersect("_grams", "_any"), lambda own: F.transform("_notices", lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))
    both = both.withColumn("similarity", F.coalesce(F.array_max(share), F.lit(0.0)))
    stands = (F.col("similarity") >= MIN_SIMILARITY) & (F.col("probability") >= MIN_PROBABILITY)
    both = both.withColumn("licence", F.when(stands, F.col("predicted")).when(F.col("cued"), "unknown").otherwise("none"))
    return both.select("doc_id", "paragraph", "licence", "probability", "similarity")


def by_document(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, licence, probability, similarity, n_paragraphs`` (worth a score).

    ``licence`` is the likeliest confirmed family, else ``unknown``, or ``none`` without cue words. Rows that
    share a ``doc_id``, or have none, get the same answer.
    """
    level = F.when(F.col("licence") == "none", 0).when(F.col("licence") == "unknown", 1).otherwise(2)
    rank = F.struct(level.alias("a"), "probability", "similarity", "licence")
    found = paragraphs.groupBy("doc_id").agg(F.max(rank).alias("b"), F.count("*").alias("n"))
    found = found.withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.coalesce("b.licence", F.lit("none")).alias("licence"),
        "b.probability",
        "b.similarity",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"),
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return by_document(docs, scan(docs))
