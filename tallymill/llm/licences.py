"""Licence scans: paragraphs are classified by licence family, and templates confirm the verdict.

A multinomial logistic regression over sparse word 1- and 2-grams is trained on the paragraphs of the templates below
and on the ordinary paragraphs of all documents, which make up the class ``unknown``: those without a word that marks
licences, that no template would confirm. Equal sets of features are one row with their number as its weight. Only
n-grams with a word that is no function word are features, and only those that templates have: a paragraph without any
is ``unknown`` for certain, is counted, and is not scored. The least probability that a licence needs is calibrated so
that none of the ordinary paragraphs kept back for it, every fourth by hash, would pass. A prediction is confirmed when
the paragraph holds enough of a template of that family, or mostly consists of one.

All of the scan is DataFrame expressions; the weights are a table as small as the templates.

Defined cases: a null text is empty; a text without licences has an empty list; null ids are kept; repeated rows each
get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallymill.llm.frames import documents
from tallymill.sources.work import settle

UNKNOWN = "unknown"
#: Different sets of features in one task of the training.
SETS = 200_000
#: Share of a template's n-grams that a paragraph has to hold, and of a paragraph's that templates of a family explain.
HOLDS, EXPLAINED = 0.7, 0.6
LEAST_PROBABILITY = 0.5

# fixed values: notices and characteristic sentences of licences; digits stand for any number
TEMPLATES = {
    "MIT": """
Released under the MIT License.
Licensed under the MIT license.
This project is licensed under the terms of the MIT license.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
SPDX-License-Identifier: MIT
""",
    "Apache": """
Licensed under the Apache License, Version 0.0.
Licensed under the Apache License, Version 0.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-0.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
This product includes software developed at The Apache Software Foundation.
SPDX-License-Identifier: Apache-0.0
""",
    "GPL": """
This work is licensed under the GNU General Public License, version 0.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 0 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/
Released under the GNU GPL version 0.
SPDX-License-Identifier: GPL-0.0-or-later
""",
    "LGPL": """
This work is licensed under the GNU Lesser General Public License, version 0.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 0.0 of the License, or any later version.
You should have received a copy of the GNU Lesser General Public License along with this library.
SPDX-License-Identifier: LGPL-0.0-or-later
""",
    "AGPL": """
This work is licensed under the GNU Affero General Public License, version 0.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.
SPDX-License-Identifier: AGPL-0.0-or-later
""",
    "BSD": """
Released under the BSD License.
Licensed under the 0-Clause BSD License.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
SPDX-License-Identifier: BSD-0-Clause
""",
    "MPL": """
Licensed under the Mozilla Public License, Version 0.0.
This Source Code Form is subject to the terms of the Mozilla Public License, v. 0.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/0.0/
SPDX-License-Identifier: MPL-0.0
""",
    "CC-BY": """
Licensed under CC BY 0.0.
This work is licensed under a Creative Commons Attribution 0.0 International License.
Text is available under the Creative Commons Attribution License.
""",
    "CC-BY-SA": """
Licensed under CC BY-SA 0.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 0.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.
""",
    "CC-BY-NC": """
Licensed under CC BY-NC 0.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 0.0 International License.
Licensed under CC BY-NC-SA 0.0.
""",
    "CC0": """
Released under CC0 0.0 Universal.
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
This is free and unencumbered software released into the public domain.
""",
    "ISC": """
Released under the ISC License.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
""",
    "proprietary": """
Copyright 0000. All rights reserved.
All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher.
Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.
""",
}
# fixed values: function words; an n-gram of these alone is no feature
FUNCTION_WORDS = "a an and any are as at be by for from in is it no not of on or that the this to under use with you your"
# fixed values: what marks paragraphs that may be licences themselves
SUSPECT = r"licen[sc]|copyright|warrant|redistribut|creative commons|public domain|reserved"


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``number`` and ``words`` of all lines: lower-case runs of letters and digits, each
    digit as zero."""
    lines = documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("number", "line"))
    return lines.select("doc_id", "text_hash", "number", "line", _words(F.col("line")).alias("words"))


def _words(line: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(line), "123456789", "000000000"), r"[^\p{L}0]+"), lambda w: w != "")


def _terms(words: Column) -> Column:
    """Different 1- and 2-grams that are not of function words alone."""
    plain = F.array(*[F.lit(w) for w in FUNCTION_WORDS.split()])
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.when(b.isNotNull() & ~(F.array_contains(plain, a) & F.array_contains(plain, b)), F.concat_ws(" ", a, b)),
    )
    return F.array_distinct(F.filter(F.concat(F.array_except(words, plain), pairs), lambda t: t.isNotNull()))


def templates(spark) -> DataFrame:
    """``family``, ``template`` (number) and ``terms`` of every template."""
    rows = [(f, k, line) for f, text in TEMPLATES.items() for k, line in enumerate(text.strip().split("\n"))]
    lines = spark.createDataFrame(rows, "family string, template int, line string")
    return lines.select("family", "template", _terms(_words(F.col("line"))).alias("terms"))


def vocabulary_of(known: DataFrame) -> list[str]:
    """The different terms of the templates."""
    return sorted(r["t"] for r in known.select(F.explode("terms").alias("t")).distinct().collect())


def featured(docs: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, int]:
    """All paragraphs with features: ``id``, their key, ``terms`` (those that templates have), ``n_terms`` (of all), whether
    they are ``suspect``, and ``cell``; and how many others, outside cell 0, have words but no feature."""
    features = F.array(*[F.lit(w) for w in vocabulary if " " not in w])
    lines = paragraphs(docs).where(F.size("words") > 0)
    lines = lines.withColumns({"plain": ~F.arrays_overlap("words", features), "cell": F.pmod(F.xxhash64("line"), F.lit(4))})
    seen = Observation()
    lines = lines.observe(seen, F.count_if(F.col("plain") & (F.col("cell") != 0)).alias("plain"))
    lines = lines.where(~F.col("plain")).withColumn("all_terms", _terms(F.col("words")))
    known_terms = F.array_intersect("all_terms", F.array(*[F.lit(t) for t in vocabulary]))
    rows = lines.select(
        "doc_id", "text_hash", "number", known_terms.alias("terms"), F.size("all_terms").alias("n_terms"),
        F.lower("line").rlike(SUSPECT).alias("suspect"), "cell", F.monotonically_increasing_id().alias("id"),
    )
    rows = settle(rows, "licence-paragraphs")  # with their numbers, so that those stay the same
    return rows, seen.get.get("plain") or 0


def _confirms(holds: float, explained: float) -> Column:
    """Whether the paragraph holds enough of the template ``known``, or mostly consists of it."""
    common = F.size(F.array_intersect("terms", "known"))
    return (common >= holds * F.size("known")) | (common >= explained * F.col("n_terms"))


def ordinary_sets(rows: DataFrame, known: DataFrame, holds: float = HOLDS, explained: float = EXPLAINED) -> DataFrame:
    """``terms`` of the ordinary paragraphs of ``rows``, and how many have them in the training (``learnt``) and were
    ``kept_back``."""
    shortest = known.agg(F.min(F.size("terms")).alias("n")).first()["n"]
    # others no template can confirm
    full = F.size("terms") >= F.least(F.lit(holds * shortest), explained * F.col("n_terms"))
    numbers = [F.count_if(F.col("cell") != 0).alias("learnt"), F.count_if(F.col("cell") == 0).alias("kept_back")]
    sets = rows.where(~F.col("suspect")).groupBy(F.sort_array("terms").alias("terms"), F.when(full, F.col("n_terms")).alias("n_terms")).agg(*numbers)
    # a few templates per family
    like = sets.where("n_terms is not null").join(F.broadcast(known.select(F.col("terms").alias("known"))), _confirms(holds, explained), "left_anti")
    both = like.unionByName(sets.where("n_terms is null"))
    return both.groupBy("terms").agg(F.sum("learnt").alias("learnt"), F.sum("kept_back").alias("kept_back"))


def train(
    rows: DataFrame, plain: int, vocabulary: list[str], holds: float = HOLDS, explained: float = EXPLAINED
) -> tuple[DataFrame, list[str], float]:
    """Weights (``term``, one value per class), the classes, and the least probability that a licence needs, from what
    ``featured`` gives of all documents."""
    spark = rows.sparkSession
    known = templates(spark).select("family", "terms")
    ordinary = settle(ordinary_sets(rows, known, holds, explained).withColumn("key", F.monotonically_increasing_id()), "ordinary-sets")
    # halves of templates teach excerpts; the all-zero row is a paragraph without any feature
    half = F.greatest(F.floor(F.size("terms") / 2), F.lit(1)).cast("int")
    excerpts = known.select("family", F.slice("terms", F.lit(1), half).alias("terms")).union(
        known.select("family", F.slice("terms", half, F.size("terms")).alias("terms"))
    )
    classes = [UNKNOWN, *TEMPLATES]
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    empty = spark.createDataFrame([(UNKNOWN, [])], "family string, terms array<string>")
    sizes = ordinary.agg(F.count("*").alias("sets"), F.coalesce(F.sum("learnt"), F.lit(0)).alias("learnt")).first()
    n_templates = sum(len(t.strip().split("\n")) for t in TEMPLATES.values())
    # all ordinary paragraphs together weigh as much as all templates
    each = 4.0 * n_templates / max(sizes["learnt"] + plain, 1)
    others = spark.createDataFrame([([], 0.0, each * plain)], "terms array<string>, label double, weight double")
    learnt = (
        known.union(known).union(excerpts).union(empty).select("terms", number.alias("label"), F.lit(1.0).alias("weight"))
        .union(ordinary.where("learnt > 0").select("terms", F.lit(0.0).alias("label"), each * F.col("learnt")))
        .union(others.where("weight > 0"))
    )
    # in a fixed order, as sums of fractions depend on it
    parts = -(-(sizes["sets"] + 1) // SETS)
    learnt = learnt.repartition(parts, "terms").sortWithinPartitions("terms", "label", "weight")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "terms", "features").transform(learnt).cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, weightCol="weight", standardization=False).fit(vectors)
    vectors.unpersist()
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    names = ", ".join(f"w{k} double" for k in range(len(classes)))
    weights = spark.createDataFrame(
        [(t, *map(float, matrix[:, k])) for k, t in enumerate(vocabulary)] + [("", *map(float, bias))], f"term string, {names}"
    )
    kept_back = ordinary.where("kept_back > 0").select("key", "terms")
    highest = _probabilities(kept_back, weights, classes, ["key"]).agg(F.max("probability").alias("p")).first()["p"]
    return weights, classes, max(LEAST_PROBABILITY, highest or 0.0)


def _probabilities(rows: DataFrame, weights: DataFrame, classes: list[str], key: list[str]) -> DataFrame:
    """The likeliest licence of each row that has features, and its probability."""
    sums = [F.sum(f"w{k}").alias(f"w{k}") for k in range(len(classes))]
    bias = weights.where("term = ''").drop("term").first()
    met = rows.select(*key, F.explode("terms").alias("t")).join(F.broadcast(weights), F.col("t") == F.col("term"))
    logits = [F.col(f"w{k}") + F.lit(bias[f"w{k}"]) for k in range(len(classes))]
    top = F.greatest(*logits)
    parts = F.array(*[F.exp(x - top) for x in logits])
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.slice(parts, 2, len(classes) - 1))
    names = F.array(*[F.lit(c) for c in classes])
    # the first class is unknown
    place = F.array_position(F.slice(parts, 2, len(classes) - 1), best) + 1
    return met.groupBy(*key).agg(*sums).select(*key, F.element_at(names, place.cast("int")).alias("family"), (best / total).alias("probability"))


def scan(docs: DataFrame, holds: float = HOLDS, explained: float = EXPLAINED) -> DataFrame:
    """``doc_id``, ``licences`` (paragraph number, family, probability) and ``families`` (sorted names) of every document."""
    known = templates(docs.sparkSession)
    vocabulary = vocabulary_of(known)
    judged, plain = featured(docs, vocabulary)
    weights, classes, least = train(judged, plain, vocabulary, holds, explained)
    key = ["doc_id", "text_hash", "number"]
    likely = _probabilities(judged, weights, classes, ["id"]).where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    same = [F.col("doc_id").eqNullSafe(F.col("of_doc_id")), F.col("text_hash") == F.col("of_text_hash")]
    candidates = judged.select("id", *key, "terms", "n_terms").join(likely.select("id", F.col("family").alias("likely"), "probability"), "id")
    # a few templates per family
    beside = candidates.join(F.broadcast(known.withColumnRenamed("terms", "known")), F.col("likely") == F.col("family"))
    confirmed = beside.where(_confirms(holds, explained))
    found = (
        confirmed.groupBy(*key).agg(F.first("family").alias("family"), F.first("probability").alias("probability"))
        .groupBy(F.col("doc_id").alias("of_doc_id"), F.col("text_hash").alias("of_text_hash"))
        .agg(F.sort_array(F.collect_list(F.struct("number", "family", "probability"))).alias("licences"))
    )
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(found, same[0] & same[1], "left")
    none = F.array().cast("array<struct<number:int,family:string,probability:double>>")
    return joined.select(
        "doc_id",
        F.coalesce("licences", none).alias("licences"),
        F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.col("licences.family"))), ","), F.lit("")).alias("families"),
    )
