"""Licence families of paragraphs: n-gram logistic regression, calibrated, confirmed by templates.

Only DataFrame functions and expressions run on the texts.  The model is
trained with ``pyspark.ml`` on the templates below and their variants, and is
a few thousand numbers that become literals of the plan, so scoring neither
shuffles nor joins.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

BUCKETS = 2048
SLOTS = 4096
UNKNOWN = "unknown"
#: Least calibrated probability of a family; share of the template's or the paragraph's n-grams that must be shared.
LEAST_PROBABILITY = 0.5
LEAST_OVERLAP = 0.6

# Statements of licence families.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 2.",
        "Licensed under the GNU GPL v3.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL v3 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC-BY 3.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is prohibited.",
    ],
}

# Paragraphs that state no licence, most with words of licences.
OTHER = [
    "He lost his driving licence after the accident and had to take the bus to work.",
    "The restaurant applied for a liquor license last spring, and the council granted it.",
    "With the permission of the teacher, the children left the room early.",
    "The seats in the front row are reserved for members of the family.",
    "The fridge came with a two year warranty, but the shop refused to repair it.",
    "The plan would redistribute money from the rich regions to the poor ones.",
    "Copyright law was the subject of the lecture on Tuesday afternoon.",
    "She studied at MIT and later worked on Apache helicopters for the army.",
    "The licence plate of the car was covered with mud and could not be read.",
    "A quiet, reserved man, he asked permission before he spoke.",
    "The licensing board met on Monday to discuss fees for taxi drivers.",
    "The warrant was issued by a judge in the morning, and the police searched the house.",
    "Most of these old songs are in the public domain, says the librarian, who collects them.",
    "The agreement reserved the right of the town to use the road.",
    "License fees rose again this year, which angered the fishermen.",
    "She wrote a book about copyright and creative commons, and how writers earn a living.",
    "The software of the new machine was written by two students in a single summer.",
    "Use the form on this page to send us your question, and we will answer within a week.",
    "Version 2.0 of the game came out in 2019 and sold well in the first three months.",
    "The library is open to the public from nine to five, free of charge for all children.",
    "Er verlor seinen F\u00fchrerschein und musste mit dem Bus zur Arbeit fahren.",
    "Die Rechte der Kinder waren das Thema der Stunde, und alle haben viel gelernt.",
    "Avec la permission du professeur, les enfants sont sortis plus t\u00f4t de la salle.",
    "Tous les soirs, il lisait un livre sous la licence du vieux p\u00eacheur.",
    "Con el permiso de la maestra, los ni\u00f1os salieron temprano de la sala.",
    "La licencia de pesca cuesta m\u00e1s este a\u00f1o, y eso no gusta a nadie.",
]

_PREFIXES = ["", "Copyright (c) 2021 Example Authors. ", "# ", "Notice: "]


def _variants() -> list[dict]:
    """Each statement as it is, after prefixes, and each half of a long one; all forms of every third one are for calibration."""
    out = []
    for family, statements in [*TEMPLATES.items(), (UNKNOWN, OTHER)]:
        for number, text in enumerate(statements):
            words = text.split()
            forms = [p + text for p in _PREFIXES] if family != UNKNOWN else [text, text + " " + text, "Yesterday, " + text, text + " That was all."]
            if len(words) >= 24 and family != UNKNOWN:
                forms += [" ".join(words[: len(words) // 2]), text + " " + text]
            out += [{"family": family, "text": f, "held": number % 3 == 1} for f in forms]
    return out


def _words(low: Column) -> Column:
    return F.split(low, r"[^\p{L}\p{N}]+")


def grams(text: Column) -> Column:
    """Distinct words and word pairs, in lower case; digits count as words."""
    w = F.array_remove(_words(F.lower(text)), "")
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(w, F.filter(pairs, lambda x: x.isNotNull())))


def _bucket(gram: Column, count: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(count)).cast("int")


def buckets(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda g: _bucket(g)))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


class Model:
    """families in order of the classes, unknown first; weights by bucket and class; intercepts; temperature that calibrates; n-grams that it knows, with their buckets."""

    def __init__(self, families: list[str], weights: list[list[float]], intercept: list[float], temperature: float, known: dict[str, int]):
        self.families, self.weights, self.intercept, self.temperature = families, weights, intercept, temperature
        self.known = known

    def bounded(self) -> bool:
        """Whether the intercept of every family lacks something to that of unknown; else a paragraph may be of a family by its intercept alone."""
        return max(self.intercept[1:]) < self.intercept[0]

    def lifts(self) -> list[float]:
        """By hash of a word, the most that it and its pairs can weigh for some family above unknown, as a share of what the family's intercept lacks.

        A known pair counts with one of its words, that in fewer known pairs, so
        that frequent words carry little; words of equal hash are added.
        """
        own = np.asarray(self.weights)
        lacks = self.intercept[0] - np.asarray(self.intercept[1:])
        share = (np.maximum(own[:, 1:] - own[:, :1], 0.0) / lacks).max(axis=1)
        often = Counter(w for g in self.known if " " in g for w in g.split(" "))
        rows = [(min(g.split(" "), key=lambda x: (often[x], x)), float(share[b])) for g, b in self.known.items()]
        words = SparkSession.active().createDataFrame(rows, "w string, u double").groupBy(_bucket(F.col("w"), SLOTS).alias("b")).agg(F.sum("u").alias("u"))
        found = {r.b: r.u for r in words.collect()}
        return [found.get(i, 0.0) for i in range(SLOTS)]

    def logits(self, found: Column) -> Column:
        """Each bucket of known n-grams counts 1 / sqrt(number of all n-grams)."""
        weights = _literal(self.weights, "array<array<double>>")
        zero = F.array(*[F.lit(0.0)] * len(self.families))
        hashed = buckets(F.filter(found, lambda g: g.isin(list(self.known))))
        total = F.aggregate(hashed, zero, lambda acc, h: F.zip_with(acc, F.element_at(weights, h + 1), lambda a, b: a + b))
        scale = F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
        return F.zip_with(total, _literal(self.intercept, "array<double>"), lambda a, b: (a / scale + b) / F.lit(self.temperature))


def _best(logits: Column) -> Column:
    """(z, p): the greatest logit and its probability; each logit is read once."""
    start = F.struct(F.lit(-1e300).alias("z"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("f"))

    def add(acc, x):
        top = F.greatest(acc["z"], x)
        s = acc["s"] * F.exp(acc["z"] - top) + F.exp(x - top)
        return F.struct(top.alias("z"), s.alias("s"), (acc["n"] + 1).alias("n"), F.when(x > acc["z"], acc["n"]).otherwise(acc["f"]).alias("f"))

    return F.aggregate(logits, start, add, lambda acc: F.struct(acc["f"].alias("f"), (1 / acc["s"]).alias("q")))


def _regression(train: DataFrame, families: list[str], known: dict[str, int]) -> Model:
    """Sparse (elastic net) multinomial regression on (label, g), the n-grams of a statement."""
    h = train.select("label", buckets(F.col("g")).alias("h"), F.size("g").cast("double").alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.when(F.array_contains("h", i), 1 / F.sqrt("n")).otherwise(F.lit(0.0)))
    rows = h.select("label", array_to_vector(dense).alias("features")).coalesce(1)
    fitted = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.2, maxIter=60, standardization=False).fit(rows)
    matrix = fitted.coefficientMatrix.toArray()
    weights = [[round(float(x), 5) for x in matrix[:, b]] for b in range(BUCKETS)]
    return Model(families, weights, [float(x) for x in fitted.interceptVector], 1.0, known)


def fit(spark: SparkSession) -> Model:
    """Regression on all variants, with the temperature of least log loss on statements held out of another one.

    The model knows the n-grams of the variants; others only make a paragraph longer.
    """
    families = [UNKNOWN, *TEMPLATES]
    rows = F.from_json(F.lit(json.dumps([v | {"label": families.index(v["family"])} for v in _variants()])), "array<struct<family string, text string, held boolean, label double>>")
    data = spark.range(1).select(F.explode(rows).alias("r")).select("r.*").withColumn("g", grams(F.col("text")))
    seen = data.select("held", F.explode("g").alias("g")).groupBy("g", _bucket(F.col("g")).alias("b")).agg(F.bool_and("held").alias("held")).orderBy("g").collect()
    trial = _regression(data.filter("not held"), families, {r.g: r.b for r in seen if not r.held})
    held = data.filter("held").select("label", trial.logits(F.col("g")).alias("z"))
    choices = [0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5]
    own = F.element_at("z", F.col("label").cast("int") + 1)
    loss = lambda t: F.log(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - own) / F.lit(t))))
    losses = held.agg(*[F.avg(loss(t)).alias(f"t{i}") for i, t in enumerate(choices)]).first()
    model = _regression(data, families, {r.g: r.b for r in seen})
    model.temperature = choices[min(range(len(choices)), key=lambda i: losses[i])]
    return model


@lru_cache(maxsize=1)
def _standard() -> Model:
    """The fitted model, the same numbers in every session, so it is fitted once."""
    return fit(SparkSession.active())


def scan(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with n_paragraphs, licences and families.

    A text is cut at blank lines, or at every line break if it has none.
    licences lists, for paragraphs in which a family is found, (paragraph,
    family, probability, overlap, confirmed): the family is the likeliest class
    if that isn't unknown and has at least LEAST_PROBABILITY; it is confirmed
    if the share of n-grams common with its best template, of the smaller of
    the two, is at least LEAST_OVERLAP.  families holds the sorted confirmed
    families.  Every paragraph is judged by the model; those whose words, by
    ``Model.lifts``, can't lift any family to what it lacks are unknown for
    sure, before pairs of words are made.  Null and empty texts have no paragraphs.  Rows are neither moved nor dropped;
    clashing columns are replaced.
    """
    model = model or _standard()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    low = F.lower(body)
    parts = F.filter(F.when(F.regexp_like(low, F.lit(r"\n[ \t]*\n")), F.split(low, r"\n[ \t]*\n")).otherwise(F.split(low, "\n")), lambda p: F.regexp_like(p, F.lit(r"\S")))
    out = without(docs, ["n_paragraphs", "licences", "families"])
    out = out.withColumn("__parts", parts)
    numbered = F.transform("__parts", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    if model.bounded():
        lifts = _literal(model.lifts(), "array<double>")

        def may_win(p):
            """m different words make at least m - 1 different pairs, so the sum of what the words lift is divided by no less than sqrt(2 m - 1)."""
            start = F.struct(F.lit(0.0).alias("u"), F.lit(0).alias("m"))
            add = lambda acc, w: F.struct((acc["u"] + F.element_at(lifts, _bucket(w, SLOTS) + 1)).alias("u"), (acc["m"] + 1).alias("m"))
            found = F.array_distinct(F.array_remove(_words(p), ""))
            return F.aggregate(found, start, add, lambda acc: acc["u"] >= (1 - 1e-6) * F.sqrt(F.greatest(2 * acc["m"] - 1, F.lit(1))))

        numbered = F.filter(numbered, lambda x: may_win(x["p"]))
    out = out.withColumn("__numbered", numbered)
    out = out.withColumn("__grams", F.transform("__numbered", lambda x: F.struct(x["i"].alias("i"), grams(x["p"]).alias("g"))))
    out = out.withColumn("__probs", F.transform("__grams", lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), _best(model.logits(x["g"])).alias("b"))))
    names = _literal(model.families, "array<string>")
    best = F.transform("__probs", lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), x["b"]["q"].alias("q"), F.element_at(names, x["b"]["f"] + 1).alias("f")))
    out = out.withColumn("__best", F.filter(best, lambda x: (x["f"] != UNKNOWN) & (x["q"] >= LEAST_PROBABILITY)))
    told = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    rows = docs.sparkSession.range(1).select(*[grams(F.lit(t)).alias(f"t{i}") for i, (_, t) in enumerate(told)]).first()
    sets = _literal([{"f": f, "g": list(rows[i])} for i, (f, _) in enumerate(told)], "array<struct<f string, g array<string>>>")

    def overlap(x):
        shared = lambda t: F.size(F.array_intersect(t["g"], x["g"])) / F.greatest(F.lit(1), F.least(F.size(t["g"]), F.size(x["g"])))
        return F.coalesce(F.array_max(F.transform(F.filter(sets, lambda t: t["f"] == x["f"]), shared)), F.lit(0.0))

    met = F.transform("__best", lambda x: F.struct(x["i"].alias("paragraph"), x["f"].alias("family"), x["q"].alias("probability"), overlap(x).alias("overlap")))
    out = out.withColumn("__met", met)
    licences = F.transform("__met", lambda x: F.struct(x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), x["overlap"].alias("overlap"), (x["overlap"] >= LEAST_OVERLAP).alias("confirmed")))
    out = out.withColumn("n_paragraphs", F.size("__parts").cast("long")).withColumn("licences", licences)
    out = out.withColumn("families", F.array_sort(F.array_distinct(F.transform(F.filter("licences", lambda x: x["confirmed"]), lambda x: x["family"]))))
    return out.drop("__parts", "__numbered", "__grams", "__probs", "__best", "__met")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_licences"),
        F.size(F.filter("licences", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
        F.array_join("families", ",").alias("families"),
    )
