"""Licence scans: a trained paragraph classifier over word n-grams, with DataFrame functions only.

Training paragraphs are cut from the families' notices below (windows of several lengths, so that partial
notices are known too); paragraphs of the corpus that are unlike every notice are the class `none`. A multinomial
logistic regression with an L1 penalty over hashed words and word pairs is fitted by Spark's own JVM
implementation; its weights become one constant array that scores paragraphs inside the scan, without a
shuffle. Every paragraph is scored: first by a bound that its weights give on the probability of any licence, then,
unless the bound proves that `none` is likelier, in full. A paragraph that is likelier a licence than not, but whose best family is under a floor calibrated
on held-out windows, or which shares too little with every notice of that family, is `unknown`. The floor says nothing
of licences that no notice is like: for them the comparison with the templates decides.

Cases: null and empty texts have no paragraph; a paragraph is a line with a word. A notice that is wrapped counts once:
neighbouring licence lines are one licence up to a line that ends a sentence, of the likeliest family among them
that is not `unknown`. Letter case does not count; a notice that is repeated counts each time; repeated rows get equal
results; extra columns are ignored; an empty table gives an empty result (the class `none` then has one placeholder paragraph).
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import let, staged

#: Notices by family: openings and grant sentences as licences publish them.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License",
        "as published by the Free Software Foundation, either version 3 of the License, or at your option any later version",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
BUCKETS = 1024
#: Documents that the class `none` is sampled from, and paragraphs taken.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 2000, 2000
#: Share of the shorter one's words and pairs that a paragraph and a notice have in common: to confirm, and at most for `none`.
SHARED, UNLIKE = 0.6, 0.34


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbouring words of w."""

    def both(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
        return F.array_distinct(F.concat(w, F.coalesce(pairs, F.array().cast("array<string>"))))

    # Taken once: w is often a pattern's matches, and the pairs ask for each of its words.
    return let(w, both)


def buckets(g: Column) -> Column:
    return F.array_distinct(F.transform(g, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _notices(spark: SparkSession) -> DataFrame:
    """(family, line): one row a notice."""
    rows = [{"family": f, "line": x} for f, lines in NOTICES.items() for x in lines]
    return spark.range(1).select(F.explode(_constant(rows, "array<struct<family:string,line:string>>")).alias("n")).select("n.*")


def _windows(notices: DataFrame) -> DataFrame:
    """(family, w): every window of 4, 6, 9 and 14 words that only one family's notices have, and each whole notice."""
    w = words(F.col("line"))
    cut = [F.when(F.size("w") > k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i, k=k: F.slice("w", i, k))) for k in (4, 6, 9, 14)]
    none = F.array().cast("array<array<string>>")
    every = F.concat(F.array("w"), *(F.coalesce(c, none) for c in cut))
    cut = notices.select("family", w.alias("w")).select("family", F.explode(every).alias("w"))
    # Wording that families share says nothing about which one it is.
    return cut.groupBy("w").agg(F.min("family").alias("family"), F.count_distinct("family").alias("n")).where("n = 1").select("family", "w")


def _known() -> Column:
    """The notices with their words and pairs, as a constant."""
    notices = [{"family": f, "grams": _grams(x)} for f, lines in NOTICES.items() for x in lines]
    return _constant(notices, "array<struct<family:string,grams:array<string>>>")


def _share(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


class Scanner:
    """The fitted classifier as constants: weights, families, floor."""

    def __init__(self, families: list[str], weights: list[list[float]], bias: list[float], floor: float):
        self.families, self.weights, self.bias, self.floor = families, weights, bias, floor

    def _bounds(self) -> tuple[float, list[float]]:
        """(start, a step a bucket): where start and the steps of a paragraph's buckets do not pass 0, `none` has half or more.

        A family's odds against `none` are exp(bias + its weights over those of `none`); every weight is at most the bucket's largest.
        """
        start = math.log(sum(math.exp(b - self.bias[0]) for b in self.bias[1:]))
        return start, [max(w[1:]) - w[0] for w in self.weights]

    def possible(self, b: Column) -> Column:
        """Whether a paragraph with these buckets can be a licence; false only if it provably cannot."""
        start, steps = self._bounds()
        table = _constant(steps, "array<double>")
        # The sums of both ways round differently, by far less than this.
        return F.aggregate(b, F.lit(start), lambda acc, i: acc + F.get(table, i)) > -1e-6

    def _probabilities(self, b: Column) -> Column:
        table = _constant(self.weights, "array<array<double>>")
        raw = F.aggregate(b, _constant(self.bias, "array<double>"), lambda acc, i: F.zip_with(acc, F.get(table, i), lambda a, b: a + b))
        grown = let(raw, lambda r: F.transform(r, lambda x: F.exp(x - F.array_max(r))))
        return let(grown, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

    def paragraph(self, line: Column) -> Column:
        """struct(family, p): family is null for no licence, else a family's name or unknown."""
        known = _known()
        names = F.array(*(F.lit(f) for f in self.families))

        def judge(g: Column, b: Column) -> Column:
            def of(p: Column) -> Column:
                best = F.array_max(F.slice(p, 2, len(self.families)))
                family = F.get(names, (F.array_position(F.slice(p, 2, len(self.families)), best) - 1).cast("int"))
                close = F.exists(known, lambda n: (n["family"] == family) & (_share(g, n["grams"]) >= SHARED))
                sure = (best / F.greatest(1 - F.get(p, F.lit(0)), F.lit(1e-12)) >= self.floor) & close
                return F.struct(F.when(F.get(p, F.lit(0)) < 0.5, F.when(sure, family).otherwise("unknown")).alias("family"), best.alias("p"))

            # Without a word there are no buckets, and no paragraph.
            return F.when((F.size(b) > 0) & self.possible(b), let(self._probabilities(b), of))

        return let(grams(words(line)), lambda g: let(buckets(g), lambda b: judge(g, b)))

    def scan(self, docs: DataFrame) -> DataFrame:
        """docs with licences: array of struct(line number from 0, n_lines, family, p), in order."""
        lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
        ended = lambda x: F.rlike(x, F.lit(r"[.!?:;]\s*$"))
        judged = F.transform(lines, lambda x, i: F.struct(i.alias("line"), ended(x).alias("ended"), self.paragraph(x).alias("j")))
        return docs.withColumn("licences", let(F.filter(judged, lambda x: x["j"]["family"].isNotNull()), _joined))


def _joined(hits: Column) -> Column:
    """Licence lines (line, ended, j) as licences: lines that follow one that does not end a sentence belong to it."""

    def whole(first: Column, stop: Column) -> Column:
        rank = lambda x: F.struct((x["j"]["family"] != "unknown").alias("known"), x["j"]["p"].alias("p"), x["j"]["family"].alias("family"))
        best = let(F.slice(hits, first + 1, stop - first), lambda run: F.array_max(F.transform(run, rank)))
        return let(best, lambda b: F.struct(F.get(hits, first)["line"].alias("line"), (stop - first).alias("n_lines"), b["family"].alias("family"), b["p"].alias("p")))

    def goes_on(i: Column) -> Column:
        return (i > 0) & ~F.get(hits, i - 1)["ended"] & (F.get(hits, i - 1)["line"] + 1 == F.get(hits, i)["line"])

    starts = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: ~goes_on(i))
    every = let(starts, lambda s: F.transform(s, lambda i, k: whole(i, F.coalesce(F.get(s, k + 1), F.size(hits)))))
    # Of an empty array a sequence would run backwards.
    return F.when(F.size(hits) == 0, F.array().cast("array<struct<line:int,n_lines:int,family:string,p:double>>")).otherwise(every)


def _grams(line: str) -> list[str]:
    import re

    w = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", line.lower())
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


def fit(docs: DataFrame, error: float = 0.02) -> Scanner:
    """Train on the notices' windows and a bounded sample of paragraphs (SAMPLE_DOCS, SAMPLE_PARAGRAPHS).

    Sampled paragraphs that share little with every notice are the class `none`.
    The floor is the `error` quantile of the true family's probability on windows that were held out of training.
    """
    spark = docs.sparkSession
    hashed = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    # The texts with the lowest hashes; copies of a text are one.
    top = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    few = hashed.where(F.col("h") <= F.lit(top)).dropDuplicates(["h"])
    # Lines are hashed to a limit, so a few very long texts cannot fill the sample.
    lines = few.select("h", F.explode(F.split("text", "\n")).alias("line")).distinct().orderBy(F.xxhash64("h", "line"), "line").limit(SAMPLE_PARAGRAPHS)
    sample = staged(lines.select(words(F.col("line")).alias("w")).where(F.size("w") > 0), "paragraphs")
    notices = _notices(spark)
    plain = sample.where(let(grams(F.col("w")), lambda g: ~F.exists(_known(), lambda n: _share(g, n["grams"]) >= UNLIKE)))
    positive = _windows(notices)
    families = list(NOTICES)
    names = F.array(*(F.lit(f) for f in families))
    negative = plain.select(F.lit(0.0).alias("label"), "w").union(spark.range(1).select(F.lit(0.0), F.array(F.lit("nothing"))))
    rows = positive.select(F.array_position(names, F.col("family")).cast("double").alias("label"), "w").union(negative)
    hot = let(buckets(grams(F.col("w"))), lambda b: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains(b, i).cast("double")))
    rows = rows.withColumn("held", (F.pmod(F.xxhash64("w"), F.lit(5)) == 0) & (F.col("label") > 0))
    data = staged(rows.select("label", "w", "held", hot.alias("x")).coalesce(4), "training").withColumn("features", array_to_vector("x"))
    model = LogisticRegression(family="multinomial", maxIter=50, regParam=5e-5, elasticNetParam=1.0, standardization=False).fit(data.where(~F.col("held")))
    matrix = model.coefficientMatrix.toArray().T.round(6).tolist()
    found = Scanner(families, matrix, model.interceptVector.toArray().tolist(), 0.0)
    p = found._probabilities(buckets(grams(F.col("w"))))
    truth = F.get(p, F.col("label").cast("int")) / F.greatest(1 - F.get(p, F.lit(0)), F.lit(1e-12))
    floor = data.where("held").agg(F.percentile_approx(truth, error).alias("q")).first().q
    found.floor = min(0.5, floor) if floor is not None else 0.5
    return found


def op4_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_licences, n_unknown, families (distinct, sorted, comma-joined)."""
    scanned = fit(docs).scan(docs.select("doc_id", "text"))
    families = F.transform("licences", lambda x: x["family"])
    return scanned.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.size(F.filter(families, lambda f: f == "unknown")).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(families)), ",").alias("families"),
    )
