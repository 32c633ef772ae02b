"""Licence statements by Dice similarity of word bigrams.

Texts are normalised (lower case; all but a-z and 0-9 are blanks) and taken
as units: each line, each paragraph of several lines, and the whole text. A
unit matches a template if the Dice coefficient of their bigram sets is at
least ``threshold``. That bounds the size: |unit| lies between t / (2 - t) and
(2 - t) / t times |template|, and at least t (|unit| + |template|) / 2 bigrams
are shared, so units without so many bigrams known to any template (and, before these are
formed, units with too many words that no template has) go before the join, and the join looks at templates of fitting size alone.
The same bound prunes templates for whole texts: words that take part in more than (1 - t / (2 - t)) |template|
bigrams are chosen for each (``anchors``); a text with none of them matches nothing and is not cut into units.

Null and empty texts have no unit and no match; a unit of one word has no
bigram. Ties go to the template whose name sorts first. Rows are told apart by
position in the table. All of it is built-in expressions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import documents, materialize

# Short statements and standard notices of common licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}


def normalised_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> set[str]:
    w = normalised_words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, int, int, list[str]]]:
    """(licence, number, size, bigrams) of each template."""
    texts = [(name, t) for name, many in sorted(templates.items()) for t in many]
    return [(name, i, len(bigrams(t)), sorted(bigrams(t))) for i, (name, t) in enumerate(texts)]


def anchors(templates: list[tuple[str, int, int, list[str]]], threshold: float) -> list[str]:
    """Words of which every match holds at least one: without them too few of
    any template's bigrams are left. Words that serve many templates first."""
    open_ = [{tuple(b.split()) for b in bs} for *_, bs in templates]
    need = [threshold / (2 - threshold) * len(bs) - 1e-9 for bs in open_]
    chosen: list[str] = []
    while any(len(bs) >= n for bs, n in zip(open_, need)):
        gain = Counter(w for bs, n in zip(open_, need) if len(bs) >= n for b in bs for w in set(b))
        best = max(gain, key=lambda w: (len(w) >= 6, gain[w], w))
        chosen.append(best)
        open_ = [{b for b in bs if best not in b} for bs in open_]
    return chosen


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """row, doc_id and matches: array of (licence, dice, unit) of every document;
    unit is the line's number from 1, 0 for the whole text, or minus the
    paragraph's number."""
    spark = docs.sparkSession
    rows = template_rows(templates or TEMPLATES)
    known = sorted({b for *_, bs in rows for b in bs})
    least = min(math.ceil(threshold / (2 - threshold) * n - 1e-9) for _, _, n, _ in rows)
    shared = min(math.ceil(threshold * n / (2 - threshold) - 1e-9) for _, _, n, _ in rows)
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9\n]+", " ").alias("text"))

    def numbered(parts, sign):
        return F.transform(parts, lambda x, i: F.struct((sign * (i + 1)).cast("int").alias("unit"), x.alias("text")))

    paragraphs = F.filter(numbered(F.split("text", "\n[ \n]*\n"), -1), lambda u: F.contains(u["text"], F.lit("\n")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.struct(F.lit(0).alias("unit"), F.col("text").alias("text")))
                   ).otherwise(F.array().cast("array<struct<unit:int,text:string>>"))
    vocabulary = sorted({w for b in known for w in b.split()})

    def word_list(u):
        return F.struct(u["unit"].alias("unit"), F.filter(F.split(F.translate(u["text"], "\n", " "), " "),
                                                          lambda x: x != "").alias("w"))

    # Of n bigrams at least t / (2 - t) n are known, and every two unknown
    # words make one more that is not: few units have so few unknown words.
    strange = 2 * (1 - threshold / (2 - threshold))

    def familiar(u):
        unknown = F.array_distinct(F.filter(u["w"], lambda x: ~x.isin(vocabulary)))
        return (F.size(u["w"]) > least) & (F.size(unknown) <= strange * (F.size(u["w"]) - 1) + 1e-9)

    def describe(u):
        w = u["w"]
        pair = F.array_distinct(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))),
                                           lambda x, y: F.when(y.isNotNull(), F.concat_ws(" ", x, y))))
        pair = F.filter(pair, lambda x: x.isNotNull())
        return F.struct(u["unit"].alias("unit"), F.size(pair).alias("n"), F.filter(pair, lambda x: x.isin(known)).alias("b"))

    # a unit of m characters has at most (m - 1) / 2 bigrams
    units = F.filter(F.concat(numbered(F.split("text", "\n"), 1), paragraphs, whole),
                     lambda u: F.length(u["text"]) >= 2 * least + 1)
    found = F.filter(F.transform(F.filter(F.transform(units, word_list), familiar), describe), lambda u: F.size(u["b"]) >= shared)
    likely = reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in anchors(rows, threshold)])
    base = materialize(base.select("row", "doc_id", F.when(likely, found).alias("found")), "licences")
    pairs = base.select("row", F.explode("found").alias("u")).select("row", "u.unit", "u.n", "u.b")
    # templates are constants of the module: their bigrams are a bounded table
    index = F.broadcast(spark.createDataFrame([(name, i, n, b) for name, i, n, bs in rows for b in bs],
                                              "licence string, template int, size int, b string"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    hits = (pairs.select("row", "unit", "n", F.explode("b").alias("b")).join(index, "b")
            .where((F.col("n") >= low * F.col("size") - 1e-9) & (F.col("n") <= high * F.col("size") + 1e-9))
            .groupBy("row", "unit", "n", "licence", "template", "size").agg(F.count(F.lit(1)).alias("common")))
    dice = 2 * F.col("common") / (F.col("n") + F.col("size")).cast("double")
    best = (hits.withColumn("dice", dice).where(F.col("dice") >= threshold).groupBy("row", "unit", "licence")
            .agg(F.max("dice").alias("dice")).groupBy("row")
            .agg(F.sort_array(F.collect_list(F.struct("licence", "dice", "unit"))).alias("matches")))
    return base.select("row", "doc_id").join(best, "row", "left")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences named in every whole document: n_matches, licences, best_dice."""
    return scan(documents(spark, sf_dir)).select(
        "doc_id", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_distinct(F.transform("matches", lambda m: m["licence"])), ","), F.lit("")).alias("licences"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"))
