"""Licence scan (operator 8): Dice coefficient over word bigrams between texts and licence templates.

DataFrame functions only. Every line of a document, and the document as a whole, is normalised (lower case, runs of
other characters than a-z and 0-9 become one space) and compared as a bag of word bigrams. A Dice coefficient of t needs
bag sizes within a factor of (2 - t) / t of each other: units outside the bounds of all templates are dropped before any
bigram is made, and each of the others meets only the templates whose bounds it is in. It also needs t / (2 - t) of a
template's bigrams, so words that cover the rest of them and one more (``anchors``) cannot all be missing: texts and units
without any of these words are dropped as well. Both bounds are exact. Only bigrams that some template has are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Notices of common public licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                         "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                      "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved.",
}
NUM, DEN = 80, 100


def template_bigrams(spark, templates: dict[str, str]) -> DataFrame:
    """(license, size, bigram, times) of the templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return (rows.select("license", words.alias("w")).select("license", (F.size("w") - 1).alias("size"), F.explode(bigrams("w")).alias("bigram"))
            .groupBy("license", "size", "bigram").agg(F.count(F.lit(1)).alias("times")))


def bigrams(words: str):
    w = F.col(words)
    return F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, license, dice, line, n_units) for every row of ``docs``.

    The best template at Dice num / den or more, where it stands (line from 0; -1: the whole text), and how many units of
    the document matched any template. Ties go to the smaller line, then the smaller name. Null and empty texts, and texts
    without a match, have a null licence and 0 units. Rows that share an id are one document and get its result each.
    """
    spark = docs.sparkSession
    found = template_bigrams(spark, TEMPLATES if templates is None else templates)
    sizes = sorted({len(normal(t)) - 1 for t in (TEMPLATES if templates is None else templates).values()})
    fits = [(s * num + 2 * den - num - 1) // (2 * den - num) for s in sizes], [s * (2 * den - num) // num for s in sizes]
    words = anchors(TEMPLATES if templates is None else templates, num, den)
    # ``low`` comes out of a generator, so the conditions on it do not each lower the text again
    low = docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))
    held = F.lit(False)
    for word in words:
        held = held | F.contains("low", F.lit(word))
    lines = low.where(held).select("doc_id", F.regexp_replace("low", "[^a-z0-9\n]+", " ").alias("t"))
    # words are split inside the generator: the filter on their number then reads a column and computes nothing again
    split = F.transform(F.concat(F.split("t", "\n"), F.when(F.contains("t", F.lit("\n")), F.array(F.regexp_replace("t", "\n", " "))).otherwise(F.array())),
                        lambda u: F.split(F.trim(F.regexp_replace(u, " +", " ")), " "))
    lines = (lines.select("doc_id", (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).alias("breaks"), F.posexplode(split).alias("i", "w")))
    size = F.size("w") - 1
    some = F.lit(False)
    for lo, hi in zip(*fits, strict=True):
        some = some | size.between(lo, hi)
    units = lines.where(some & F.arrays_overlap("w", F.array(*[F.lit(x) for x in words]))).select("doc_id", F.when(F.col("i") > F.col("breaks"), -1).otherwise(F.col("i")).alias("line"), "w")
    made = units.select("doc_id", "line", size.alias("n"), F.explode(bigrams("w")).alias("bigram"))
    met = (made.join(found, "bigram").where((F.col("n") * num <= F.col("size") * (2 * den - num)) & (F.col("size") * num <= F.col("n") * (2 * den - num)))
           .groupBy("doc_id", "line", "n", "license", "size", "bigram", "times").agg(F.count(F.lit(1)).alias("here"))
           .groupBy("doc_id", "line", "n", "license", "size").agg(F.sum(F.least("here", "times")).alias("common"))
           .where(2 * F.col("common") * den >= num * (F.col("n") + F.col("size")))
           .withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("size"))))
    best = met.groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("d"), "line", "license")).alias("b"), F.count_distinct("line").alias("n_units"))
    return (docs.select("doc_id").join(best, "doc_id", "left")
            .select("doc_id", "b.license", (-F.col("b.d")).alias("dice"), "b.line", F.coalesce("n_units", F.lit(0)).alias("n_units")))


def anchors(templates: dict[str, str], num: int, den: int) -> list[str]:
    """Words of which every text that is similar enough to a template has at least one: for each template, long words
    first, until the bigrams with none of them are fewer than a match must share."""
    chosen: set[str] = set()
    for text in templates.values():
        w = normal(text)
        pairs = list(zip(w, w[1:]))
        need = -(-len(pairs) * num // (2 * den - num))
        for word in sorted(set(w), key=lambda x: (x not in chosen, len(x) < 6, -sum(x in p for p in pairs), x)):
            if sum(not chosen & set(p) for p in pairs) < need:
                break
            if any(word in p and not chosen & set(p) for p in pairs):
                chosen.add(word)
    return sorted(chosen)


def normal(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def oracle(templates: dict[str, str] | None = None, num: int = NUM, den: int = DEN) -> str:
    values = ", ".join("('" + name + "', '" + " ".join(normal(t)) + "')" for name, t in sorted((TEMPLATES if templates is None else templates).items()))
    return f"""
WITH tpl AS (SELECT * FROM (VALUES {values}) v(license, text)),
tw AS (SELECT license, string_split(text, ' ') w FROM tpl),
tb AS (SELECT license, len(w) - 1 AS size, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigram FROM tw),
t AS (SELECT license, size, bigram, count(*) AS times FROM tb GROUP BY ALL),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS c FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(string_split(c, chr(10))))) AS line, unnest(string_split(c, chr(10))) AS u FROM d
      UNION ALL SELECT doc_id, -1, replace(c, chr(10), ' ') FROM d WHERE contains(c, chr(10))),
u AS (SELECT doc_id, line, string_split(trim(regexp_replace(u, ' +', ' ', 'g')), ' ') AS w FROM l),
b AS (SELECT doc_id, line, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigram FROM u
      WHERE len(w) - 1 <= (SELECT max(size) FROM t) * {(2 * den - num) / num}),
h AS (SELECT doc_id, line, n, bigram, count(*) AS here FROM b GROUP BY ALL),
m AS (SELECT doc_id, line, license, 2.0::DOUBLE * sum(least(here, times)) / (n + size) AS dice, sum(least(here, times)) AS common, n, size
      FROM h JOIN t USING (bigram) GROUP BY doc_id, line, n, license, size HAVING 2 * sum(least(here, times)) * {den} >= {num} * (n + size)),
best AS (SELECT doc_id, license, dice, line, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, license) AS r FROM m),
cnt AS (SELECT doc_id, count(DISTINCT line) AS k FROM m GROUP BY doc_id)
SELECT x.doc_id, best.license, best.dice, best.line, coalesce(cnt.k, 0) AS n_units
FROM documents x LEFT JOIN best ON x.doc_id = best.doc_id AND best.r = 1 LEFT JOIN cnt ON x.doc_id = cnt.doc_id"""
