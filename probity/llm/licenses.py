"""Licence scans: Dice coefficient over word bigrams against templates.

Units of a text are its lines, its paragraphs of several lines, and the whole. A
unit is normalised (A-Z lower-cased, all but a-z and 0-9 made blanks) and
compared with the templates by 2 * common / (own + template's), over distinct
word bigrams. Templates are pruned by size: at a coefficient of t a unit has
between t / (2 - t) and (2 - t) / t times the template's bigrams, and by
pigeonhole holds one of any share above 1 - t / (2 - t) of the template's bigrams.
Such a share of each template, its anchors, lies around its longest words; texts
and units without any of these words are left out before they are normalised, and
units without an anchor before they are joined. All of it is DataFrame
expressions; the templates are a fixed table of a few rows.

Edge cases. Null, empty or blank texts and units of fewer than two words match
nothing. Null doc_id is a group of its own. Rows with one doc_id are reported
together. A unit counts for its nearest template, of equals the first by name. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.shared import ASCII_LOWER, ASCII_UPPER, lower_ascii

# Notices as their licences' publishers ask to write them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
}


def _template_bigrams(text: str) -> list[str]:
    words = "".join(c if c in ASCII_LOWER or c.isdigit() else " " for c in text.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def bigrams(normal: Column) -> Column:
    """Distinct word bigrams of a normalised unit."""
    words = F.split(normal, " ")
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "))


def _anchors(sets: dict[str, list[str]], share: float) -> tuple[list[str], list[str]]:
    """Anchor bigrams of all templates, around each one's longest words; and words
    one of which stands in every anchor."""
    anchors, words = set(), set()
    for own in sets.values():
        need, taken = floor((1 - share) * len(own)) + 1, set()
        for word in sorted({w for b in own for w in b.split()}, key=lambda w: (-len(w), w)):
            if len(taken) >= need:
                break
            words.add(word)
            taken |= {b for b in own if word in b.split()}
        anchors |= taken
    return sorted(anchors), sorted(words)


def _once(value: Column) -> Column:
    """The value, computed once for each row: filters above don't compute it again."""
    return F.explode(F.array(value))


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document and licence found: doc_id, license, units (how many of its
    distinct units match) and dice (the best coefficient)."""
    spark = docs.sparkSession
    sets = {name: _template_bigrams(text) for name, text in templates.items()}
    share = threshold / (2 - threshold)
    anchors, words = _anchors(sets, share)
    least, most = min(map(len, sets.values())) * share, max(map(len, sets.values())) / share
    table = spark.createDataFrame([(name, s, len(s)) for name, s in sets.items()], "license string, template array<string>, m int")
    holds = lambda c: reduce(lambda a, w: a | F.contains(c, F.lit(w)), words[1:], F.contains(c, F.lit(words[0])))

    # lower() changes no letter a-z or digit of a normalised text, so no text with an anchor is lost
    texts = docs.select("doc_id", "text", _once(F.lower("text")).alias("low")).where(holds(F.col("low")))
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = texts.select("doc_id", F.explode(F.array_distinct(F.concat(lines, paragraphs, F.array("text")))).alias("unit"))
    normal = units.select("doc_id", "unit", _once(normalise(F.col("unit"))).alias("normal")).where(holds(F.col("normal")))
    own = normal.select("doc_id", "unit", _once(bigrams(F.col("normal"))).alias("own")).withColumn("n", F.size("own"))
    own = own.where((F.col("n") >= least) & (F.col("n") <= most)).where(F.arrays_overlap("own", F.array(*map(F.lit, anchors))))
    pairs = own.join(F.broadcast(table), (F.col("n") >= F.col("m") * share - 1e-9) & (F.col("n") <= F.col("m") / share + 1e-9))
    dice = 2.0 * F.size(F.array_intersect("own", "template")) / (F.col("n") + F.col("m"))
    near = pairs.select("doc_id", "unit", "license", dice.alias("dice")).where(F.col("dice") >= threshold)
    best = near.groupBy("doc_id", "unit").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"))
    found = best.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("units"), F.round(F.max("dice"), 6).alias("dice"))


def oracle_sql(threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> str:
    """The same result from DuckDB, every unit against every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in templates.items())
    normal = lambda c: f"trim(regexp_replace(translate({c}, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates AS (
  SELECT name AS license, {grams} AS template FROM (SELECT name, string_split({normal('body')}, ' ') AS w FROM (VALUES {rows}) AS t(name, body))),
texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS paragraphs FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat(lines, list_concat(list_filter(paragraphs, lambda p: contains(p, chr(10))), [text])))) AS unit FROM texts),
own AS (SELECT doc_id, unit, {grams} AS own FROM (SELECT doc_id, unit, string_split({normal('unit')}, ' ') AS w FROM units)),
scored AS (
  SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(own, template)) / (len(own) + len(template)) AS dice
  FROM own, templates WHERE len(own) > 0 AND len(own) <= 3 * len(template)),
best AS (SELECT * FROM scored WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1)
SELECT doc_id, license, count(*)::BIGINT AS units, round(max(dice), 6) AS dice FROM best GROUP BY doc_id, license
"""
