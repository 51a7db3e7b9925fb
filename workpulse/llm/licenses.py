"""License scans: units of normalised text against license templates by the Dice coefficient over word bigrams.

All of it is expressions over a row: no Python on the executors, no join, no shuffle. A unit is a line, or a paragraph
of several lines (blank lines part them). With a bigrams in a unit and b in a template, Dice 2 s / (a + b) >= t needs
t / (2 - t) b <= a <= (2 - t) / t b; templates outside these bounds are pruned before bigrams are compared. Texts
without any anchor word are pruned first: the bigrams of a template that hold an anchor are so many that any match
has at least one of them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Notices and opening passages of well-known licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.translate({ord(c): ord(c.lower()) for c in LETTERS})).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and most bigrams of a unit that can match a template of ``n``."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9), math.floor((2 - threshold) / threshold * n + 1e-9)


def anchors(templates: list[list[str]], threshold: float) -> list[str]:
    """Words such that each template has more bigrams with one of them than a match can lack."""
    needed = [len(b) - math.ceil(threshold / (2 - threshold) * len(b) - 1e-9) + 1 for b in templates]
    chosen: list[str] = []
    open_bigrams = [list(b) for b in templates]
    while any(n > 0 for n in needed):
        gain: dict[str, int] = {}
        for b, n in zip(open_bigrams, needed):
            if n > 0:
                for word in {w for x in b for w in x.split() if len(w) >= 3 or all(len(y) < 3 for y in x.split())}:
                    gain[word] = gain.get(word, 0) + min(n, sum(word in x.split() for x in b))
        word = max(gain, key=lambda w: (gain[w], len(w), w))
        chosen.append(word)
        for i, b in enumerate(open_bigrams):
            needed[i] -= sum(word in x.split() for x in b)
            open_bigrams[i] = [x for x in b if word not in x.split()]
    return chosen


def lowered(text: Column) -> Column:
    return F.translate(text, LETTERS, LETTERS.lower())


def units(text: Column) -> Column:
    paragraphs = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(F.split(text, "\n"), paragraphs)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bigrams(unit: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(unit, "[^a-z0-9\\x{80}-\\x{10ffff}]+", " ")), " ")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(bound(words, pairs))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id and ``matches``, an array of (license, dice, unit), best first (ties: by license, then unit).

    Each unit of Dice ``threshold`` or more with a template is a match, once for a license, by its best template. Units
    are numbered from 0, lines before paragraphs. A null or empty text has no match; nor has a unit, or a template, of
    fewer than two words. A repeated row gives a row each; an empty table none. ``templates`` is a list in the plan,
    so keep it to some hundreds.
    """
    known = [(name, b) for name, text in templates if (b := template_bigrams(text))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "array<struct<license:string,dice:double,unit:int>>"
    if not known:
        return rows.select(F.col("id").alias(id_col), F.array().cast(kind).alias("matches"))
    listed = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), *(F.lit(x).alias(y) for x, y in zip(bounds(len(b), threshold), ("low", "high"))), F.array(*map(F.lit, b)).alias("bigrams")) for name, b in known))
    words = anchors([b for _, b in known], threshold)

    def anchored(text: Column) -> Column:
        found = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(text, F.lit(word))
        return found

    def of_unit(unit: Column, number: Column) -> Column:
        def scored(found: Column) -> Column:
            n = F.size(found)
            dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(found, t["bigrams"])) / (n + t["n"])
            fitting = F.filter(listed, lambda t: (n >= t["low"]) & (n <= t["high"]))
            each = F.transform(fitting, lambda t: F.struct(t["license"].alias("license"), dice(t).alias("dice"), number.cast("int").alias("unit")))
            return F.filter(each, lambda m: m["dice"] >= threshold - 1e-12)

        return F.when(anchored(unit), bound(bigrams(unit), scored)).otherwise(F.array().cast(kind))

    key = lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"), m["unit"].alias("unit"))
    once = lambda ms: F.filter(ms, lambda m, i: ~F.exists(F.slice(ms, 1, i), lambda o: (o["license"] == m["license"]) & (o["unit"] == m["unit"])))
    every = F.flatten(F.transform(bound(lowered(F.col("text")), units), of_unit))
    ordered = bound(F.array_sort(F.transform(every, key)), once)
    matches = F.transform(ordered, lambda m: F.struct(m["license"].alias("license"), (-m["d"]).alias("dice"), m["unit"].alias("unit")))
    none = F.array().cast(kind)
    return rows.select(F.col("id").alias(id_col), F.when(F.coalesce(bound(F.lower("text"), anchored), F.lit(False)), matches).otherwise(none).alias("matches"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    best = F.get("matches", F.lit(0))
    listed = F.array_join(F.transform(F.array_sort(F.transform("matches", lambda m: F.struct(m["unit"].alias("unit"), m["license"].alias("license")))), lambda m: F.concat(m["unit"].cast("string"), F.lit(":"), m["license"])), ",")
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"),
        F.round(best["dice"], 9).alias("dice"), listed.alias("matches"),
    )


def sql() -> str:
    """DuckDB SQL for the rows of ``op1_license_scan``."""
    values = ", ".join(f"({i}, '{name}', [{', '.join(repr(x) for x in b)}])" for i, (name, b) in enumerate((n, template_bigrams(t)) for n, t in TEMPLATES))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH templates(no, license, bigrams) AS (VALUES {values}),
texts AS (SELECT doc_id, translate(text, '{LETTERS}', '{LETTERS.lower()}') AS text FROM documents),
unit_lists AS (SELECT doc_id, list_concat(string_split(text, chr(10)), list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10)))) AS units FROM texts WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) - 1 AS no FROM unit_lists),
split AS (SELECT doc_id, no, string_split(trim(regexp_replace(unit, '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g')), ' ') AS words FROM numbered
  WHERE contains(unit, 'licen') OR contains(unit, 'copyright') OR contains(unit, 'software') OR contains(unit, 'permi') OR contains(unit, 'redistribution') OR contains(unit, 'modif')),
pairs AS (SELECT doc_id, no, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams FROM split),
scored AS (SELECT p.doc_id, p.no AS unit, t.license, max(2.0::DOUBLE * len(list_intersect(p.bigrams, t.bigrams)) / (len(p.bigrams) + len(t.bigrams))) AS dice
  FROM pairs p JOIN templates t ON len(p.bigrams) BETWEEN {low} * len(t.bigrams) - 1e-9 AND {high} * len(t.bigrams) + 1e-9 GROUP BY ALL),
matched AS (SELECT * FROM scored WHERE dice >= {THRESHOLD} - 1e-12),
by_doc AS (SELECT doc_id, count(*) AS n_matches, arg_min(license, (-dice, license, unit)) AS license, round(max(dice), 9) AS dice, string_agg(unit || ':' || license, ',' ORDER BY unit, license) AS matches FROM matched GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n_matches, 0)::BIGINT AS n_matches, b.license, b.dice, coalesce(b.matches, '') AS matches FROM documents d LEFT JOIN by_doc b ON b.doc_id = d.doc_id
"""
