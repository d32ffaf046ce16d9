"""License scans by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words once, with marks where sentences, lines
and paragraphs (blank lines) end. Compared are the paragraphs of several
sentences, the sentences, with wrapped lines joined, and the single lines of wrapped
sentences; templates are cut the same way. A unit and a template unit match when
the Dice coefficient of their distinct word bigrams reaches the threshold t. As
that needs t * m / (2 - t) <= n <= m * (2 - t) / t for n and m bigrams, templates
are indexed by the sizes they can match, and a unit meets only templates listed
under its own size. For the same reason t / (2 - t) of the bigrams of a unit occur
in some template; other units are left out before the join. Likewise t / (2 - t) of
the bigrams of a template occur in a unit it matches, so at least one of any
m - ceil(t * m / (2 - t)) + 1 of them: the longest words of as many bigrams are
anchors, and paragraphs without an anchor are not cut into units.

Defined results: null and empty texts and units of fewer than two words match
nothing; rows of one id (null is an id, too) count as one document; repeated rows
and units count repeatedly in ``n_matches``; without rows or templates there are no
matches; columns besides ``doc_id`` and ``text`` are ignored; control characters 1
to 3 end a sentence, a line, a paragraph.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.llm.common import text_or_empty

THRESHOLD = 0.8
MAX_BROADCAST_ROWS = 100_000
MAX_KNOWN = 10_000  # bigrams of templates that are sent along as a filter; more are not filtered

# Public short notices and opening sentences of licences.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD", "Licensed under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose is granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Public texts and usual notices of licences, a paragraph each.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES + TEXTS, "license_id string, text string")


def marked(text: Column) -> Column:
    """Lower-case words between blanks; characters 1, 2 and 3 end a sentence, a line, a paragraph."""
    text = F.regexp_replace(F.lower(text), "\\n[ \\t\\r]*\\n", "\x03")
    text = F.regexp_replace(text, "([.!?])[ \\t\\r\\n]+", "$1\x01")
    text = F.replace(text, F.lit("\n"), F.lit("\x02"))
    return F.regexp_replace(text, "[^\\p{L}\\p{N}\\x01-\\x03]+", " ")


def units(paragraph: Column) -> Column:
    """What is compared of a marked paragraph: itself, its sentences, the lines of wrapped sentences."""
    sentences = F.filter(F.split(paragraph, "\x01"), lambda s: F.trim(F.translate(s, "\x02", " ")) != "")
    several = F.when(F.size(sentences) > 1, F.array(paragraph)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(sentences, lambda s: s.contains("\x02"))
    return F.concat(several, sentences, F.flatten(F.transform(lines, lambda s: F.split(s, "\x02"))))


def words_of(unit: Column) -> Column:
    return F.split(F.trim(F.translate(unit, "\x01\x02", "  ")), " +")


def bigrams(words: str) -> Column:
    """Distinct pairs of neighbours in an array column; none for fewer than two words."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.size(words)),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(pairs)


def anchor_words(pairs: list[str], threshold: float) -> set[str]:
    """Words of which every unit that matches a template of these bigrams holds at least one."""
    spare = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
    longest = sorted((max(p.split(" "), key=lambda w: (len(w), w)) for p in pairs), key=lambda w: (-len(w), w))
    return set(longest[:spare + 1])


def _cut(df: DataFrame, key: str, shortest: int, longest: int, anchors: list[str] | None = None) -> DataFrame:
    """Units with ``shortest`` to ``longest`` bigrams, of paragraphs with an anchor if any are given: key, pairs, n."""
    cut = df.select(key, F.explode(F.split(marked(text_or_empty()), "\x03")).alias("paragraph"))
    if anchors is not None:
        cut = cut.filter(F.exists(F.split("paragraph", "[ \\x01\\x02]+"), lambda w: w.isin(anchors)))
    words = cut.select(key, F.explode(units(F.col("paragraph"))).alias("unit")).select(key, words_of(F.col("unit")).alias("words"))
    pairs = words.filter(F.size("words") > shortest).select(key, bigrams("words").alias("pairs")).withColumn("n", F.size("pairs"))
    return pairs.filter(F.col("n").between(shortest, longest))


def size_index(templates: DataFrame, threshold: float) -> DataFrame:
    """(n, license_id, m, template): every template under each size it can match."""
    parts = _cut(templates, "license_id", 1, 2**31 - 1).distinct()
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = F.sequence(F.ceil(F.col("n") * low - 1e-9).cast("int"), F.floor(F.col("n") * high + 1e-9).cast("int"))
    return parts.select(F.explode(sizes).alias("n"), "license_id", F.col("n").alias("m"),
                        F.col("pairs").alias("template"))


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license_id, n_matches, best_dice) of all matches."""
    index = size_index(templates, threshold)
    seen = index.agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    small, low, high = seen["rows"] <= MAX_BROADCAST_ROWS, seen["low"] or 1, seen["high"] or 0
    known = index.select("template").distinct() if small else None
    if known is not None and (known.agg(F.sum(F.size("template"))).first()[0] or 0) <= MAX_KNOWN:
        parts = [r["template"] for r in known.collect()]
        anchors = set().union(*(anchor_words(p, threshold) for p in parts))
        found = _cut(docs, "doc_id", low, high, sorted(anchors))
        met = F.size(F.filter("pairs", lambda p: p.isin(sorted(set().union(*parts)))))
        found = found.filter(met >= F.col("n") * (threshold / (2 - threshold)) - 1e-9)
    else:
        found = _cut(docs, "doc_id", low, high)
    dice = 2.0 * F.size(F.array_intersect("pairs", "template")) / (F.col("n") + F.col("m"))
    return (
        found.join(F.broadcast(index) if small else index, "n")
        .withColumn("dice", dice)
        .filter(F.col("dice") >= threshold)
        .groupBy("doc_id", "license_id")
        .agg(F.count("*").alias("n_matches"), F.max("dice").alias("best_dice"))
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _cut_sql(name: str, key: str, given: str) -> str:
    blank = "trim(translate(s, chr(1) || chr(2), '  '))"
    return f"""
{name}_low AS (SELECT {key}, regexp_replace(lower(coalesce(text, '')), '\\n[ \\t\\r]*\\n', chr(3), 'g') AS t FROM {given}),
{name}_marked AS (SELECT {key}, regexp_replace(replace(regexp_replace(t, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(10), chr(2)),
  '[^\\p{{L}}\\p{{N}}\\x01-\\x03]+', ' ', 'g') AS t FROM {name}_low),
{name}_paragraphs AS (SELECT {key}, unnest(string_split(t, chr(3))) AS p FROM {name}_marked),
{name}_parted AS (SELECT {key}, p, list_filter(string_split(p, chr(1)), lambda s: {blank} <> '') AS ss FROM {name}_paragraphs),
{name}_units AS (SELECT {key}, unnest(list_concat(list_concat(CASE WHEN len(ss) > 1 THEN [p] ELSE [] END, ss),
  flatten(list_transform(list_filter(ss, lambda s: contains(s, chr(2))), lambda s: string_split(s, chr(2)))))) AS s FROM {name}_parted),
{name}_words AS (SELECT {key}, regexp_split_to_array({blank}, ' +') AS w FROM {name}_units)"""


SQL = f"""
WITH given AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in NOTICES + TEXTS)}) AS t(license_id, text)),
{_cut_sql("t", "license_id", "given")},
templates AS (SELECT DISTINCT license_id, list_sort(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS b FROM t_words WHERE len(w) > 1),
{_cut_sql("d", "doc_id", "documents")},
units AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM d_words WHERE len(w) > 1),
scored AS (SELECT doc_id, license_id, 2.0::DOUBLE * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
  FROM units u JOIN templates t ON len(u.b) BETWEEN {THRESHOLD} / {2 - THRESHOLD} * len(t.b) - 1e-9 AND {2 - THRESHOLD} / {THRESHOLD} * len(t.b) + 1e-9)
SELECT doc_id, license_id, count(*) AS n_matches, CAST(max(dice) AS DOUBLE) AS best_dice
FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id, license_id
"""
