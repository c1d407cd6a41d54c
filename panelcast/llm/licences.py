"""Licence scan in DataFrame operations only.

A document's units are its lines, its whole text and passages: runs of words
that may cross lines or lie within one.  A unit is normalised to
lower-case ASCII words and compared to each licence template by the Dice
coefficient over word bigrams, counted with repeats.  Sizes alone bound that
coefficient, so a template is a candidate only for units whose bigram count
is within its bounds, only bigrams that a candidate has are counted, and
texts without any of a few words that no match can do without are passed over.
A passage is worth a look only if its first and last bigram are the
template's, and only where enough of the template's bigrams lie close by.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.qda import fresh
from panelcast.session import stored

BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Notices and texts as their licences publish them.  Texts that
#: are alike (versions of the GPL family) are found together; the exact one has
#: the higher coefficient.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "all-rights-reserved": "All rights reserved.",
    "bsd-2-clause": f"""{BSD_GRANT} {BSD_DISCLAIMER}""",
    "bsd-3-clause": f"""{BSD_GRANT} Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. {BSD_DISCLAIMER}""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details.""",
    "lgpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details.""",
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Affero General Public License for more details.""",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "bsd-notice": "Released under the BSD License.",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/""",
}
DICE = 0.8


def template_bigrams(templates: dict[str, str], least: float) -> list[tuple[str, int, int, int, str, int]]:
    """``(template, size, low, high, bigram, count)``: the bounds are the unit
    sizes at which the coefficient can reach ``least``."""
    rows = []
    for name, text in templates.items():
        words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        n = len(pairs)
        if not n:
            raise ValueError(f"template {name!r} needs two words")
        low, high = math.ceil(least / (2 - least) * n - 1e-9), math.floor((2 - least) / least * n + 1e-9)
        rows += [(name, n, low, high, p, pairs.count(p)) for p in sorted(set(pairs))]
    return rows


def anchor_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which any unit that matches some template has at least one.

    At the coefficient ``least`` a unit must have ``0.5 * least * (low +
    size)`` of a template's bigrams or more, so it can't miss all bigrams of a
    set larger than the rest; a template's anchors are words, long ones first,
    that lie in so many of its bigrams."""
    anchors: set[str] = set()
    rows = template_bigrams(templates, least)
    for name in templates:
        own = [(r[4].split(" "), r[5]) for r in rows if r[0] == name]
        size, low = next((r[1], r[2]) for r in rows if r[0] == name)
        enough = size - math.ceil(0.5 * least * (low + size) - 1e-9) + 1

        def covered(words):
            return sum(n for pair, n in own if words & set(pair))

        chosen = anchors & {w for pair, _ in own for w in pair}
        while covered(chosen) < enough:
            left = {w for pair, _ in own for w in pair} - chosen
            chosen.add(max(left, key=lambda w: (covered(chosen | {w}) > covered(chosen), min(len(w), 6), covered(chosen | {w}), w)))
        anchors |= chosen
    return sorted(anchors)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and template found: ``doc_id, template, dice``
    (the best unit's), ``line_no`` (the first such line from 0, for a passage
    the line where it begins, -1 for the whole text of more than one line),
    ``n_units`` (units that match).

    A passage counts unless it overlaps a line or whole text that matches the
    same template, or one with as many of another template's bigrams, or a
    passage with more of its template's (then the higher coefficient, the
    earlier begin, the first template by name).

    Null and blank texts match nothing; rows that share an id are scanned each
    on its own; other columns are ignored.  The templates' bigrams are a fixed
    table of a few KB, sent to all executors."""
    spark: SparkSession = docs.sparkSession
    rows = template_bigrams(templates, least)
    known = spark.createDataFrame(rows, "template string, size int, low int, high int, bigram string, times int")
    bounds = sorted({(r[2], r[3]) for r in rows})
    text = F.col(text_col).cast("string")
    most = max(high for _, high in bounds)
    anchors = anchor_words(templates, least)
    short = "|".join(w for w in anchors if len(w) < 4)

    def may_match(t):
        """Some anchor in the lower-cased text; short ones as whole words."""
        tests = [F.contains(t, F.lit(w)) for w in anchors if len(w) >= 4]
        return reduce(Column.__or__, tests + [F.rlike(t, F.lit(f"(?<![a-z0-9])({short})(?![a-z0-9])"))] * bool(short), F.lit(False))

    # lower once for all words
    found_word = F.transform(F.array(F.lower(text)), may_match)[0]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"),
                       found_word.alias("may")).where("may").select("doc_id", "row", "text")
    base = stored(base, "licence-texts")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.filter(_words(x), lambda w: w != ""))

    def units(words):
        """The lines' words, after the whole text's if those are few enough to match anything."""
        n = F.aggregate(words, F.lit(0), lambda a, w: a + F.size(w))
        whole = F.when((F.size(words) > 1) & (n <= most + 1), F.flatten(words)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(whole), words)

    # the words come out of the explode as a column, so later conditions on them don't split the text again
    cut = base.select("doc_id", "row", F.posexplode(F.transform(F.array(lines), units)[0]).alias("at", "words"))
    cut = cut.select("doc_id", "row", (F.col("at") - 1).alias("line_no"), "words")
    sized = cut.withColumn("n", F.size("words") - 1)
    any_bound = F.lit(False)
    for low, high in bounds:
        any_bound = any_bound | F.col("n").between(low, high)
    pairs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    bigrams = sized.where((F.col("n") >= 1) & any_bound).select("doc_id", "row", "line_no", "n", F.explode(pairs).alias("pair"))
    shared = (bigrams.join(F.broadcast(known), (F.col("pair") == F.col("bigram")) & F.col("n").between(F.col("low"), F.col("high")))
              .groupBy("doc_id", "row", "line_no", "n", "template", "size", "bigram").agg(F.least(F.count("*"), F.max("times")).alias("both"))
              .groupBy("doc_id", "row", "line_no", "n", "template", "size").agg(F.sum("both").alias("both")))
    dice = (2 * F.col("both") / (F.col("n") + F.col("size"))).alias("dice")
    found = stored(shared.select("doc_id", "row", "line_no", "template", "both", dice).where(F.col("dice") >= least), "licence-units")
    more = _passages(base.select("doc_id", "row", lines.alias("lines")), known, found, least, most)
    best = F.max(F.struct("dice", (-F.col("line_no")).alias("order")))
    return (found.unionByName(more).groupBy("doc_id", "row", "template").agg(best.alias("best"), F.count("*").alias("n_units"))
            .select("doc_id", "template", F.col("best.dice").alias("dice"), (-F.col("best.order")).cast("int").alias("line_no"), "n_units"))


def _passages(texts: DataFrame, known: DataFrame, found: DataFrame, least: float, most: int) -> DataFrame:
    """``found``'s columns for the passages of ``texts`` (``doc_id, row,
    lines``: words by line) that count beside the units ``found``.

    ``hits`` are the places of templates' bigrams.  A best passage begins and
    ends with one, as it only gains by leaving others out there."""
    words = F.flatten(F.transform("lines", lambda line, k: F.transform(line, lambda w: F.struct(w.alias("w"), k.alias("k")))))
    flat = texts.select("doc_id", "row", words.alias("words")).where(F.size("words") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(
        F.concat_ws(" ", F.get("words", i - 1)["w"], F.get("words", i)["w"]).alias("pair"),
        F.get("words", i - 1)["k"].alias("k"), F.get("words", i)["k"].alias("k_end")))
    placed = flat.select("doc_id", "row", F.posexplode(pairs).alias("at", "x")).select("doc_id", "row", "at", "x.*")
    hits = placed.join(F.broadcast(known), F.col("pair") == F.col("bigram")).select(
        "doc_id", "row", "template", "at", "k", "k_end", "bigram", "times", "size", "low", "high")
    # a passage of n bigrams needs half of least * (n + size) of the template's, and n is at least low
    need = F.ceil(0.5 * least * (F.col("low") + F.col("size")) - 1e-9)
    order = Window.partitionBy("row", "template").orderBy("at")
    ahead = F.count("*").over(order.rangeBetween(0, most - 1))
    around = F.count("*").over(order.rangeBetween(1 - most, most - 1))
    dense = stored(hits.withColumn("ahead", ahead).withColumn("around", around).where(F.col("around") >= need), "licence-hits")
    # a begin and each hit that its passage can reach, by buckets of the longest passage
    begin = dense.where(F.col("ahead") >= need).select("row", "template", F.col("at").alias("begin"), F.col("k").alias("line_no"),
                                                       F.explode(F.array(F.expr(f"at div {most}"), F.expr(f"at div {most} + 1"))).alias("bucket"))
    reached = begin.join(dense.withColumn("bucket", F.expr(f"at div {most}")), ["row", "template", "bucket"]).where(
        F.col("at").between(F.col("begin"), F.col("begin") + F.col("high") - 1))
    nth = F.row_number().over(Window.partitionBy("row", "template", "begin", "bigram").orderBy("at"))
    so_far = Window.partitionBy("row", "template", "begin").orderBy("at")
    n = F.col("at") - F.col("begin") + 1
    cut = (reached.withColumn("nth", nth).withColumn("both", F.sum(F.when(F.col("nth") <= F.col("times"), 1).otherwise(0)).over(so_far))
           .withColumn("dice", 2 * F.col("both") / (n + F.col("size"))).where((n >= F.col("low")) & (F.col("dice") >= least)))
    key = ["row", "template", "begin", "at"]
    cut = stored(cut.select("doc_id", *key, "line_no", "k_end", "both", "dice"), "licence-cuts")
    unit = found.select("row", F.col("line_no").alias("k"), F.col("template").alias("t2"), F.col("both").alias("both2"))
    lost = (F.col("t2") == F.col("template")) | (F.col("both2") >= F.col("both"))
    in_line = cut.select(*key, "both", F.explode(F.sequence("line_no", "k_end")).alias("k")).join(unit, ["row", "k"]).where(lost).select(*key)
    in_whole = cut.select(*key, "both").join(unit.where("k = -1"), "row").where(lost).select(*key)
    cut = cut.join(in_line.union(in_whole).distinct(), key, "left_anti")
    value = F.struct("both", "dice", (-F.col("begin")).alias("early"))
    by_begin = stored(cut.groupBy("doc_id", "row", "template", "begin").agg(F.max(F.struct("both", "dice", "at", "line_no")).alias("x"))
                      .select("doc_id", "row", "template", "begin", "x.*").withColumn("value", value), "licence-passages")
    reach = F.explode(F.sequence(F.expr(f"begin div {most}"), F.expr(f"(at + 1) div {most}"))).alias("bucket")
    other = by_begin.select("row", F.col("template").alias("t2"), F.col("begin").alias("b2"), F.col("at").alias("a2"), F.col("value").alias("v2"), reach)
    beaten = (by_begin.select("*", reach).join(other, ["row", "bucket"])
              .where((F.col("b2") <= F.col("at") + 1) & (F.col("begin") <= F.col("a2") + 1)
                     & ((F.col("v2") > F.col("value")) | (F.col("v2") == F.col("value")) & (F.col("t2") < F.col("template"))))
              .select("row", "template", "begin").distinct())
    return by_begin.join(beaten, ["row", "template", "begin"], "left_anti").select("doc_id", "row", "line_no", "template", "both", "dice")


def with_licences(docs: DataFrame, **options) -> DataFrame:
    """``docs`` rows and an array of the templates found, as ``licences`` (a
    longer name if there is such a column)."""
    name, key = fresh(docs, "licences"), fresh(docs, "__licence_id")
    id_col = options.get("id_col", "doc_id")
    found = scan(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_set("template")).alias(name))
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left").drop(key)


def oracle(templates: dict[str, str] = TEMPLATES, least: float = DICE) -> str:
    values = ", ".join("('{}', {}, {}, {}, '{}', {})".format(*r) for r in template_bigrams(templates, least))
    return f"""
WITH known(template, size, low, high, bigram, times) AS (VALUES {values}),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no, unnest(parts) AS unit FROM cut
  UNION ALL SELECT doc_id, -1, text FROM cut WHERE len(parts) > 1),
worded AS (
  SELECT doc_id, line_no, string_split(trim(lower(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS words FROM units),
sized AS (SELECT *, len(words) - 1 AS n FROM worded WHERE len(words) > 1),
bigrams AS (
  SELECT doc_id, line_no, n, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, n + 1)]) AS pair
  FROM sized WHERE EXISTS (SELECT 1 FROM known WHERE sized.n BETWEEN low AND high)),
shared AS (
  SELECT doc_id, line_no, n, template, size, bigram, least(count(*), max(times)) AS alike
  FROM bigrams JOIN known ON pair = bigram AND n BETWEEN low AND high GROUP BY ALL),
scored AS (
  SELECT doc_id, line_no, template, 2 * sum(alike) / (n + size) AS dice FROM shared GROUP BY doc_id, line_no, n, template, size),
found AS (SELECT * FROM scored WHERE dice >= {least})
SELECT doc_id, template, max(dice) AS dice, CAST(min(line_no) FILTER (dice = top) AS INTEGER) AS line_no, count(*) AS n_units
FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, template) AS top FROM found)
GROUP BY doc_id, template"""
