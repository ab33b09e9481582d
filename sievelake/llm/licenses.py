"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Built-in column functions and joins only. What is compared: with short notices, every line and every two or three lines in a row of every file, as notices are wrapped; with
these and with the texts of licences, every block of lines between blank ones, the header of a file being its first, and the whole text of licence files. The templates
are a fixed small table; terms count by the logarithm of their number and by inverse document frequency among the templates, and terms that no template has by the greatest such weight, so strange words lower the cosine.

Only units that can reach THRESHOLD are scored, by bounds that lose nothing. A cosine is at most the root of the sum of the squared weights of the template's terms that the unit
has, so a line without any required term of a notice can't reach it (hint()). And it is at most the root of the share that the template's terms have in the unit's own
squared weights, so a unit most of whose weight lies on terms that no template has can't reach it either (may_reach()); ordinary prose goes by this.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.shared import materialize

# The public wordings of licences and of their usual notices, in the SPDX list's names.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _MIT],
    "ISC": ["ISC License", _ISC],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", _APACHE],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format(kind="", n=3)],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format(kind="", n=2)],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format(kind="Lesser ", n=3)],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.format(kind="Affero ", n=3)],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_2 + _BSD_END],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License.", _BSD_2 + _BSD_3 + _BSD_END],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", _MPL],
    "Unlicense": [_UNLICENSE],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0-1.0": ["Released under CC0 1.0 Universal, dedicated to the public domain."],
    "Proprietary": ["All rights reserved."],
}
for _name, _notices in TEMPLATES.items():
    if _name != "Proprietary":
        _notices.append(f"SPDX-License-Identifier: {_name}")

THRESHOLD = 0.7
_TERM = "[a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LICENCE_FILE = "(^|/)(licen[sc]e|copying|notice)[^/]*$"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.translate(str.maketrans(_UPPER, _LOWER)))


def weights() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """idf of the terms of the templates, that of other terms, and (SPDX id, unit vector) of each notice."""
    notices = [(spdx, _terms(t)) for spdx, ts in TEMPLATES.items() for t in ts]
    n = len(notices)
    seen = sorted({t for _, ts in notices for t in ts})
    idf = {t: math.log((1 + n) / (1 + sum(t in ts for _, ts in notices))) + 1 for t in seen}
    vectors = []
    for spdx, ts in notices:
        v = {t: (1 + math.log(ts.count(t))) * idf[t] for t in sorted(set(ts))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((spdx, {t: x / norm for t, x in v.items()}))
    return idf, math.log(1 + n) + 1, vectors


#: Templates of more distinct terms than this are texts of licences, all others short notices.
_SHORT = 16
_ENOUGH = THRESHOLD * THRESHOLD - 1e-3


#: Words that most texts have. They are put in the parts of templates that the bounds below set aside, which affects how many units are scored, never which are found.
_EVERYDAY = set("a all and any are as by code form forms general in is of or person public source subject terms that the this to under use version with without work".split())


def _set_aside(v: dict[str, float], idf: dict[str, float]) -> set[str]:
    """Terms of a template, everyday words first, then numbers, then the commonest among the templates, that together can't reach THRESHOLD."""
    out: set[str] = set()
    total = 0.0
    for t in sorted(v, key=lambda t: (t not in _EVERYDAY, not t.isdigit(), idf[t], t)):
        if total + v[t] * v[t] < _ENOUGH:
            out.add(t)
            total += v[t] * v[t]
    return out


def required_terms() -> list[str]:
    """Terms of which a unit that is near a short notice has at least one."""
    idf, _, vectors = weights()
    return sorted({t for _, v in vectors if len(v) <= _SHORT for t in v.keys() - _set_aside(v, idf)})


def _any(terms: list[str]) -> str:
    """A pattern for one of the terms in lower-cased text, as a tree of their letters, so that a word is left at its first letter that no term has."""
    tree: dict = {}
    for t in terms:
        at = tree
        for c in t + "$":
            at = at.setdefault(c, {})

    def write(at: dict) -> str:
        parts = [c + write(below) for c, below in sorted(at.items()) if c != "$"] + ["(?![a-z0-9])"] * ("$" in at)
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?<![a-z0-9]){write(tree)}"


def hint() -> str:
    return _any(required_terms())


def may_reach(text: Column) -> Column:
    """False only if the lower-cased text's weight on terms of templates is too small a share of all its weight.

    (1 + ln n) ** 2 is at most 4 / e * n, so each place of a known term adds at most 4 / e squares of the greatest weight, a quarter of that if the term's weight is half the
    greatest at most; each distinct unknown term adds one square at least.
    """
    idf, other, _ = weights()
    heavy = _any(sorted(t for t, w in idf.items() if w > other / 2))
    strong = F.regexp_count(text, F.lit(heavy))

    def counts(words: Column) -> Column:
        # A set of literals is hashed once for all texts, the array that array_except() takes once for each.
        strange = F.size(F.array_distinct(F.filter(words, lambda t: ~t.isin(*sorted(idf)))))
        return F.struct(F.size(words).alias("n"), strange.alias("strange"))

    def test(c: Column) -> Column:
        # The cheaper test, with all known terms taken for heavy ones, goes first.
        most, places = 4 / math.e * (1 - _ENOUGH), c["n"] - c["strange"]
        return (most * places >= _ENOUGH * c["strange"]) & (most * (strong + 0.25 * (places - strong)) >= _ENOUGH * c["strange"])

    # What is mentioned more than once is bound, as nothing in a lambda function is shared between mentions.
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return let(let(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), counts), test)


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def is_licence_file(path: Column) -> Column:
    return _lower(path).rlike(_LICENCE_FILE)


def units(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, content, block) of what is scored, lower-cased: block is true for blocks of lines and whole licence files, which are compared with all templates, and
    false for lines and runs of lines, which are compared with the short ones."""
    text = _lower(F.coalesce(F.col(text_col), F.lit("")))
    df = files.select("path", is_licence_file(F.col("path")).alias("whole"), text.alias("text"))

    def runs(lines: Column) -> Column:
        """All runs of up to three lines that hold a line with a required term. lines is bound once, as Catalyst would split the text again for each mention of a column."""
        at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(hint()), i + 1)), lambda i: i.isNotNull())
        join = lambda i, k: F.array_join(F.slice(lines, i, k), " ")
        return F.flatten(F.transform(at, lambda i: F.array(*[F.when(i > back, join(i - back, k)) for k in (1, 2, 3) for back in range(k)])))

    both = lambda some, block: F.transform(F.array_distinct(F.filter(some, lambda x: x.isNotNull() & (x != "") & may_reach(x))), lambda x: F.struct(x.alias("content"), F.lit(block).alias("block")))

    def found(text: Column) -> Column:
        """All units of a text, which is bound once, so that it is lower-cased once."""
        some = F.get(F.transform(F.array(F.split(text, "\n")), runs), F.lit(0))
        blocks = F.concat(F.split(text, "\n[ \t-\r]*\n"), F.array(F.when(F.col("whole"), text)))
        return F.concat(both(some, False), both(blocks, True))

    return df.select("path", F.explode(F.get(F.transform(F.array("text"), found), F.lit(0))).alias("unit")).select("path", "unit.*").distinct()


def scan(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, spdx, similarity) of the best notice in the whole text of each file that has one at THRESHOLD or above.

    files has path and text; null texts have no notice, rows that share a path are one file, extra columns are ignored. Equal cosines, to six places, go to the first
    SPDX id in alphabetical order.
    """
    spark = files.sparkSession
    idf, other, vectors = weights()
    rows = [(spdx, k, t, x, idf[t], str(len(v) > _SHORT).lower()) for k, (spdx, v) in enumerate(vectors) for t, x in v.items()]
    values = ",".join(f"('{s}',{k},'{t}',{x!r}D,{i!r}D,{long})" for s, k, t, x, i, long in rows)
    notices = spark.sql(f"SELECT * FROM VALUES {values} AS t(spdx, notice, term, w, idf, long)")
    # Few units are left to score. Each distinct one is scored once, however many files have it, and its verdict joined back to them.
    held = materialize(units(files, text_col).withColumn("unit", F.sha2("content", 256)), "license-units")
    once = held.groupBy("unit", "block").agg(F.first("content").alias("content"))
    found = once.select("unit", "block", F.explode(F.regexp_extract_all("content", F.lit(_TERM), F.lit(0))).alias("term"))
    tf = found.groupBy("unit", "block", "term").agg(F.count("*").alias("tf"))
    known = notices.select("term", "idf").distinct()
    weighed = tf.join(F.broadcast(known), "term", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other)))
    # One row per term of a unit; the few notices that share it are carried as a list so that the norm is summed once.
    by_term = notices.groupBy("term").agg(F.collect_list(F.struct("notice", "spdx", "w", "long")).alias("in"))
    scored = weighed.join(F.broadcast(by_term), "term", "left")
    norm = scored.groupBy("unit", "block").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = scored.select("unit", "block", "x", F.explode("in").alias("n")).where("block or not n.long")
    dots = dots.groupBy("unit", "block", "n.notice", "n.spdx").agg(F.sum(F.col("x") * F.col("n.w")).alias("dot"))
    near = dots.join(norm, ["unit", "block"]).select("unit", "block", "spdx", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    verdict = near.where(F.col("similarity") >= THRESHOLD).groupBy("unit", "block").agg(F.min(F.struct(-F.col("similarity"), "spdx")).alias("best"))
    best = held.select("path", "unit", "block").join(verdict, ["unit", "block"]).groupBy("path").agg(F.min("best").alias("best"))
    return best.select("path", F.col("best.spdx").alias("spdx"), (-F.col("best.col1")).alias("similarity"))


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """(path, license, similarity, origin, from_path) for every row of files.

    A file's own notice counts first. Else it has the licence of the licence file in its directory or the nearest directory above that has
    one; origin is own, inherited or none. Of several licence files of a directory the most similar counts, then the least path. The nearest licence
    is found once for each distinct directory, then joined to files; null paths have none.
    """
    at = own.where(is_licence_file(F.col("path"))).withColumn("dir", _dir(F.col("path")))
    at = at.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "spdx")).alias("l"))
    dirs = files.where("path is not null").select(_dir(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("up"))
    near = above.join(at.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("l", "depth").alias("l"))
    mine = own.select("path", F.col("spdx").alias("own_spdx"), F.col("similarity").alias("own_similarity"))
    rows = files.select("path").withColumn("dir", _dir(F.col("path"))).join(near, "dir", "left").join(mine, "path", "left")
    has = F.col("own_spdx").isNotNull()
    return rows.select(
        "path",
        F.coalesce("own_spdx", "l.spdx").alias("license"),
        F.coalesce("own_similarity", -F.col("l.s")).alias("similarity"),
        F.when(has, "own").when(F.col("l").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("l.path")).alias("from_path"),
    )


def scan_tree(files: DataFrame) -> DataFrame:
    """inherit() of the scan of files (path, text). Repeated paths give repeated rows; an empty table gives none."""
    files = files.select("path", "text")
    return inherit(files, materialize(scan(files), "license-own"))


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: (doc_id, path, text).

    A document lies in source/a/b by the hundreds of its number; the first of each hundred is that directory's LICENSE file, the first of
    each thousand its parent's, so that only those with a notice give one to their directory.
    """
    i = F.col("doc_id")
    top, mid = F.expr("doc_id div 1000"), F.expr("doc_id div 100")
    src = F.coalesce("source", F.lit("none"))
    name = F.when(i % 1000 == 0, F.concat_ws("/", src, top, F.concat(F.lit("LICENSE."), i)))
    name = name.when(i % 100 < 5, F.concat_ws("/", src, top, mid, F.concat(F.lit("LICENSE."), i)))
    return docs.select("doc_id", name.otherwise(F.concat_ws("/", src, top, mid, F.concat(i, F.lit(".txt")))).alias("path"), "text")


def doc_id_of(path: Column) -> Column:
    """The document that document_paths() gave the path."""
    return F.regexp_extract(path, "(-?[0-9]+)([.]txt)?$", 1).cast("long")


def _oracle() -> str:
    """scan_tree() of document_paths() of documents as SQL for DuckDB."""
    idf, other, vectors = weights()
    notices = ",".join(f"('{s}',{k},'{t}',CAST({x!r} AS DOUBLE),CAST({idf[t]!r} AS DOUBLE),{len(v) > _SHORT})" for k, (s, v) in enumerate(vectors) for t, x in v.items())
    lower = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH notices AS (SELECT * FROM (VALUES {notices}) AS t(spdx, notice, term, w, idf, long)),
placed AS (
    SELECT doc_id, coalesce(source, 'none') || '/' || CASE
        WHEN doc_id % 1000 = 0 THEN (doc_id // 1000) || '/LICENSE.' || doc_id
        WHEN doc_id % 100 < 5 THEN (doc_id // 1000) || '/' || (doc_id // 100) || '/LICENSE.' || doc_id
        ELSE (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path, {lower("coalesce(text, '')")} AS text
    FROM documents
), files AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_matches({lower("path")}, '{_LICENCE_FILE}') AS whole FROM placed
), lines AS (SELECT path, text, whole, string_split(text, chr(10)) AS lines FROM files
), units AS (
    SELECT path, false AS block, unnest(flatten(list_transform(range(1, len(lines) + 1), lambda i: [lines[i], array_to_string(lines[i : i + 1], ' '), array_to_string(lines[i : i + 2], ' ')]))) AS content FROM lines
    UNION SELECT path, true, unnest(string_split_regex(text, '\n[ \\x09-\\x0D]*\n')) FROM lines
    UNION SELECT path, true, text FROM lines WHERE whole
), tf AS (
    SELECT path, content, block, term, count(*) AS n FROM (SELECT path, content, block, unnest(regexp_extract_all(content, '{_TERM}')) AS term FROM units) GROUP BY ALL
), known AS (SELECT DISTINCT term, idf FROM notices
), weighed AS (SELECT path, content, block, tf.term, (1 + ln(n)) * coalesce(idf, CAST({other!r} AS DOUBLE)) AS x FROM tf LEFT JOIN known ON tf.term = known.term
), norms AS (SELECT path, content, block, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL
), dots AS (SELECT path, content, block, notice, spdx, sum(x * w) AS dot FROM weighed JOIN notices ON weighed.term = notices.term AND (block OR NOT long) GROUP BY ALL
), near AS (SELECT dots.path, spdx, round(dot / norm, 6) AS similarity FROM dots JOIN norms ON dots.path = norms.path AND dots.content = norms.content AND dots.block = norms.block
), own AS (SELECT path, spdx, similarity FROM near WHERE similarity >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, spdx) = 1
), licences AS (
    SELECT files.dir, own.path, spdx, similarity FROM own JOIN files ON own.path = files.path WHERE whole
    QUALIFY row_number() OVER (PARTITION BY files.dir ORDER BY similarity DESC, own.path, spdx) = 1
), near_dir AS (
    SELECT d.dir, l.path, spdx, similarity FROM (SELECT DISTINCT dir FROM files) d JOIN licences l ON l.dir = '' OR d.dir = l.dir OR starts_with(d.dir, l.dir || '/')
    QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) = 1
)
SELECT doc_id, files.path, coalesce(own.spdx, near_dir.spdx) AS license, coalesce(own.similarity, near_dir.similarity) AS similarity,
    CASE WHEN own.path IS NOT NULL THEN 'own' WHEN near_dir.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN own.path IS NOT NULL THEN files.path ELSE near_dir.path END AS from_path
FROM files LEFT JOIN own ON files.path = own.path LEFT JOIN near_dir ON files.dir = near_dir.dir
"""


ORACLE = _oracle()
