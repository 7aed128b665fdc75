"""License scan: which license notices a text holds, by containment of their word shingles.

Method: for each size of template the text's 5-word shingles are cut into overlapping
windows, twice as many shingles as the template has (up to a power of two) at a step of
half a window, so any run of a template's length lies whole in a window. A window's MinHash
signature is cut into bands, and equal bands retrieve templates. A window that contains 80 %
of a template has a Jaccard similarity of ``0.8 / 2.2`` to it at least if the template fills
its size class, and half that otherwise, so with bands of one row ``BANDS = 64`` of them
leave a chance under ``1e-5`` to retrieve nothing. Retrieved pairs are verified by exact
containment.

A window can only meet a template's band on a shingle that they share, so windows are made
around shared shingles alone, and texts without one of the templates' words are passed over
first. Both save work and change no result. DataFrame functions only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.staging import stage

BANDS = 64
WORDS = 5
CONTAINED = 0.8
#: Templates' shingles that are sent to all tasks as literals; larger sets are joined.
LITERALS = 20_000
#: Words that the first pass looks for; templates with more go without it.
MARKS = 2000
#: Up to so many of them are looked for by a pattern, more word by word.
PATTERN_WORDS = 100
_SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
#: One-line notices by which texts name common licenses.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "template_id string, text string")

#: Standard headers of source files; their fill-in lines are left out. Full texts are in ``license_texts``.
HEADERS = {
    "agpl-3.0": _GNU_HEADER.format(name="GNU Affero General Public License", version=3),
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-2.0": _GNU_HEADER.format(name="GNU General Public License", version=2),
    "gpl-3.0": _GNU_HEADER.format(name="GNU General Public License", version=3),
    "lgpl-2.1": _GNU_HEADER.format(name="GNU Lesser General Public License", version=2.1),
    "lgpl-3.0": _GNU_HEADER.format(name="GNU Lesser General Public License", version=3),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def templates(spark: SparkSession) -> DataFrame:
    """The notices with and without their full stop, the standard headers and the full texts."""
    texts = [(f.stem, f.read_text(encoding="utf-8")) for f in (Path(__file__).parent / "license_texts").glob("*.txt")]
    rows = [*NOTICES.items(), *((k, v.rstrip(".")) for k, v in NOTICES.items()), *HEADERS.items(), *texts]
    return spark.createDataFrame(sorted(rows), "template_id string, text string")


def words(text: Column) -> Column:
    """Words between ASCII white space with A-Z in lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _SPACES), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """Hashes of the 5-word shingles in order; of the whole sequence if there are fewer words."""
    at = lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WORDS)))
    return F.when(F.size(ws) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - WORDS, F.lit(0))), at))


def _either(word: str) -> str:
    """A pattern of a word with A-Z in either case."""
    return "".join(f"[{c}{c.upper()}]" if "a" <= c <= "z" else re.escape(c) for c in word)


def _signature(sh: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, F.array_min(F.transform(sh, lambda s: F.xxhash64(s, b)))))


def scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, template_id, containment, first_word, n_windows`` for each template in each text.

    ``containment`` is the largest share of a template's distinct shingles in a window, at
    least ``contained``; ``first_word`` the place of the first such window's first shingle
    that the two share, ``n_windows`` how many windows do. A text of fewer than five words is
    one shingle, and so is such a template. Null, empty and blank texts and templates match
    nothing; templates with a null id are left out. Several texts of one template id are
    templates of their own and their best counts. Rows that are equal in id and text give
    one row each, so repeated rows give one. Long texts are scanned whole; empty tables give
    no rows; other columns are ignored.
    """
    t = templates.select(templates["template_id"].cast("string").alias("template_id"), words(templates["text"].cast("string")).alias("ws")).dropna()
    # Staged, or the lambdas would split the text anew for each word.
    t = stage(t, "op9-words")
    t = stage(t.select("template_id", "ws", F.array_distinct(shingles(F.col("ws"))).alias("ts")).where(F.size("ts") > 0), "op9-templates")
    t = t.withColumn("step", F.pow(2, F.ceil(F.log2(F.size("ts")))).cast("int")).withColumn("t", F.xxhash64("template_id", "ts"))
    n = t.agg(F.coalesce(F.sum(F.size("ts")), F.lit(0))).first()[0]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = t.select("ws", "ts", "step").collect() if n <= LITERALS else []
    # The longest word of each shingle: a text without any of them holds no shingle.
    marks = sorted({max(r[0][k : k + WORDS], key=lambda w: (len(w), w)) for r in known for k in range(max(1, len(r[0]) - WORDS + 1))})
    if marks and len(marks) <= PATTERN_WORDS:
        rows = rows.where(F.col("text").rlike("|".join(map(_either, marks))))
    # One step at a time: an expression inside a lambda would be worked out for each element.
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words(F.col("text")).alias("ws"))
    every = shingles(F.col("ws"))
    if PATTERN_WORDS < len(marks) <= MARKS:
        every = F.when(F.exists("ws", lambda w: w.isin(marks)), every).otherwise(F.array().cast("array<long>"))
    rows = rows.select("doc_id", "row", every.alias("all"))
    # A window of a size can only meet templates of that size.
    if n <= LITERALS:
        of: dict[int, set[int]] = {}
        for _, ts, step in known:
            of.setdefault(step, set()).update(ts)
        listed = lambda held: ", ".join(f"{h}L" for h in sorted(held) if h != -(2**63)) or "0L"
        near = rows.select("doc_id", "row", "all", F.expr(f"filter(transform(all, (s, i) -> if(s IN ({listed(set().union(*of.values()))}), struct(s, i AS at), null)), x -> x IS NOT NULL)").alias("hits"))
        around = [f"transform(array_distinct(flatten(transform(filter(hits, x -> x.s IN ({listed(held)})), x -> array(x.at div {k} * {k}, greatest(x.at div {k} - 1, 0L) * {k})))), v -> struct({k} AS step, int(v) AS start, slice(all, int(v) + 1, 2 * {k}) AS run))" for k, held in sorted(of.items())]
        near = near.select("doc_id", "row", F.explode_outer(F.expr(f"concat({', '.join(around)})") if around else F.expr("array(struct(1 AS step, 0 AS start, all AS run))")).alias("w")).where("w IS NOT NULL").select("doc_id", "row", "w.step", "w.start", "w.run")
    else:
        steps = t.select(F.explode("ts").alias("s"), "step").distinct()
        near = rows.select("doc_id", "row", F.posexplode("all").alias("at", "s")).join(steps, "s")
        at = F.floor(F.col("at") / F.col("step")).cast("int")
        starts = F.explode(F.array_distinct(F.array(at * F.col("step"), F.greatest(at - 1, F.lit(0)) * F.col("step")))).alias("start")
        starts = near.select("doc_id", "row", "step", starts).dropDuplicates(["row", "step", "start"])
        near = starts.join(rows.select("row", "all").dropDuplicates(["row"]), "row").select("doc_id", "row", "step", "start", F.slice("all", F.col("start") + 1, 2 * F.col("step")).alias("run"))
    near = near.dropDuplicates(["row", "step", "start"])
    windows = near.withColumn("sh", F.array_distinct("run"))
    bands = windows.select("*", F.posexplode(_signature(F.col("sh"))).alias("band", "hash"))
    keys = t.select("t", "template_id", "ts", "step", F.posexplode(_signature(F.col("ts"))).alias("band", "hash"))
    if n <= LITERALS:
        keys = F.broadcast(keys)
    share = F.size(F.array_intersect("sh", "ts")) / F.size("ts")
    met = bands.join(keys, ["step", "band", "hash"]).dropDuplicates(["row", "step", "start", "t"])
    place = F.col("start") + F.array_position("run", F.get(F.array_intersect("sh", "ts"), F.lit(0))) - 1
    good = met.select("doc_id", "row", "template_id", "start", share.alias("containment"), place.alias("place")).where(F.col("containment") >= contained)
    out = good.groupBy("row", "template_id").agg(F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.min("place").cast("long").alias("first_word"), F.countDistinct("start").alias("n_windows"))
    return out.select("doc_id", "template_id", "containment", "first_word", "n_windows")
