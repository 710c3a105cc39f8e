"""Licence scans: a normalised text's windows of words compared to licence templates by Dice over word bigrams.

Normalised: lower case, each run of other than letters and digits one space; so lines, comment marks and punctuation
don't matter, and templates pass the same expression. For a template of m bigrams the segments are all windows of
min(L, n) consecutive bigrams of the text's n, for each L of SIZES times m. Dice is twice the multiset intersection of
both over the sum of their sizes: 1 for a template against itself.

Size bounds prune first: a text of under m * t / (2 - t) bigrams cannot reach the threshold t, nor can one with fewer
bigrams of the template than the smallest window needs in common. What is left is swept: an occurrence of a bigram
counts for the window starts between which it lies in the window and is among the last c of its kind there (c being
how often the template has it), so counts of all windows of a text are one running sum over starts, linear in its hits.

DataFrame functions only. Each text is exploded where it lies and counted before the shuffle; only texts that pass the
bounds are swept. A null or empty text has no match. Texts may be of any length. Rows may repeat (the same key and
text get the same answer) and keys may be null; ties go to the larger template, then to the first by name. An empty
table gives an empty result; no other columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8
#: Windows' sizes, as multiples of a template's.
SIZES = (0.8, 1.0, 1.25)
#: Up to so many texts that pass the bounds (16 bytes and a key each), their keys are broadcast; beyond, joined by a shuffle.
BROADCAST_ROWS = 500_000

# Wording of public licences and their customary notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
TEMPLATES["MIT-text"] = TEMPLATES["MIT-permission"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEMPLATES["BSD-3-text"] = TEMPLATES["BSD-redistribution"] + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def normal(text: Column) -> Column:
    """Words in lower case, one space between them; texts and templates alike."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def sizes(m: Column) -> list[Column]:
    return [F.greatest(F.lit(1), F.floor(m * x + 0.5).cast("int")) for x in SIZES]


def _templates(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """name, m, least (bigrams of a text) and common (with the template) that can reach the threshold, bigram and c, how often the template has it. As many rows as templates have bigrams."""
    given = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(0).alias("h"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])))
    own = _pairs(given.select("key", "h", normal(F.col("text")).alias("normal")))
    m = F.col("m")
    least = F.ceil(m * threshold / (2 - threshold) - 1e-9).cast("int")
    listed = own.groupBy(F.col("key").alias("name"), F.col("n").alias("m"), "bigram").agg(F.count("*").cast("int").alias("c")).withColumn("least", least)
    return listed.withColumn("common", F.ceil(threshold * (m + F.least("least", *sizes(m))) / 2 - 1e-9).cast("int"))


def _pairs(texts: DataFrame) -> DataFrame:
    """texts (key, h, normal) as a row for each bigram, with pos and n, the text's number of bigrams."""
    words = texts.select("key", "h", F.split("normal", " ").alias("w"))
    both = words.select("key", "h", (F.size("w") - 1).alias("n"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("pos", "x"))
    return both.where("pos < n").select("key", "h", "n", "pos", F.concat("x.a", F.lit(" "), "x.b").alias("bigram"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, licence (the template of the best window, else null), dice (rounded to 6 places, else null), first_word (where its first such window starts, from 0, else null) and n_templates, those that reach the threshold; for every row."""
    listed, _ = written(_templates(docs, templates or TEMPLATES, threshold), "templates")  # some hundred rows a template, which the caller gives
    most = listed.agg(F.max("c")).first()[0] or 1
    own = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))
    hits = _pairs(own.select("key", "h", normal(F.col("text")).alias("normal"))).join(F.broadcast(listed), "bigram").where("n >= least")
    able = hits.groupBy("key", "h", "name").agg(F.count("*").alias("hits"), F.first("common").alias("common")).where("hits >= common").select("key", "h", "name")

    few, _ = written(able.select(F.col("key").alias("k"), F.col("h").alias("g")).distinct(), "able")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    texts = own.join(few, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g")), "left_semi").dropDuplicates(["key", "h"])
    again = _pairs(texts.select("key", "h", normal(F.col("text")).alias("normal"))).join(F.broadcast(listed), "bigram").where("n >= least")
    following = F.coalesce(*[F.when(F.col("c") == c, F.lead("pos", c).over(_order())) for c in range(1, most + 1)])
    spans = again.withColumn("following", following).withColumn("size", F.explode(F.array_distinct(F.array(*[F.least("n", x) for x in sizes(F.col("m"))]))))
    first = F.greatest(F.lit(0), F.col("pos") - F.col("size") + 1)
    last = F.least(F.col("pos"), F.col("n") - F.col("size"), F.coalesce(F.col("following") - F.col("size"), F.col("pos")))
    steps = spans.select("key", "h", "name", "m", "size", F.explode(F.array(F.struct(first.alias("s"), F.when(last >= first, 1).otherwise(0).alias("d")), F.struct((last + 1).alias("s"), F.when(last >= first, -1).otherwise(0).alias("d")))).alias("e"))
    held = F.sum("e.d").over(Window.partitionBy("key", "h", "name", "size").orderBy("e.s").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    swept = steps.select("key", "h", "name", "m", F.col("e.s").alias("s"), (2.0 * held / (F.col("m") + F.col("size"))).alias("dice")).where(F.col("dice") >= threshold)
    best = swept.groupBy("key", "h", "name", "m").agg(F.max(F.struct("dice", (-F.col("s")).alias("s"))).alias("b"))
    of = best.groupBy("key", "h").agg(F.min(F.struct((-F.col("b.dice")).alias("dice"), (-F.col("m")).alias("m"), "name", (-F.col("b.s")).alias("s"))).alias("b"), F.count("*").alias("n_templates"))
    found = of.select(F.col("key").alias("k"), F.col("h").alias("g"), F.col("b.name").alias("licence"), F.round(-F.col("b.dice"), 6).alias("dice"), F.col("b.s").cast("bigint").alias("first_word"), "n_templates")
    every = own.select("key", "h").join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g")), "left")
    return every.select(F.col("key").alias(key), "licence", "dice", "first_word", F.coalesce("n_templates", F.lit(0)).alias("n_templates"))


def _order() -> Window:
    return Window.partitionBy("key", "h", "name", "bigram").orderBy("pos")


def sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB by brute force: every window of every size that a bigram of a template lies in, its bigrams counted one by one."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (templates or TEMPLATES).items())
    normal_sql = lambda c: rf"trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
WITH given(name, text) AS (VALUES {rows}),
tw AS (SELECT name, string_split({normal_sql("text")}, ' ') AS w FROM given),
t AS (SELECT name, m, bigram, count(*) AS c FROM (SELECT name, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM tw) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS id, doc_id, string_split({normal_sql("text")}, ' ') AS w FROM documents),
p AS (SELECT id, len(w) - 1 AS n, unnest(range(1, len(w))) AS i, w FROM d WHERE len(w) > 1),
g AS (SELECT id, n, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS bigram FROM p),
x AS (SELECT g.id, g.n, g.pos, g.bigram, t.name, t.m, t.c, least(g.n, l) AS size FROM g JOIN t USING (bigram), LATERAL (SELECT DISTINCT least(g.n, greatest(1, floor(t.m * z + 0.5)::INT)) AS l FROM (VALUES {", ".join(f"({z})" for z in SIZES)}) v(z)) q),
k AS (SELECT id, name, m, size, bigram, c, unnest(range(greatest(0, pos - size + 1), least(pos, n - size) + 1)) AS s FROM x),
f AS (SELECT id, name, m, size, s, sum(u) AS common FROM (SELECT id, name, m, size, s, bigram, least(count(*), any_value(c)) AS u FROM k GROUP BY id, name, m, size, s, bigram) GROUP BY ALL),
r AS (SELECT id, name, m, s, 2.0::DOUBLE * common / (m + size) AS dice FROM f WHERE 2.0::DOUBLE * common / (m + size) >= {threshold}),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dice DESC, m DESC, name, s) AS turn FROM r),
o AS (SELECT id, max(name) FILTER (turn = 1) AS name, max(dice) AS dice, max(s) FILTER (turn = 1) AS s, count(DISTINCT name) AS n FROM b GROUP BY id)
SELECT doc_id, name AS licence, round(dice, 6) AS dice, s AS first_word, coalesce(n, 0) AS n_templates FROM d LEFT JOIN o USING (id)
"""
