"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's share of TOTAL times all sizes follows its weight, up to CAP times its size; what a capped source can't take
is shared anew by weight. target / size is how often each of its documents should be taken: a whole part, and a
fractional probability to be rounded. Two documents at a time transfer word mass between their probabilities, in a
random direction that keeps expectations, until one becomes integral; the other goes on. Documents are dealt into
buckets of about BUCKET by a hash, one fold pairs a bucket's documents, and the buckets' residuals meet in the next
level's buckets: a reduction tree of logarithmic depth whose tasks all stay small, however hot a source is. A source's
mass stays the same throughout, so its taken words miss the target only by the last residual's rounding.

All random draws are hashes of the documents paired, so reruns agree. Null texts have size 0 and are taken 0 times; a
null source is a source, last in order. Rows that repeat (source, doc_id and size) are rounded as one and get the same.
Texts may be of any length. An empty table gives an empty result; extra columns are not read.

Only the table of sources (name, size) is ordered as a whole, and the shares are found by sums over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unlike, written

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
CAP = 2.0
BUCKET = 200
_UNIT = "struct<h:bigint,key:{key},size:bigint,n:bigint,w:double,p:double>"


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source and size, the number of words."""
    return docs.select(docs[key].alias("key"), docs[source].alias("source"), F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """per_source (source, source_size, units) with weight and target; weights repeat in the order of the sources' code points."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    weighted, _ = written(weighted, "sources")
    words = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while words:  # raises the level of words a weight until no further source is full
        full = F.col("weight") * level > cap * F.col("source_size")
        rest, held, n = weighted.agg(F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.count(F.when(full, 1))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total * words - cap * held) / rest
    return weighted.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.lit(float(level)) * F.col("weight")))


def _draw(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _pair(state: Column, x: Column, key: str) -> Column:
    """One step of pivotal rounding: the unit that becomes integral joins `done`, the other stays."""
    r = state["rest"]
    room, held = r["w"] * (1 - r["p"]), r["w"] * r["p"]
    x_room, x_held = x["w"] * (1 - x["p"]), x["w"] * x["p"]
    up, down = F.least(room, x_held), F.least(held, x_room)
    rises = _draw(r["h"], x["h"]) * (up + down) < down  # with probability down / (up + down), so neither expectation moves
    r_ends = F.when(rises, room <= x_held).otherwise(held <= x_room)
    moved = F.when(rises, up).otherwise(-down)
    unit = lambda u, p: F.struct(u["h"], u["key"], u["size"], u["n"], u["w"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))
    ended = F.when(r_ends, unit(r, rises.cast("double"))).otherwise(unit(x, (~rises).cast("double")))
    rest = F.when(r_ends, unit(x, x["p"] - moved / x["w"])).otherwise(unit(r, r["p"] + moved / r["w"]))
    kind = _UNIT.format(key=key)
    return F.struct(F.concat(state["done"], F.array(ended)).cast(f"array<{kind}>").alias("done"), rest.cast(kind).alias("rest"))


def _fold(units: DataFrame, key: str, seed: int, of: list[str]) -> DataFrame:
    """One level: units (of, buckets, u) to a row for each bucket with done and rest."""
    kind = _UNIT.format(key=key)
    dealt = units.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "u.h"), "buckets"))
    lists = dealt.groupBy(*of, "buckets", "bucket").agg(F.array_sort(F.collect_list("u")).alias("us"))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.element_at("us", 1).cast(kind).alias("rest"))
    folded = F.aggregate(F.slice("us", 2, F.greatest(F.size("us") - 1, F.lit(0))), start, lambda state, x: _pair(state, x, key))
    return lists.select(*of, "buckets", folded.alias("f")).select(*of, "buckets", "f.done", "f.rest")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """For every row: key, source, size, source_size, target, copies (taken whole) and part (words of one further, partial copy: of the one document of a source that is left over)."""
    kind = docs.schema[key].dataType.simpleString()
    own, _ = written(sizes(docs, key, source, text), "sizes")
    units = own.groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    per_source = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    shares = targets(per_source).withColumn("often", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    of = ["source", "source_size", "target", "whole"]
    shares = shares.select(F.col("source").alias("s"), "source_size", "target", F.floor("often").alias("whole"), (F.col("often") - F.floor("often")).alias("p"), F.ceil(F.col("units") / BUCKET).alias("buckets"))
    joined = units.join(shares, units.source.eqNullSafe(shares.s)).drop("s")
    unit = F.struct(F.xxhash64(F.lit("mix"), "key", "size").alias("h"), "key", "size", "n", (F.col("size") * F.col("n")).cast("double").alias("w"), "p").cast(_UNIT.format(key=kind)).alias("u")
    ready, _ = written(joined.select(*of, "buckets", unit), "units")
    settled = (F.col("u.p") == 0) | (F.col("u.size") == 0)
    done = [ready.where(settled).select(*of, F.col("u.key").alias("key"), F.col("u.size").alias("size"), F.col("u.n").alias("n"), F.lit(0.0).alias("p"))]
    left = ready.where(~settled)
    most = left.agg(F.max("buckets")).first()[0]
    level = 0
    while most:
        folded, _ = written(_fold(left, kind, level, of), "level")
        last = most == 1
        ended = F.concat("done", F.array("rest")) if last else F.when(F.col("buckets") == 1, F.concat("done", F.array("rest"))).otherwise(F.col("done"))
        done.append(folded.select(*of, F.explode(ended).alias("u")).select(*of, "u.key", "u.size", "u.n", "u.p"))
        left = folded.where("buckets > 1").select(*of, F.ceil(F.col("buckets") / BUCKET).alias("buckets"), F.col("rest").alias("u"))
        most = 0 if last else left.agg(F.max("buckets")).first()[0]
        level += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    split = every.select(*of, "key", "size", "n", F.floor(F.col("p")).cast("bigint").alias("extra"), (F.col("p") % 1.0).alias("p"))
    rows = split.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.cast("bigint").alias("copies"), F.round(F.col("p") * F.col("size")).cast("bigint").alias("part"))


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, size, source_size, target and taken, for every row."""
    return mix(docs, key).select(key, "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def repeated(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: docs, each row as often as it is taken; the left-over copy of a source whole or not at all, whichever is nearer."""
    k, s, size, times, words, copy = unlike(docs.columns, "k", "s", "size_of", "times", "words", "copy")
    found = mix(docs.select(docs[key].alias("key"), docs[source].alias("source"), docs[text].alias("text")), "key", "source", "text")
    taken = F.col("copies") + F.when(F.col("part") * 2 >= F.col("size"), F.signum("part")).otherwise(0)
    chosen = found.select(F.col("key").alias(k), F.col("source").alias(s), F.col("size").alias(size), taken.cast("int").alias(times))
    chosen = chosen.groupBy(k, s, size).agg(F.max(times).alias(times)).where(F.col(times) > 0)
    own = docs.withColumn(words, F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint"))
    same = own[key].eqNullSafe(chosen[k]) & own[source].eqNullSafe(chosen[s]) & (own[words] == chosen[size])
    return own.join(chosen, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[own[c] for c in docs.columns])
