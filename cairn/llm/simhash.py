"""SimHash near-duplicates: fingerprints compared bit by bit over vertically stored planes, and their components.

Equal fingerprints collapse to one representative. Two fingerprints within RADIUS bits agree in at least two of
RADIUS + 2 blocks of bits, so each pair of blocks is a key under which candidates meet; that loses no link. Under a
key, bit planes hold 64 fingerprints a word; carry-save counters add up many distances at once, and words whose lanes
all exceed the radius are dropped. Keys with many fingerprints are cut into blocks, and each pair of blocks is a task
of its own, so no task holds a whole hot key. A task returns a spanning forest of the links it finds, not all pairs;
components come from alternating star contraction over written tables.

Null texts and texts without a word have fingerprint zero and link as any other. Texts may be of any length. Rows may
repeat: they get the same component. A null doc_id never names a component unless all its members' are null. An empty
table gives an empty result; only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, remove, trimmed, unlike, written

RADIUS = 2
WIDTH = 3
SEED = 42
#: The most fingerprints of a key that one task compares with as many others.
BLOCK = 2048
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.array([len(w) + 1 for w in words]))
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
    stops = (ends - 1).tolist()[width - 1 :]
    digest = xxhash.xxh64_intdigest
    step = 1 << 16
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + step], stops[lo : lo + step], strict=False)], "<u8") for lo in range(0, len(stops), step))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of all the blocks' hashes."""
    set_bits, n = np.zeros(64, np.int64), 0
    for h in blocks:
        set_bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits((2 * set_bits > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def planes(fingerprints: np.ndarray) -> np.ndarray:
    """A row for each bit of a fingerprint (of one 64-bit word, or a row of several); bit i % 64 of word i // 64 in row b is bit b of fingerprint i."""
    own = np.ascontiguousarray(fingerprints.astype("<u8")).view(np.uint8).reshape(len(fingerprints), -1)
    words = -(-len(fingerprints) // 64)
    bits = np.zeros((words * 64, own.shape[1] * 8), np.uint8)
    bits[: len(fingerprints)] = np.unpackbits(own, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def links(queries: np.ndarray, stored: np.ndarray, radius: int = RADIUS, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, stored) within the radius, as two arrays of indices, by ascending query."""
    if not len(queries) or not len(stored):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    queries, sliced = queries.reshape(len(queries), -1), planes(stored)
    words = sliced.shape[1]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    counters = max(1, radius.bit_length())
    first = 2**counters - 1 - radius  # so that a counter overflows just beyond the radius
    empty = np.zeros(words, np.uint64)
    if len(stored) % 64:
        empty[-1] = FULL << np.uint64(len(stored) % 64)
    for lo in range(0, len(queries), max(1, 200_000 // words)):
        q = queries[lo : lo + max(1, 200_000 // words)]
        row, word = np.repeat(np.arange(len(q)), words), np.tile(np.arange(words), len(q))
        count = [np.full(len(row), FULL if first >> k & 1 else 0, np.uint64) for k in range(counters)]
        over = empty[word]
        for b in range(len(sliced)):
            carry = sliced[b][word] ^ (np.uint64(0) - (q[row, b // 64] >> np.uint64(b % 64) & np.uint64(1)))
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % step == step - 1:
                alive = over != FULL
                if not alive.all():
                    row, word, over, count = row[alive], word[alive], over[alive], [c[alive] for c in count]
                if not len(row):
                    break
        if len(row):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(hit)
            out.append((row[at] + lo, word[at] * 64 + lane))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same of n nodes as all links a, b do: at most n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(i, root(i)) for i in range(n) if root(i) != i]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, [key], text, f"`{key}` {kind}, fp bigint", lambda ts: {"fp": np.array([fingerprint(t) for t in ts], np.uint64).view(np.int64)})


def _keys(radius: int) -> list[Column]:
    """A key for each pair of radius + 2 blocks of bits."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    part = lambda i: F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << edges[i + 1] - edges[i]) - 1)
    return [F.struct(F.lit(n).alias("n"), part(i).alias("x"), part(j).alias("y")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))]


def candidate_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a > b between distinct fingerprints that join what all links within the radius join."""
    keyed = distinct.select("fp", F.explode(F.array(*_keys(radius))).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("n", "x", "y").agg(F.count("*").alias("size")).where("size > 1")
    blocked = keyed.join(sizes, ["n", "x", "y"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    tasks = blocked.select("fp", "n", "x", "y", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("n", "x", "y", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    dealt = tasks.repartition("n", "x", "y", "i", "j").sortWithinPartitions("n", "x", "y", "i", "j", "fp")

    def found(group: pa.Table) -> pa.RecordBatch:
        fp, own = group.column("fp").to_numpy().view(np.uint64), group.column("own").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        tree: list[tuple[int, int]] = []
        for lo in range(0, len(left), 256):  # a hot key's pairs are folded into the forest as they come
            a, b = links(fp[left[lo : lo + 256]], fp[right], radius)
            a, b = left[lo + a], right[b]
            new = a != b if i != j else a < b
            tree = forest(len(fp), np.array([x for x, _ in tree] + a[new].tolist(), np.int64), np.array([y for _, y in tree] + b[new].tolist(), np.int64))
        s = fp.view(np.int64)
        pairs = np.array([(max(s[x], s[y]), min(s[x], s[y])) for x, y in tree], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(5)]
            new = np.zeros(batch.num_rows, bool)
            for c, k in zip(columns, range(5), strict=True):
                new[1:] |= c[1:] != c[:-1]
                new[0] |= not held or held[-1].column(k)[held[-1].num_rows - 1].as_py() != c[0]
            cuts = [0, *np.flatnonzero(new[1:]) + 1, batch.num_rows]
            if new[0] and held:
                yield found(pa.Table.from_batches(held))
                held = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield found(pa.Table.from_batches(held))
                    held = []
        if held:
            yield found(pa.Table.from_batches(held))

    return dealt.mapInArrow(trimmed(run), "a bigint, b bigint").dropDuplicates()


def components(links_: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for every node of the links a > b.

    Alternates large-star and small-star contraction until nothing changes; each round is a written table.
    """
    spark = links_.sparkSession
    edges, path = written(links_, "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).dropDuplicates()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges, next_path = written(small.where("a <> b").dropDuplicates(), "links")
        before, now = now, state(edges)
        remove(spark, path)
        path = next_path
        if now == before:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("label"))
    return stars.select(F.col("a").alias("node"), "label").union(edges.select(F.col("b"), F.col("b")).dropDuplicates())


def _named(printed: DataFrame, radius: int) -> DataFrame:
    """fp, component_id and label (the least fingerprint of the component), from key and fp."""
    distinct, _ = written(printed.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    labels = components(candidate_links(distinct, radius))
    labelled, _ = written(distinct.join(labels, distinct.fp == labels.node).select("fp", "label", "least"), "labels")
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = labelled.join(lowest, "label").select("fp", "component_id", "label")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, the least key that links reach, for every row."""
    printed, _ = written(fingerprints(docs, key, text).withColumnRenamed(key, "key"), "fingerprints")
    found = printed.join(_named(printed, radius), "fp")
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the least key, null being last; rows of equal keys are told apart by their text. No column of docs is touched, whatever its name."""
    h, kept_key, same = unlike(docs.columns, "h", "kept_key", "same")
    own = docs.withColumn(h, F.xxhash64(docs[text]))
    kind = docs.schema[key].dataType.simpleString()
    keyed = own.select(own[key].alias("key"), own[h].alias("h"), own[text].alias("text"))
    printed, _ = written(map_texts(keyed, ["key", "h"], "text", f"key {kind}, h bigint, fp bigint", lambda ts: {"fp": np.array([fingerprint(t) for t in ts], np.uint64).view(np.int64)}), "fingerprints")
    found = printed.join(_named(printed, radius).select("fp", "label"), "fp")
    stays = found.groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("m")).select(F.col("m.key").alias(kept_key), F.col("m.h").alias(same))
    kept = own.join(stays, own[key].eqNullSafe(stays[kept_key]) & (own[h] == stays[same]), "left_semi")
    return kept.dropDuplicates([key, h]).select(*docs.columns)
