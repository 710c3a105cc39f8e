"""SimHash near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of THRESHOLD or more.

Sets that similar differ in 9.7 of 64 bits on average (up to 12 for the shortest), far beyond what blocks of a fingerprint
can serve as keys for: at a radius of 19 bits, which 0.1 % of them exceed, a block has three bits. So the keys under
which texts meet are minima: BANDS keys, every one of ROWS minima of the shingles' hashes; a pair of similarity s shares
none with probability (1 - s^ROWS)^BANDS, 3 in a million at 0.8, less above. What meets is compared as in simhash: two
fingerprints of 64 bits lie in bit planes, carry-save counters add up many distances at once, and words of lanes beyond
RADIUS of both are dropped (at 0.8 it misses under one pair in ten million, and passes one in forty of unlike texts). The
whole sets of shingles then decide, so no estimate ever links.

Equal sets collapse to one node. Keys that gather just the same nodes are compared once. Large keys are cut into blocks,
and each pair of blocks is a task of its own. A task returns a spanning forest of the links it finds; components come
from star contraction over written tables, as in simhash.

Null texts and texts without a word have one shingle, the empty one, and link to each other. Rows may repeat and keys may
be null. An empty table gives an empty result. Other columns come along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import map_texts, trimmed, unlike, written

#: Similarity from which two texts are near copies, as a fraction.
THRESHOLD = (4, 5)
WIDTH = 5
SEED = 42
BANDS, ROWS = 32, 5
#: The most bits of both fingerprints in which near copies may differ.
RADIUS = 52
#: The most texts, and about the most shingles, of a key that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = text.encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.array([len(w) + 1 for w in words])).tolist()
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)], np.uint64))


def keys(own: np.ndarray) -> np.ndarray:
    """A key for each band, from the minima of the products with FACTORS."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 1024):
        np.minimum(least, (FACTORS[:, None] * own[None, lo : lo + 1024]).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def prints(own: np.ndarray) -> list[int]:
    """Two SimHash fingerprints of a set of shingles: of their hashes, and of these hashed anew."""
    step = 1 << 16
    blocks = [own[lo : lo + step] for lo in range(0, len(own), step)]
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * FACTORS[0]
    return [simhash.majority(blocks), simhash.majority((y := mixed(x)) ^ (y >> np.uint64(32)) for x in blocks)]


def similar(sets: list[np.ndarray], fingerprints: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between left and right that join what all pairs of THRESHOLD or more, and within RADIUS, between them join."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts, label, mark, out = ends - sizes, np.arange(len(sets)), np.zeros(ids.max() + 1, np.int32), []
    part, whole = THRESHOLD
    same = left is right
    near = _near(fingerprints, left, right)
    for at, x in enumerate(left.tolist()):
        others = next(near)
        others = right[others[others > at] if same else others]
        n = sizes[others]
        others = others[(label[others] != label[x]) & (whole * np.minimum(n, sizes[x]) >= part * np.maximum(n, sizes[x]))]
        if not len(others):
            continue
        own = ids[starts[x] : ends[x]]
        mark[own] = 1
        n = sizes[others]
        cuts = np.cumsum(n) - n
        common = np.add.reduceat(mark[np.concatenate([ids[starts[y] : ends[y]] for y in others.tolist()])], cuts)
        mark[own] = 0
        for y in others[whole * common >= part * (n + sizes[x] - common)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _near(fingerprints: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """For each of left, the places in right of those within RADIUS."""
    for lo in range(0, len(left), 256):
        part = left[lo : lo + 256]
        a, b = simhash.links(fingerprints[part], fingerprints[right], RADIUS, step=16)
        ends = np.searchsorted(a, np.arange(len(part) + 1))
        yield from (b[x:y] for x, y in zip(ends, ends[1:], strict=False))


def links(nodes: DataFrame, sets: DataFrame, proposed: DataFrame) -> DataFrame:
    """Links a > b between nodes (node, n, bands), from proposed (x, size, total) keys and the sets (node, own, prints) of their members."""
    members = nodes.select("node", F.explode("bands").alias("x")).join(proposed, "x")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    blocked = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tasks = blocked.select("node", "x", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("x", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node").join(sets, "node")
    dealt = tasks.select("x", "i", "j", "mine", "node", "own", "prints").repartition("x", "i", "j").sortWithinPartitions("x", "i", "j")

    def found(group: pa.Table) -> pa.RecordBatch:
        node, mine = group.column("node").to_numpy(), group.column("mine").to_numpy()
        own = [s.values.to_numpy().view(np.uint64) for s in group.column("own")]
        fingerprints = np.array(group.column("prints").to_pylist(), np.int64).view(np.uint64)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left = np.flatnonzero(mine == i)
        pairs = similar(own, fingerprints, left, left if i == j else np.flatnonzero(mine == j))
        ends = np.array([(max(node[a], node[b]), min(node[a], node[b])) for a, b in pairs], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, i, j = (batch.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and last != (x[a], i[a], j[a]):
                    yield found(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = (x[a], i[a], j[a])
        if held:
            yield found(pa.Table.from_batches(held))

    return dealt.mapInArrow(trimmed(run), "a bigint, b bigint").dropDuplicates()


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least key, null being last; rows of equal keys are told apart by their text."""
    h, none, key_text = unlike(docs.columns, "h", "none", "key_text")
    own = docs.withColumns({h: F.xxhash64(docs[text]), none: docs[key].isNull(), key_text: F.coalesce(docs[key].cast("string"), F.lit(""))})
    kind = docs.schema[key].dataType.simpleString()

    def digests(batch: list[str]) -> dict[str, object]:
        sets = [shingles(t) for t in batch]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        return {"node": node, "n": np.array([len(s) for s in sets], np.int64), "bands": pa.array([keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))}

    first = own.select(own[none].alias("none"), own[key].alias("key"), own[h].alias("h"), own[text].alias("text"))
    printed = map_texts(first, ["none", "key", "h"], "text", f"none boolean, key {kind}, h bigint, node bigint, n bigint, bands array<bigint>", digests)
    nodes, _ = written(printed.groupBy("node").agg(F.min(F.struct("none", "key", "h")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")

    keyed = nodes.select("node", "n", F.explode("bands").alias("x"))
    gathered = keyed.groupBy("x").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("members")).where("size > 1")
    proposed, _ = written(gathered.groupBy("size", "total", "members").agg(F.min("x").alias("x")).select("x", "size", "total"), "proposed")
    asked = nodes.join(keyed.join(proposed, "x", "left_semi").select("node").distinct(), "node", "left_semi")

    def row(m: str):
        return [F.col(f"{m}.none").alias(none), F.coalesce(F.col(f"{m}.key").cast("string"), F.lit("")).alias(key_text), F.col(f"{m}.h").alias(h)]

    found = [none, key_text, h]
    (node,) = unlike(found, "node")
    texts = own.select(*found, own[text].alias("text")).join(asked.select(F.col("node").alias(node), *row("least")), found).dropDuplicates(found)

    def gather(batch: list[str]) -> dict[str, object]:
        sets = [shingles(t) for t in batch]
        both = np.array([prints(s) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
        return {"own": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), "prints": pa.array(list(both), pa.list_(pa.int64()))}

    sets = map_texts(texts.select(F.col(node).alias("node"), "text"), ["node"], "text", "node bigint, own array<bigint>, prints array<bigint>", gather)
    labels = simhash.components(links(nodes, sets, proposed)).withColumnRenamed("node", "linked")
    labelled = nodes.join(labels, nodes.node == labels.linked, "left").select(F.coalesce("label", "node").alias("label"), "least")
    stays = labelled.groupBy("label").agg(F.min("least").alias("m")).select(*row("m"))
    return own.join(stays, found, "left_semi").dropDuplicates(found).select(*docs.columns)
