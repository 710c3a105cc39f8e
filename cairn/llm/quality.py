"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated from labelled rows.

Every whole text gives rule statistics; documents that a few random splits of these set apart from known good ones are
anomalous. All labelled rows that pass the base rules take part: a hash of the key deals the good ones into two halves.
Each tree's splits are drawn, as the method has it, from PER_TREE rows of its own, out of all of the first half; how many
rows a leaf stands for, and so the paths' lengths, is counted over all of that half. The threshold is read off the scores
of all of the other half and of all bad rows. Rows stay in Spark: what comes to the driver is bounded by the trees' size
and by BINS, not by the input. Scoring covers every document.

Null texts count as having no words: base_failed, hence not kept. Texts may be of any length; rows may repeat and keys
may be null: each row is judged by its text alone, so ties get the same. An empty table gives an empty result. Without bad
labelled rows, with under two good ones in the first half or none in the other, only the base rules decide. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, remove, written

TREES = 100
PER_TREE = 256
#: The share of good calibration rows that the threshold must keep.
KEEP_GOOD = 0.998
#: Scores are counted in so many bins, each row in one, and thresholds lie between bins.
BINS = 1 << 16
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["chars_a_word", "symbols_a_char", "repeats_a_word", "marks_a_word"]


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(again) + k] |= again
    return int(hit.sum())


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts, and what the forest sees."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    base = [n, chars, symbols, dup, repeated_words(words)]
    marks = len(raw) - len(raw.translate(None, b"!?"))
    some = max(n, 1)
    return base, [chars / some, symbols / max(chars, 1), base[4] / some, marks / some]


@dataclass
class Forest:
    """Random splits. Node i sends x[feature] < cut to left[i], else to left[i] + 1; a leaf (feature -1) adds the mean length of the paths it stands for.

    A cut is drawn from the range of the node's rows widened by `margin` of each feature's deviation over all the
    sample, so what lies beside all known good rows, even in a feature that never varies among them, leaves early.
    """

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    extra: np.ndarray
    scale: float

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, x: np.ndarray, deviation: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, margin: float = 0.5, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        m = min(per_tree, len(x))
        return cls.grow_on([x[rng.choice(len(x), m, replace=False)] for _ in range(trees)], deviation, margin, seed)

    @classmethod
    def grow_on(cls, parts: list[np.ndarray], deviation: np.ndarray, margin: float = 0.5, seed: int = 7) -> Forest:
        """One tree on each part."""
        rng = np.random.default_rng(seed)
        m = max(map(len, parts))
        deepest = 2 * max(1, int(np.ceil(np.log2(max(m, 2)))))
        roots, feature, cut, left, extra = [], [], [], [], []

        def add() -> int:
            for column, value in ((feature, -1), (cut, 0.0), (left, 0), (extra, 0.0)):
                column.append(value)
            return len(feature) - 1

        for whole in parts:
            roots.append(add())
            waiting = [(roots[-1], whole, 0)]
            while waiting:
                i, part, depth = waiting.pop()
                if depth == deepest or len(part) < 2:
                    extra[i] = cls.mean_path(len(part))
                    continue
                low, high = part.min(0) - margin * deviation, part.max(0) + margin * deviation
                wide = np.flatnonzero(high > low)
                if not len(wide):
                    extra[i] = cls.mean_path(len(part))
                    continue
                f = rng.choice(wide)
                feature[i], cut[i], left[i] = f, rng.uniform(low[f], high[f]), add()
                add()
                below = part[:, f] < cut[i]
                waiting += [(left[i], part[below], depth + 1), (left[i] + 1, part[~below], depth + 1)]
        return cls(np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(extra), cls.mean_path(m))

    def masses(self, x: np.ndarray) -> np.ndarray:
        """How many rows of x end at each node."""
        found, at = np.zeros(len(self.feature), np.int64), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                node = np.where(inner, self.left[node] + (x[at, np.maximum(self.feature[node], 0)] >= self.cut[node]), node)
            found += np.bincount(node, minlength=len(found))
        return found

    def weigh(self, masses: np.ndarray, n: int) -> None:
        """From now on leaves stand for these masses, those of n rows."""
        self.extra = np.where(self.feature < 0, [self.mean_path(k) for k in masses], 0.0)
        self.scale = self.mean_path(n)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its usual length: near 1 for what is set apart at once."""
        total, at = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                f = self.feature[node]
                total += inner
                node = np.where(inner, self.left[node] + (x[at, np.maximum(f, 0)] >= self.cut[node]), node)
            total += self.extra[node]
        return 2 ** (-total / len(self.roots) / max(self.scale, 1e-9))


@dataclass
class Judge:
    forest: Forest | None
    threshold: float

    def anomalous(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.forest.score(x) if self.forest and len(x) else np.zeros(len(x))
        return score, score > self.threshold


def binned(score: np.ndarray) -> np.ndarray:
    return np.clip((score * BINS).astype(np.int64), 0, BINS - 1)


def threshold(fine: np.ndarray, poor: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """From the numbers of good and bad rows by bin: the cut with the most bad rows above it, less good ones, among those that keep keep_good of the good."""
    least = int(np.searchsorted(np.cumsum(fine), np.ceil(keep_good * fine.sum())))
    above = lambda n: n.sum() - np.cumsum(n)
    gain = above(poor) / poor.sum() - above(fine) / fine.sum()
    best = least + int(np.argmax(gain[least:]))
    later = np.flatnonzero((fine + poor)[best + 1 :])
    middle = (best + 1 + (later[0] / 2 if len(later) else 0)) / BINS
    return float(np.nextafter(middle, 0))  # a score on the border belongs to the bin above


def fit(x: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD, seed: int = 7) -> Judge:
    """train() on rows in memory: grows the forest on half of the good rows; the other half and the bad rows set the threshold."""
    order = np.random.default_rng(seed).permutation(np.flatnonzero(good))
    grown, held = order[: len(order) // 2], order[len(order) // 2 :]
    if len(grown) < 2 or good.all():
        return Judge(None, np.inf)
    forest = Forest.grow(x[grown], x.std(0), seed=seed)
    forest.weigh(forest.masses(x[grown]), len(grown))
    fine, poor = (np.bincount(binned(forest.score(x[part])), minlength=BINS) for part in (held, ~good))
    return Judge(forest, threshold(fine, poor, keep_good))


def single_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """key and __label of all labelled keys, each once: of contradicting labels the larger counts."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the text column and __label of at most `most` documents, by a hash of their key, for a look at the data; no model is fitted on it.

    Of contradicting labels the larger counts, of a key's repeated rows the text of the least hash: reruns agree.
    """
    some = single_labels(labels, label, key).orderBy(F.xxhash64(F.col(key)), key).limit(most)
    found = docs.select(docs[key], docs[text]).join(F.broadcast(some), key)
    return found.groupBy(key, "__label").agg(F.min_by(text, F.xxhash64(text)).alias(text)).select(key, text, "__label")


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """__key (a hash), part (grown, held or poor) and features of all labelled documents that pass the base rules.

    Statistics are taken before the join, so texts are not shuffled. Of a key's repeated rows the text of the least hash counts.
    """
    given = docs.where(docs.doc_id.isNotNull()).select("doc_id", F.xxhash64(docs.text).alias("__hash"), "text")
    rows = _statistics(given, ["doc_id", "__hash"]).join(single_labels(labels, "quality"), "doc_id")
    rows = rows.groupBy("doc_id", "__label").agg(F.min_by(F.struct("features", "base_failed"), "__hash").alias("s")).where("NOT s.base_failed")
    half = F.when(F.xxhash64("doc_id", F.lit("half")) % 2 == 0, "grown").otherwise("held")
    return rows.select(F.xxhash64("doc_id").alias("__key"), F.when(F.col("__label") == 1, half).otherwise("poor").alias("part"), F.col("s.features").alias("features"))


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def drawn(rows: DataFrame, n: int, trees: int = TREES, per_tree: int = PER_TREE) -> list[np.ndarray]:
    """For each tree its rows, drawn from all n rows: those with the least hash of key and tree, taken from what lies below a bound that leaves a few more."""
    share = min(1.0, (per_tree + 8 * per_tree**0.5) / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, x = b.column(0).to_numpy().astype(np.uint64), _features(b)
            for tree in range(trees):
                h = key + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
                own = np.flatnonzero(u < share)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree, np.int32)), pa.array(u[own]), *(pa.array(c) for c in x[own].T)], names=["tree", "u", *FEATURES])

    found = rows.select("__key", "features").mapInArrow(run, "tree int, u double, " + ", ".join(f"{c} double" for c in FEATURES)).toArrow()
    found = found.sort_by([(c, "ascending") for c in found.column_names])
    tree, x = found.column("tree").to_numpy(), np.stack([found.column(c).to_numpy() for c in FEATURES], 1)
    first = np.searchsorted(tree, np.arange(trees + 1))
    return [x[lo : min(hi, lo + per_tree)] for lo, hi in zip(first[:-1], first[1:], strict=True)]


def tally(rows: DataFrame, names: list[str], size: int, count: object) -> list[np.ndarray]:
    """For each name the numbers 0 to size - 1, summed over all rows; count(batch) gives one array of them for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), size), np.int64)
        for b in batches:
            total += count(b)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], names=["at", *names])

    found = rows.mapInArrow(run, "at bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((len(names), size), np.int64)
    out[:, found.column("at").to_numpy()] = [found.column(c).to_numpy() for c in names]
    return list(out)


def train(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, seed: int = 7) -> Judge:
    """The judge from all labelled rows that pass the base rules; see the module's head for what each part of them does."""
    rows, path = written(labelled_statistics(docs, labels), "quality")
    spread = [F.stddev_pop(F.col("features")[i]).alias(f"d{i}") for i in range(len(FEATURES))]
    n = rows.agg(*[F.count_if(F.col("part") == p).alias(p) for p in ("grown", "held", "poor")], *spread).first()
    if n.grown < 2 or not n.held or not n.poor:
        remove(docs.sparkSession, path)
        return Judge(None, np.inf)
    grown = rows.where("part = 'grown'")
    deviation = np.array([float(f"{n[f'd{i}']:.9g}") for i in range(len(FEATURES))])  # sums in another order agree to so many digits
    forest = Forest.grow_on(drawn(grown, n.grown), deviation, seed=seed)
    (masses,) = tally(grown, ["n"], len(forest.feature), lambda b: forest.masses(_features(b))[None])
    forest.weigh(masses, n.grown)

    def scores(b: pa.RecordBatch) -> np.ndarray:
        at, poor = binned(forest.score(_features(b))), np.array(b.column(1).to_pylist()) == "poor"
        return np.stack([np.bincount(at[part], minlength=BINS) for part in (~poor, poor)])

    fine, poor = tally(rows.where("part <> 'grown'"), ["fine", "poor"], BINS, scores)
    remove(docs.sparkSession, path)
    return Judge(forest, threshold(fine, poor, keep_good))


def _statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    def kernel(batch: list[str]) -> dict[str, object]:
        found = [statistics(t) for t in batch]
        return {"features": [f for _, f in found], "base_failed": [base_failed(*np.array(b)[[0, 4]]) for b, _ in found]}

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(df, keep, "text", f"{kinds}, features array<double>, base_failed boolean", kernel)


def judge(docs: DataFrame, model: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, the base counts, base_failed, anomaly (the forest's score) and kept, for every document."""

    def kernel(batch: list[str]) -> dict[str, object]:
        found = [statistics(t) for t in batch]
        base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
        score, odd = model.anomalous(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
        failed = base_failed(base[:, 0], base[:, 4])
        return dict(zip(BASE, base.T, strict=True)) | {"base_failed": failed, "kept": ~failed & ~odd, "anomaly": score}

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return map_texts(docs, [key], text, schema, kernel)
