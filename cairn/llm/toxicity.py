"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's vector is the sum of rows of one hashed table: that of the word and those of its first four and five bytes.
Filters of WIDTHS words slide over the whole text, each keeps its maximum, and a logistic layer weighs the maxima. The
language, which sets the threshold, is guessed from the text's function words; the score is then rescaled so that 0.5
is the threshold. Nothing but the text enters a score.

Null and empty texts are a text without words: they get the score that the bias gives. Texts may be of any length;
rows may repeat and keys may be null: each row is scored by its text alone. An empty table gives an empty result;
without labelled rows of both kinds every score is 0.

The classifier is fitted on all labelled rows and all their words, the held-out fifth left out; a quarter of the rows, by a
hash of the key, calibrates instead. Training goes in ROUNDS: every shard of rows (about SHARD_WORDS words of one task, twice as many at most) goes
on from the common model, and the shards' changes are averaged, those of a row of the table over the shards that changed
it. Which rows share a shard depends on how Spark splits the files. What comes to the driver is the model, and counts by
language and by GRID steps of the score, whatever the number of rows. Scoring covers every row and all its words.
"""

from __future__ import annotations

import copy
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, small_batches, texts, trimmed, written
from .quality import single_labels, tally

BUCKETS = 1 << 15  # 16 bits hold a row's number
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
BATCH = 64
#: Rows of the table that fewer training texts use stay zero, as they'd only learn those texts by heart.
RARE = 4
#: Minibatches of a shard in all rounds; a shard of few rows passes by more often, as far as ROUND_WORDS words a round, and any PASSES times a round.
STEPS = 900
ROUNDS = 4
PASSES = 3
ROUND_WORDS = 6_000_000
#: Words that make a shard full, and a pack, the stored unit. All texts count, a longer one makes a larger shard.
SHARD_WORDS = 2_000_000
PACK_WORDS = 200_000
#: Words whose windows are computed at once; only speed and memory depend on it.
BLOCK_WORDS = 16_000
#: Steps of the score that thresholds are chosen from.
GRID = 10_000
#: Bytes of text that are split and hashed at once, up to the next white space; of words with more than LONG bytes each is hashed alone.
PIECE = 1 << 17
LONG = 32
PAD = max(WIDTHS) - 1
STRIP = b".,;:!?\"'()[]{}<>*#%&$|-_"

#: Frequent function words of each language; a text's language is that with most of them.
LANGUAGES = {
    "en": "the of and to in is that for it with as was on are by this be from or an at not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les de et des un une du en que qui dans pour par sur au pas est plus ne",
    "es": "el la los las de y que en un una por con para del se no su al lo como más",
}
NAMES = [*LANGUAGES, "other"]
_VOTES = {w.encode(): frozenset(i for i, words in enumerate(LANGUAGES.values()) if w in words.split()) for ws in LANGUAGES.values() for w in ws.split()}


def lowered(text: str) -> bytes:
    return text.lower().encode()


def split(text: str) -> list[bytes]:
    return lowered(text).split()


def buckets(word: bytes) -> tuple[int, int, int]:
    """Rows of the table for the word and for its first four and five bytes. Row 0 is kept for the padding."""
    w = word.strip(STRIP) or word
    return 1 + zlib.crc32(w) % (BUCKETS - 1), 1 + zlib.crc32(w[:4], 4) % (BUCKETS - 1), 1 + zlib.crc32(w[:5], 5) % (BUCKETS - 1)


def language(words: list[bytes]) -> int:
    votes = [0] * len(LANGUAGES)
    for w in words:
        for i in _VOTES.get(w, ()):
            votes[i] += 1
    return int(np.argmax(votes)) if any(votes) else len(LANGUAGES)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_KIND = np.zeros(256, np.uint8)  # of a byte: 1 for white space, 2 if it is stripped
_KIND[[*b" \t\n\v\f\r"]], _KIND[[*STRIP]] = 1, 2
#: CRC-32 is linear: that of a word is that of as many zeros, and of each byte what it adds; a byte followed by k others adds _ADDS[k + 1]. Row 0 adds nothing.
_ADDS = np.array([[0] * 256, *([zlib.crc32(bytes([b, *bytes(k)])) ^ zlib.crc32(bytes(k + 1)) for b in range(256)] for k in range(LONG))], np.uint32).ravel()
_ZEROS = np.array([[zlib.crc32(bytes(n), start) for n in range(LONG + 1)] for start in (0, 4, 5)], np.uint32)
#: The function words as numbers: their bytes, at most 7, and their length.
_CODES, _CODE_VOTES = (np.array(x) for x in zip(*sorted((int.from_bytes(w, "little") | len(w) << 56, [i in v for i in range(len(LANGUAGES))]) for w, v in _VOTES.items()), strict=True))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)], np.int64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where data's words begin, buckets() of each, and of the function words the places among the words and among _CODES."""
    b = np.frombuffer(data + bytes(8), np.uint8)
    kind = _KIND.take(b[: len(data)])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kind == 1, [True]])))
    begin, end = edges[::2], edges[1::2]
    short = np.flatnonzero(end - begin < 8)
    codes = np.lib.stride_tricks.sliding_window_view(b, 8)[begin[short]].view(np.int64)[:, 0]
    codes = codes & _MASKS[(end - begin)[short]] | (end - begin)[short] << 56
    at = np.minimum(np.searchsorted(_CODES, codes), len(_CODES) - 1)
    votes = _CODES[at] == codes
    first, last = begin.copy(), end.copy()
    edge = np.flatnonzero((kind[begin] == 2) | (kind[end - 1] == 2))
    if len(edge):
        inner = np.flatnonzero(kind == 0)
        lo, hi = np.searchsorted(inner, begin[edge]), np.searchsorted(inner, end[edge])
        edge, lo, hi = edge[lo < hi], lo[lo < hi], hi[lo < hi]  # a word of nothing else stays
        first[edge], last[edge] = inner[lo], inner[hi - 1] + 1
    size = last - first
    long = np.flatnonzero(size > LONG)
    size[long] = 5  # what their beginnings need
    out = np.empty((len(first), 3), np.uint16)
    ends = np.cumsum(size)
    if len(first):
        steps = np.arange(ends[-1])
        left, letters = np.repeat(ends, size) - steps, b.take(np.repeat(first - ends + size, size) + steps)
        whole = np.bitwise_xor.reduceat(_ADDS.take(left * 256 + letters), ends - size) ^ _ZEROS[0].take(size)
        for i in long.tolist():
            whole[i] = zlib.crc32(data[first[i] : last[i]])
        out[:, 0] = whole % (BUCKETS - 1) + 1
        heads = [b.take(first + j) for j in range(5)]
        for c, most in ((1, 4), (2, 5)):
            n = np.minimum(size, most)
            crc = _ZEROS[c].take(n)
            for j in range(most):
                crc ^= _ADDS.take(np.maximum(n - j, 0) * 256 + heads[j])
            out[:, c] = crc % (BUCKETS - 1) + 1
    return begin, out, short[votes], at[votes]


def hashed(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """buckets() of every word of the texts, how many words each text has, and its language()."""
    data = [lowered(x) for x in batch]
    whole = b" ".join(data)
    starts = np.cumsum([0, *[len(x) + 1 for x in data]])[:-1]
    counts, votes, ids, lo = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(LANGUAGES)), np.int64), [np.zeros((0, 3), np.uint16)], 0
    while lo < len(whole):
        cut = _SPACE.search(whole, lo + PIECE)
        hi = cut.start() if cut else len(whole)
        begin, found, which, code = _words(whole[lo:hi])
        owner = np.searchsorted(starts, begin + lo, "right") - 1
        counts += np.bincount(owner, minlength=len(batch))
        for i in range(len(LANGUAGES)):
            votes[:, i] += np.bincount(owner[which[_CODE_VOTES[code, i]]], minlength=len(batch))
        ids.append(found)
        lo = hi
    return np.concatenate(ids), counts, np.where(votes.any(1), votes.argmax(1), len(LANGUAGES))


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    shift: list[np.ndarray]
    weight: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language

    @classmethod
    def start(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        table[0] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, np.full(len(NAMES), 0.5))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.table.take(ids[:, 0], 0)
        x += self.table.take(ids[:, 1], 0)
        x += self.table.take(ids[:, 2], 0)
        return x

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weight + self.bias


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' rows, PAD empty ones after each, and where each starts."""
    gap = np.zeros((PAD, 3), np.int32)
    starts = np.cumsum([0, *[len(d) + PAD for d in docs]])[:-1]
    return np.concatenate([x for d in docs for x in (d, gap)]), starts


def _maxima(m: Model, ids: np.ndarray, starts: np.ndarray, placed: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width the texts' maxima (before the cut at 0) and, if placed, their first places, in blocks, so that memory doesn't follow a text's length."""
    tops = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    places = np.zeros(tops.shape, np.int64)
    matrix = np.concatenate([f[j] for f in m.filters for j in range(len(f))], 1).T.copy()
    shift = np.concatenate(m.shift)
    for lo in range(0, len(ids), BLOCK_WORDS):
        hi = min(len(ids), lo + BLOCK_WORDS)
        n, pad = hi - lo, np.flatnonzero(ids[lo:hi, 1] == 0)
        x = m.vectors(ids[lo : hi + PAD])
        products = np.zeros((len(matrix), n + PAD), np.float32)
        np.matmul(matrix, x.T, out=products[:, : len(x)])
        y, row = np.empty((len(shift), n), np.float32), 0
        for k, w in enumerate(WIDTHS):
            part = y[k * FILTERS : (k + 1) * FILTERS]
            part[:] = products[row : row + FILTERS, :n]
            for j in range(1, w):
                part += products[row + j * FILTERS : row + (j + 1) * FILTERS, j : j + n]
            row += w * FILTERS
        y[:, pad] = 0  # else a window there would reach into the next text
        y += shift[:, None]
        first = int(np.searchsorted(starts, lo, "right")) - 1
        docs = slice(first, int(np.searchsorted(starts, hi, "left")))
        begin = np.maximum(starts[docs], lo) - lo
        top = np.maximum.reduceat(y, begin, 1).T
        if placed:
            at = np.array([y[:, a:b].argmax(1) for a, b in zip(begin, [*begin[1:], n], strict=True)]) + begin[:, None] + lo
            places[docs] = np.where(top > tops[docs], at, places[docs])
        tops[docs] = np.maximum(top, tops[docs])
    cuts = [slice(k * FILTERS, (k + 1) * FILTERS) for k in range(len(WIDTHS))]
    return [tops[:, c] for c in cuts], [places[:, c] for c in cuts]


def pooled(m: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum(np.concatenate(_maxima(m, ids, starts, False)[0], 1), 0)


def probabilities(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    found = [pooled(m, *_padded(docs[lo : lo + 256])) for lo in range(0, len(docs), 256)]
    return 1 / (1 + np.exp(-np.clip(m.logit(np.concatenate(found)), -30, 30)))


def seen_in(docs: list[np.ndarray]) -> np.ndarray:
    """How many of the texts use each row of the table."""
    found, last = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for d in docs:
        rows, at = d.ravel().astype(np.int64), np.arange(d.size)
        last[rows] = at
        found[rows[last[rows] == at]] += 1  # each row once
    return found


class State:
    """A model in training: with the sums of squares of Adagrad, and the rows of the table that stay zero."""

    def __init__(self, seen: np.ndarray, seed: int):
        self.model = Model.start(seed)
        self.rare = seen < RARE
        self.rare[0] = True
        self.model.table[self.rare] = 0
        self.table_squares = np.full(BUCKETS, 1e-3, np.float32)
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.dense().items()}

    def dense(self) -> dict[str, np.ndarray]:
        """All but the table; the arrays are the model's own, but for the bias."""
        m = self.model
        return {"weight": m.weight, "bias": np.array([m.bias], np.float32)} | {f"shift{k}": x for k, x in enumerate(m.shift)} | {f"filter{k}": x for k, x in enumerate(m.filters)}

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The table with its squares as last column; the rest, with its squares after it."""
        return np.column_stack([self.model.table, self.table_squares]).astype(np.float64), np.concatenate([x.ravel() for part in (self.dense(), self.squares) for x in part.values()]).astype(np.float64)

    def add(self, table: np.ndarray, rest: np.ndarray) -> None:
        """Adds changes of flat()'s shapes."""
        self.model.table += table[:, :DIM].astype(np.float32)
        self.table_squares += table[:, DIM].astype(np.float32)
        at = 0
        for part in (self.dense(), self.squares):
            for name, x in part.items():
                x += rest[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
                if part is not self.squares and name == "bias":
                    self.model.bias = float(x[0])

    def descend(self, docs: list[np.ndarray], toxic: np.ndarray, passes: int, rng: np.random.Generator, rate: float = 0.03) -> None:
        """Minibatch Adagrad on the logistic loss. Only the words that a maximum picks get a gradient."""
        m, rare, table_squares = self.model, self.rare, self.table_squares

        def step(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
            s = self.squares[name]
            s += gradient**2
            value -= rate * gradient / np.sqrt(s)

        for _ in range(passes):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                ids, starts = _padded([docs[i] for i in part])
                pad = ids[:, 1] == 0
                ids[rng.random(len(ids)) < 0.03, 0] = 0  # some words are known by their first bytes only
                tops, places = _maxima(m, ids, starts)
                p = np.concatenate([np.maximum(t, 0) for t in tops], 1)
                error = ((1 / (1 + np.exp(-np.clip(m.logit(p), -30, 30)))) - toxic[part]) / len(part)
                back = np.outer(error, m.weight).astype(np.float32)
                step("weight", m.weight, p.T @ error.astype(np.float32) + 1e-5 * m.weight)
                bias = np.array([m.bias], np.float32)
                step("bias", bias, np.array([error.sum()], np.float32))
                m.bias = float(bias[0])
                end = np.concatenate([ids, np.zeros((PAD, 3), ids.dtype)])
                hit_rows, hit_grads = [], []
                for k, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
                    at = places[k]
                    g = back[:, k * FILTERS : (k + 1) * FILTERS] * (tops[k] > 0)
                    df = np.zeros_like(f)
                    in_text = g * ~pad[at]
                    for j in range(w):
                        seen = m.vectors(end[at + j].reshape(-1, 3)).reshape(*at.shape, DIM)
                        df[j] = np.einsum("nf,nfd->df", in_text, seen)
                        inside = at + j < len(ids)
                        hit_rows.append((at + j)[inside])
                        hit_grads.append((in_text[:, :, None] * f[j].T[None])[inside])
                    step(f"shift{k}", m.shift[k], g.sum(0))
                    step(f"filter{k}", f, df)
                rows, grads = np.concatenate(hit_rows), np.concatenate(hit_grads)
                for c in range(3):
                    target = ids[rows, c]
                    by_row = np.argsort(target, kind="stable")
                    target = target[by_row]
                    begin = np.flatnonzero(np.diff(target, prepend=-1))
                    found, total = target[begin], np.add.reduceat(grads.take(by_row, 0), begin, 0)
                    total[rare[found]] = 0
                    table_squares[found] += (total**2).mean(1)
                    m.table[found] -= rate * total / np.sqrt(table_squares[found])[:, None]


def train(docs: list[np.ndarray], toxic: np.ndarray, steps: int = STEPS, seed: int = 11, rate: float = 0.03) -> Model:
    """One shard, in memory."""
    state = State(seen_in(docs), seed)
    state.descend(docs, toxic, -(-steps * BATCH // max(len(docs), 1)), np.random.default_rng(seed), rate)
    return state.model


class Scorer:
    """Scores texts, some at a time; a very long one in blocks that overlap."""

    def __init__(self, model: Model):
        self.model = model

    def score(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rescaled scores, and the guessed languages."""
        found, langs = [np.zeros((0, FILTERS * len(WIDTHS)), np.float32)], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(batch):
            size, hi = len(batch[lo]), lo + 1
            while hi < len(batch) and size + len(batch[hi]) < PIECE:
                size += len(batch[hi])
                hi += 1
            ids, counts, lang = hashed(batch[lo:hi])
            starts = np.cumsum(counts + PAD) - counts - PAD
            padded = np.zeros((len(ids) + PAD * len(counts), 3), np.uint16)
            padded[np.arange(len(ids)) + np.repeat(PAD * np.arange(len(counts)), counts)] = ids
            found.append(pooled(self.model, padded, starts))
            langs.append(lang)
            lo = hi
        p = 1 / (1 + np.exp(-np.clip(self.model.logit(np.concatenate(found)), -30, 30)))
        lang = np.concatenate(langs)
        return rescaled(p, self.model.thresholds[lang]), lang


def rescaled(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def _cells(p: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return lang * GRID + np.clip((p * GRID).astype(np.int64), 0, GRID - 1)


def calibrate(model: Model, p: np.ndarray, toxic: np.ndarray, lang: np.ndarray) -> None:
    cells = _cells(p, lang)
    calibrate_on(model, *(np.bincount(cells[part], minlength=GRID * len(NAMES)) for part in (toxic, ~toxic)))


def calibrate_on(model: Model, toxic: np.ndarray, fine: np.ndarray) -> None:
    """From the rows' numbers by cell: for each language the threshold with the fewest errors, halfway in its gap; where a language has under 20 rows of either kind, that of all rows."""

    def best(y: np.ndarray, n: np.ndarray) -> float:
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
        good = np.flatnonzero(errors == errors.min())
        return float(np.clip(good[len(good) // 2] / GRID, 0.01, 0.99))

    toxic, fine = toxic.reshape(-1, GRID), fine.reshape(-1, GRID)
    both = best(toxic.sum(0), fine.sum(0)) if toxic.any() and fine.any() else 0.5
    for i in range(len(NAMES)):
        model.thresholds[i] = best(toxic[i], fine[i]) if min(toxic[i].sum(), fine[i].sum()) >= 20 else both


def fit_rows(ids: list[np.ndarray], toxic: np.ndarray, lang: np.ndarray, seed: int = 11) -> Model | None:
    """train_on() for rows in memory: three quarters of the rows train, the rest calibrate."""
    if not toxic.any() or toxic.all():
        return None
    order = np.random.default_rng(seed).permutation(len(ids))
    cut = max(1, len(order) * 3 // 4)
    model = train([ids[i] for i in order[:cut]], toxic[order[:cut]].astype(np.float32), seed=seed)
    held = order[cut:] if cut < len(order) else order
    calibrate(model, probabilities(model, [ids[i] for i in held]), toxic[held], lang[held])
    return model


PACK = "calibrates boolean, n bigint, n_toxic bigint, keys binary, sizes binary, ids binary, toxic binary, lang binary"


def packs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled rows outside the held-out fifth, whole texts as rows of the table, many in a row of their own. Of a key's repeated rows the text of the least hash counts."""
    small_batches(docs.sparkSession)
    learnt = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = docs.select(docs.doc_id, docs.text).where(learnt).join(single_labels(labels.where(learnt), "toxic"), "doc_id")
    rows = rows.groupBy("doc_id", "__label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def pack(c: bool) -> pa.RecordBatch:
            key, toxic, ids, lang = zip(*held[c], strict=True)
            made = [c, len(key), sum(toxic), np.array(key, np.int64).tobytes(), np.array([len(x) for x in ids], np.int64).tobytes(), b"".join(x.tobytes() for x in ids), bytes(toxic), bytes(lang)]
            held[c], size[c] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=[x.split()[0] for x in PACK.split(", ")])

        for b in batches:
            given = texts(b.column(3))
            rows = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            for lo in range(0, len(given), 16):
                ids, counts, lang = hashed(given[lo : lo + 16])
                ends = np.cumsum(counts)
                for n, a, z, (key, c, toxic) in zip(lang.tolist(), ends - counts, ends, itertools.islice(rows, len(counts)), strict=True):
                    held[c].append((key, int(toxic), ids[a:z], n))
                    size[c] += int(z - a) + PAD
                    if size[c] >= PACK_WORDS:
                        yield pack(c)
        for c in held:
            if held[c]:
                yield pack(c)

    calibrates = F.xxhash64("doc_id", F.lit("calibrates")) % 4 == 0
    return rows.select(F.xxhash64("doc_id"), calibrates, F.col("__label") == 1, "text").mapInArrow(trimmed(run), PACK)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Of each pack the keys, texts, labels and languages."""
    for r in batch.to_pylist():
        sizes = np.frombuffer(r["sizes"], np.int64)
        ids = np.frombuffer(r["ids"], np.uint16).reshape(-1, 3)
        yield np.frombuffer(r["keys"], np.int64), np.split(ids, np.cumsum(sizes)[:-1]), np.frombuffer(r["toxic"], np.uint8) == 1, np.frombuffer(r["lang"], np.uint8).astype(np.int64)


BLOCK_ROWS = 1024


def _round(shards: DataFrame, state: State, turn: int, seed: int) -> None:
    """Every shard goes on from state; then state takes their average change."""
    given = shards.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = given.value
        table0, rest0 = start.flat()
        table, rest, first = np.zeros((BUCKETS, DIM + 2)), np.zeros(len(rest0) + 1), None
        held: list[tuple] = []

        def learn() -> None:
            nonlocal rest, first
            own = copy.deepcopy(start)
            keys, docs, toxic = np.concatenate([h[0] for h in held]), [d for h in held for d in h[1]], np.concatenate([h[2] for h in held])
            order = np.argsort(keys, kind="stable")
            low = int(keys[order[0]]) % 2**64
            passes = max(PASSES, min(-(-STEPS * BATCH // ROUNDS // len(docs)), ROUND_WORDS // (sum(map(len, docs)) + 1)))
            own.descend([docs[i] for i in order], toxic[order].astype(np.float32), passes, np.random.default_rng([seed, turn, low]))
            t, r = own.flat()
            t -= table0
            table[:] += np.column_stack([t, t.any(1)])
            rest += np.append(r - rest0, 1)
            first = low if first is None else min(first, low)
            held.clear()

        words = 0
        for b in batches:
            for pack in _unpacked(b):
                held.append(pack)
                words += sum(len(d) + PAD for d in pack[1])
                if words >= 2 * SHARD_WORDS:
                    learn()
                    words = 0
        if held:
            learn()
        if first is not None:
            parts = [*(table[lo : lo + BLOCK_ROWS] for lo in range(0, BUCKETS, BLOCK_ROWS)), rest]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([f"{first:020d}"] * len(parts)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "first", "data"])

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("first")  # so that sums agree in all runs
        data = sum(np.frombuffer(x.as_py()) for x in rows.column("data"))
        return pa.table({"part": rows.column("part").slice(0, 1), "data": pa.array([data.tobytes()], pa.binary())})

    schema = "part int, first string, data binary"
    found = shards.mapInArrow(trimmed(run), schema).groupBy("part").applyInArrow(total, "part int, data binary").toArrow().sort_by("part")
    *table, rest = [np.frombuffer(x) for x in found.column("data").to_pylist()]
    whole = np.concatenate(table).reshape(BUCKETS, DIM + 2)
    state.add(whole[:, :-1] / np.maximum(whole[:, -1:], 1), rest[:-1] / rest[-1])
    given.destroy()


def train_on(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model | None:
    """The model of all labelled rows outside the held-out fifth: crc32 of doc_id, as text, not divisible by 5."""
    rows, path = written(packs(docs, labels), "toxicity")
    counts = {r.calibrates: (r.n, r.n_toxic) for r in rows.groupBy("calibrates").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).collect()}
    n, n_toxic = (sum(c[i] for c in counts.values()) for i in range(2))
    model = None
    if 0 < n_toxic < n:
        own, own_toxic = counts.get(False, (0, 0))
        shards = rows.where("NOT calibrates") if 0 < own_toxic < own else rows  # very few rows do both
        (seen,) = tally(shards, ["n"], BUCKETS, lambda b: sum(seen_in(d) for _, d, *_ in _unpacked(b))[None] if b.num_rows else 0)
        state = State(seen, seed)
        words = shards.agg(F.sum(F.length("ids"))).first()[0] // 6
        shards = shards.coalesce(words // SHARD_WORDS + 1)  # else many small files would make shards of few rows
        for turn in range(ROUNDS):
            _round(shards, state, turn, seed)
        model = state.model

        def cells(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((2, GRID * len(NAMES)), np.int64)
            for _, d, toxic, lang in _unpacked(b):
                at = _cells(probabilities(model, d), lang)
                out += [np.bincount(at[part], minlength=out.shape[1]) for part in (toxic, ~toxic)]
            return out

        calibrate_on(model, *tally(rows.where("calibrates") if True in counts else rows, ["toxic", "fine"], GRID * len(NAMES), cells))
    remove(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns keep (all, if None) with score, predicted and guessed_lang added; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "guessed_lang")]
    given = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats: 1.6 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value) if given.value else None
        for b in batches:
            s, lang = scorer.score(texts(b.column(len(names)))) if scorer else (np.zeros(b.num_rows), np.full(b.num_rows, len(NAMES) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array([NAMES[i] for i in lang])], names=[*names, "score", "predicted", "guessed_lang"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*[docs[c] for c in names], docs[text].alias("__text")).mapInArrow(trimmed(run), f"{kinds}score double, predicted int, guessed_lang string")


def clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value) if given.value else None
        for b in batches:
            yield b.filter(pa.array(scorer.score(texts(b.column(names.index(text))))[0] < 0.5)) if scorer and b.num_rows else b

    return docs.mapInArrow(trimmed(run), docs.schema)
