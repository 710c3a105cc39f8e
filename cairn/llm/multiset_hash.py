"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph is what a newline, a sentence's end or PIECE_WORDS words close, without white space around it. Each is
hashed to 64 bytes: LANES signs of one bit and STRONG words of 64 bits. The fingerprint sums the signs (+1 or -1)
modulo 2^32 and the words modulo 2^64 over all paragraphs, repeats included. So order doesn't matter, inserting or
deleting a paragraph adds or subtracts its vector, and equal fingerprints mean equal multisets but for a collision of
STRONG x 64 bits. As the signs are random, the lanes' squared differences estimate how many paragraphs differ, which
gives a likeness of two fingerprints by themselves.

Null texts count as empty: the fingerprint of no paragraph. Texts may be of any length, up to 2^31 paragraphs for a
likeness; a fingerprint has a fixed size. Rows may repeat; an empty table gives an empty result; other columns are not
read. A likeness is an estimate (standard error about 0.09 for unlike texts); equality is exact but for a collision.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, small_batches, written

LANES = 256
STRONG = 4
PIECE_WORDS = 4
#: Rows dealt to one partition when each document must meet the next.
ROWS_A_PART = 3000
#: The most parts: their bounds are a constant of the plan. Beyond, parts grow; a part is sorted with spilling and streamed.
MOST_PARTS = 20_000
SENTENCE = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+")


def paragraphs(text: str) -> list[bytes]:
    out = []
    for line in text.encode().split(b"\n"):
        for sentence in SENTENCE.split(line) if b". " in line or b"! " in line or b"? " in line else (line,):
            words = sentence.split()
            out += [b" ".join(words[i : i + PIECE_WORDS]) for i in range(0, len(words), PIECE_WORDS)]
    return out


class Fingerprint:
    """Sums of paragraph vectors; insert, delete and + keep them exact."""

    def __init__(self, lanes: np.ndarray | None = None, strong: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes
        self.strong = np.zeros(STRONG, np.uint64) if strong is None else strong

    @classmethod
    def of(cls, items: Iterable[bytes]) -> Fingerprint:
        return cls().insert(items)

    @staticmethod
    def _sum(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lanes, strong = np.zeros(LANES, np.int64), np.zeros(STRONG, np.uint64)
        for lo in range(0, len(items), 4096):
            part = items[lo : lo + 4096]
            raw = np.frombuffer(b"".join([hashlib.blake2b(x).digest() for x in part]), np.uint8).reshape(len(part), 64)
            lanes += 2 * np.unpackbits(np.ascontiguousarray(raw[:, :32]), axis=1).sum(0, dtype=np.int64) - len(part)
            strong += np.ascontiguousarray(raw[:, 32:]).view("<u8").sum(0, dtype=np.uint64)
        return lanes.astype(np.uint32), strong

    def insert(self, items: Iterable[bytes]) -> Fingerprint:
        lanes, strong = self._sum(list(items))
        return Fingerprint(self.lanes + lanes, self.strong + strong)

    def delete(self, items: Iterable[bytes]) -> Fingerprint:
        lanes, strong = self._sum(list(items))
        return Fingerprint(self.lanes - lanes, self.strong - strong)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.strong + other.strong)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    __hash__ = None

    def hex(self) -> str:
        return (self.lanes.astype("<u4").tobytes() + self.strong.astype("<u8").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        """An estimate of twice the inner product of both multisets over the sum of their squares: 1 for equal ones, about 0 for what shares nothing."""
        if self == other:
            return 1.0
        a, b = self.lanes.view(np.int32).astype(np.float64), other.lanes.view(np.int32).astype(np.float64)
        return float(max(0.0, 2 * (a @ b) / max(a @ a + b @ b, 1.0)))


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by as much of the start of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint, for every row."""
    return map_texts(docs, [key], text, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string", lambda ts: {"fingerprint": [Fingerprint.of(paragraphs(t)).hex() for t in ts]})


def _parted(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """docs as (part, border, key, text), in parts by descending key; each part ends with a border row: the first of the next part that has rows, after the last part that of the first.

    The bounds are quantiles of the keys. A row finds its part in two steps, through every 64th bound. Borders come
    from a table of one row a part.
    """
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    rows, none = own.agg(F.count("key"), F.count(F.when(F.col("key").isNull(), 1))).first()
    parts = min(MOST_PARTS, max(1, -(-rows // ROWS_A_PART)))
    bounds = sorted(set(own.approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if bounds:
        every = F.array(*[F.lit(int(b)) for b in bounds])
        coarse = F.array(*[F.lit(int(b)) for b in bounds[::64]])
        first = F.size(F.filter(coarse, lambda b: b < F.col("key")))
        fine = F.slice(every, F.greatest(first - 1, F.lit(0)) * 64 + 1, 64)
        above = F.greatest(first - 1, F.lit(0)) * 64 + F.size(F.filter(fine, lambda b: b < F.col("key")))
        part = F.lit(len(bounds)) - above
    else:
        part = F.lit(0)
    # Null keys follow in the order of their texts' hashes, so ranges of these are parts of their own.
    more = min(MOST_PARTS, -(-none // ROWS_A_PART))
    place = F.floor((F.xxhash64("text").cast("double") / F.lit(2.0**64) + 0.5) * more)
    part = F.when(F.col("key").isNull(), len(bounds) + 1 + F.least(place, F.lit(more - 1))).otherwise(part).cast("int") if more else part.cast("int")
    own = own.select(part.alias("part"), "key", "text")
    heads = own.groupBy("part").agg(F.max(F.struct("key", F.bitwise_not(F.xxhash64("text")).alias("h"))).alias("m")).select("part", F.col("m.key").alias("head"), F.bitwise_not("m.h").alias("head_h"))
    order = Window.orderBy(F.col("part").desc())
    last = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = heads.select("part", "head", "head_h", F.lead("part").over(order).alias("before"), F.last("part").over(last).alias("end"))
    to, _ = written(to.select(F.coalesce("before", "end").alias("to"), "part", "head", "head_h"), "borders")
    border = own.join(to.withColumnRenamed("part", "of"), (F.col("part") == F.col("of")) & F.col("key").eqNullSafe(F.col("head")) & (F.xxhash64("text") == F.col("head_h")))
    every_row = own.select("part", F.lit(0).alias("border"), "key", "text").union(border.select(F.col("to"), F.lit(1), "key", "text"))
    return every_row, len(bounds) + 1 + more


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is that with the next lower key; after the last the first follows. Null keys come last; rows of equal
    keys follow each other by a hash of their text. Keys are numbers. A single row is its own next. Each row's text is shuffled once.
    """
    small_batches(docs.sparkSession)
    rows, parts = _parted(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "border", F.col("key").desc_nulls_last(), F.xxhash64("text"))

    def compared(row: tuple, following: tuple) -> tuple:
        k, own, pieces, print_ = row
        _, theirs, _, next_print = following
        changed = edited(own, theirs)
        new = paragraphs(changed)
        same = next((i for i, (a, b) in enumerate(zip_longest(pieces, new)) if a != b), len(new))
        changed_print = print_.delete(pieces[same:]).insert(new[same:])  # only what the edit touches is hashed
        return k, len(own), hashlib.sha256(changed.encode()).hexdigest(), print_.hex(), changed_print.hex(), print_.likeness(changed_print), print_.likeness(next_print)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part = None, None
        for b in batches:
            out = []
            for p, border, k, t in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if border and (waiting is None or p != part):
                    continue  # a further row of the border's key
                own = t or ""
                pieces = paragraphs(own)
                row = (k, own, pieces, Fingerprint.of(pieces))
                if waiting is not None:
                    out.append(compared(waiting, row))
                waiting, part = (None if border else row), p
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds[0] = b.column(2).type
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
