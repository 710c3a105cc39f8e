"""Hostile words, clashing column names, repeated keys, tiny archives, very repetitive texts."""

import io
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cairn import scratch
from cairn.llm import bpe, common, mixing, multiset_hash, near_copies, pii, quality, simhash, toxicity, warc


@pytest.mark.parametrize("query_bytes", [200_000, 1000])
def test_long_words_are_those_of_the_library(monkeypatch, query_bytes):
    """Random words of few letters, periodic ones, and runs that slices cut, behind what may shift their pairs."""
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "QUERY_BYTES", query_bytes)
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(query_bytes)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdef", "aeiost", "01", "-=") for n in (70, 300, 2500)]
    words += [start + unit * (3000 // len(unit)) for start in ("", "b", "the") for unit in ("a", "ing", "ab", "=", "inter")]
    words += [("a" * 900 + "bc" * 400) * 2, "".join(rng.choice(["a", "ab", "ion", "er"]) * rng.randrange(1, 400) for _ in range(9))]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_words(words)] == [own.encode_ordinary(w) for w in words]


def test_a_word_of_many_slices(monkeypatch):
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    for w in ("".join(rng.choice("abcdef") for _ in range(450_000)), "x" + "=" * 450_000):
        assert np.frombuffer(codec.encode_words([w])[0], "<u4").tolist() == own.encode_ordinary(w)


CLASHING = ["h", "__h", "none", "key", "key_text", "__key", "kept_key", "same", "node", "label", "k", "s", "size_of", "times", "words", "copy", "__own", "__text", "fp", "size", "source_size"]


def clashing(spark):
    rows = [(1, "one two three four five six seven", "a"), (2, "one two three four five six seven", "a"), (3, None, "b"), (4, "", None), (None, "call +49 30 1234567 now " * 20, "b"), (5, "other words stand here, and mail me@example.org too", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])


@pytest.mark.parametrize("stage", [near_copies.deduplicated, simhash.deduplicated, mixing.repeated, pii.redact, lambda d: toxicity.clean(d, None)])
def test_no_column_of_documents_is_touched(spark, stage):
    docs = clashing(spark)
    out = stage(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
    assert stage(docs.limit(0)).count() == 0


def test_stages_take_very_long_texts(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", len(long) + 4), (3, "x" * 300_000, "en", "b", 300_000)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        counts.append(docs.count())
    assert counts[:3] == [3, 2, 2]


def test_similar_sets_lie_within_the_radius():
    """Sets of just the threshold, of every size from the least: both fingerprints together differ in no more bits."""
    rng = np.random.default_rng(2)
    worst = 0
    for n in [4, 5, 8, 9, 12, 20, 50, 200, 1000] * 60:
        common_part = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
        cut = rng.integers(0, len(extra) + 1)
        a, b = (near_copies.prints(np.concatenate([common_part, x])) for x in (extra[:cut], extra[cut:]))
        worst = max(worst, sum((x ^ y).bit_count() for x, y in zip(a, b)))
    assert 20 < worst <= near_copies.RADIUS


def test_bit_slices_of_two_words():
    x = np.random.default_rng(4).integers(0, 2**64, (300, 2), dtype=np.uint64)
    a, b = simhash.links(x[:100], x, near_copies.RADIUS, step=16)
    want = np.nonzero(np.bitwise_count(x[:100, None] ^ x[None]).sum(2) <= near_copies.RADIUS)
    assert list(zip(a.tolist(), b.tolist())) == list(zip(*[w.tolist() for w in want])) and (np.diff(a) >= 0).all()


def test_repetitive_texts_have_a_likeness():
    few, many = (multiset_hash.Fingerprint.of([b"same"] * n) for n in (30_000, 40_000))
    assert abs(few.likeness(many) - 0.96) < 1e-9
    assert abs(multiset_hash.Fingerprint.of([b"same"] * 200_000).likeness(multiset_hash.Fingerprint.of([b"same"] * 100_000)) - 0.8) < 1e-9


def test_null_keys_fall_into_many_parts(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "ROWS_A_PART", 3)
    rows = [(None, f"text {i} of none") for i in range(40)] + [(i, f"text {i}") for i in range(10)] + [(9, "text 9"), (9, "another text 9")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, part string, border int")
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    got = sorted((str(r.doc_id), r.edited_sha256) for r in multiset_hash.report(df).collect())
    digest = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    assert got == sorted((str(k), digest(multiset_hash.edited(t, after[1]))) for (k, t), after in zip(order, order[1:] + order[:1]))


@pytest.mark.parametrize("n", [1, 2, 7, 9, 300])
def test_every_archive_has_a_dictionary(n):
    rng = random.Random(n)
    records = [warc.record(i, f"http://a/{i}", (f"<p>{rng.random()}</p>" * (i % 50)).encode(), "0" * 40, None) for i in range(n)]
    data = b"".join(warc.archive(records))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and size > 100
    assert list(warc.read_archive(io.BytesIO(data))) == records


def test_a_key_counts_once_among_the_labelled(spark):
    docs = spark.createDataFrame([(1, f"copy {i % 3}") for i in range(500)] + [(2, None), (3, "three")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 1), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    got = quality.labelled_sample(docs, labels, "toxic", 6000).collect()
    assert len(got) == 3 and {(r.doc_id, r["__label"]) for r in got} == {(1, 1), (2, 1), (3, 0)}
    assert sorted(map(str, got)) == sorted(map(str, quality.labelled_sample(docs.orderBy(F.rand(3)), labels.orderBy(F.rand(4)), "toxic", 6000).collect()))


def test_scratch_is_swept(spark, tmp_path):
    df, path = common.written(spark.range(3), "swept")
    assert df.count() == 3
    common.remove(spark, path)
    assert path not in scratch._paths
    assert common.unlike(["A", "b"], "a", "b", "a") == ["a_", "b_", "a__"]
