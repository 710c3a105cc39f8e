import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cairn.llm import bpe

ODD = [
    "", " ", "  ", "a", "a" * 5001, "ab" * 3000, "中文字符测试" * 200, "x  y\n\n z \t", "\x1c\x1d a\x85b\xa0c  d", "\0a b", "it's we'll 'so don't'", " lead", " \n x",
    "-" * 1000 + "==" * 500, "🙂" * 300, "trail ", "é ١٢ x", "<|endoftext|>", "Ünï\r\ncode sep", "thanea.\nThen  edinth\n\n",
]


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


def samples():
    rng = random.Random(5)
    for alphabet, n in (("ab", 700), ("ab \n's1!.é", 2000), ("thea", 600), ("abcdefghijklmnopqrstuvwxyz", 600)):
        yield "".join(rng.choice(alphabet) for _ in range(n))
    yield "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500))
    yield "".join(chr(rng.randrange(32, 0x2100)) for _ in range(3000))


def test_ids_are_those_of_the_library(codec, reference):
    texts = [*ODD, *samples()]
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]
    assert codec.encode(texts) == got  # now from memory


def test_memory_may_overflow(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 5)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 10)
    texts = ["one two three four", "five six seven", "one five" * 40]
    got = [codec.encode([t])[0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_an_unknown_id_is_an_error(codec):
    with pytest.raises(ValueError):
        codec.decode([np.array([50257], "<u4").tobytes()])


def test_tables(spark, reference):
    rows = [(1, "hello wörld"), (1, "hello wörld"), (2, None), (None, ""), (3, "x" * 100_000 + " y" * 50_000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, ids int")
    both = bpe.decode(bpe.encode(df)).collect()
    assert len(both) == 5
    for r in both:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    got = bpe.round_trip(df.select("doc_id", "text")).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for _, t in rows)
    assert bpe.round_trip(df.limit(0)).count() == 0 == bpe.decode(bpe.encode(df.limit(0))).count()


def test_words_of_a_batch_are_found_at_once(codec, reference, monkeypatch):
    """One search of the pattern for each stretch between spaces took most of the time of a batch of new words."""
    rng, found = random.Random(9), codec.pattern.findall
    signs = ["'", "'s", "'ll", "'re", "'v", "'r", "s", "l", "e", "é", "中", "1", "²", "Ⅷ", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "​", "́", "!", "_", "\0", "🙂"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)] + ODD + ["'", "'s", "s", "'", "ll", "", " ", "x", "\n "]
    want, searched = [found(t) for t in texts], []

    class Search:
        def findall(self, text):
            searched.append(text)
            return found(text)

    monkeypatch.setattr(codec, "pattern", Search())
    assert codec.encode(["edge fringe,\nborder rim. ", "ledge's 22 edges"]) and not searched
    words, counts = codec._words(texts)
    ends = np.cumsum(counts).tolist()
    assert [words[a:b].to_pylist() for a, b in zip([0, *ends], ends, strict=False)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert codec.encode([]) == [] and codec.encode(["", ""]) == [b"", b""]


def test_words_that_recur_stay_known(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 400)
    made, encode_words = [], codec.encode_words
    monkeypatch.setattr(codec, "encode_words", lambda words: made.extend(words) or encode_words(words))
    codec.known.clear()
    for i in range(20):
        codec.encode([f"recurring words {'x'.join(' ' + 'ab' * k + chr(97 + i) for k in range(60))}"])
    assert made.count(" words") == 1 and len(codec.known) <= 400


def test_any_other_pattern(reference):
    own = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), r"\w+|\W")
    other = tiktoken.Encoding("other", pat_str=r"\w+|\W", mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    texts = ["It's one, and  two.", "", "é中1 "]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [other.encode_ordinary(t) for t in texts]
