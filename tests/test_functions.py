import hashlib
import os
import random

import pytest

from cairn.functions import blake3, cdc, compression, merkle


def test_blake3_known_values():
    """The published vectors' input: bytes i % 251."""
    given = [bytes(i % 251 for i in range(n)) for n in (0, 1, 1024, 102400)]
    assert [d.hex()[:16] for d in blake3.digests(given)] == ["af1349b9f5f9a1a6", "2d3adedff11b61f1", "42214739f095a406", "bc3e3d41a1146b06"]


def test_blake3_against_the_jvm(spark):
    """Spark ships an implementation of its own."""
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    inputs = [os.urandom(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 7168, 7169, 70000)]
    for key in (blake3.DATA_KEY, blake3.NODE_KEY):
        ours = blake3.digests(inputs, key)
        theirs = [bytes(jvm.keyedHash(bytearray(key), bytearray(x))) for x in inputs]
        assert ours == theirs


def by_the_book(data: bytes, c: cdc.Chunking) -> list[int]:
    ends, start = [], 0
    while start < len(data):
        left = len(data) - start
        if left < c.least:
            return [*ends, len(data)]
        h, end = 0, min(start + c.most, len(data))
        for i in range(start + max(c.least - 65, 0), end):
            h = ((h << 1) + int(c.table[data[i]])) % 2**64
            if h & c.mask == 0:
                end = i + 1
                break
        start += max(end - start, min(c.least, left))
        ends.append(start)
    return ends


@pytest.mark.parametrize("target", [128, 512, 1024, 4096])
def test_chunking_is_the_rolling_definition(target):
    c = cdc.Chunking(target)
    for data in (b"", b"x", os.urandom(40000), b"\xab" * 30000, b"test data for chunking" * 1000, bytes(2000)):
        assert cdc.boundaries(data, c) == by_the_book(data, c)


def test_chunk_bounds_and_coverage():
    data = b"\xab" * (512 << 10)
    sizes = [n for _, n in cdc.chunks(data)]
    assert sum(sizes) == len(data) and all(8192 <= n <= 131072 for n in sizes[:-1]) and sizes[-1] <= 131072
    assert cdc.chunks(bytes(1024)) == [(0, 1024)]
    with pytest.raises(ValueError):
        cdc.Chunking(1000)


def test_streaming_equals_one_shot():
    data = bytes(i % 256 for i in range(500_000))
    s, got = cdc.StreamingChunker(cdc.Chunking(1024)), []
    for i in range(0, len(data), 8192):
        got += s.feed(data[i : i + 8192])
    got += s.finish()
    assert [(a, len(b)) for a, b in got] == cdc.chunks(data, cdc.Chunking(1024)) and b"".join(b for _, b in got) == data


def test_merkle_groups_and_roots():
    assert merkle.root([]) == bytes(32) == merkle.file_hash([])
    one = [(b"\1" * 32, 5)]
    assert merkle.root(one) == one[0][0] != merkle.file_hash(one)
    odd = b"\1" * 32
    assert merkle.groups([odd] * 20) == [9, 18, 20]
    assert merkle.groups([b"\4" * 32] * 7) == [3, 6, 7]
    two = [(b"\1" * 32, 5), (b"\2" * 32, 6)]
    assert merkle.root(two) == blake3.node_hash([b"".join(merkle.line(*x) for x in two)])[0] != merkle.root(two[::-1])
    lists = [[(bytes([i]) * 32, i) for i in range(n)] for n in (0, 1, 2, 10, 100)]
    assert merkle.roots(lists) == [merkle.root(x) for x in lists]


def test_compression_round_trips():
    rng = random.Random(3)
    for n in (0, 1, 3, 12, 13, 17, 270, 5000, 70000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert compression.bg4_regroup(compression.bg4_split(data)) == data
            for kind in compression.SCHEMES.values():
                packed = compression.compress(kind, data)
                assert compression.decompress(kind, packed, n) == data and len(packed) <= compression.most_compressed(n, kind)
    assert len(compression.compress(compression.LZ4, b"a" * 70000)) < 400


def test_compression_rejects():
    good = compression.compress(compression.LZ4, b"hello hello hello hello hello")
    for bad in (good[:3], good[:-1], b"\xff" + good[1:], good[:4] + b"\x0f\0\0\0"):
        with pytest.raises(ValueError):
            compression.decompress(compression.LZ4, bad, 29)
    with pytest.raises(ValueError):
        compression.compress(7, b"")
    assert compression.scheme("none") == 0 and compression.scheme("what") == compression.LZ4


def test_hashing_block_by_block():
    rng = random.Random(3)
    for n in (0, 1, 1024, 1 << 20, (1 << 20) + 1, (1 << 20) + 1024, (1 << 21) + 5000, 5 * (1 << 20) + 77):
        data = rng.randbytes(n)
        h, dual = blake3.Hasher(), blake3.DualHasher(most=n)
        at = 0
        while at < n:
            step = rng.choice([1, 1000, 4096, 700_000, 3_000_000])
            h.update(data[at : at + step])
            dual.update(data[at : at + step])
            at += step
        assert h.digest() == blake3.digests([data])[0]
        assert dual.ids() == (blake3.data_hash([data])[0].hex(), hashlib.sha256(data).hexdigest())
        dual.verify(hashlib.sha256(data).hexdigest().upper())
        with pytest.raises(ValueError):
            dual.verify("0" * 64)
        with pytest.raises(ValueError):
            dual.update(b"x")


def test_lz4_codecs_agree():
    rng = random.Random(9)
    for n in (0, 1, 5, 12, 13, 64, 65, 66, 100, 5000, 70_000):
        data = bytes(rng.choice(b"ab" if n % 2 else bytes(range(256))) for _ in range(n))
        for make in (compression.lz4_block, compression.plain_lz4_block):
            block = make(data)
            assert compression.lz4_unblock(block, n) == data == compression.plain_lz4_unblock(block, n)
            for size in {n - 1, n + 1} - {-1}:
                for read in (compression.lz4_unblock, compression.plain_lz4_unblock):
                    with pytest.raises(ValueError):
                        read(block, size)
            for bad in (block[:-1], block[: len(block) // 2]):
                with pytest.raises(ValueError):
                    if n > 12:
                        compression.lz4_unblock(bad, n)
                    else:
                        raise ValueError
