import os

import pytest

from cairn.plans.containers import convert, rebuild
from cairn.sources import containers as k


def test_chunk_header_layout():
    assert k.chunk_header(0x123456, 1, 0xABCDEF).hex() == "0056341201efcdab"
    assert k.parse_chunk_header(bytes.fromhex("0056341201efcdab")) == (0x123456, 1, 0xABCDEF)


@pytest.mark.parametrize("scheme", [0, 1, 2])
def test_pack_round_trip(scheme):
    parts = [b"hello" * 100, b"", os.urandom(5000)]
    p = k.build_pack(parts, scheme)
    pack_hash, chunks = k.verify_pack(p.data)
    assert pack_hash == p.pack_hash and [k.extract(p.data, c.start, c.raw, c.stored_hash) for c in chunks] == parts
    assert k.PackIndex.length(3) == len(p.data) - sum(8 + c.packed for c in chunks)
    assert k.verify_pack(k.build_pack([]).data) == (bytes(32), [])


def test_pack_rejects_corruption():
    p = k.build_pack([b"a" * 100, b"b" * 200])
    for at in (0, 9, 120, len(p.data) - 1, p.data.rfind(k.TAGS.bounds), p.data.rfind(k.TAGS.bounds) + 8, p.data.rfind(k.TAGS.main) + 7):
        bad = bytearray(p.data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            k.verify_pack(bytes(bad))
    for bad in (p.data + b"x", p.data[:-1], b""):
        with pytest.raises(ValueError):
            k.verify_pack(bad)
    assert [isinstance(x, ValueError) for x in k.verify_packs([b"", p.data])] == [True, False]


def test_manifest_round_trip_and_rejection():
    p = k.build_pack([b"x" * 10, b"y" * 20])
    m = k.Manifest([(b"f" * 32, [(p.pack_hash, 10, 0, 1)]), (b"g" * 32, [(p.pack_hash, 20, 1, 2)])], [(p.pack_hash, list(zip(p.stored_hashes, p.starts, p.raw_sizes)), p.payload_bytes)], [(b"a" * 32, p.pack_hash, 0), (b"b" * 32, p.pack_hash, 1)])
    data = m.encode()
    assert k.Manifest.decode(data) == m and m.totals() == (30, 30, 30) and len(data) == 48 + 4 * 48 + 48 + 3 * 48 + 48 + 2 * 68 + 208
    for bad in (data[:-1], b"z" + data[1:], data[:100], data[:-8] + bytes(8)):
        with pytest.raises(ValueError):
            k.Manifest.decode(bad)
    with pytest.raises(ValueError):
        k.Manifest([], m.packs, []).encode()


def test_convert_and_rebuild(spark):
    rows = [(1, "abc" * 3000), (2, ""), (3, None), (4, "é" * 5000), (4, "é" * 5000)]
    packs = convert(spark.createDataFrame(rows, "doc_id bigint, text string"), scheme=1)
    got = rebuild(packs).collect()
    assert sorted((r.doc_id, r.ok) for r in got) == [(1, True), (4, True), (4, True)]
    from pyspark.sql import functions as F

    broken = packs.withColumn("pack", F.expr("overlay(pack placing X'00' from 20)"))
    assert not any(r.ok for r in rebuild(broken).collect())
    assert rebuild(convert(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
