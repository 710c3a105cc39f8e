import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from cairn.llm import bpe, mixing, pii, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(60, 120))]
        toxic = i % 4 == 0
        if toxic:
            w[3:3] = ["zrud", "ywonk"]
        if i % 7 == 0:
            w.insert(9, "mail me.2@host.example.com")
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s1") for i in range(1, 60, 2)] + [(2000, None, "en", None), (2001, "", None, "s1"), (None, rows[5][1], "en", "s0")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert docs.schema == spark.read.parquet(f"{sf_dir}/documents.parquet").schema
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        kept[name] = (before, docs.collect())

    before, after = kept["toxicity"]
    gone = Counter(r.doc_id for r in before) - Counter(r.doc_id for r in after)
    toxic = {r.doc_id for r in before if "zrud" in (r.text or "")}
    assert len(toxic - set(gone)) <= 3 and len(set(gone) - toxic) <= 3

    before, after = kept["simhash_near_dedup"]
    prints = [simhash.fingerprint(r.text or "") for r in before]
    parent = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    groups = {}
    for p, r in zip(parent, before):
        groups.setdefault(p, []).append(r)
    least = lambda g: min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert sorted(map(str, after)) == sorted(str(least(g)) for g in groups.values()) and len(after) < len(before)

    before, after = kept["pii"]
    want = {r.doc_id: None if r.text is None else pii.mask(r.text, pii.spans(r.text)) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.text is None or r.n_chars == len(r.text) for r in after)
    assert any("[email]" in (r.text or "") for r in after) and not any("@" in (r.text or "") for r in after)

    before, after = kept["mixing"]
    chosen = mixing.mix(spark.createDataFrame(before, SCHEMA)).collect()
    times = {r.doc_id: r.copies + (r.part > 0 and 2 * r.part >= r.size) for r in chosen}
    assert Counter(r.doc_id for r in after) == Counter({k: n for k, n in times.items() if n})
    by_id = {r.doc_id: r for r in before}
    assert all(r == by_id[r.doc_id] for r in after)

    before, after = kept["bpe"]
    texts = {r.doc_id: r.text or "" for r in before}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    decoded = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in after], "doc_id bigint, ids array<int>")).collect()
    assert all(bytes(r.decoded) == texts[r.doc_id].encode() for r in decoded)
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in after)

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.ids_sha256) for r in whole) == sorted((str(r.doc_id), r.ids_sha256) for r in after)
