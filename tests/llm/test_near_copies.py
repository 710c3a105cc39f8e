import random

import pytest

import corpus_pipeline
from cairn.llm import near_copies, simhash


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    groups = {}
    for p, r in zip(parent, rows):
        groups.setdefault(p, []).append(r)
    return sorted(str(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]) for g in groups.values())


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(80, 300))]
        rows.append((100 * i, " ".join(words)))
        for k in range(1, 8):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, k * len(words) // 250)):
                copy[at] = word()
            rows.append((100 * i + k, " ".join(copy)))
    rng.shuffle(rows)
    return rows + [(5000, ""), (5001, None), (None, " "), (7000, rows[0][1].upper()), (7001, rows[0][1]), (7001, rows[0][1]), (None, "only here"), (6000, "x" * 200_000), (6001, "one two three four"), (6002, "one two three five")]


@pytest.mark.parametrize("block", [2048, 2])
def test_stage_drops_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame([(*r, "s", i) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, n_chars int").drop("n_chars")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    want = brute_kept(rows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and len(want) < 130
    if block > 2:
        assert simhash.deduplicated(df).count() > len(want) + 50  # two bits of op9 find few of them


def test_empty_and_bounds(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_copies.deduplicated(df).count() == 0
    words = [f"w{i}" for i in range(94)]
    pair = lambda n: spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[: 94 - n], *[f"v{i}" for i in range(n)]]))], "doc_id bigint, text string")
    assert [near_copies.deduplicated(pair(n)).count() for n in (10, 11)] == [1, 2]  # 80 of 100 and 79 of 101 shingles
