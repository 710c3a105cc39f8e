import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cairn.llm import multiset_hash as m
from cairn.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted((str(k), f"{p:016x}", str(least[root(i)])) for i, ((k, _), p) in enumerate(zip(rows, prints)))


def test_fingerprints():
    rng = random.Random(3)
    for t in ("", " \n", "One", "one TWO", "one two three", "É é x y", "a b\x1cc d", *[" ".join(rng.choice("aBcdé") for _ in range(n)) for n in (4, 5, 100, 900)]):
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices_find_just_the_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = base[:60] ^ (np.uint64(5) << rng.integers(0, 60, 60, dtype=np.uint64))
    x = np.concatenate([base, near, near ^ np.uint64(1)])
    a, b = simhash.links(x, x, radius)
    want = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= radius)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*[w.tolist() for w in want]))


def near_rows():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [rng.choice("alpha beta gamma delta omega kappa sigma".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(150, 400))]
        rows.append((10 * i, " ".join(words)))
        for k in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
            rows.append((10 * i + 1 + k, " ".join(words)))
    return rows + [(5000, ""), (5001, None), (None, " "), (7, rows[0][1]), (7, rows[0][1]), (None, "only here"), (6000, "x" * 200_000)]


def test_components(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fp string")
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len(rows) - 20
    show = lambda: sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert show() == want
    monkeypatch.setattr(simhash, "BLOCK", 2)  # hot keys fall into many tasks
    assert show() == want


def test_hot_group(spark):
    """Hundreds of fingerprints in one ball still form one component, found by blocks."""
    rng = np.random.default_rng(5)
    x = np.unique(np.array([0] + [int(1) << int(a) | int(1) << int(b) for a, b in rng.integers(0, 64, (700, 2))], np.uint64).view(np.int64))
    tree = simhash.components(simhash.candidate_links(spark.createDataFrame([(int(v),) for v in x], "fp bigint"))).collect()
    assert {r.node for r in tree} == set(x.tolist()) and {r.label for r in tree} == {int(x.min())} and len(tree) == len(x)


def test_one_row_stays(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "src", i) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, __row int")
    kept = simhash.deduplicated(df.drop("__row"))
    assert kept.columns == ["doc_id", "text", "source"]
    want = {w[2] for w in brute_components(rows)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)
    assert simhash.deduplicated(df.limit(0)).count() == 0 == simhash.near_duplicates(df.limit(0)).count()


def test_sums_are_homomorphic():
    a, b = [b"one", b"two", b"two", b""], [b"three"]
    f = m.Fingerprint.of
    assert f(a) == f(a[::-1]) and f(a + b) == f(a) + f(b) and f(a + b).delete(b) == f(a) and f(a) != f(a[1:]) and f([b"two"] * 2) != f([b"two"])
    assert f([b"x"] * 70000).delete([b"x"] * 69999) == f([b"x"])
    assert f(a).likeness(f(a)) == 1 and f([]).likeness(f([])) == 1 and f([]).likeness(f(b)) == 0
    many = [str(i).encode() for i in range(400)]
    assert abs(f(many).likeness(f(many[100:] + [b"new%d" % i for i in range(100)])) - 0.75) < 0.12


def test_next_documents(spark, monkeypatch):
    monkeypatch.setattr(m, "ROWS_A_PART", 3)
    rng = random.Random(2)
    rows = [(k, ". ".join(" ".join(rng.choice("abcdefg") * 2 for _ in range(6)) for _ in range(rng.randrange(9)))) for k in rng.sample(range(1000), 40)]
    rows += [(None, "last of all"), (2000, None), (2001, "é🙂" * 50), (2002, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: r for r in m.report(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        changed, own = m.edited(t, after), m.Fingerprint.of(m.paragraphs(t))
        assert changed == t[: len(t) - len(t) // 3] + after[: len(t) // 3] and got[k].n_chars == len(t)
        assert got[k].edited_sha256 == __import__("hashlib").sha256(changed.encode()).hexdigest()
        assert got[k].fingerprint == own.hex() and got[k].edited_fingerprint == m.Fingerprint.of(m.paragraphs(changed)).hex()
        assert got[k].near_next == own.likeness(m.Fingerprint.of(m.paragraphs(after)))


def test_next_of_ties_and_few(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a c")], "doc_id bigint, text string")
    assert m.report(df).count() == 3
    one = m.report(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert m.report(df.limit(0)).count() == 0
    assert m.fingerprints(df).distinct().count() == 2
