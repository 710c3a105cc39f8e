import random
import zlib

import numpy as np

from cairn.llm import toxicity as t


def made(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["zrud", "ywonk!", "quost" + rng.choice("abcdef")])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_gradient_of_the_filters_learns_and_scoring_agrees():
    rows = made(600, 1)
    ids = [np.array([t.buckets(w) for w in t.split(x)], np.int32) for _, x, _ in rows]
    toxic = np.array([y == 1 for *_, y in rows])
    model = t.fit_rows(ids[:450], toxic[:450], np.zeros(450, np.int64))
    scorer = t.Scorer(model)
    scores = scorer.score([x for _, x, _ in rows[450:]])[0]
    assert ((scores >= 0.5) == toxic[450:]).mean() > 0.93 and scores.min() >= 0 and scores.max() <= 1
    # Alone, in company, in blocks and after forgetting: the same.
    texts = ["", *[x for _, x, _ in rows[:20]], " ".join(x for _, x, _ in rows[:2000]) * 3]
    together = scorer.score(texts)[0]
    alone = np.array([t.Scorer(model).score([x])[0][0] for x in texts])
    assert np.allclose(together, alone, atol=1e-6)
    pooled = np.maximum(np.concatenate(model.shift), 0)  # that of a window of padding
    x = np.concatenate([model.vectors(ids[0]), np.zeros((t.PAD, t.DIM))])
    for k, (w, f) in enumerate(zip(t.WIDTHS, model.filters)):
        for at in range(len(ids[0])):
            y = sum(x[at + j] @ f[j] for j in range(w)) + model.shift[k]
            part = slice(k * t.FILTERS, (k + 1) * t.FILTERS)
            pooled[part] = np.maximum(pooled[part], y)
    p = 1 / (1 + np.exp(-model.logit(pooled[None])))
    assert np.allclose(t.rescaled(p, model.thresholds[scorer.score([rows[0][1]])[1]])[0], together[1], atol=1e-5)


def test_thresholds_by_language():
    model = t.Model.start(0)
    p = np.r_[np.linspace(0.1, 0.3, 50), np.linspace(0.4, 0.6, 50), np.linspace(0.1, 0.6, 50), np.linspace(0.7, 0.9, 50)]
    y = np.r_[np.zeros(50), np.ones(50), np.zeros(50), np.ones(50)] == 1
    t.calibrate(model, p, y, np.repeat([0, 1], 100))
    assert 0.3 < model.thresholds[0] < 0.4 and 0.6 < model.thresholds[1] < 0.7
    assert t.rescaled(np.array([0.0, model.thresholds[0], 1.0]), model.thresholds[:1]).tolist() == [0, 0.5, 1]
    assert [t.NAMES[t.language(t.split(x))] for x in ("the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el perro y los gatos", "zzz")] == ["en", "de", "fr", "es", "other"]


def test_tables(spark):
    rows = made(400, 2) + [(None, "zrud zrud", 1), (900, None, 0), (901, "", 0), (5, "repeated row", 0)]
    docs = spark.createDataFrame([(k, x, "en") for k, x, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k is not None and k % 3] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = t.train_on(docs, labels)
    got = t.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = t.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert {r.doc_id for r in kept.collect()} >= {900, 901}
    assert t.train_on(docs, labels.limit(0)) is None
    assert t.clean(docs, None).count() == len(rows) and t.score(docs.limit(0), model).count() == 0


def test_every_labelled_row_and_word_trains(spark, monkeypatch):
    """Long texts count whole, rows beyond any fixed number too, in several shards; what they teach is found in other texts."""
    monkeypatch.setattr(t, "PACK_WORDS", 4000)
    monkeypatch.setattr(t, "SHARD_WORDS", 60_000)
    rows = made(1500, 3)
    rng = random.Random(4)
    filler = [w for _, x, y in rows[:40] if not y for w in x.split()]
    late = lambda toxic: " ".join([*(rng.choice(filler) for _ in range(3200)), *(["vexil"] if toxic else []), "end"])
    rows += [(2000 + i, late(i % 2), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    found = t.packs(docs, labels).collect()
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert sum(r.n for r in found) == len(learnt) and sum(r.n_toxic for r in found) == sum(r[2] for r in learnt)
    assert sum(len(r.ids) for r in found) == 6 * sum(len(t.split(r[1])) for r in learnt)
    model = t.train_on(docs, labels)
    fresh = [(r[1], r[2]) for r in rows if r not in learnt]
    scores = t.Scorer(model).score([x for x, _ in fresh])[0]
    assert ((scores >= 0.5) == np.array([y == 1 for _, y in fresh])).mean() > 0.9


def test_blocks_make_no_difference(monkeypatch):
    ids = [np.array([t.buckets(w) for w in t.split(x)], np.int32) for _, x, _ in made(50, 5)] + [np.zeros((0, 3), np.int32)]
    model = t.Model.start(3)
    whole = t._maxima(model, *t._padded(ids))
    monkeypatch.setattr(t, "BLOCK_WORDS", 7)
    cut = t._maxima(model, *t._padded(ids))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole[0], cut[0]))


def test_words_are_hashed_together(monkeypatch):
    """A batch's words get the rows, counts and languages that they get one by one, and scoring doesn't go word by word."""
    rng = random.Random(6)
    parts = ["a", "B", "ß", "é", "İ", "Σ", "😀", "\0", " ", "  ", "\t\n", "\x1c", "\xa0", ".", "--", "#", "the ", "und ", "más ", "für", "nicht", "x" * 31, "y" * 40, "." * 35]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(400)]
    texts += ["", " \n", "...", "the\0 the", "z" * 5000, "." * 5000 + " the el el", *[x for _, x, _ in made(30, 7)]]
    words = [t.split(x) for x in texts]
    for piece in (t.PIECE, 7):
        monkeypatch.setattr(t, "PIECE", piece)
        for lo, hi in ((0, len(texts)), (3, 4), (400, 402), (0, 0)):
            ids, counts, lang = t.hashed(texts[lo:hi])
            assert ids.tolist() == [list(t.buckets(w)) for ws in words[lo:hi] for w in ws]
            assert counts.tolist() == [len(ws) for ws in words[lo:hi]] and lang.tolist() == [t.language(ws) for ws in words[lo:hi]]
    model = t.Model.start(1)
    one_by_one = t.probabilities(model, [np.array([t.buckets(w) for w in ws], np.int32).reshape(-1, 3) for ws in words])
    monkeypatch.setattr(t, "buckets", None)
    monkeypatch.setattr(t, "language", None)
    assert np.allclose(t.Scorer(model).score(texts)[0], one_by_one, atol=1e-6)  # 0.5 is the threshold


def test_each_text_counts_once_for_a_row():
    docs = [np.array([[5, 6, 6], [5, 7, 8]], np.uint16), np.zeros((0, 3), np.uint16), np.array([[9, 5, 9]], np.uint16)]
    seen = t.seen_in(docs)
    assert {int(i): int(seen[i]) for i in np.flatnonzero(seen)} == {5: 2, 6: 1, 7: 1, 8: 1, 9: 1}
