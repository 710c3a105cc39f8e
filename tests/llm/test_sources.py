import hashlib
import io
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import pytest

from cairn.llm import licences, mixing, url_filter, warc


# --- mixing


def brute_targets(size_of):
    """Level by level, as the contract words it."""
    names = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(size_of.values())
    target, free, left = {}, set(names), total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size_of[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * size_of[s]
            left -= target[s]
        free -= full
    return target


def mixed_rows():
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(900)]
    rows = [(i, t, "big" if i % 3 == 0 else rng.choice(["a", "b", "ä", None, "tiny"] if i % 50 else ["one"])) for i, t in rows]
    return rows + [(3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (None, "a b c", "a"), (None, None, "b"), (5000, None, None), (5001, "x " * 20_000, "big")]


def test_mix(spark, monkeypatch):
    rows = mixed_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, size int")
    monkeypatch.setattr(mixing, "BUCKET", 7)  # several levels
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((k, s, size(t)) for k, t, s in rows)
    sums = Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    want = brute_targets(sums)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sums[r.source]
        often = r.target / r.source_size
        assert r.size == 0 and r.copies == 0 or math.floor(often) <= r.copies <= math.ceil(often)
        assert r.copies * r.size + r.part <= 2 * r.size
    for s, rs in by.items():
        assert len({(r.doc_id, r.size) for r in rs if r.part}) <= 1, "one document is left over"
        assert abs(sum(r.copies * r.size + r.part for r in rs) - want[s]) <= 2
    assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, got))
    assert any(r.copies == 1 for r in got) and any(r.copies == 2 for r in got)


def test_mix_itself(spark):
    rows = mixed_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, copies string")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    times = Counter((r.doc_id, r.source, r.text) for r in out.collect())
    chosen = mixing.mix(df).collect()
    assert sum(times.values()) == sum(r.copies + (r.part > 0 and 2 * r.part >= r.size) for r in chosen)
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.repeated(df.limit(0)).count()
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id bigint, text string, source string")
    assert [(r.target, r.copies, r.part) for r in mixing.mix(nothing).collect()] == [(0, 0, 0)] * 2


# --- WARC


def brute_pages(rows):
    same = defaultdict(list)
    for k, _, h in rows:
        if len((h or "").encode()) >= 1000:
            same[h].append(k)
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        last = max((x for x in same.get(h, ()) if x is not None), default=None)
        refers = last if len(same.get(h, ())) > 1 and k != last else None
        out.append(str((k, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers)))
    return sorted(out)


def test_archives(spark, monkeypatch):
    rng = random.Random(9)
    html = lambda n: "<p>" + " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n)) + "</p>\r\n\r\n"
    rows = [(i, f"http://a/{i}", html(rng.randrange(400))) for i in range(300)]
    rows += [(1000 + i, None, "é" * 600) for i in range(20)] + [(2000, "http://b\r\nX: y", "short"), (2001, "u", "short"), (3000, "u", None), (1019, "u", "é" * 600), (None, "u", "é" * 600), (None, "u", ""), (4000, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    got = warc.round_trip(df).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_pages(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_layout():
    records = [warc.record(i, "u", b"<html>common words in every page %d</html>" % i * 20, "d", None) for i in range(400)]
    data = b"".join(warc.archive(records))
    assert data[:4] == b"\x5d\x2a\x4d\x18" and data[8:12] == b"\x37\xa4\x30\xec", "a skippable frame holds a dictionary"
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert list(warc.read_archive(io.BytesIO(b"".join(warc.archive(records[:3]))))) == records[:3]
    assert len(data) < len(b"".join(warc.archive(records[:7]))) * 400 / 7 and list(warc.read_archive(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-2])))


# --- licences and URLs


def brute_licence(text, templates, threshold):
    """Every window of every size, its bigrams counted anew."""
    pairs = lambda t: list(zip(w := re.sub(r"[^\w]|_", " ", (t or "").lower()).split(), w[1:]))
    own, hits = pairs(text), []
    for name, template in templates.items():
        want = Counter(pairs(template))
        m = want.total()
        for size in {min(len(own), max(1, math.floor(m * x + 0.5))) for x in licences.SIZES} - {0}:
            for s in range(len(own) - size + 1):
                dice = 2 * (Counter(own[s : s + size]) & want).total() / (m + size)
                if dice >= threshold:
                    hits.append((-dice, -m, name, s))
    if not hits:
        return None, None, None, 0
    best = min(hits)
    return best[2], round(-best[0], 6), best[3], len({h[2] for h in hits})


def licence_rows():
    t = licences.TEMPLATES
    code = "\n".join(f"    x{i} = compute(the, value, of={i})" for i in range(40))
    header = "\n".join(f" * {x}" for x in textwrap.wrap(t["Apache-2.0-header"], 60))
    return [
        (1, "Some words.\n  RELEASED under the MIT licence!\nMore words here."), (2, "Released under the MIT License.\nReleased under the MIT License."), (3, t["MIT-permission"].replace(" ", "\n", 3)), (4, None), (5, ""),
        (None, "Licensed under CC BY-NC 4.0."), (1, "nothing"), (6, "word " * 700), (7, t["Apache-2.0-header"] + "\nlast line of it"), (8, f"{code}\n/*\n{header}\n */\n{code}"),
        (9, "This line tells of many things. Released under the MIT License. And it goes on about others."), (10, t["MIT-text"].replace("free of charge", "at no charge")), (11, t["BSD-3-text"]), (11, t["BSD-3-text"]), (12, "of the " * 200 + t["ISC-text"]),
        (13, "under the MIT License " * 50), (14, "Released"), (15, "released under"), (16, "Straße — ÉTÉ\x00 released UNDER the mit license"),
    ]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_licences(spark, monkeypatch, broadcast):
    monkeypatch.setattr(licences, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(*r, "x", 1) for r in licence_rows()], "doc_id bigint, text string, licence string, h int")
    got = [tuple(r) for r in licences.scan(df).collect()]
    want = [(k, *brute_licence(t, licences.TEMPLATES, 0.8)) for k, t in licence_rows()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    con = duckdb.connect()
    con.register("given", df.where("doc_id is null or doc_id <> 6").toArrow())
    con.execute("CREATE TABLE documents AS SELECT doc_id, text FROM given")
    assert sorted(map(str, con.sql(licences.sql()).fetchall())) == sorted(str(w) for w in want if w[0] != 6)
    by = {r[0]: r[1:] for r in got if r[0] != 1}
    assert by[8][0] == "Apache-2.0-header" and by[8][1] > 0.95 and by[9][:2] == ("MIT", 1.0) and by[10][0] == "MIT-text" and by[11][:2] == ("BSD-3-text", 1.0) and by[12][0] == "ISC-text"
    assert licences.scan(df.limit(0)).count() == 0 and "PythonUDF" not in licences.scan(df)._jdf.queryExecution().toString()


def test_a_template_is_itself_and_others_may_be_given(spark):
    df = spark.createDataFrame(sorted(licences.TEMPLATES.items()), "doc_id string, text string")
    assert all(r.licence == r.doc_id and r.dice == 1 for r in licences.scan(df).collect())
    given = {"ru": "Это произведение доступно по свободной лицензии", "long": " ".join(f"w{i % 7}" for i in range(60))}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["w1 w2", "w3 w4 w5", "w6 w0", "Это произведение доступно", "по свободной лицензии", "x"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=given, threshold=0.6).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, *brute_licence(t, given, 0.6))) for k, t in rows) and any(r.licence for r in got)


URLS = [
    "http://a.com/x", "http://a.com", "HTTPS://WWW.Example.COM/en/1", "http://www.example.com/En/1", "http://x.example.com/en/", "http://example.com/en", "http://notexample.com/en/", "http://a.net/es/1?x=/fr/",
    "http://net/fr/", "http://a.net/de/", "ftp://b.org?x://y/z", "no scheme", "", None, "a://b://c/d", "http://spam-farm.example.org/x", "http://my-casino-site.org/", "http://tracker.x.org/pixel?1", "http://tracker.x.org/pixels",
    "http://a.com:80/x", "http://xxx.org", "http://free-pills-now.net/a", "http://é.net/es/ü",
]


def test_url_verdicts(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, "http://a.com/")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, host string")
    got = url_filter.judge(df).collect()
    con = duckdb.connect()
    con.register("given", df.toArrow())
    con.execute("CREATE TABLE pages AS SELECT page_id, url FROM given")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(url_filter.SQL).fetchall()))
    by = {r.page_id: r for r in got}
    assert by[2].rule == "www.example.com/en/" and by[2].verdict == "allow" and by[4].verdict == "block" and by[5].rule == "com/" and by[1].rule is None
    assert url_filter.judge(df.limit(0)).count() == 0


def test_rules_of_several_passes_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rules = [*reversed(url_filter.PATTERNS), *url_filter.HOST_RULES, url_filter.Rule("again", "block", "com", ())]
    want = sorted(map(str, url_filter.judge(df, rules=rules).collect()))
    monkeypatch.setattr(url_filter, "RULES_PER_PASS", 4)
    assert sorted(map(str, url_filter.judge(df, rules=rules).collect())) == want


def test_tokens_are_read_off_the_pattern():
    want = {"abc": (), "/abc/": ("abc",), "/ab*c/": (), "/a(b|c)d/": (), "x?/foo/": ("foo",), "foo$": (), "/foo$": ("foo",), "^foo/": ("foo",), "/foo(?:/bar)?/": ("foo",), "/foo(?:bar)?/": (), "/foo.bar/": (), "/foo[^x]/": (), "(?i)/foo/": (), "/é/a/": ("a",), "[./]a-b1[?#]": ("a", "b1"), "/x(?:/|$)": ("x",)}
    assert {p: url_filter.literal_tokens(p) for p in want} == want
    assert [r.tokens for r in url_filter.PATTERNS] == [("spam", "farm"), ("casino",), ("pills",), ("tracker", "pixel"), ("xxx",)]
    rng = random.Random(6)
    for _ in range(400):
        pattern = "".join(rng.choice(["a", "b", "/", r"\.", "[./]", "(?:a|/)", "(?:/b)?", "a?", "b*", ".", "$", "[^a]"]) for _ in range(rng.randrange(1, 7)))
        for _ in range(30):
            url = "".join(rng.choice("ab/.") for _ in range(rng.randrange(9)))
            if re.search(pattern, url):
                assert set(url_filter.literal_tokens(pattern)) <= set(url_filter.TOKEN.findall(url)), (pattern, url)


def test_index_runs_only_candidates_and_loses_none():
    rules = [*url_filter.HOST_RULES, *url_filter.PATTERNS, url_filter.Rule("any", "block", r"\d{7}", ())]
    index = url_filter.Index(rules, {"com": 50, "example": 10, "en": 90})
    assert [r.name for _, r, _ in index.by_token["example"]] == ["example.com/en/"] and None in index.by_token
    for url in [u for u in URLS if u] + ["http://x.org/1234567"]:
        host, path = url_filter.host_and_path(url)
        brute = {r.name for r in rules if re.search(r.pattern, host + path if r.host_rule else url.lower())}
        assert {r.name for _, r in index.matches(url, host, path)} == brute, url
