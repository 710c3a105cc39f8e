import math
import os

import duckdb
import pytest

from cairn import catalogue
from cairn.operators import reconstruction, repositories, rules
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(str(show(x)) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.sql(catalogue.SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == names
    assert plain([tuple(r[n] for n in names) for r in got.collect()]) == plain(zip(*[want.column(n).to_pylist() for n in names], strict=True))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_run(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA).collect()
    assert rows and ("ok" not in rows[0] or all(r.ok for r in rows))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_content_chunks_and_roots_equal_the_kernels(spark, duck):
    """q09, q10 and q18 against the byte-level kernels, one document at a time on the driver."""
    from cairn.functions import cdc, merkle
    from cairn.functions.blake3 import data_hash
    from cairn.operators import chunks

    docs = [(d, s, t.encode()) for d, s, t in duck.sql("SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL").fetchall()]
    want, roots, stored = [], [], {}
    for d, s, data in docs:
        own = [(o, n, data_hash([data[o : o + n]])[0]) for o, n in cdc.chunks(data, cdc.Chunking(1024))]
        want += [(d, i, o, n, h.hex()) for i, (o, n, h) in enumerate(own)]
        roots.append((d, merkle.file_hash([(h, n) for _, n, h in own]).hex(), len(own), len(data)))
        for _, n, h in own:
            stored.setdefault(s, []).append((h, n))
    assert plain(catalogue.QUERIES["q09_cdc_chunks"](spark, DATA).select("doc_id", "pos", "offset", "size", "raw_hash").collect()) == plain(want)
    assert plain(catalogue.QUERIES["q18_merkle_root"](spark, DATA).collect()) == plain(roots)
    again = chunks.merkle_roots(chunks.content_chunks(spark.read.parquet(f"{DATA}/documents.parquet")), "doc_id", "pos", "raw_hash", "size").collect()
    assert plain(again) == plain([r[:2] for r in roots if r[2]])
    got = catalogue.QUERIES["q10_cdc_dedup_stats"](spark, DATA).select("source", "n_chunks", "n_distinct", "raw_bytes", "stored_bytes").collect()
    assert plain(got) == plain([(s, len(x), len(set(x)), sum(n for _, n in x), sum(n for _, n in set(x))) for s, x in stored.items()])


def one(spark, column, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column(F.col("x"))).collect()]


def test_names_paths_and_keys(spark):
    assert one(spark, rules.repo_name_error, ["ok-1_.x", "", "a" * 97, "a b", ".a", "-a", "a.", "a..b"]) == [None, "empty", "too long", "characters", "start", "start", "end", "dots"]
    assert one(spark, rules.file_path_error, ["a/b", "", "a\0", "/a", "\\a", "a/../b", "a//b", "con/x", "console/x"]) == [None, "empty", "null byte", "absolute", "absolute", "traversal", "empty component", "reserved", None]
    assert one(spark, rules.storage_key_error, ["a/b", "", "/a", "a\\..\\b"]) == [None, "empty", "absolute", "traversal"]
    assert one(spark, rules.valid_oid, ["a" * 64, "A" * 64, "g" * 64, "a" * 63]) == [True, True, False, False]
    assert one(spark, rules.repo_type, ["dataset", "Dataset", None]) == ["dataset", "model", "model"]
    assert one(spark, lambda c: rules.repo_type(c, strict=True), ["Dataset", "x"]) == ["dataset", None]
    assert one(spark, rules.bearer_or_basic, ["Bearer abc", "Basic dTpwOnE=", "Other"]) == ["abc", "p:q", None]
    assert one(spark, lambda c: rules.rewrite_url(c, "https", "h:1", F.lit("t")), ["http://a/b?c#d", "http://a", "no url"]) == ["https://h:1/b?c&token=t#d", "https://h:1?token=t", None]


def test_prefix_has_a_boundary(spark):
    tree = spark.createDataFrame([("models/a.bin", 1), ("models2/b.bin", 2), ("models/x/c", 3)], "path string, size bigint")
    assert [r.path for r in repositories.list_tree(tree, "models").collect()] == ["models/a.bin", "models/x"]
    assert [r.path for r in repositories.list_tree(tree, "/models/", recursive=True).collect()] == ["a.bin", "x/c"]
    assert [r.path for r in repositories.list_tree(tree).collect()] == ["models", "models2"]


def test_log_and_limits(spark):
    revisions = spark.createDataFrame([(1, "c1", None), (1, "c2", "c1"), (1, "c3", "c2")], "repo int, commit string, parent string")
    heads = spark.createDataFrame([(1, "c3")], "repo int, commit string")
    log = lambda n: [r.commit for r in repositories.commit_log(revisions, heads, n).collect()]
    assert log(10) == ["c3", "c2", "c1"] and log(2) == ["c3", "c2"] and log(0) == ["c3"]


def test_a_long_history(spark):
    """5,000 commits, and beside them one that names a parent which isn't there."""
    kind = "repo int, commit long, parent long"
    revisions = spark.range(1, 5001).selectExpr("1 AS repo", "id AS commit", "nullif(id - 1, 0) AS parent").union(spark.createDataFrame([(2, 7, 6)], kind))
    heads = spark.createDataFrame([(1, 5000), (2, 7), (3, 1)], "repo int, commit long")
    got = repositories.commit_log(revisions, heads, 100_000).collect()
    assert [tuple(r) for r in got] == [(1, d, 5000 - d) for d in range(5000)] + [(2, 0, 7)]
    assert repositories.commit_log(revisions, heads, 150).count() == 151


def test_snapshot_and_upserts(spark):
    kind = "path string, size bigint"
    parent = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], kind).withColumn("commit_id", F.lit("p"))
    added, deleted = spark.createDataFrame([("b", 20), ("d", 4)], kind), spark.createDataFrame([("c",), ("d",)], "path string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(repositories.snapshot(parent, added, deleted, "n")) == [("a", 1, "p"), ("b", 20, "n"), ("d", 4, "n")]
    assert rows(repositories.snapshot(parent, added, deleted, "n", inherit=False)) == [("b", 20, "n"), ("d", 4, "n")]
    assert rows(repositories.insert_new(parent.select("path", "size"), added.union(added), ["path"])) == [("d", 4)]
    assert rows(repositories.upsert(parent.select("path", "size"), added, ["path"])) == [("a", 1), ("b", 20), ("c", 3), ("d", 4)]


def test_head_conflicts(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), ("a", None), (None, "a"), ("a", "b")], "e string, h string")
    assert [r[0] for r in df.select(repositories.head_conflict(F.col("e"), F.col("h"))).collect()] == ["ok", "ok", "unknown_parent", "parent_required", "conflict"]


def test_operations_are_parsed(spark):
    lines = ['{"key":"file","value":{"path":"p","content":"aGk="}}', '{"key":"file","value":{"path":"p","content":"aGk"}}', "", "no json", '{"key":"what","value":{}}', '{"key":"header","value":{"summary":"s"}}']
    got = repositories.parse_operations(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.key, bytes(r.data) if r.data else None, r.error) for r in got] == [("file", b"hi", None), ("file", None, "bad content"), (None, None, "malformed"), ("what", None, "unknown key"), ("header", None, None)]


def test_plan_spans_packs(spark):
    """A file over two packs: the second's chunk 0 is the file's chunk 1."""
    segments = spark.createDataFrame([("f", 0, "x", 0, 1, 6), ("f", 1, "y", 0, 2, 6), ("g", 0, "y", 1, 2, 3)], "file string, seg_index bigint, pack_hash string, chunk_start bigint, chunk_end bigint, unpacked_bytes bigint")
    chunks = spark.createDataFrame([("x", 0, 0, 6, "r0"), ("y", 0, 0, 3, "r1"), ("y", 1, 11, 3, "r2")], "pack_hash string, chunk_index bigint, byte_start bigint, raw_len bigint, raw_hash string")
    got = reconstruction.plan(segments, chunks)
    assert sorted((r.file, r.pos, r.raw_hash) for r in got.collect() if r.file == "f") == [("f", 0, "r0"), ("f", 1, "r1"), ("f", 2, "r2")]
    body = {r.file: r.body for r in reconstruction.to_json(got).collect()}
    assert body["g"] == '{"packs":[{"hash":"y","chunks":[{"hash":"r2","offset":11,"length":3}]}]}'


SEGMENTS = "file string, seg_index bigint, pack_hash string, chunk_start bigint, chunk_end bigint, unpacked_bytes bigint"


def test_every_corruption_of_a_manifest_is_named(spark):
    sound = {
        "segments": [("f", 0, "x", 0, 2, 5), ("f", 1, "y", 1, 2, 4), ("f", 2, "x", 1, 1, 0), ("g", 0, "y", 0, 2, 7)], "packs": [("x", 2), ("y", 2)],
        "chunks": [("x", 0, 0, 3), ("x", 1, 11, 2), ("y", 0, 0, 3), ("y", 1, 11, 4)], "lookup": [("x", 0, "r0"), ("x", 1, "r1"), ("y", 0, "r2"), ("y", 1, "r3")],
    }
    kinds = {"segments": SEGMENTS, "packs": "pack_hash string, n_chunks bigint", "chunks": "pack_hash string, chunk_index bigint, byte_start bigint, raw_len bigint", "lookup": "pack_hash string, chunk_index bigint, raw_hash string"}
    files = spark.createDataFrame([("f", 3), ("g", 1), ("h", None)], "file string, n_segments int")

    def errors(**change):
        made = {k: spark.createDataFrame(change.get(k, v), kinds[k]) for k, v in sound.items()}
        return {r.file: r.error for r in reconstruction.plan_errors(files, **made).collect()}

    s = sound["segments"]
    assert errors() == {"f": None, "g": None, "h": "file not found"}
    assert set(errors(packs=[*sound["packs"], ("x", 2)]).values()) == {"duplicate pack"}
    assert set(errors(lookup=[*sound["lookup"], ("x", 0, "r9")]).values()) == {"duplicate lookup"}
    assert errors(segments=[("f", 0, "x", 2, 1, 0), *s[1:]])["f"] == "reversed range"
    assert errors(packs=[("y", 2)]) == {"f": "missing pack", "g": None, "h": "file not found"}
    assert errors(segments=[("f", 0, "x", 0, 3, 5), *s[1:]])["f"] == "range beyond the pack"
    assert errors(chunks=[c for c in sound["chunks"] if c[:2] != ("x", 1)])["f"] == "missing chunk"
    assert errors(lookup=[c for c in sound["lookup"] if c[:2] != ("y", 1)]) == {"f": "missing raw hash", "g": "missing raw hash", "h": "file not found"}
    assert errors(segments=[("f", 0, "x", 0, 2, 6), *s[1:]])["f"] == "segment length"
    assert errors(segments=[*s[:2], ("f", 2, "z", 5, 1, 0), ("f", 3, "z", 0, 1, 0)])["f"] == "reversed range"
    plan, bad = reconstruction.checked_plan(files, **{k: spark.createDataFrame(v, kinds[k]) for k, v in sound.items()})
    assert sorted((r.file, r.pos, r.raw_hash) for r in plan.collect()) == [("f", 0, "r0"), ("f", 1, "r1"), ("f", 2, "r3"), ("g", 0, "r2"), ("g", 1, "r3")] and [r.file for r in bad.collect()] == ["h"]


def test_positions_over_blocks_of_segments(spark, monkeypatch):
    """Empty and reversed ranges give no chunk, and blocks of segments go on where the one before ended."""
    monkeypatch.setattr(reconstruction, "SEGMENTS_A_BLOCK", 2)
    rows = [("f", i, "x", i % 3, 3 if i % 4 else i % 3, 0) for i in range(9)] + [("f", 9, "x", 2, 1, 0)]
    chunks = spark.createDataFrame([("x", i, 0, 1, f"r{i}") for i in range(3)], "pack_hash string, chunk_index bigint, byte_start bigint, raw_len bigint, raw_hash string")
    got = sorted((r.pos, r.chunk_index) for r in reconstruction.plan(spark.createDataFrame(rows, SEGMENTS), chunks).collect())
    assert got == list(enumerate(c for _, _, _, a, b, _ in rows for c in range(a, b)))


def test_entry_stands_without_the_optional_parts(tmp_path):
    """The rest imports and answers where the subpackage and the pipeline are missing."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "cairn"), tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'], set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0 and said.stdout.strip() == f"{len(catalogue.QUERIES)} [] True", said.stderr


def test_iso_times_of_large_keys_equal_the_sql(spark, tmp_path):
    """Keys whose seconds lie beyond the year 9999, before the year 0, at both ends of a timestamp's range, and null."""
    keys = [None, 1, 719_162, 2_932_931, 2_932_932, 2_932_933, 8_999_999, 106_753_226, -719_169, -719_171, -719_529, -719_537, -720_001, -1_100_001, -106_753_053]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["q55_iso_times"](spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # where 2:00 to 3:00 is skipped on 2024-03-10
    try:
        assert one(spark, rules.iso_time, [1_710_037_800, 1_710_041_400], "bigint") == ["2024-03-10T02:30:00Z", "2024-03-10T03:30:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert plain(got) == plain(con.execute(catalogue.SQL["q55_iso_times"]).fetchall())
