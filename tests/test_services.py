from pyspark.sql import functions as F

from cairn.operators import services
from cairn.sources import containers, storage
from cairn.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repositories_are_created_once(spark):
    kind = "namespace string, name string, repo_type string, sha string"
    repos = spark.createDataFrame([("a", "x", "model", "1")], kind)
    same, said = services.create_repo(repos, spark.createDataFrame([("a", "x", "model", "2")], kind))
    assert said == "exists" and rows(same) == [("a", "x", "model", "1")]
    more, said = services.create_repo(repos, spark.createDataFrame([("a", "x", "dataset", "2")], kind))
    assert said == "created" and more.count() == 2


def test_commits_move_the_head(spark):
    revisions = spark.createDataFrame([("c1", 1, None)], "commit_id string, repo_id bigint, parent string")
    heads = spark.createDataFrame([(1, "c1"), (2, "z")], "repo_id bigint, commit_id string")
    tree = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size bigint").withColumn("commit_id", F.lit("c1"))
    new = spark.createDataFrame([("c2", 1, "c1")], revisions.schema)
    added, gone = spark.createDataFrame([("c", 3)], "path string, size bigint"), spark.createDataFrame([("a",)], "path string")
    r, h, t, said = services.commit(1, "c1", new, added, gone, revisions, heads, tree)
    assert said == "ok" and rows(h) == [(1, "c2"), (2, "z")] and rows(t) == [("b", 2, "c1"), ("c", 3, "c2")] and r.count() == 2
    for expected, why in (("c0", "conflict"), (None, "parent_required")):
        r, h, t, said = services.commit(1, expected, new, added, gone, revisions, heads, tree)
        assert said == why and rows(h) == rows(heads) and r.count() == 1 and t.count() == 2
    assert services.commit(3, None, spark.createDataFrame([("n", 3, None)], revisions.schema), added, gone, revisions, heads, tree.limit(0))[3] == "ok"


def test_delete_takes_all_levels(spark):
    one = spark.createDataFrame([(1,), (2,)], "repo_id bigint")
    assert [rows(t) for t in services.delete_repos(one.where("repo_id = 1"), one, one, one, one)] == [[(2,)]] * 4


def test_tokens(spark):
    kind = "token_hash string, user_id bigint, created_at bigint, revoked_at bigint"
    tokens = spark.createDataFrame([("a", 1, 5, None), ("b", 1, 9, 3), ("c", 2, 1, None)], kind)
    users = spark.createDataFrame([(1, "u")], "user_id bigint, username string")
    assert [r.token_hash for r in services.list_tokens(tokens).collect()] == ["b", "a", "c"]
    assert rows(services.revoke_token(services.revoke_token(tokens, "a", 7), "b", 8).select("token_hash", "revoked_at")) == [("a", 7), ("b", 3), ("c", None)]
    more, known = services.create_token(tokens, users, spark.createDataFrame([("d", 1, 9, None)], kind), spark.createDataFrame([(1, "other")], users.schema))
    assert more.count() == 4 and rows(known) == [(1, "u")]


def test_schema_gate_and_salt(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    assert services.schema_error(df, "a bigint, b string", 3, 3) is None
    assert services.schema_error(df, "a bigint", 4, 3) == "version 4 is newer than 3" and services.schema_error(df, "a bigint", 2, 3) == "version 2 is older than 3"
    assert services.schema_error(df, "a int, c string", 3, 3) == "a: bigint; c: missing"
    settings, salt = services.salt_of(spark.createDataFrame([], "key string, value string"), "s1")
    assert salt == "s1" and services.salt_of(settings, "s2")[1] == "s1"


def test_bodies_of_commits(spark):
    kind = "place int, key string, summary string, parent string, error string"
    body = lambda given: tuple(services.commit_body_error(spark.createDataFrame(given, kind)).first())
    assert body([(0, "header", "a", "p", None), (1, "file", None, None, None), (2, "header", "b", None, None)]) == (3, "b", None, None)
    assert body([(1, "file", None, None, None)])[3] == "no header" and body([(0, "x", None, None, "unknown key"), (1, "y", None, None, "malformed")])[3] == "unknown key"
    assert body([(i, "header", "a", "p", None) for i in range(services.COMMIT_OPERATIONS + 1)])[3] == "too many operations"


def test_tokens_of_any_shape_decode(spark):
    df = spark.createDataFrame([(x,) for x in ("", "user_", "user_a.b.c", "robot_a.b.c", None, "user_e30.e30.c")], "t string").select(services.token_error(services.decode_token(F.col("t")), "k1", 10).alias("e"))
    assert [r.e for r in df.collect()] == ["prefix", "parts", "header", "prefix", "prefix", "header"]


def test_listings(spark, tmp_path):
    for name in ("models/a.bin", "models/x/b.bin", "models2/c.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    base = f"file://{tmp_path}"
    names = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    assert names(storage.list_folder(spark, base, "models")) == ["a.bin", "b.bin"] and names(storage.list_folder(spark, base, "none")) == []
    assert names(storage.list_keys(spark, base, "models")) == ["a.bin", "b.bin", "c.bin"] and names(storage.list_keys(spark, base, "models/x")) == ["b.bin"]
    from cairn import scratch

    for _ in range(2):  # deleting again is no error
        scratch.remove(spark, f"{base}/models2")
    assert names(storage.list_keys(spark, base, "models2")) == []


def test_scans_skip_nothing_and_name_what_is_bad(spark):
    pack = containers.build_pack([b"one", b"two" * 50])
    manifest = containers.Manifest([(b"f" * 32, [(pack.pack_hash, 153, 0, 2)])], [(pack.pack_hash, list(zip(pack.stored_hashes, pack.starts, pack.raw_sizes)), pack.payload_bytes)], [(b"r" * 32, pack.pack_hash, 0), (b"s" * 32, pack.pack_hash, 1)]).encode()
    df = spark.createDataFrame([(1, bytearray(pack.data)), (2, bytearray(pack.data[:-1])), (3, None)], "n int, content binary")
    assert [(n, p, c) for n, p, c, _ in rows(storage.scan_packs(df))] == [(1, pack.pack_hash.hex(), 2), (2, None, None), (3, None, None)]
    found = rows(storage.scan_manifests(spark.createDataFrame([(1, bytearray(manifest)), (2, bytearray(b"x"))], df.schema)))
    assert found[0][2:] == (1, 1, 2, None) and len(found[0][1]) == 64 and found[1][5] == "not a manifest of this version"
    assert containers.Manifest.outline(manifest) == {"files": 1, "packs": 1, "chunks": 2, "stored_bytes": 153, "file_bytes": 153, "unpacked_bytes": 153}
    assert storage.scan_packs(df.limit(0)).count() == 0


def test_keyed_ids_are_accepted_too(spark):
    import hashlib

    from cairn.functions.blake3 import data_hash

    data = b"some bytes"
    blobs = spark.createDataFrame([(1, hashlib.sha256(data).hexdigest(), bytearray(data)), (2, data_hash([data])[0].hex(), bytearray(data)), (3, "0" * 64, bytearray(data)), (4, hashlib.sha256(data).hexdigest(), bytearray(data)), (5, None, None)], "k int, oid string, data binary")
    got = storage.put_blobs(blobs, spark.createDataFrame([], "oid string"), "k")
    assert [(k, e, i) for k, e, i in rows(got.select("k", "error", "was_inserted"))] == [(1, None, True), (2, None, True), (3, "oid mismatch", False), (4, None, False), (5, "oid mismatch", False)]


def test_streamed_counters(spark, tmp_path):
    put = lambda codes: spark.createDataFrame([(c,) for c in codes], "code int").write.mode("append").parquet(f"{tmp_path}/in")
    put([200, 201, 404])
    stream = ingest.counters(spark.readStream.schema("code int").parquet(f"{tmp_path}/in"))
    start = lambda: stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    start()
    put([500, 200])
    start()
    assert rows(spark.table("counted")) == [("2xx", 3), ("4xx", 1), ("5xx", 1)]
