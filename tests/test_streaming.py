import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cairn.functions import cdc
from cairn.functions.blake3 import data_hash
from cairn.streaming import ingest


def test_a_blob_that_comes_again_is_stored_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    put = lambda rows: spark.createDataFrame(rows, ingest.BLOB).write.mode("append").parquet(f"{folder}/in")
    run = lambda: ingest.ingest(spark.readStream.schema(ingest.BLOB).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    put([("a", 1), ("b", 2), ("a", 1)])
    run()
    put([("b", 2), ("c", 3)])
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("oid", "size").collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_windowed_rates_equal_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 3, start + timedelta(minutes=17 * i)) for i in range(50)]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = ingest.rates(spark.readStream.schema("user_id bigint, ts timestamp").parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = spark.createDataFrame(rows, "user_id bigint, ts timestamp").groupBy("user_id", F.window("ts", "1 hour").start.alias("start")).agg(F.count("*").alias("requests"))
    assert sorted(map(str, spark.table("rates").collect())) == sorted(map(str, want.collect()))


def test_blobs_that_arrive_in_blocks(spark, tmp_path):
    """Two blobs in blocks over three batches give the chunks of the whole blobs."""
    rng = random.Random(5)
    blobs = {"a": rng.randbytes(30_000), "b": b"ab" * 9000, "c": b""}
    kind = "blob string, seq bigint, data binary, last boolean"
    blocks = [(k, i, bytearray(v[i * 7000 : (i + 1) * 7000]), (i + 1) * 7000 >= len(v)) for k, v in blobs.items() for i in range(max(1, -(-len(v) // 7000)))]
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/in")
    stream = ingest.chunk_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    for batch in (0, 1, 2):
        part = [b for b in blocks if (2 if b[1] > 2 else b[1] // 2) == batch]
        spark.createDataFrame(part[::-1], kind).write.mode("append").parquet(f"{tmp_path}/in")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.blob, r.offset, r.size, r.raw_hash) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    c = cdc.Chunking(1024)
    assert got == sorted((k, o, n, data_hash([v[o : o + n]])[0].hex()) for k, v in blobs.items() for o, n in cdc.chunks(v, c))
