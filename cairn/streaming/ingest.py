"""Idempotent ingest of blobs as a stream of files: what arrives twice is stored once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.functions import cdc
from cairn.functions.blake3 import data_hash
from cairn.operators.metrics import status_class
from cairn.registry import query, table
from cairn.scratch import path

BLOB = "oid string, size bigint"


def ingest(blobs: DataFrame, stored: str, checkpoint: str):
    """Starts a stream that appends each batch's new oids to the table at `stored`, once each.

    The table lies in folders by the oid's first digit; a batch reads only the ids, and only of folders that it writes to.
    """
    spark = blobs.sparkSession
    spark.createDataFrame([], BLOB + ", part string").write.mode("append").partitionBy("part").parquet(stored)

    def put(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["oid"]).withColumn("part", F.substring("oid", 1, 1)).persist()
        parts = [r.part for r in fresh.select("part").distinct().collect()]  # 16 at most
        existing = spark.read.schema(BLOB + ", part string").parquet(stored).where(F.col("part").isin(parts))
        fresh.join(existing.select("oid"), "oid", "left_anti").select("oid", "size", "part").write.mode("append").partitionBy("part").parquet(stored)
        fresh.unpersist()

    return blobs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("SELECT DISTINCT sha256(text) AS oid, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL")
def q50_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed twice over give each blob once."""
    folder = path(spark, "ingest")
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    data = F.col("text").cast("binary")
    for name in ("a", "b"):
        docs.select(F.sha2(data, 256).alias("oid"), F.octet_length(data).cast("bigint").alias("size")).write.mode("append").parquet(f"{folder}/in")
    ingest(spark.readStream.schema(BLOB).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(BLOB + ", part string").parquet(f"{folder}/out").select("oid", "size")


def rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """user_id, window start and requests of a stream of events; state older than `late` is dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", window)).agg(F.count("*").alias("requests")).select("user_id", F.col("window.start").alias("start"), "requests")


def counters(requests: DataFrame) -> DataFrame:
    """class and requests since the start, of a stream with a status code; for the complete or update mode, five rows of state."""
    return requests.groupBy(status_class(F.col("code")).alias("class")).agg(F.count("*").alias("requests"))


def chunk_stream(blocks: DataFrame, target: int = 1024) -> DataFrame:
    """blob, offset, size and raw_hash of the content-defined chunks of blobs that arrive block by block: blob, seq, data, last.

    A blob's state is what no chunk holds yet, at most the longest chunk and a block, and goes with its last block. Blocks of a
    micro-batch are put in order by seq; those of a later batch come after them. The chunks are those of the whole blob.
    """
    chunking = cdc.Chunking(target)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunker, found, ended = cdc.StreamingChunker(chunking), [], False
        if state.exists:
            held, chunker.offset = state.get
            chunker.held = bytearray(held)
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            found += chunker.feed(row.data or b"")
            if row.last:
                found += chunker.finish()
                ended = True
        if not ended:
            state.update((bytes(chunker.held), chunker.offset))
        elif state.exists:
            state.remove()
        hashes = [h.hex() for h in data_hash([data for _, data in found])]
        yield pd.DataFrame({"blob": [key[0]] * len(found), "offset": [o for o, _ in found], "size": [len(data) for _, data in found], "raw_hash": hashes})

    return blocks.groupBy("blob").applyInPandasWithState(run, "blob string, offset bigint, size bigint, raw_hash string", "held binary, at bigint", "append", GroupStateTimeout.NoTimeout)
