"""Blobs, chunks, and the index of chunks: identity, deduplication, packing offsets and one level of the Merkle tree.

Chunk bytes never cross a shuffle for deduplication: what is grouped and joined are hashes. Null texts are no blob.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import cdc, merkle
from cairn.functions.blake3 import data_hash
from cairn.registry import query, table

FIXED_CHUNK = 1024
HEADER_BYTES = 8
#: Sizes outside these aren't converted.
SMALLEST, LARGEST = 1024, 16384


#: Inputs below this many bytes, as Catalyst estimates, are dealt out before work that is heavy per byte.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores, as it may be one row group of one file and so one task. Large ones stay where they are read."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_INPUT else df


def oid(data: Column | str) -> Column:
    return F.sha2(F.col(data) if isinstance(data, str) else data, 256)


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, oid, size of each document's bytes."""
    data = F.col("text").cast("binary")
    return docs.where(F.col("text").isNotNull()).select("doc_id", "source", "lang", oid(data).alias("oid"), F.octet_length(data).cast("bigint").alias("size"))


def fixed_chunks(docs: DataFrame, size: int = FIXED_CHUNK, keep: tuple[str, ...] = ("doc_id", "source"), with_bytes: bool = False) -> DataFrame:
    """Each document's bytes cut every `size` bytes: keep, pos, byte_start, raw_len, raw_hash, and the bytes if asked for."""
    data = docs.select(*keep, F.col("text").cast("binary").alias("data")).where(F.octet_length("data") > 0)
    at = data.select(*keep, "data", F.explode(F.sequence(F.lit(0), ((F.octet_length("data") - 1) / size).cast("int"))).alias("pos"))
    part = F.substring("data", F.col("pos") * size + 1, F.lit(size))
    out = at.select(*keep, F.col("pos").cast("bigint").alias("pos"), (F.col("pos").cast("bigint") * size).alias("byte_start"), part.alias("part"))
    return out.select(*keep, "pos", "byte_start", F.octet_length("part").cast("bigint").alias("raw_len"), F.sha2("part", 256).alias("raw_hash"), *["part"] * with_bytes)


CHUNKS_SQL = """
b AS (SELECT doc_id, source, lang, sha256(text) AS oid, encode(text) AS data, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
chunks AS (SELECT doc_id, source, lang, oid, i AS pos, i * 1024 AS byte_start, least(1024, n - i * 1024) AS raw_len,
  sha256(unhex(substr(hex(data), (i * 2048 + 1)::BIGINT, 2048))) AS raw_hash FROM b, LATERAL (SELECT unnest(range(0, (n + 1023) // 1024)) AS i))
"""


@query("SELECT doc_id, sha256(text) AS oid, octet_length(encode(text)) AS size, regexp_matches(sha256(text), '^[0-9a-fA-F]{64}$') AS valid FROM documents WHERE text IS NOT NULL")
def q01_blob_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(table(spark, sf_dir, "documents")).select("doc_id", "oid", "size", F.col("oid").rlike("^[0-9a-fA-F]{64}$").alias("valid"))


@query("SELECT sha256(text) AS oid, count(*) AS copies, min(doc_id) AS first_doc, ((count(*) - 1) * min(octet_length(encode(text))))::BIGINT AS spare_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q02_exact_dup_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = blobs(table(spark, sf_dir, "documents")).groupBy("oid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min("size").alias("size"))
    return groups.where("copies > 1").select("oid", "copies", "first_doc", ((F.col("copies") - 1) * F.col("size")).alias("spare_bytes"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, pos, byte_start, raw_len, raw_hash FROM chunks")
def q03_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_chunks(table(spark, sf_dir, "documents")).drop("source")


@query(f"""WITH {CHUNKS_SQL} SELECT source, sum(n)::BIGINT AS n_chunks, sum(n * raw_len)::BIGINT AS raw_bytes, sum(raw_len)::BIGINT AS stored_bytes
FROM (SELECT source, raw_hash, raw_len, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY source""")
def q04_dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Equal chunks of a source collapse first, so that the second aggregation is over partial sums.
    distinct = fixed_chunks(table(spark, sf_dir, "documents")).groupBy("source", "raw_hash").agg(F.count("*").alias("n"), F.sum("raw_len").alias("raw"), F.max("raw_len").alias("stored"))
    return distinct.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.sum("raw").alias("raw_bytes"), F.sum("stored").alias("stored_bytes"))


def last_writers(registered: DataFrame, chunk: str, order: list[str], values: list[str]) -> DataFrame:
    """For each chunk the values of its last registration: a maximum, so partly aggregated before the shuffle."""
    last = registered.groupBy(chunk).agg(F.max(F.struct(*order, *values)).alias("last"))
    return last.select(chunk, *[F.col(f"last.{v}").alias(v) for v in values])


@query(f"WITH {CHUNKS_SQL} SELECT raw_hash, arg_max(oid, (doc_id, pos)) AS pack_hash, arg_max(pos, (doc_id, pos)) AS chunk_index FROM chunks GROUP BY raw_hash")
def q05_chunk_index_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("pack_hash", oid(F.col("text").cast("binary")))
    registered = fixed_chunks(docs, keep=("doc_id", "pack_hash")).withColumn("chunk_index", F.col("pos"))
    return last_writers(registered, "raw_hash", ["doc_id", "pos"], ["pack_hash", "chunk_index"])


@query(f"""WITH {CHUNKS_SQL}, ix AS (SELECT raw_hash, arg_max(oid, (doc_id, pos)) AS pack_hash, arg_max(pos, (doc_id, pos)) AS chunk_index FROM chunks GROUP BY raw_hash),
p AS (SELECT item_id, sha256(text) AS raw_hash FROM benchmark UNION ALL SELECT 1000000 + doc_id * 1000 + pos, raw_hash FROM chunks)
SELECT item_id, raw_hash, pack_hash, chunk_index, pack_hash IS NOT NULL AS found FROM p LEFT JOIN ix USING (raw_hash)""")
def q06_global_dedup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", oid(F.col("text").cast("binary")).alias("raw_hash"))
    own = fixed_chunks(table(spark, sf_dir, "documents")).select((1000000 + F.col("doc_id") * 1000 + F.col("pos")).alias("item_id"), "raw_hash")
    found = items.union(own).join(q05_chunk_index_lww(spark, sf_dir), "raw_hash", "left")
    return found.select("item_id", "raw_hash", "pack_hash", "chunk_index", F.col("pack_hash").isNotNull().alias("found"))


@query("SELECT sha256(text) AS file_hash, string_agg(DISTINCT source, ',' ORDER BY source) AS shards, count(DISTINCT source) AS n_shards FROM documents WHERE text IS NOT NULL GROUP BY 1")
def q07_file_refs_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = blobs(table(spark, sf_dir, "documents")).groupBy("oid").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return refs.select(F.col("oid").alias("file_hash"), F.array_join("s", ",").alias("shards"), F.size("s").cast("bigint").alias("n_shards"))


@query(f"WITH {CHUNKS_SQL} SELECT count(DISTINCT oid) AS files, count(DISTINCT raw_hash) AS chunks FROM chunks")
def q08_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("oid", oid(F.col("text").cast("binary")))
    both = fixed_chunks(docs, keep=("oid",))
    files = both.select("oid").distinct().agg(F.count("*").alias("files"))
    return files.crossJoin(both.select("raw_hash").distinct().agg(F.count("*").alias("chunks")))  # one row by one row


def pack_offsets(chunks: DataFrame, pack: str, order: str, size: str, header: int = HEADER_BYTES) -> DataFrame:
    """chunks with stored_end (running sum of stored lengths) and unpacked_start (running sum of raw ones before)."""
    w = Window.partitionBy(pack).orderBy(order)
    upto = F.sum(F.col(size)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return chunks.withColumn("stored_end", upto + header * F.row_number().over(w)).withColumn("unpacked_start", upto - F.col(size))


@query(f"""WITH {CHUNKS_SQL} SELECT doc_id, pos, (sum(raw_len + 8) OVER w)::BIGINT AS stored_end, (sum(raw_len) OVER w - raw_len)::BIGINT AS unpacked_start
FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def q11_pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_offsets(fixed_chunks(table(spark, sf_dir, "documents")), "doc_id", "pos", "raw_len").select("doc_id", "pos", "stored_end", "unpacked_start")


def merged_lines(chunks: DataFrame, group: list[str], order: str, h: str, size: str) -> DataFrame:
    """group, merged_hash (of the lines "hash : size" in order) and total."""
    line = F.struct(F.col(order), F.concat(F.col(h), F.lit(" : "), F.col(size).cast("string"), F.lit("\n")).alias("line"))
    lists = chunks.groupBy(*group).agg(F.array_sort(F.collect_list(line)).alias("ls"), F.sum(size).alias("total"))
    return lists.select(*group, F.sha2(F.array_join(F.transform("ls", lambda x: x["line"]), ""), 256).alias("merged_hash"), "total")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, sha256(string_agg(raw_hash || ' : ' || raw_len || chr(10), '' ORDER BY pos)) AS merged_hash, sum(raw_len)::BIGINT AS total FROM chunks GROUP BY doc_id")
def q17_merkle_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_lines(fixed_chunks(table(spark, sf_dir, "documents")), ["doc_id"], "pos", "raw_hash", "raw_len")


def size_gate(size: Column, least: int = SMALLEST, most: int = LARGEST, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit("disabled")
    return F.when(size < least, "too_small").when(size > most, "too_large").otherwise("converted")


@query(f"""WITH {CHUNKS_SQL}, g AS (SELECT *, CASE WHEN n < 1024 THEN 'too_small' WHEN n > 16384 THEN 'too_large' ELSE 'converted' END AS outcome FROM b),
c AS (SELECT chunks.*, min(doc_id) OVER (PARTITION BY raw_hash) AS first_doc FROM chunks JOIN g USING (doc_id) WHERE outcome = 'converted'),
s AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (first_doc < doc_id) AS n_deduped, sum(raw_len + 8)::BIGINT AS pack_bytes FROM c GROUP BY doc_id)
SELECT doc_id, outcome, n AS raw_bytes, n_chunks, n_deduped, pack_bytes FROM g LEFT JOIN s USING (doc_id)""")
def q19_convert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents convert in the order of doc_id; a chunk is deduplicated if an earlier document registered it."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length(F.col("text").cast("binary")) > 0)
    gated = docs.withColumn("raw_bytes", F.octet_length(F.col("text").cast("binary")).cast("bigint")).withColumn("outcome", size_gate(F.col("raw_bytes")))
    own = fixed_chunks(gated.where("outcome = 'converted'"))
    first = own.groupBy("raw_hash").agg(F.min("doc_id").alias("first_doc"))
    counted = own.join(first, "raw_hash").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("first_doc") < F.col("doc_id"), 1)).alias("n_deduped"), F.sum(F.col("raw_len") + HEADER_BYTES).alias("pack_bytes"))
    return gated.select("doc_id", "outcome", "raw_bytes").join(counted, "doc_id", "left")


def content_chunks(docs: DataFrame, target: int = 1024, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, pos, offset, size, raw_hash (keyed BLAKE3) of content-defined chunks; one pass, no shuffle."""
    chunking = cdc.Chunking(target)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", pos bigint, offset bigint, size bigint, raw_hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, at = [], [], []
            for i, data in enumerate(b.column(len(keep)).to_pylist()):
                for pos, (offset, size) in enumerate(cdc.chunks(data, chunking)):
                    rows.append((pos, offset, size))
                    parts.append(data[offset : offset + size])
                    at.append(i)
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kept = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int64()) for c in columns], pa.array([h.hex() for h in data_hash(parts)], pa.string())], names=[*keep, "pos", "offset", "size", "raw_hash"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")  # rows are whole blobs
    return spread(docs.where(F.col("text").isNotNull()).select(*keep, F.col("text").cast("binary").alias("data"))).mapInArrow(run, schema)


@query()
def q09_cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_chunks(table(spark, sf_dir, "documents")).drop("source")


@query()
def q10_cdc_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = content_chunks(table(spark, sf_dir, "documents")).groupBy("source", "raw_hash").agg(F.count("*").alias("n"), F.sum("size").alias("raw"), F.max("size").alias("stored"))
    return distinct.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum("raw").alias("raw_bytes"), F.sum("stored").alias("stored_bytes"))


def merkle_roots(chunks: DataFrame, group: str, order: str, h: str, size: str, salted: bool = True) -> DataFrame:
    """group and file_hash (or pack_hash): the Merkle root of the chunks in order. A file has at most 100,000 chunks a pack, 72 bytes each."""
    lists = chunks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, h, size))).alias("cs"))
    name = "file_hash" if salted else "pack_hash"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = merkle.file_hashes if salted else merkle.roots
        for b in batches:
            found = of([[(bytes.fromhex(c[h]), c[size]) for c in cs] for cs in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.hex() for x in found], pa.string())], names=[group, name])

    return lists.mapInArrow(run, f"`{group}` {chunks.schema[group].dataType.simpleString()}, {name} string")


def file_roots(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 1024) -> DataFrame:
    """key, file_hash, n_chunks and size of each blob, in the pass that chunks it: neither bytes nor chunks are shuffled. For chunks that are stored already there is merkle_roots."""
    chunking = cdc.Chunking(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            spans = [cdc.chunks(data, chunking) for data in blobs]
            hashes = iter(data_hash([data[o : o + n] for data, own in zip(blobs, spans, strict=True) for o, n in own]))
            found = merkle.file_hashes([[(next(hashes), n) for _, n in own] for own in spans])
            columns = [pa.array([h.hex() for h in found], pa.string()), pa.array([len(own) for own in spans], pa.int64()), pa.array([len(d) for d in blobs], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, "file_hash", "n_chunks", "size"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")  # rows are whole blobs
    data = docs.where(docs[text].isNotNull()).select(docs[key], docs[text].cast("binary").alias("data"))
    return spread(data).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, file_hash string, n_chunks bigint, size bigint")


@query()
def q18_merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_roots(table(spark, sf_dir, "documents"))
