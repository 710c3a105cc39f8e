"""Stored objects: listings, checked puts, and scans of packs and manifests that note bad ones instead of failing.

A put takes claimed ids with bytes, recomputes what they should be, and inserts what is neither wrong nor there. Bytes are
hashed where they lie; only ids meet in joins. Rows are whole objects, so batches are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.blake3 import data_hash
from cairn.operators.chunks import oid
from cairn.plans.containers import convert
from cairn.registry import query, table
from cairn.sources import containers

MOST_BYTES = 64 << 20


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    found = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not spark._jvm.org.apache.hadoop.fs.FileSystem.get(found.toUri(), spark._jsc.hadoopConfiguration()).globStatus(found):
        return spark.createDataFrame([], "path string, size bigint")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", F.col("length").alias("size"))


def list_folder(spark: SparkSession, base: str, folder: str = "") -> DataFrame:
    """path and size of all files below a folder of base; none if it isn't there. Contents aren't read."""
    return _files(spark, "/".join(x for x in (base.rstrip("/"), folder.strip("/")) if x))


def list_keys(spark: SparkSession, base: str, prefix: str) -> DataFrame:
    """path and size of all files whose key (what follows base) starts with the prefix, folder or not."""
    return _files(spark, f"{base.rstrip('/')}/{prefix}*")


def _each(df: DataFrame, column: str, fields: str, judge: Callable[[list[bytes]], list[tuple]]) -> DataFrame:
    """df without its bytes, and for each row the fields that judge gives."""
    keep = [c for c in df.columns if c != column]
    names = [f.name for f in df.sparkSession.createDataFrame([], fields).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*judge([x or b"" for x in b.column(len(keep)).to_pylist()]), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *[pa.array(c) if b.num_rows else pa.nulls(0) for c in made]], names=[*keep, *names])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > 64:
        df.sparkSession.conf.set(name, "64")
    return df.select(*keep, column).mapInArrow(_typed(run, kinds + fields, df.sparkSession), kinds + fields)


def _typed(run: Callable, ddl: str, spark: SparkSession) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    return lambda batches: (pa.Table.from_batches([b]).cast(schema).combine_chunks().to_batches()[0] if b.num_rows else pa.RecordBatch.from_pylist([], schema) for b in run(batches))


def scan_manifests(stored: DataFrame, column: str = "content") -> DataFrame:
    """stored without the bytes, with the manifest's id (the keyed hash of its bytes), files, packs, chunks and error; a bad one has only an error."""

    def judge(batch: list[bytes]) -> list[tuple]:
        out = []
        for data, own in zip(batch, data_hash(batch), strict=True):
            try:
                m = containers.Manifest.decode(data)
                out.append((own.hex(), len(m.files), len(m.packs), len(m.lookup), None))
            except ValueError as e:
                out.append((None, None, None, None, str(e)))
        return out

    return _each(stored, column, "id string, files bigint, packs bigint, chunks bigint, error string", judge)


def scan_packs(stored: DataFrame, column: str = "content") -> DataFrame:
    """stored without the bytes, with the pack's hash and chunks, every hash, length and offset checked, or the error."""

    def judge(batch: list[bytes]) -> list[tuple]:
        return [(None, None, str(x)) if isinstance(x, ValueError) else (x[0].hex(), len(x[1]), None) for x in containers.verify_packs(batch)]

    return _each(stored, column, "pack_hash string, chunks bigint, error string", judge)


def _inserted(checked: DataFrame, existing: DataFrame, key: str, found: str) -> DataFrame:
    """checked (key, found, error) with was_inserted: right, not there, and the first of its batch."""
    there = existing.select(F.col(found)).distinct().withColumn("there", F.lit(True))
    first = Window.partitionBy(found, F.col("error").isNull()).orderBy(key)
    turn = F.when(F.col("error").isNull(), F.row_number().over(first))
    marked = checked.withColumn("turn", turn).join(there, found, "left")
    return marked.withColumn("was_inserted", F.col("error").isNull() & F.col("there").isNull() & (F.col("turn") == 1)).drop("turn", "there")


def put_blobs(blobs: DataFrame, existing: DataFrame, key: str, keyed_too: bool = True, most: int = MOST_BYTES) -> DataFrame:
    """key, oid, error and was_inserted of blobs (key, oid, data): an oid must be the SHA-256 (or, if allowed, the keyed hash) of the bytes."""
    sized = blobs.withColumn("sha", oid("data")).withColumn("size", F.octet_length("data"))
    if keyed_too:
        sized = _each(sized, "data", "keyed string", lambda batch: [(h.hex(),) for h in data_hash(batch)])
    right = F.lower("oid") == F.col("sha")
    right = right | (F.lower("oid") == F.col("keyed")) if keyed_too else right
    error = F.when(F.col("size") > most, "too large").when(~F.coalesce(right, F.lit(False)), "oid mismatch")
    return _inserted(sized.select(key, F.lower("oid").alias("oid"), error.alias("error")), existing.select(F.lower("oid").alias("oid")), key, "oid")


def put_packs(packs: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """key, pack_hash, error and was_inserted of packs (key, claimed, pack): verified whole, and its hash must be the claimed one."""
    seen = scan_packs(packs.select(key, "claimed", "pack"), "pack")
    error = F.coalesce("error", F.when(F.lower("claimed") != F.col("pack_hash"), "another hash"))
    return _inserted(seen.select(key, F.lower("claimed").alias("pack_hash"), error.alias("error")), existing.select("pack_hash"), key, "pack_hash")


def validated_chunks(rebuilt: DataFrame, lookup: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of lookup (key, raw_hash, pack_hash, chunk_index) that may be registered: those of files whose packs and bytes were hashed anew and found right."""
    return lookup.join(rebuilt.where("ok").select(key), key, "left_semi").dropDuplicates(["raw_hash", "pack_hash", "chunk_index"])


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, octet_length(encode(text)) AS n, CASE WHEN lang = 'de' THEN sha256(text || '!') WHEN lang = 'fr' THEN upper(sha256(text)) ELSE sha256(text) END AS oid FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, lower(oid) AS oid, CASE WHEN n > 16384 THEN 'too large' WHEN lower(oid) <> h THEN 'oid mismatch' END AS error FROM d),
x AS (SELECT DISTINCT sha256(text) AS oid FROM documents JOIN labels USING (doc_id))
SELECT doc_id, oid, error, error IS NULL AND oid NOT IN (SELECT oid FROM x WHERE oid IS NOT NULL) AND row_number() OVER (PARTITION BY oid, error IS NULL ORDER BY doc_id) = 1 AS was_inserted FROM e""")
def q73_put_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put under claimed ids: German ones under a wrong one, French ones in upper case; labelled ones are there already."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    h = F.sha2("text", 256)
    claimed = F.when(F.col("lang") == "de", F.sha2(F.concat("text", F.lit("!")), 256)).when(F.col("lang") == "fr", F.upper(h)).otherwise(h)
    blobs = docs.select("doc_id", claimed.alias("oid"), F.col("text").cast("binary").alias("data"))
    existing = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(h.alias("oid"))
    return put_blobs(blobs, existing, "doc_id", keyed_too=False, most=16384)


@query("""SELECT doc_id, doc_id % 10 > 1 AS ok, CASE WHEN doc_id % 10 > 1 THEN 1 END AS files, CASE WHEN doc_id % 10 > 1 THEN 1 END AS packs FROM documents WHERE octet_length(encode(text)) > 0""")
def q74_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored manifests, of ten one cut short and one of another tag."""
    made = convert(table(spark, sf_dir, "documents")).select("doc_id", "manifest")
    k = F.col("doc_id") % 10
    cut = F.when(k == 0, F.substring("manifest", 1, 300)).when(k == 1, F.concat(F.lit(b"\0"), F.col("manifest"))).otherwise(F.col("manifest"))
    return scan_manifests(made.select("doc_id", cut.alias("content"))).select("doc_id", F.col("error").isNull().alias("ok"), "files", "packs")


@query("""WITH d AS (SELECT doc_id, text, doc_id % 8 AS k FROM documents WHERE octet_length(encode(text)) > 0),
e AS (SELECT doc_id, text, k, CASE WHEN k = 0 THEN 'broken' WHEN k = 1 THEN 'another hash' END AS error FROM d)
SELECT doc_id, error, error IS NULL AND text NOT IN (SELECT text FROM d WHERE k = 2) AND row_number() OVER (PARTITION BY text, error IS NULL ORDER BY doc_id) = 1 AS was_inserted FROM e""")
def q75_put_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each document, of eight one broken and one under another's hash; those of another eighth are there."""
    made = convert(table(spark, sf_dir, "documents")).select("doc_id", "pack_hash", "pack")
    k = F.col("doc_id") % 8
    broken = F.when(k == 0, F.concat(F.col("pack"), F.lit(b"x"))).otherwise(F.col("pack"))
    claimed = F.when(k == 1, F.reverse("pack_hash")).otherwise(F.col("pack_hash"))
    put = put_packs(made.select("doc_id", claimed.alias("claimed"), broken.alias("pack")), made.where(k == 2).select("pack_hash"), "doc_id")
    return put.select("doc_id", F.when(F.col("error") == "another hash", "another hash").when(F.col("error").isNotNull(), "broken").alias("error"), "was_inserted")
