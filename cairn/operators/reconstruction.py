"""Reconstruction: from a file's segments to its ordered chunks, with every check, as equi-joins.

Files here are the documents of a source and language in order of doc_id, a segment for each; packs hold one document's
fixed chunks, so equal documents share a pack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.chunks import CHUNKS_SQL, FIXED_CHUNK, HEADER_BYTES, fixed_chunks, oid, pack_offsets
from cairn.registry import query, table

#: Segments of a file that are summed in one task before the blocks' sums meet.
SEGMENTS_A_BLOCK = 4096


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """segments (file, seg_index, pack_hash, chunk_start, chunk_end, unpacked_bytes) and pack_chunks (pack_hash, chunk_index, byte_start, raw_len, raw_hash)."""
    data = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").where(F.octet_length(data) > 0).withColumn("pack_hash", oid(data))
    n = F.octet_length(data).cast("bigint")
    segments = docs.select(F.concat_ws("/", "source", "lang").alias("file"), F.col("doc_id").alias("seg_index"), "pack_hash", F.lit(0).cast("bigint").alias("chunk_start"), F.floor((n + 1023) / 1024).cast("bigint").alias("chunk_end"), n.alias("unpacked_bytes"), "n_chars")
    chunks = fixed_chunks(docs, keep=("pack_hash",)).groupBy("pack_hash", "pos").agg(F.first("raw_len").alias("raw_len"), F.first("raw_hash").alias("raw_hash"))
    offsets = pack_offsets(chunks, "pack_hash", "pos", "raw_len")
    stored = F.col("stored_end") - F.col("raw_len") - HEADER_BYTES
    return segments, offsets.select("pack_hash", F.col("pos").alias("chunk_index"), stored.alias("byte_start"), "raw_len", "raw_hash")


def plan(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """file, pos, and for each chunk in order pack_hash, chunk_index, byte_start, raw_len, raw_hash.

    A segment's half-open range explodes into chunk numbers, which join the packs' chunks by equality; an empty range
    gives none. What is wrong with a file is found by plan_errors, which checked_plan asks first. Segments' first
    positions are sums within blocks of numbers and over blocks, so that no task orders all segments of a file.
    """
    some = segments.where("chunk_end > chunk_start")
    wanted = some.select("file", "seg_index", "pack_hash", F.explode(F.sequence("chunk_start", F.col("chunk_end") - 1)).alias("chunk_index"), "chunk_start")
    joined = wanted.join(chunks, ["pack_hash", "chunk_index"])
    n = some.select("file", "seg_index", (F.col("chunk_end") - F.col("chunk_start")).alias("n"), F.floor(F.col("seg_index") / SEGMENTS_A_BLOCK).alias("block"))
    before = lambda *of: Window.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = n.groupBy("file", "block").agg(F.sum("n").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before("file", "block")), F.lit(0)).alias("earlier"))
    within = n.select("file", "block", "seg_index", F.coalesce(F.sum("n").over(before("file", "block", "seg_index")), F.lit(0)).alias("first"))
    starts = within.join(blocks, ["file", "block"]).select("file", "seg_index", (F.col("first") + F.col("earlier")).alias("first"))
    at = F.col("first") + F.col("chunk_index") - F.col("chunk_start")
    return joined.join(starts, ["file", "seg_index"]).select("file", at.alias("pos"), "pack_hash", "chunk_index", "byte_start", "raw_len", "raw_hash")


#: What may be wrong with a file's plan, in the order of the checks. The first two concern the manifest, and so every file of it.
PLAN_ERRORS = ("duplicate pack", "duplicate lookup", "reversed range", "missing pack", "range beyond the pack", "missing chunk", "missing raw hash", "segment length")


def plan_errors(files: DataFrame, segments: DataFrame, packs: DataFrame, chunks: DataFrame, lookup: DataFrame) -> DataFrame:
    """file and error: the first that applies, by segment and then in the order of PLAN_ERRORS; null for a sound file, "file not found" for one asked for that has no entry.

    files: file (asked for), n_segments (null if it has no entry); segments as in plan; packs: pack_hash, n_chunks;
    chunks: pack_hash, chunk_index, raw_len; lookup: pack_hash, chunk_index, raw_hash. All of one manifest.
    """
    listed = packs.groupBy("pack_hash").agg(F.max("n_chunks").alias("n_chunks"), F.count("*").alias("n"))
    known = lookup.groupBy("pack_hash", "chunk_index").agg(F.count("*").alias("n"), F.lit(1).alias("has_raw"))
    twice = lambda df: df.agg(F.coalesce(F.max("n"), F.lit(0)) > 1).first()[0]  # noqa: E731  one boolean
    whole = PLAN_ERRORS[0] if twice(listed) else PLAN_ERRORS[1] if twice(known) else None
    if whole:
        return files.select("file", F.lit(whole).alias("error"))
    of = segments.join(listed, "pack_hash", "left")
    early = (
        F.when(F.col("chunk_end") < F.col("chunk_start"), 2).when(F.col("n_chunks").isNull(), 3).when(F.col("chunk_end") > F.col("n_chunks"), 4)
    )
    of = of.select("file", "seg_index", "pack_hash", "chunk_start", "chunk_end", "unpacked_bytes", early.alias("early"))
    each = of.where("early IS NULL AND chunk_end > chunk_start").select("file", "seg_index", "pack_hash", F.explode(F.sequence("chunk_start", F.col("chunk_end") - 1)).alias("chunk_index"))
    found = each.join(chunks.select("pack_hash", "chunk_index", "raw_len"), ["pack_hash", "chunk_index"], "left").join(known.drop("n"), ["pack_hash", "chunk_index"], "left")
    fault = F.when(F.col("raw_len").isNull(), F.struct("chunk_index", F.lit(5).alias("code"))).when(F.col("has_raw").isNull(), F.struct("chunk_index", F.lit(6).alias("code")))
    sums = found.groupBy("file", "seg_index").agg(F.sum("raw_len").alias("sum"), F.min(fault).alias("fault"))
    late = F.when(F.col("fault").isNotNull(), F.col("fault.code")).when(F.coalesce("sum", F.lit(0)) != F.col("unpacked_bytes"), 7)
    codes = of.join(sums, ["file", "seg_index"], "left").select("file", "seg_index", F.coalesce("early", late).alias("code")).where("code IS NOT NULL")
    first = codes.groupBy("file").agg(F.min(F.struct("seg_index", "code")).alias("m")).select("file", F.element_at(F.array(*map(F.lit, PLAN_ERRORS)), F.col("m.code") + 1).alias("why"))
    return files.join(first, "file", "left").select("file", F.when(F.col("n_segments").isNull(), "file not found").otherwise(F.col("why")).alias("error"))


def checked_plan(files: DataFrame, segments: DataFrame, packs: DataFrame, chunks: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan of the sound files among those asked for, and plan_errors of the others."""
    verdict = plan_errors(files, segments, packs, chunks, lookup)
    sound = segments.join(verdict.where("error IS NULL").select("file"), "file", "left_semi")
    raw = chunks.select("pack_hash", "chunk_index", "byte_start", "raw_len").join(lookup.select("pack_hash", "chunk_index", "raw_hash"), ["pack_hash", "chunk_index"])
    return plan(sound, raw), verdict.where("error IS NOT NULL")


PLAN_SQL = f"""WITH {CHUNKS_SQL},
pc AS (SELECT DISTINCT oid AS pack_hash, pos AS chunk_index, pos * 1032 AS byte_start, raw_len, raw_hash FROM chunks),
seg AS (SELECT concat_ws('/', source, lang) AS file, doc_id, oid AS pack_hash, (n + 1023) // 1024 AS chunk_end, n AS unpacked_bytes FROM b),
st AS (SELECT *, coalesce(sum(chunk_end) OVER (PARTITION BY file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM seg),
plan AS (SELECT file, first + chunk_index AS pos, pack_hash, chunk_index, byte_start, raw_len, raw_hash FROM st JOIN pc USING (pack_hash))
"""


@query(PLAN_SQL + "SELECT * FROM plan")
def q12_reconstruction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(*model(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, lang, octet_length(encode(text)) AS n, doc_id % 9 AS k FROM documents WHERE octet_length(encode(text)) > 0)
SELECT doc_id AS file, CASE WHEN k = 0 THEN 'reversed range' WHEN k = 1 THEN 'missing pack' WHEN k = 2 THEN 'range beyond the pack' WHEN k = 3 THEN 'missing chunk' WHEN k = 4 THEN 'missing raw hash'
WHEN k = 5 THEN 'segment length' WHEN k = 6 THEN 'file not found' END AS error FROM d""")
def q58_plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one segment and pack for each document, corrupted in a way that its number gives; two ninths are sound."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length(F.col("text").cast("binary")) > 0)
    chunks = fixed_chunks(docs, keep=("doc_id",)).withColumn("k", F.col("doc_id") % 9).withColumnRenamed("pos", "chunk_index")
    k = F.col("doc_id") % 9
    n = F.octet_length(F.col("text").cast("binary")).cast("bigint")
    count = F.floor((n + FIXED_CHUNK - 1) / FIXED_CHUNK)
    all_segments = docs.select(F.col("doc_id").alias("file"), k.alias("k"), F.lit(0).alias("seg_index"), F.col("doc_id").alias("pack_hash"), F.when(k == 0, count + 1).otherwise(0).alias("chunk_start"), F.when(k == 2, count + 1).otherwise(count).alias("chunk_end"), F.when(k == 5, n + 1).otherwise(n).alias("unpacked_bytes"))
    files = all_segments.select("file", F.when(F.col("k") != 6, 1).alias("n_segments"))
    packs = docs.where(k != 1).select(F.col("doc_id").alias("pack_hash"), count.alias("n_chunks"))
    keep = chunks.withColumnRenamed("doc_id", "pack_hash")
    return plan_errors(files, all_segments.where("k <> 6").drop("k"), packs, keep.where("k <> 3 OR chunk_index > 0"), keep.where("k <> 4 OR chunk_index > 0"))


@query(PLAN_SQL + "SELECT file, pack_hash, min(pos) AS first_pos, count(*) AS n_chunks, sum(raw_len)::BIGINT AS length FROM plan GROUP BY ALL")
def q13_recon_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of each file in the order of their first chunk."""
    return plan(*model(spark, sf_dir)).groupBy("file", "pack_hash").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_chunks"), F.sum("raw_len").alias("length"))


def to_json(p: DataFrame) -> DataFrame:
    """file and the nested answer: packs in order of their first chunk, each with its chunks (raw hash, stored start, raw length)."""
    chunk = F.struct("pos", F.col("raw_hash").alias("hash"), F.col("byte_start").alias("offset"), F.col("raw_len").alias("length"))
    packs = p.groupBy("file", "pack_hash").agg(F.array_sort(F.collect_list(chunk)).alias("cs"), F.min("pos").alias("first"))
    packs = packs.withColumn("chunks", F.transform("cs", lambda c: F.struct(c["hash"].alias("hash"), c["offset"].alias("offset"), c["length"].alias("length"))))
    files = packs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("first", "pack_hash", "chunks"))).alias("ps"))
    return files.select("file", F.to_json(F.struct(F.transform("ps", lambda x: F.struct(x["pack_hash"].alias("hash"), x["chunks"].alias("chunks"))).alias("packs"))).alias("body"))


@query(PLAN_SQL + "SELECT file, count(DISTINCT pack_hash) AS n_packs, sum(n)::BIGINT AS download_bytes FROM (SELECT DISTINCT file, pack_hash, unpacked_bytes AS n FROM seg) GROUP BY file")
def q14_recon_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct packs of each file, and the raw bytes of whole packs that a download takes."""
    segments, chunks = model(spark, sf_dir)
    whole = chunks.groupBy("pack_hash").agg(F.sum("raw_len").alias("n"))
    return segments.select("file", "pack_hash").distinct().join(whole, "pack_hash").groupBy("file").agg(F.count("*").alias("n_packs"), F.sum("n").alias("download_bytes"))


def fetch_map(p: DataFrame, packs: DataFrame) -> DataFrame:
    """file, place, pack_hash, and for each pack the chunks that the file takes of it and the stored bytes they lie in, end exclusive. Packs come in the order of the manifest (packs: pack_hash, place), not of the file."""
    stored_end = F.col("byte_start") + HEADER_BYTES + F.col("raw_len")
    ranges = p.groupBy("file", "pack_hash").agg(F.min("chunk_index").alias("first_chunk"), (F.max("chunk_index") + 1).alias("end_chunk"), F.min("byte_start").alias("range_start"), F.max(stored_end).alias("range_end"))
    return ranges.join(packs, "pack_hash").select("file", "place", "pack_hash", "first_chunk", "end_chunk", "range_start", "range_end")


def fetch_json(fetched: DataFrame) -> DataFrame:
    """file and its body: the packs in order, and a map from each to its ranges."""
    one = F.struct(F.struct(F.col("first_chunk").alias("start"), F.col("end_chunk").alias("end")).alias("chunks"), F.struct(F.col("range_start").alias("start"), F.col("range_end").alias("end")).alias("bytes"))
    listed = fetched.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "pack_hash", one.alias("info")))).alias("ps"))
    info = F.map_from_entries(F.transform("ps", lambda x: F.struct(x["pack_hash"], F.array(x["info"]))))
    return listed.select("file", F.to_json(F.struct(F.transform("ps", lambda x: x["pack_hash"]).alias("packs"), info.alias("fetch"))).alias("body"))


@query(PLAN_SQL + """, pl AS (SELECT oid AS pack_hash, min(doc_id) AS place FROM b GROUP BY oid)
SELECT file, place, pack_hash, min(chunk_index)::BIGINT AS first_chunk, (max(chunk_index) + 1)::BIGINT AS end_chunk, min(byte_start)::BIGINT AS range_start, max(byte_start + 8 + raw_len)::BIGINT AS range_end FROM plan JOIN pl USING (pack_hash) GROUP BY ALL""")
def q76_fetch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, chunks = model(spark, sf_dir)
    return fetch_map(plan(segments, chunks), segments.groupBy("pack_hash").agg(F.min("seg_index").alias("place")))


def compared(p: DataFrame, expected: DataFrame) -> DataFrame:
    """file, chunks planned and expected, raw bytes, and the first position at which their hashes differ (null if none): file by file, place by place."""
    both = p.select("file", "pos", "raw_hash", "raw_len").join(expected.select("file", "pos", F.col("raw_hash").alias("want")), ["file", "pos"], "full")
    differs = F.when(~F.col("raw_hash").eqNullSafe(F.col("want")), F.col("pos"))
    return both.groupBy("file").agg(F.count("raw_hash").alias("planned"), F.count("want").alias("expected"), F.coalesce(F.sum("raw_len"), F.lit(0)).alias("raw_bytes"), F.min(differs).alias("first_difference"))


@query(PLAN_SQL + """, w AS (SELECT file, pos, CASE WHEN pos % 50 = 49 AND file LIKE 'src1%' THEN 'other' ELSE raw_hash END AS want FROM plan WHERE NOT (file LIKE 'src2%' AND pos = 3))
SELECT file, count(raw_hash) AS planned, count(want) AS expected, sum(raw_len)::BIGINT AS raw_bytes, min(CASE WHEN raw_hash IS DISTINCT FROM want THEN pos END)::BIGINT AS first_difference FROM plan FULL JOIN w USING (file, pos) GROUP BY file""")
def q77_compare_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans against lists of hashes; those of one source have other hashes in places, those of another lack a chunk."""
    p = plan(*model(spark, sf_dir))
    wrong = F.when((F.col("pos") % 50 == 49) & F.col("file").startswith("src1"), "other").otherwise(F.col("raw_hash"))
    return compared(p, p.where(~(F.col("file").startswith("src2") & (F.col("pos") == 3))).select("file", "pos", wrong.alias("raw_hash")))


def first_good(tried: DataFrame) -> DataFrame:
    """file, reference and error, from tries (file, seq, error): the first reference without an error; else the first error that isn't "stale"; else "not found"."""
    good, bad = F.when(F.col("error").isNull(), F.col("seq")), F.when(F.col("error") != "stale", F.struct("seq", "error"))
    one = tried.groupBy("file").agg(F.min(good).alias("seq"), F.min(bad).alias("bad"))
    return one.select("file", "seq", F.when(F.col("seq").isNull(), F.coalesce("bad.error", F.lit("not found"))).alias("error"))


@query("""WITH t AS (SELECT o_custkey AS file, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'stale' WHEN 'F' THEN 'hash ' || o_orderkey % 3 END AS error FROM orders)
SELECT file, min(seq) FILTER (error IS NULL) AS seq, CASE WHEN min(seq) FILTER (error IS NULL) IS NULL THEN coalesce(arg_min(error, seq) FILTER (error <> 'stale'), 'not found') END AS error FROM t GROUP BY file""")
def q78_first_good_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("o_orderstatus") == "O", "stale").when(F.col("o_orderstatus") == "F", F.concat(F.lit("hash "), (F.col("o_orderkey") % 3).cast("string")))
    return first_good(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("seq"), error.alias("error")))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id AS seg_index, n_chars AS declared, sum(raw_len)::BIGINT AS found FROM chunks JOIN documents USING (doc_id) GROUP BY ALL HAVING sum(raw_len) <> n_chars")
def q15_segment_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose declared length (here the number of characters) isn't that of their chunks."""
    segments, chunks = model(spark, sf_dir)
    found = chunks.groupBy("pack_hash").agg(F.sum("raw_len").alias("found"))
    return segments.join(found, "pack_hash").where(F.col("found") != F.col("n_chars")).select("seg_index", F.col("n_chars").alias("declared"), "found")


@query(f"""WITH {CHUNKS_SQL}, ok AS (SELECT DISTINCT oid FROM b JOIN documents d USING (doc_id) WHERE b.n = d.n_chars)
SELECT DISTINCT oid AS pack_hash, pos AS chunk_index, raw_hash FROM chunks SEMI JOIN ok USING (oid)""")
def q16_validated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that some validated segment uses; only these are registered."""
    segments, chunks = model(spark, sf_dir)
    valid = segments.where(F.col("unpacked_bytes") == F.col("n_chars"))
    return chunks.join(valid, "pack_hash", "left_semi").select("pack_hash", "chunk_index", "raw_hash")


@query("SELECT doc_id, sha256(text) AS oid, TRUE AS ok FROM documents WHERE octet_length(encode(text)) > 0")
def q47_reconstruct_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together in order, and the hash of what results."""
    docs = table(spark, sf_dir, "documents").withColumn("oid", oid(F.col("text").cast("binary")))
    parts = fixed_chunks(docs, keep=("doc_id", "oid"), with_bytes=True)
    whole = spark.sql("SELECT doc_id, oid, listagg(part) WITHIN GROUP (ORDER BY pos) AS data FROM {parts} GROUP BY doc_id, oid", parts=parts)
    return whole.select("doc_id", "oid", (F.sha2("data", 256) == F.col("oid")).alias("ok"))
