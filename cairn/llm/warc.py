"""WARC archives compressed with a dictionary of their own: written by tasks into the shared folder, then read back.

An archive is a leading skippable frame that holds a Zstandard dictionary, built from parts of all its records, and a
frame for each record, compressed alone with that dictionary, so that any record can be read by its offset. Records of
equal payloads (SHA-256) of at least REVISIT_BYTES share one payload: that with the largest page_id is the response,
the others revisit it.

A null html is an empty payload, a null url the target urn:page:<id>. Of repeated rows with the largest page_id each is
a response; a null page_id is less than any. Payloads may be of any length. A task rolls to a new archive after
ARCHIVE_BYTES. Archives get a name of their own for each attempt, and only those that a successful task lists are read,
so a lost executor leaves no half-written one behind. An empty table gives no archive and an empty result. Only the
three columns are read. Archives are written and read by pyarrow's file systems, so the folder may be file, HDFS or S3.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
#: About the bytes from which the dictionary is built: as many of each record, from places that move on.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: A skippable frame's magic number.
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, but its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if refers_to is not None else payload
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves as raw content."""
    share = max(256, SAMPLE_BYTES // len(records))
    samples = []
    for i, r in enumerate(records):
        at = i * share % max(1, len(r) - share + 1)
        samples.append(r[at : at + share])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The archive's pieces: the dictionary's frame, then each record's."""
    built = dictionary(records)
    yield struct.pack("<II", SKIPPABLE, len(built)) + built
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(built))
    for r in records:
        yield compressor.compress(r)


def read_archive(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """The archive's records, one frame at a time."""
    head = stream.read(8)
    given = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        given = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=given)
    rest = head
    while True:
        one = decompressor.decompressobj()
        out = []
        while not one.eof:
            data = rest or stream.read(1 << 16)
            rest = b""
            if not data:
                if out:
                    raise ValueError("an archive ends within a record")
                return
            out.append(one.decompress(data))
        rest = one.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> dict[str, object]:
    """A record's page_id, type and reference, and its payload's length and digest: of the payload itself, if there is one."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    payload = block[: int(fields["Content-Length"])]
    if block[len(payload) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to. Only digests are grouped, partly before the shuffle; the join can split a hot digest, as each has one row on its other side."""
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("__same"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = own.where(large).groupBy("__same").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n")).where("__n > 1").select("__same", "__last")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return own.join(groups, "__same", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives into folder; returns their paths and numbers of records, as a written table."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for piece in archive(records):
                    out.write(piece)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], names=["name", "records"])

        held, size = [], 0
        for b in batches:
            for row in b.to_pylist():
                held.append(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return written(with_references(pages).mapInArrow(run, "name string, records bigint"), "archives")[0]


def read(listed: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the listed archives; a count that differs from the list is an error."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = dict(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

        for b in batches:
            for row in b.to_pylist():
                rows, n = [], 0
                with fs.open_input_stream(f"{base}/{row['name']}", compression=None) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse(raw))
                        n += 1
                        if not payloads:
                            rows[-1].pop("payload")
                        if len(rows) == 500:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
                if n != row["records"]:
                    raise ValueError(f"{row['name']} has {n} records instead of {row['records']}")

    spread = listed.repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism), F.xxhash64("name"))
    return spread.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages in the shared folder and reads the archives back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, payload FROM p),
g AS (SELECT payload, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY payload HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d LEFT JOIN g USING (payload)
"""
