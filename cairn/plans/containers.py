"""From blobs to packs and manifests and back: each step checked, whole blobs in tasks, only hashes across shuffles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import cdc, compression, merkle
from cairn.functions.blake3 import data_hash
from cairn.operators.chunks import spread
from cairn.registry import query, table
from cairn.sources import containers


def convert(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: int = compression.NONE, target: int = 1024) -> DataFrame:
    """key, oid, file_hash, pack_hash, n_chunks, raw_bytes, pack (bytes) and manifest (bytes) of each blob with data: one pack and one file of one segment."""
    chunking = cdc.Chunking(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            parts = [[data[a : a + n] for a, n in cdc.chunks(data, chunking)] for data in blobs]
            flat = iter(data_hash([p for ps in parts for p in ps]))
            raws = [[next(flat) for _ in ps] for ps in parts]
            packs = containers.build_packs(parts, scheme)
            files = merkle.file_hashes([list(zip(raw, map(len, ps), strict=True)) for raw, ps in zip(raws, parts, strict=True)])
            rows = []
            for data, ps, raw, pack, file_hash in zip(blobs, parts, raws, packs, files, strict=True):
                stored = list(zip(pack.stored_hashes, pack.starts, pack.raw_sizes, strict=True))
                manifest = containers.Manifest([(file_hash, [(pack.pack_hash, len(data), 0, len(ps))])], [(pack.pack_hash, stored, pack.payload_bytes)], [(h, pack.pack_hash, i) for i, h in enumerate(raw)])
                rows.append((hashlib.sha256(data).hexdigest(), file_hash.hex(), pack.pack_hash.hex(), len(ps), len(data), pack.data, manifest.encode()))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[key, "oid", "file_hash", "pack_hash", "n_chunks", "raw_bytes", "pack", "manifest"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # rows are whole blobs
    data = docs.select(docs[key], docs[text].cast("binary").alias("data")).where(F.octet_length("data") > 0)
    kind = docs.schema[key].dataType.simpleString()
    return spread(data).mapInArrow(run, f"`{key}` {kind}, oid string, file_hash string, pack_hash string, n_chunks bigint, raw_bytes bigint, pack binary, manifest binary")


def rebuild(packs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ok, error and n_chunks: each manifest and pack parsed and verified, the file rebuilt from its segments, and its hash compared with the oid, the keyed hash of the bytes and the file hash; any one is enough, as an id may be either."""

    def parts_of(pack: bytes, verified: object, encoded: bytes) -> tuple[containers.Manifest, list[bytes]]:
        manifest = containers.Manifest.decode(encoded)
        if isinstance(verified, ValueError):
            raise verified
        pack_hash, chunks = verified
        if manifest.packs[0][0] != pack_hash or [(c.stored_hash, c.start, c.raw) for c in chunks] != manifest.packs[0][1]:
            raise ValueError("the manifest lists other chunks")
        parts = []
        for _, size, first, end in manifest.files[0][1]:
            own = [containers.extract(pack, c.start, c.raw, None) for c in chunks[first:end]]
            if sum(map(len, own)) != size:
                raise ValueError("a segment has another length")
            parts += own
        return manifest, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            oids, data, encoded = (b.column(i).to_pylist() for i in (1, 2, 3))
            found: list = []
            for pack, verified, manifest in zip(data, containers.verify_packs(data), encoded, strict=True):
                try:
                    found.append(parts_of(pack, verified, manifest))
                except ValueError as e:
                    found.append(e)
            good = [k for k, x in enumerate(found) if isinstance(x, tuple)]
            flat = iter(data_hash([p for k in good for p in found[k][1]]))
            raws = {k: [next(flat) for _ in found[k][1]] for k in good}
            files = dict(zip(good, merkle.file_hashes([list(zip(raws[k], map(len, found[k][1]), strict=True)) for k in good]), strict=True))
            whole = dict(zip(good, data_hash([b"".join(found[k][1]) for k in good]), strict=True))
            for k in good:
                manifest, parts = found[k]
                ids = {hashlib.sha256(b"".join(parts)).hexdigest(), whole[k].hex(), files[k].hex()}
                if [h for h, _, _ in manifest.lookup] != raws[k]:
                    found[k] = ValueError("a raw hash is wrong")
                elif oids[k] not in ids or manifest.files[0][0] != files[k]:
                    found[k] = ValueError("the file has another hash")
            error = [str(x) if isinstance(x, ValueError) else None for x in found]
            n = [0 if isinstance(x, ValueError) else len(x[1]) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e is None for e in error]), pa.array(error, pa.string()), pa.array(n, pa.int64())], names=[key, "ok", "error", "n_chunks"])

    kind = packs.schema[key].dataType.simpleString()
    return packs.select(key, "oid", "pack", "manifest").mapInArrow(run, f"`{key}` {kind}, ok boolean, error string, n_chunks bigint")


@query()
def q44_lz4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs compressed after grouping bytes by four, verified and rebuilt."""
    return rebuild(convert(table(spark, sf_dir, "documents"), scheme=compression.BG4_LZ4))


@query()
def q45_pack_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild(convert(table(spark, sf_dir, "documents")))


@query()
def q46_manifest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests read back as rows, one for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, encoded in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = containers.Manifest.decode(encoded)
                for raw_hash, pack, i in m.lookup:
                    own, start, raw = m.packs[0][1][i]
                    rows.append((key, m.files[0][0].hex(), pack.hex(), i, raw_hash.hex(), own.hex(), start, raw))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "file_hash", "pack_hash", "chunk_index", "raw_hash", "stored_hash", "byte_start", "raw_len"])

    manifests = convert(table(spark, sf_dir, "documents")).select("doc_id", "manifest")
    return manifests.mapInArrow(run, "doc_id bigint, file_hash string, pack_hash string, chunk_index bigint, raw_hash string, stored_hash string, byte_start bigint, raw_len bigint")
