"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and once for the figure; results go to the noop sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cairn import catalogue
from cairn.functions import blake3, cdc, compression, merkle

HEADLINE = [
    "q02_exact_dup_blobs", "q03_fixed_chunks", "q04_dedup_ratio", "q05_chunk_index_lww", "q06_global_dedup_probe", "q09_cdc_chunks", "q10_cdc_dedup_stats",
    "q11_pack_offsets", "q12_reconstruction_plan", "q17_merkle_one_level", "q18_merkle_root", "q19_convert_summary", "q23_tree_prefix", "q27_commit_log",
    "q29_snapshot_merge", "q31_ndjson_commit_parse", "q37_status_histogram", "q44_lz4_roundtrip", "q45_pack_verify", "q47_reconstruct_verify", "q49_rate_windows",
]


def kernels() -> dict[str, float]:
    """Single-core rates of the byte-level kernels: MB/s, and roots of 1024 leaves a second."""
    data = os.urandom(8 << 20)
    parts = [data[i : i + 65536] for i in range(0, len(data), 65536)]
    leaves = [(bytes([i % 251]) * 32, 65536) for i in range(1024)]
    text = b"".join(b"line %d of a text that repeats itself\n" % (i % 977) for i in range(220_000))[: 8 << 20]
    block = compression.lz4_block(text)
    out = {}
    for name, f, amount in (("lz4_block_mb_s", lambda: compression.lz4_block(text), 8.0), ("lz4_unblock_mb_s", lambda: compression.lz4_unblock(block, len(text)), 8.0), ("chunking_mb_s", lambda: cdc.boundaries(data), 8.0), ("data_hash_mb_s", lambda: blake3.data_hash(parts), 8.0), ("merkle_roots_1024_s", lambda: merkle.root(leaves), 1.0)):
        f()
        began = time.perf_counter()
        f()
        out[name] = round(amount / (time.perf_counter() - began), 2)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "kernels": kernels()}))
    spark.stop()


if __name__ == "__main__":
    main()
