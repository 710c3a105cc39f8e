"""What the operators share: tables, the shared folder, written intermediates, and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.registry import table  # noqa: F401  the operators take it from here
from cairn.scratch import path as scratch  # noqa: F401
from cairn.scratch import remove, written  # noqa: F401

#: White space between words, by the contracts: space and U+0009 to U+000D. bytes.split() without arguments splits at just these.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 500


def unlike(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until none is among names (in any case, as Spark compares them)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_PER_BATCH rows: texts are long, and a Python worker holds one batch at a time.

    Spark reads this setting when a query runs, so it stays in the session; it is only ever lowered, to one value.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def trim() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and what the last one freed would else stay theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back at the task's end."""

    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return trimming


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def gathered(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Batches joined, in order, until their column holds most_bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, kernel: Callable[[list[str]], dict[str, object]]) -> DataFrame:
    """keep, and the columns that kernel makes of the texts; schema is that of all these.

    Only the columns asked for are read, so extra columns of the input, whatever their names, cost nothing.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields][len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel(texts(batch.column(len(keep))))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(made[n]) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(trimmed(run), schema)
