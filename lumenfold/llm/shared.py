"""Helpers of the corpus operators: word definition and batching, beside the library's storage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.storage import dropped, fresh_path, shared_dir, written

__all__ = ["WORD", "dropped", "fresh_path", "give_back", "rows_of", "shared_dir", "small_batches", "table", "word_count", "written"]

#: The separators of words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to Python: whole texts are long, and a task holds a batch or two on either side.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df itself; lowers the session's Arrow batches to BATCH_BYTES where they may be larger (one longer row is a batch of its own)."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def word_count(text: str | Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system; a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def rows_of(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts (null: empty), each of about so many bytes of text at most, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist() if batch.num_rows else []
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > chars:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(text).to_pylist()]
                start, held = i, 0
            held += n
        if sizes:
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
    give_back()
