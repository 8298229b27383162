"""Token files: ids of documents in Simple-8b words, written in order of the documents and read back.

A file holds, little-endian: MAGIC; the block size and the numbers of documents, ids, blocks and words; for each document
whether it has an id, its id, and its number of tokens; for each block the place of its first word, and the end; the words.
A document's ids are found from the tokens before it: block = place // block size, whose words decode alone.

Rows are dealt to tasks by ranges of the document id and sorted there, and only then encoded, so what is shuffled is
the text. A task rolls its files by bytes. Each file goes to a name of its own attempt first and is then renamed, so a task that
runs twice leaves the same file; the manifest, a table of the names that finished tasks returned, is what a reader trusts.
Where a document begins in the corpus comes from the manifest: totals of the tasks, then of a task's files.

Defined cases: a null or empty text has the end id alone; documents without an id come first; rows of one id are
ordered by their text's hash (a hot id is split over tasks), and repeat as they come; a document's tokens never cross files, so a very long one makes a large file; an empty table has no files
and gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simple8b
from .shared import fresh_path, give_back, rows_of, small_batches, written
from .word_tokens import words

MAGIC = b"S8BTOKENS1"
#: Ids of a block.
BLOCK = 1024
#: Bytes of words after which a file ends with its document.
FILE_BYTES = 16 << 20
#: Ids that are encoded or decoded at once.
CHUNK = 256 * BLOCK
MANIFEST = "task int, part int, name string, n_docs long, n_ids long"


class Writer:
    """Builds one file."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.parts: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_words = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """One document."""
        self.ids.append(key)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= CHUNK:
            self._pack(self.n_waiting // BLOCK * BLOCK)

    def _pack(self, upto: int) -> None:
        held = np.concatenate([np.zeros(0, np.uint64), *self.waiting])
        for i in range(0, upto, CHUNK):
            made, offsets = simple8b.encode(held[i : min(i + CHUNK, upto)], BLOCK)
            self.parts.append(made)
            self.offsets.append(offsets[:-1] + self.n_words)
            self.n_words += len(made)
        self.waiting, self.n_waiting = [held[upto:]], len(held) - upto

    def size(self) -> int:
        """Bytes of the words so far; three ids a word for those that wait."""
        return 8 * (self.n_words + self.n_waiting // 3)

    def finished(self) -> bytes:
        """The file."""
        self._pack(self.n_waiting)
        offsets = np.concatenate([np.zeros(0, np.int64), *self.offsets, [self.n_words]]).astype("<u8")
        head = np.array([BLOCK, len(self.ids), sum(self.counts), len(offsets) - 1, self.n_words], "<u8")
        known = np.array([i is not None for i in self.ids], np.uint8)
        keys = np.array([i or 0 for i in self.ids], "<i8")
        return b"".join([MAGIC, head.tobytes(), known.tobytes(), keys.tobytes(), np.array(self.counts, "<u8").tobytes(), offsets.tobytes(), *(p.astype("<u8").tobytes() for p in self.parts)])


class Reader:
    """One file's tables, and ids of any range of its tokens."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.block, n_docs, self.n_ids, n_blocks, n_words = take(5, "<u8").tolist()
        known, keys = take(n_docs, "u1"), take(n_docs, "<i8")
        self.ids = [k if on else None for k, on in zip(keys.tolist(), known.tolist(), strict=True)]
        self.counts = take(n_docs, "<u8").astype(np.int64)
        self.offsets = take(n_blocks + 1, "<u8").astype(np.int64)
        self.words = take(n_words, "<u8")

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids at start and after, from the blocks that hold them alone."""
        if not count:
            return np.zeros(0, np.uint64)
        first, last = start // self.block, (start + count - 1) // self.block
        found = simple8b.decode(self.words[self.offsets[first] : self.offsets[last + 1]])
        return found[start - first * self.block :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, start within the file, number of tokens, crc32 of the ids as little-endian unsigned 32-bit integers) of each document."""
        starts = np.cumsum(self.counts) - self.counts
        base = upto = 0
        held = np.zeros(0, "<u4")
        for key, start, count in zip(self.ids, starts.tolist(), self.counts.tolist(), strict=True):
            crc, at = 0, start
            while at < start + count:
                if at >= upto:
                    base, upto = at // self.block * self.block, min(at // self.block * self.block + CHUNK, self.n_ids)
                    held = self.tokens(base, upto - base).astype("<u4")
                stop = min(start + count, upto)
                crc, at = zlib.crc32(held[at - base : stop - base], crc), stop
            yield key, start, count, crc


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without names the cluster's default storage, which need not be the local disk."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(conf).makeQualified(found).toString()


def write(df: DataFrame, tokenizer: str, end_id: int, path: str, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """The manifest (task, part, name, n_docs, n_ids) of token files of df's texts below path, by a file of the tokenizers library on the driver.

    path: a URI that pyarrow's file systems open, in storage that all executors share. Files lie in order of (task, part).
    """
    with open(tokenizer, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, a few MB
    path = qualified(df.sparkSession, path)
    system, folder = pyarrow.fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = words(held.value), TaskContext.get().partitionId()
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        writer, part, end = Writer(), 0, np.array([end_id], np.uint64)

        def put() -> pa.RecordBatch:
            nonlocal writer, part
            name = f"tokens-{task:06d}-{part:06d}.s8b"
            own = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(own, compression=None) as f:
                f.write(writer.finished())
            try:
                system.move(own, f"{folder}/{name}")
            except OSError:  # another attempt of this task was first, and its file is the same
                if system.get_file_info(f"{folder}/{name}").type == pyarrow.fs.FileType.NotFound:
                    raise
                system.delete_file(own)
            row = [[task], [part], [name], [len(writer.ids)], [sum(writer.counts)]]
            writer, part = Writer(), part + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["task", "part", "name", "n_docs", "n_ids"])

        for batch, texts in rows_of(batches, "text"):
            for i, packed in zip(batch.column("key").to_pylist(), encoder.encode(texts), strict=True):
                writer.add(i, np.concatenate([np.frombuffer(packed, np.uint32).astype(np.uint64), end]))
                if writer.size() >= file_bytes:
                    yield put()
        if writer.ids:
            yield put()

    return written(dealt.transform(small_batches).select("key", "text").mapInArrow(run, MANIFEST), "manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files that the manifest names."""
    before = lambda of: F.sum("n").over(of.rowsBetween(W.unboundedPreceding, -1))
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(before(W.orderBy("task")), F.lit(0)).alias("of_task"))
    files = manifest.withColumnRenamed("n_ids", "n").withColumn("of_file", F.coalesce(before(W.partitionBy("task").orderBy("part")), F.lit(0)))
    begin = files.join(tasks, "task").select("name", (F.col("of_task") + F.col("of_file")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(Reader(batch.column("content")[i].as_buffer()).documents())
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("name")[i].as_py()] * len(rows), pa.string()), *columns], ["name", "key", "within", "n_tokens", "ids_crc32"])
        give_back()

    content = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.s8b").load(path)
    docs = content.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content").transform(small_batches).mapInArrow(run, "name string, key long, within long, n_tokens long, ids_crc32 long")
    return docs.join(begin, "name").select(F.col("key").alias(key), (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files of df to the shared folder and reads them back."""
    path = fresh_path(df.sparkSession, "tokens")
    manifest = write(df, tokenizer, end_id, path, key, text)
    return read(df.sparkSession, path, manifest, key)
