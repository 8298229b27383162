"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payloads of at least 1,000 bytes that occur more than once are stored once; the record with
the largest id is the response, the others are revisit records without a body that name it. Records go
out through Spark's text writer, whose line separator is the blank line that ends a record, so the
archives land wherever Spark can write.

Reading: tasks look for the magic at every byte of their file and emit each candidate with the offset
of its successor, which the candidate's own header implies, in one walk over the file. A payload may hold the magic too, so a candidate counts
only if the chain that starts at the file's first byte reaches it: pointer jumping doubles
all hops in each round, after which what is reached doubles too. Bodies are digested along the walk until it has digested AHEAD times the file's length, which
only payloads full of magic that claims long bodies exceed; of the candidates after that, the reached ones alone are digested by reading their files again. Revisits at last get the length and digest of the payload that they name.

Pages are written by classes of size (CLASSES), each with as many records to a file as make 16 MB of its largest pages; a larger page has a file of its own. So a file fits a task, and chains have a bounded number of hops.

Defined cases: a null or empty payload is a record with an empty body; rows with a null id are
records without an id; rows that repeat the largest id of a payload are all responses; a null address is left
out of the header, and line ends in it become blanks; an empty table gives an empty result; other columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, fresh_path, small_batches, written

MAGIC = b"WARC/1.1\r\n"
LEAST = 1_000
#: (bytes of a payload at most, records of a file at most); the last class has no bound.
CLASSES = ((1 << 14, 1_000), (1 << 18, 64), (1 << 22, 4), (None, 1))
AHEAD = 4
PLACES = "file string, at long, next long"
RECORD = "kind string, record_id string, refers string, body_bytes long, body_digest string, digest string"
FIELD = re.compile(rb"(?<=\n)([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def decided(df: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """df with its payload's length and digest, record_type and refers_to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    sized = df.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha1(body.cast("binary")))
    large = sized.where(F.col("payload_bytes") >= least).select("payload_digest", F.col(key).alias("_key"))
    groups = large.groupBy("payload_digest").agg(F.max("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first")
    spread = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat_ws("-", "payload_digest", F.col(key).cast("string")))
    joined = sized.withColumn("_spread", spread).join(groups, F.col("_spread") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return joined.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_spread", "_digest", "_first")


def write(df: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", least: int = LEAST) -> None:
    """Archives of df in a folder below path for each class of sizes that occurs, gzipped as a whole."""
    rows = decided(df, key, payload, least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col(key))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(F.col(url), "[\r\n]", " ")), F.lit("")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit("")))
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    inside = [F.lit(True) if most is None else size <= most for most, _ in CLASSES]
    place = F.coalesce(*(F.when(ok, F.lit(i)) for i, ok in enumerate(inside)))
    there = {r[0] for r in df.select(place.alias("c")).distinct().collect()} or {0}  # at most as many as there are classes
    for i in sorted(there):
        out = rows.where(place == i).select(F.concat(header, body).alias("value")).write
        out.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", CLASSES[i][1]).option("compression", "gzip").text(f"{path}/class{i}")


def fields_of(data: bytes, at: int, stop: int) -> Iterator[re.Match]:
    """The header fields of the record at a place, whose header ends at the blank line at stop."""
    return FIELD.finditer(data, at + len(MAGIC), stop + 2)


def candidates(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, offset of its successor) of every place of a file that reads like the start of a record.

    Places before the same blank line share it and the last length named ahead of it, so each byte of a header is read once.
    """
    at, stop, named, size = data.find(MAGIC), -1, -1, 0
    while at >= 0:
        if stop < at:
            stop, named = data.find(b"\r\n\r\n", at), -1
            if stop < 0:
                return
            for m in fields_of(data, at, stop):
                if m[1].lower() == b"content-length":
                    named, size = (m.start(), int(m[2])) if m[2].isdigit() and len(m[2]) < 19 else (-1, 0)
        if named >= at:
            yield at, stop + 8 + size
        at = data.find(MAGIC, at + 1)


def record(data: bytes, at: int) -> tuple:
    """kind, id, id referred to, length and digest of the body, and digest named, of the record at a candidate's place."""
    stop = data.find(b"\r\n\r\n", at)
    fields = {m[1].lower(): m[2] for m in fields_of(data, at, stop)}
    body = memoryview(data)[stop + 4 : stop + 4 + int(fields[b"content-length"])]
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    return text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), len(body), hashlib.sha1(body).hexdigest(), text(b"warc-payload-digest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all archives below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").transform(small_batches)


def _plain(content: pa.BinaryScalar) -> bytes:
    data = content.as_py()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])


def _found(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of all archives below path, as records where the walk could afford it (otherwise body_digest is null)."""
    later = (None,) * len(RECORD.split(", "))

    def walk(name: str, data: bytes) -> Iterator[tuple]:
        left = AHEAD * len(data)
        for at, after in candidates(data):
            left -= min(after, len(data)) - at
            yield (name, at, after, *(record(data, at) if left >= 0 else later))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch(list(walk(batch.column("path")[i].as_py(), _plain(batch.column("content")[i]))), f"{PLACES}, {RECORD}")

    return _files(spark, path).mapInArrow(look, f"{PLACES}, {RECORD}")


def _records(files: DataFrame, chain: DataFrame) -> DataFrame:
    """Records of the reached places of each archive, which meets its own places."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _plain(batch.column("content")[i])
                yield _batch([record(data, at) for at in batch.column("places")[i].as_py()], RECORD)

    places = chain.groupBy("file").agg(F.array_sort(F.collect_list("at")).alias("places"))  # a file has a bounded number of records
    return files.join(places, F.col("path") == F.col("file")).select("content", "places").mapInArrow(take, RECORD)


def reached(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from each file's first byte."""
    spark = found.sparkSession
    state = written(found.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("on")), "hops")
    hops = 1
    while True:
        there = state.select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("jump").alias("far"))
        marks = state.where("`on`").select(F.col("file").alias("mf"), F.col("jump").alias("ma"))  # jumps of reached records differ
        moved = state.join(there, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("a")), "left")
        moved = moved.join(marks, (F.col("file") == F.col("mf")) & (F.col("at") == F.col("ma")), "left")
        after = written(moved.select("file", "at", F.col("far").alias("jump"), (F.col("on") | F.col("ma").isNotNull()).alias("on")).groupBy("file", "at").agg(F.max("jump").alias("jump"), F.max("on").alias("on")), "hops")
        open_ends = after.where("jump is not null").limit(1).count()
        dropped(spark, state)
        state, hops = after, hops * 2
        if not open_ends:
            return state.where("`on`").select("file", "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives; length and digest are those of the full payload.
    A revisit of a page that these archives do not hold has a null length."""
    found = written(_found(spark, path), "candidates")
    chain = found.join(reached(found), ["file", "at"])
    rows, late = chain.where("body_digest is not null").drop("file", "at", "next"), chain.where("body_digest is null").select("file", "at")
    if found.where("body_digest is null").limit(1).count():
        rows = rows.unionByName(_records(_files(spark, path), late))
    rows = written(rows, "records")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as long)")
    rows = rows.select(number("record_id").alias("page_id"), number("refers").alias("refers_to"), F.col("kind").alias("record_type"), "body_bytes", "body_digest", F.regexp_replace("digest", "^sha1:", "").alias("digest"))
    own = rows.where("record_type <> 'revisit'").select("page_id", F.col("body_bytes").alias("payload_bytes"), F.col("body_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    bodies = own.groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = rows.where("record_type = 'revisit'").join(bodies, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return own.unionByName(again.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def round_trip(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Writes archives of df to the shared folder and reads them back."""
    path = fresh_path(df.sparkSession, "warc")
    write(df, path, key, payload, url)
    return read(df.sparkSession, path)
