"""Removal of long byte strings that occur more than once.

Every byte that lies in a string of LENGTH bytes which also starts anywhere else goes, in all places.

The index is a logarithmic family of sparse suffix arrays. A window is LENGTH bytes; its anchor is the
GRAM bytes inside it with the smallest hash, the leftmost of equals. Equal windows have equal anchors
at equal places, so only the suffixes that start at anchors are indexed, about one for each 150 bytes of
text; the consecutive windows of one anchor make its range. An array orders its suffixes by
fingerprints, of the anchor and then of the range, as only equality counts here, and keeps a number for each.
Documents come in BATCHES; each batch gets its array, and arrays of equal size merge, so level k holds
2 ** k batches or nothing. One merge-scan over the levels that remain sorts the ranges into three kinds: the
anchor is found once (nothing repeats), the whole range is found again (all of it repeats), or it
differs from the others of its anchor somewhere (the ends of copied passages). The scan comes after the
last batch, because a later batch can make a string of an earlier one repeat.

The last kind is compared window by window with the different ranges of its anchor, by sorting the
hashes of the windows. Where an anchor has more different ranges than one task should hold, its windows
are first cut by their distance to the anchor until they repeat as a whole, are alone, or are few. So
counting does nearly all the work, frequent passages are summed before they are shuffled, and no task
ever holds an unbounded group.

Defined cases: null text is empty; documents under LENGTH bytes keep everything; very long texts are
taken in overlapping segments; rows that repeat count as places of their own; matches never cross
documents; an empty table gives an empty table; a null id is an id like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, rows_of, small_batches, written

LENGTH = 400
GRAM = 100
#: Batches of documents that enter the index one after the other.
BATCHES = 4
#: Different ranges of an anchor that one task compares, of 2 * LENGTH bytes at most each.
FEW = 8_192
SEGMENT = 1 << 21
#: Parts into which the windows of a crowded anchor are cut at a time.
SPLIT = 8
U = np.uint64
_P, _P_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xDABA0B6EB09322E3)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.multiply.accumulate(power, out=power))
    return out[0], out[1]


_cached_powers = lru_cache(8)(_powers)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values."""
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    many = len(x) - width + 1
    return np.minimum(after[:many], before[width - 1 : width - 1 + many])


def ranges(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash of the anchor, hash of all bytes of the range) of each range."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    power, back = _powers(n + 1)
    total = np.concatenate([[U(0)], np.cumsum((data.astype(np.uint64) + U(1)) * power[:-1])])

    def hashed(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))

    place = np.arange(n - gram + 1)
    grams = _mix((total[gram:] - total[: n - gram + 1]) * back[: n - gram + 1])
    bits = U((1 << 22) - 1)
    least = _sliding_least((grams & ~bits) | place.astype(np.uint64), length - gram + 1)
    anchor = (least & bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    at = anchor[first]
    return first, last, at, grams[at].view(np.int64), hashed(first, last + length).view(np.int64)


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, uid, text): uid is the same for rows with the same id and text."""
    return df.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("uid"), F.col(text).alias("text"))


def _all_ranges(docs: DataFrame, length: int, gram: int) -> DataFrame:
    kinds = [("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()), ("g", pa.int64()), ("r", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches, "text", 4 << 20):
            found: list[tuple[np.ndarray, ...]] = []
            for uid, t in zip(part.column("uid").to_pylist(), texts, strict=True):
                data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                for s in range(0, max(0, len(data) - length + 1), SEGMENT):
                    lo, hi, at, g, r = ranges(data[s : s + SEGMENT + length - 1], length, gram)
                    found.append((np.full(len(lo), uid), lo + s, hi + s, at + s, g, r))
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    return docs.select("uid", "text").transform(small_batches).mapInArrow(run, "uid long, lo int, hi int, anchor int, g long, r long")


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (uid, lo, hi, anchor, g, w, m) with the bytes of each range."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "anchor", "g", "w", "m")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches, "text"):
            rows: list[tuple] = []
            for uid, places, t in zip(part.column("uid").to_pylist(), part.column("places").to_pylist(), texts, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                rows += [(uid, p["lo"], p["hi"], p["anchor"], p["g"], p["w"], p["m"], raw[p["lo"] : p["hi"] + length]) for p in places]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "lo", "hi", "anchor", "g", "w", "m", "content"])

    return docs.select("uid", "text").join(lists, "uid").transform(small_batches).mapInArrow(cut, "uid long, lo int, hi int, anchor int, g long, w int, m long, content binary")


def _windows(content: bytes, length: int) -> np.ndarray:
    """Hash of each window of the content."""
    data = np.frombuffer(content, np.uint8)
    power, back = _cached_powers(1 << len(data).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * power[: len(data)], out=total[1:])
    return _mix((total[length:] - total[:-length]) * back[: len(data) - length + 1])


def compare(rows: list[tuple], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(uid, first, last) of the windows of each open row (w = 1) that another row of its anchor has too.

    rows: (g, uid, lo, hi, anchor, w, content), with different contents or places.
    """
    hashes = [_windows(r[6], length) for r in rows]
    _, name, many = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    edge = np.zeros(1, bool)
    end = 0
    for (_, uid, lo, _, _, w, _), own in zip(rows, hashes, strict=True):
        begin, end = end, end + len(own)
        if w > 1:
            continue
        turn = np.flatnonzero(np.diff(np.concatenate([edge, many[name[begin:end]] > 1, edge])))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            yield uid, lo + a, lo + b - 1


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows (uid, lo, hi) of the open rows of each group g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(held) > 1:
                out.extend(compare(held, length))
            held.clear()

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["uid", "lo", "hi"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "uid", "lo", "hi", "anchor", "w", "content")), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            yield emit()
        close()
        yield emit()

    return rows.select("g", "uid", "lo", "hi", "anchor", "w", "content").repartition("g").sortWithinPartitions("g", "uid", "lo").transform(small_batches).mapInArrow(run, "uid long, lo int, hi int")


class Levels:
    """Arrays (g, r, c) of suffixes: c is the number of places of content r at anchor g. Level k holds 2 ** k batches or nothing."""

    def __init__(self) -> None:
        self.held: list[DataFrame | None] = []

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch (g, r); as long as its level is taken, the two arrays become one of the next level."""
        array = written(self._merged(suffixes.select("g", "r", F.lit(1).cast("long").alias("c"))), "array")
        level = 0
        while level < len(self.held) and self.held[level] is not None:
            parts = [self.held[level], array]
            array = written(self._merged(parts[0].unionByName(parts[1])), "array")
            for p in parts:
                dropped(array.sparkSession, p)
            self.held[level] = None
            level += 1
        self.held += [None] * (level + 1 - len(self.held))
        self.held[level] = array

    @staticmethod
    def _merged(arrays: DataFrame) -> DataFrame:
        return arrays.groupBy("g", "r").agg(F.sum("c").alias("c")).sortWithinPartitions("g", "r")

    def scanned(self) -> DataFrame:
        """(g, r, c, m, least) of each content that is not alone at its anchor: m is the number of the anchor's contents, least the smallest number of places."""
        there = [x for x in self.held if x is not None]
        each = there[0]
        for x in there[1:]:
            each = each.unionByName(x)
        return _grouped(each.groupBy("g", "r").agg(F.sum("c").alias("c")) if len(there) > 1 else each)


def _grouped(each: DataFrame) -> DataFrame:
    """each (g, r, c, ...) with m and least of its group g, without groups of one place."""
    group = each.groupBy("g").agg(F.sum("c").alias("_n"), F.count("*").alias("m"), F.min("c").alias("least")).where("_n > 1").drop("_n")
    return each.join(group, "g")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, few: int = FEW, batches: int = BATCHES) -> DataFrame:
    """(uid, lo, hi): windows lo to hi of the document start at places where a repeated string starts. docs: (uid, text)."""
    spark = docs.sparkSession
    found = written(_all_ranges(docs, length, gram), "ranges")
    levels = Levels()
    for b in range(batches):
        levels.add(found.where(F.pmod("uid", F.lit(batches)) == b))
    kinds = written(levels.scanned(), "kinds")
    placed = written(found.join(kinds, ["g", "r"]), "placed")
    dropped(spark, found)
    whole = placed.where("c > 1").select("uid", "lo", "hi")
    mixed = placed.where("m > 1 and least = 1")
    alone = mixed.where("c = 1").select("uid", "lo", "hi", "anchor", "g", "m", F.lit(1).alias("w"))
    first = mixed.where("c > 1").groupBy("g", "r", "m").agg(F.min(F.struct("uid", "lo", "hi", "anchor")).alias("x")).select("x.*", "g", "m", F.lit(2).alias("w"))
    rows = written(_contents(docs, alone.unionByName(first), length), "contents")
    parts, width = [whole], 1 << (length - gram).bit_length()
    while width > 1:
        parts.append(_compared(rows.where(F.col("m") <= few), length))
        large = rows.where(F.col("m") > few)
        if not large.limit(1).count():
            break
        width = max(1, width // SPLIT)
        # distance of a window to the anchor: anchor - window, cut into stretches of `width`
        near, far = F.col("anchor") - F.col("hi"), F.col("anchor") - F.col("lo")
        cut = large.withColumn("_i", F.explode(F.sequence(F.floor(near / width), F.floor(far / width))))
        lo = F.greatest(F.col("lo"), (F.col("anchor") - (F.col("_i") + 1) * width + 1).cast("int"))
        hi = F.least(F.col("hi"), (F.col("anchor") - F.col("_i") * width).cast("int"))
        cut = cut.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("content", F.substring("content", F.col("_lo") - F.col("lo") + 1, F.col("_hi") - F.col("_lo") + length))
        cut = written(cut.select("uid", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "anchor", F.xxhash64("g", F.lit(width), "_i").alias("g"), "w", "content", F.md5("content").alias("r")), "cut")
        each = cut.groupBy("g", "r").agg(F.sum("w").alias("c"), F.min(F.struct("uid", "lo")).alias("x"))
        level = written(cut.join(_grouped(each), ["g", "r"]), "level")
        dropped(spark, cut)
        parts.append(level.where("c > 1 and w = 1").select("uid", "lo", "hi"))
        one = (F.col("uid") == F.col("x.uid")) & (F.col("lo") == F.col("x.lo"))
        rows = level.where("m > 1 and least = 1").where(one).select("uid", "lo", "hi", "anchor", "g", F.least(F.col("c"), F.lit(2)).cast("int").alias("w"), "m", "content")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, few: int = FEW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row: kept is what remains of its bytes, null where nothing was removed and the text stands."""
    docs = _identified(df, key, text)
    windows = written(repeated(docs, length, gram, few), "windows")
    lists = windows.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))
    whole = docs.join(lists, "uid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches, "text"):
            sizes, gone, spans, kept, sums = [], [], [], [], []
            for places, t in zip(part.column("windows").to_pylist(), texts, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                pieces, at, begin, count, out = [], 0, None, 0, 0
                for lo, hi in sorted((p["lo"], p["hi"] + length) for p in places or ()):
                    if begin is None or lo > at:
                        if begin is not None:
                            count, out = count + 1, out + at - begin
                        pieces.append(raw[at:lo])
                        begin, at = lo, hi
                    else:
                        at = max(at, hi)
                if begin is not None:
                    count, out = count + 1, out + at - begin
                pieces.append(raw[at:])
                rest = b"".join(pieces)
                sizes.append(len(raw))
                gone.append(out)
                spans.append(count)
                kept.append(rest if count else None)
                sums.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(kept, pa.binary()), pa.array(sums)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return whole.select("id", "windows", "text").transform(small_batches).mapInArrow(cut, f"doc_id {dict(docs.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
