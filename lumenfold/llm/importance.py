"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and pairs of words), one of target text and one of all
raw text, give each document a log ratio: how much likelier target-like writing is to produce it, on
average over its n-grams. Gumbel noise from a hash of the id is added to the ratio over TEMPER, and the
k documents with the largest sums are kept, which is sampling without replacement by importance weight.

The target model comes from a bounded sample of labelled rows: TARGETS ids at most, the smallest by a
hash. Raw counts cover every document. Both models are BUCKETS numbers of fixed size.

The k-th largest sum is found by counting: the sums are integers, and each pass counts
one more digit of those that still match the digits found, so only a digit's counts reach the driver.

Defined cases: null text, or text without a word, has ratio 0; very long texts are counted whole;
rows that repeat have equal sums and stand or fall together; all that tie with the k-th stay; without
labels the two models are equal and the noise decides; an empty table gives an empty table; columns
named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import rows_of, small_batches, written
from .words import U, hashed_words, mix

BUCKETS = 1 << 16
TARGETS = 20_000
KEEP = 0.85
TEMPER = 0.02
#: Sums are counted in millionths; a digit has 12 bits.
SCALE, DIGIT = 1_000_000, 12


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text of each."""
    word, first, upto = hashed_words(texts)
    owner = np.repeat(np.arange(len(texts)), upto - first)
    pair = mix(word[:-1] * U(0x9E3779B97F4A7C15) + word[1:]) if len(word) > 1 else np.zeros(0, np.uint64)
    inside = owner[:-1] == owner[1:]
    bucket = np.concatenate([word, pair[inside]]) & U(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def target_ids(labels: DataFrame, key: str, good: str, most: int = TARGETS) -> list:
    """Ids of the labelled rows that stand for the target, most of them at most."""
    rows = labels.where(good).where(F.col(key).isNotNull()).select(key, F.xxhash64(F.col(key), F.lit("target")).alias("_h")).distinct()
    return [r[0] for r in rows.orderBy("_h", key).limit(most).collect()]


def fit(df: DataFrame, targets: list, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of each bucket. Each task counts its rows into two arrays; these are summed by bucket."""
    wanted = df.sparkSession.sparkContext.broadcast(frozenset(targets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, texts in rows_of(batches, text):
            bucket, owner = grams(texts)
            chosen = np.array([i in wanted.value for i in part.column(key).to_pylist()])
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    rows = df.select(key, text).transform(small_batches).mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()  # BUCKETS rows at most
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for b, r, g in rows:
        raw[b] += r
        good[b] += g
    if len(rows) and good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def score(df: DataFrame, ratio: np.ndarray, text: str = "text", into: str = "log_ratio", drop_text: bool = False) -> DataFrame:
    """df with the mean log ratio of each text's n-grams."""
    held = df.sparkSession.sparkContext.broadcast(ratio)
    gone = {into.lower(), *([text.lower()] if drop_text else [])}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in keep]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches, text):
            bucket, owner = grams(texts)
            total = np.bincount(owner, held.value[bucket], len(texts))
            mean = total / np.maximum(1, np.bincount(owner, minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(mean)], [*names, into])

    return df.transform(small_batches).mapInArrow(rate, T.StructType([*keep, T.StructField(into, T.DoubleType())]))


def kth_largest(values: DataFrame, column: str, k: int, bits: int = 60) -> int | None:
    """The k-th largest of a long column with values of 0 to 2 ** bits."""
    if k < 1:
        return None
    found, shift = 0, bits
    while shift > 0:
        step = min(DIGIT, shift)
        shift -= step
        same = values.where(F.shiftright(column, shift + step) == found) if shift + step < 63 else values
        counts = same.groupBy(F.shiftright(column, shift).alias("digit")).count().orderBy(F.desc("digit")).collect()  # 2 ** DIGIT rows at most
        for digit, n in counts:
            found = digit
            if n >= k:
                break
            k -= n
    return found


def resample(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality = 1 and toxic = 0", keep: float = KEEP, seed: str = "gumbel") -> DataFrame:
    """(key, log_ratio, gumbel_key, kept) of each row of df."""
    docs = df.select(key, text)
    ratio = fit(docs, target_ids(labels, key, good), key, text)
    even = (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / F.lit(float(1 << 40))
    noise = -F.log(-F.log(even))
    rated = score(docs, ratio, text, drop_text=True).withColumn("gumbel_key", F.col("log_ratio") / TEMPER + noise)
    rated = written(rated.withColumn("_rank", ((F.greatest(F.least(F.col("gumbel_key"), F.lit(1e9)), F.lit(-1e9)) + F.lit(1e9)) * SCALE).cast("long")), "rated")
    least = kth_largest(rated, "_rank", int(np.ceil(keep * rated.count())))
    return rated.withColumn("kept", F.col("_rank") >= (least or 0)).drop("_rank")
