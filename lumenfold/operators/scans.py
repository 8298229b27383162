"""Running sums, maxima and last values over the rows of a key that are spread over many tasks.

Rows are dealt by ranges of key and order, so the rows of one key fill as many chunks as they need. Each chunk is summed up in one row, these
rows are scanned, and every chunk starts from what the scan says of those before it. No task holds more than its range, however the keys are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.sources.storage import written

CHUNK = "_chunk"


def spread(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with the number of the range that holds each row, written once; ranges follow each other in order."""
    return written(df.repartitionByRange(*key, *order).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def running(rows: DataFrame, key: list[str], order: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """rows of spread() with a column for each wanted name=(kind, value), over the rows of the key up to this one in the order given.

    kind: sum (nulls count as nothing; 0 where there is none), max, last (the last value that is not null), or before (likewise, without the row itself).
    Rows that are equal in key and order are taken in any order.
    """
    values = rows.select("*", *(value.alias(f"_v_{name}") for name, (_, value) in wanted.items()))
    place = F.struct(*order)

    def summed(kind: str, c: str) -> Column:
        if kind == "sum":
            return F.sum(c)
        return F.max(c) if kind == "max" else F.max_by(c, F.when(F.col(c).isNotNull(), place))

    whole = values.groupBy(*key, CHUNK).agg(*(summed(kind, f"_v_{name}").alias(f"_c_{name}") for name, (kind, _) in wanted.items()))
    ahead = W.partitionBy(*key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    folded = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, True), "before": lambda c: F.last(c, True)}
    carry = whole.select(*key, CHUNK, *(folded[kind](f"_c_{name}").over(ahead).alias(f"_c_{name}") for name, (kind, _) in wanted.items()))
    here = W.partitionBy(*key, CHUNK).orderBy(*order)
    upto, until = here.rowsBetween(W.unboundedPreceding, 0), here.rowsBetween(W.unboundedPreceding, -1)

    def joined(name: str, kind: str) -> Column:
        local, held = folded[kind](f"_v_{name}").over(until if kind == "before" else upto), F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(held, F.lit(0))
        return F.greatest(local, held) if kind == "max" else F.coalesce(local, held)

    met = values.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(key)})
    side = carry.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(key)), F.col(CHUNK).alias("_s"), *(f"_c_{name}" for name in wanted))
    same = F.col(CHUNK) == F.col("_s")
    for i in range(len(key)):
        same &= F.col(f"_k{i}").eqNullSafe(F.col(f"_s{i}"))
    both = met.join(side, same)
    return both.select(*rows.columns, *(joined(name, kind).alias(name) for name, (kind, _) in wanted.items()))


def paced(df: DataFrame, key: list[str], time: str, item: str, interval: int) -> DataFrame:
    """df with `slot`: arrivals of a key (of all rows, if no key is given) spaced by at least the interval, none before its time. slot(i) = max over j <= i of arrival(j) + (i - j) * interval.

    The gate fails closed: an arrival without a time has no slot and takes none.
    """
    keys = key or ["_all"]
    named = df if key else df.withColumn("_all", F.lit(0))
    rows = running(spread(named.where(F.col(time).isNotNull()), keys, [time, item]), keys, [time, item], _n=("sum", F.lit(1).cast("long")))
    found = running(rows, keys, [time, item], slot=("max", F.col(time) - F.col("_n") * interval))
    given = found.withColumn("slot", F.col("slot") + F.col("_n") * interval).drop("_n", CHUNK)
    refused = named.where(F.col(time).isNull()).withColumn("slot", F.lit(None).cast("long"))
    return given.unionByName(refused).drop("_all")


def trailing(df: DataFrame, key: str, time: str, width: int, *values: str) -> DataFrame:
    """(key, time, first, and each value's sum) over the rows of the last `width` units of time, for a table of one row a key and time; first: the earliest time among them.

    A row's sum is the running sum at its time less that at a probe, width before it; as many rows as the probe has behind it, plus one, is the number of the first row in its window.
    """
    own = df.select(key, time, *values, F.lit(0).alias("_probe"), F.lit(1).cast("long").alias("_one"))
    back = df.select(key, (F.col(time) - width).alias(time), *(F.lit(0).cast(dict(df.dtypes)[v]).alias(v) for v in values), F.lit(1).alias("_probe"), F.lit(0).cast("long").alias("_one"))
    order = [time, "_probe"]
    rows = written(running(spread(own.unionByName(back), [key], order), [key], order, _n=("sum", F.col("_one")), **{f"_s_{v}": ("sum", F.col(v)) for v in values}), "running")
    rows_, probes = rows.where("_probe = 0"), rows.where("_probe = 1")
    begin = probes.select(key, (F.col(time) + width).alias(time), (F.col("_n") + 1).alias("_number"), *(F.col(f"_s_{v}").alias(f"_b_{v}") for v in values))
    number = rows_.select(key, F.col("_n").alias("_number"), F.col(time).alias("first"))
    met = rows_.join(begin, [key, time]).join(number, [key, "_number"])
    return met.select(key, time, "first", *((F.col(f"_s_{v}") - F.col(f"_b_{v}")).alias(v) for v in values))
