"""Mixing sources to target weights by systematic sampling. Only DataFrame and SQL functions.

Each source has a target; target over source size is the number of copies that is expected of each of
its documents. Within the source the documents are lined up, the expected copies are prefix-summed,
one random offset for the source is added, and a document is emitted once for each integer that its
stretch of the line crosses. The line goes by size class first (two leading digits of the word count),
so that every class gives its share and the words taken come close to the target, and by a hash of the
id within a class.

A source may hold a third of all rows, so no window spans a source. The line is cut at three levels:
size class, hash bucket, document. Buckets are summed before they are numbered; there are about
the square root of the rows of them for each class, so each window has few rows at any size. Sums are exact: copies are
counted in 2^-20, so the result depends neither on the order of additions nor on the partitioning.

Defined cases: null or empty text has size 0; a null source is a source of its own, the last one; a
source without words has target 0 and gives nothing; repeated rows are documents of their own, each
with its own stretch, and share out the copies in any order, as they cannot be told apart; an empty table gives an empty
table; columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import word_count, written

UNIT = 1 << 20
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "lumenfold"
#: Rows of a hash bucket at the square-root split.
BUCKET = 64


def targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target) of each source, from one row for each document.

    The sum of the targets is SHARE times all sizes; a source whose target would pass CAP times its
    size stops there and the rest shares by weight. In the order of cap over weight, the sources that
    stop are the first ones: the rule is checked for each of them with the sums before it. One row a
    source goes through this window, never one a document.
    """
    total = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    weighed = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * CAP)
    line = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    after = line.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    stops = weighed.withColumn("level", level).withColumn("stops", F.col("cap") < F.col("level") * F.col("weight"))
    free = F.max(F.when(~F.col("stops"), F.col("level"))).over(W.partitionBy())  # of those that do not stop, the first has the level
    target = F.when(F.col("stops") | free.isNull(), F.col("cap").cast("double")).otherwise(F.least(free * F.col("weight"), F.col("cap").cast("double")))
    return stops.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """Number of digits and the two leading ones."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")).cast("int")


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, UNIT)."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(UNIT))


def copies(df: DataFrame, expected: Column, key: str = "doc_id", source: str = "source", size: str = "size", tie: Column | None = None, slim: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """df with the number of copies of each row. expected: copies expected of a row, in units of 1 / UNIT (long).

    tie: what orders rows of one id and size that differ otherwise; rows alike in all of these get the same copies in any order.
    slim: the rows of df without their wide columns, over which the buckets are then summed.
    """
    slim = df if slim is None else slim
    many = max(1, round((slim.count() / BUCKET) ** 0.5))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("|"), F.col(size).cast("string")))  # rows without an id are spread by their size

    def cut(d: DataFrame) -> DataFrame:
        d = d.withColumn("_e", expected).withColumn("_class", size_class(F.col(size))).withColumn("_hash", F.md5(name))
        return d.withColumn("_bucket", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * many / F.lit(1 << 32)).cast("int")).withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))

    rows = cut(df).withColumn("_tie", F.lit(0) if tie is None else tie)
    each = ["_source", "_class", "_bucket"]
    buckets = cut(slim).groupBy(*each).agg(F.sum("_e").alias("_sum"))
    classes = buckets.groupBy("_source", "_class").agg(F.sum("_sum").alias("_class_sum"))

    def until(order: Column | str, by: list[str]) -> W:
        return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)

    classes = classes.withColumn("_before_class", F.coalesce(F.sum("_class_sum").over(until("_class", ["_source"])), F.lit(0))).drop("_class_sum")
    buckets = buckets.withColumn("_before_bucket", F.coalesce(F.sum("_sum").over(until("_bucket", ["_source", "_class"])), F.lit(0))).drop("_sum")
    start = buckets.join(classes, ["_source", "_class"]).select(*each, (F.col("_before_class") + F.col("_before_bucket")).alias("_start"))
    line = W.partitionBy(*each).orderBy("_hash", key, size, "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("_upto", F.sum("_e").over(line)).join(start, each)
    end = F.col("_start") + F.col("_upto") + offset(F.col(source), seed)
    crossed = F.expr(f"_end div {UNIT} - (_end - _e) div {UNIT}")
    return placed.withColumn("_end", end).withColumn("copies", crossed.cast("int")).drop("_e", "_class", "_hash", "_tie", "_bucket", "_source", "_upto", "_start", "_end")


def expected_copies() -> Column:
    """Expected copies of each row, from target and source_size."""
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("long")
    return F.least(rate, F.lit(CAP * UNIT))


def aimed(df: DataFrame, goal: DataFrame) -> DataFrame:
    """df with target and source_size of each row's source. goal: targets(), written, so that its size is known when the join is planned: it is broadcast below the session's threshold, and the rows then stay where they are."""
    named = goal.withColumnRenamed("source", "_goal")
    return df.join(named, F.col("source").eqNullSafe(F.col("_goal"))).drop("_goal")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each document."""
    sizes = written(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    return copies(aimed(sizes, written(targets(sizes), "targets")), expected_copies())
