"""Changes applied to a table of files: insert, compare-and-set, delete with cascade. Each returns the keys that it changed.

A table lies in buckets of its key's hash, each a partition. A change reads the buckets that hold its keys, writes them as they will be to the shared folder, and
then replaces just these partitions. The other buckets' files stay as they are, and so do all rows that no change names. A key is in one
bucket, so a change of a few keys costs their buckets. Deleted rows stay as marks, so a bucket is never empty and a repeated delete finds nothing.

Every change is idempotent: repeated after it was applied, it returns no keys and writes nothing. A job that dies while it replaces partitions is repeated as a whole: what was
already replaced is no change any more. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.storage import written

BUCKETS = 32
BUCKET, DELETED = "_bucket", "_deleted"


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A table of df's rows at path, one row a key."""
    dealt = df.withColumn(DELETED, F.lit(False)).withColumn(BUCKET, _bucket(key, buckets))
    dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows that are not deleted."""
    return spark.read.parquet(path).where(~F.col(DELETED)).drop(BUCKET, DELETED)


def _bucket(key: str, buckets: int):  # noqa: ANN202
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _replaced(spark: SparkSession, path: str, key: str, changed: DataFrame, buckets: int) -> DataFrame:
    """Put changed (whole rows, marks included) in place of the rows with their keys; the keys."""
    rows = written(changed.withColumn(BUCKET, _bucket(key, buckets)), "changed")
    touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most the number of buckets
    if touched:
        kept = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).join(rows.select(key), key, "left_anti")
        after = written(kept.unionByName(rows), "buckets")
        after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return rows.select(key)


def insert(spark: SparkSession, path: str, key: str, rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add rows whose key the table has never had; of several rows with a new key, the smallest."""
    names = [c for c in spark.read.parquet(path).columns if c not in (BUCKET, DELETED)]
    one = rows.groupBy(key).agg(F.min(F.struct(*(c for c in names if c != key))).alias("x")).select(key, "x.*").select(*names)
    fresh = one.join(spark.read.parquet(path).select(key), key, "left_anti").withColumn(DELETED, F.lit(False))
    return _replaced(spark, path, key, fresh, buckets)


def compare_and_set(spark: SparkSession, path: str, key: str, version: str, changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Apply changes (key, version, new values) to the rows that still have that version, which goes up by one; of several changes of a row, the smallest wins, the others find it changed."""
    now = spark.read.parquet(path)
    names = [c for c in changes.columns if c not in (key, version)]
    one = changes.groupBy(key, version).agg(F.min(F.struct(*(F.col(c).alias(f"_new_{c}") for c in names))).alias("_x")).select(key, version, "_x.*")
    met = now.where(~F.col(DELETED)).join(one, [key, version])
    new = {c: F.col(f"_new_{c}") for c in names} | {version: F.col(version) + 1}
    return _replaced(spark, path, key, met.select(*(new.get(c, F.col(c)).alias(c) for c in now.columns if c != BUCKET)), buckets)


def delete_cascade(spark: SparkSession, path: str, key: str, parent: str, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Delete the rows of keys and all rows below them by `parent`, level by level; erased means that nothing but key and parent is left of a row."""
    now = spark.read.parquet(path).where(~F.col(DELETED))
    links = now.select(key, parent)
    level = written(now.select(key).join(keys.select(key).distinct(), key, "left_semi"), "level")
    gone = level
    while level.limit(1).count():
        below = links.join(level.select(F.col(key).alias(parent)), parent, "left_semi").select(key).join(gone, key, "left_anti")  # a cycle ends
        level = written(below, "level")
        gone = gone.unionByName(level)
    rows = now.join(gone, key, "left_semi")
    erased = [F.lit(True).alias(c) if c == DELETED else F.col(c) if c in (key, parent) else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != BUCKET]
    return _replaced(spark, path, key, rows.select(*erased), buckets)
