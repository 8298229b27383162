"""The tables of the photo-grouping domain, as projections of the tables at hand.

Each role is a lazy DataFrame; Catalyst prunes what a query does not read down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, time stamps without zone as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, name, plan."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("plan"))


def galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gallery_id, tenant_id, name, label, is_active."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gallery_id"), F.col("c_nationkey").alias("tenant_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), (F.col("c_acctbal") >= 0).alias("is_active"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, gallery_id, status, uploaded_at, size_bytes, filename."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").otherwise("failed")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("photo_id"), F.col("o_custkey").alias("gallery_id"), status.alias("status"), F.col("o_orderdate").alias("uploaded_at"), F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderpriority").alias("filename")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, cluster_id, face_index, quality, confidence, low_quality, version, created_at, part_key."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("cluster_id"), F.col("l_linenumber").alias("face_index"), (F.col("l_quantity") / 50).alias("quality"), (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_returnflag") == "R").alias("low_quality"), F.col("l_linestatus").alias("version"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("part_key"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, label, tenant_id."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("tenant_id"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, batch_id, status, processing_ms, ts: work items of batches."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "click", "processing").when(kind == "purchase", "succeeded").when(kind == "signup", "skipped").otherwise("failed")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("batch_id"), status.alias("status"), F.col("value").alias("processing_ms"), "ts")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, vec (array<double>), photo_id, quality, is_anchor, gallery: the faces of similarity queries."""
    quality = F.pmod(F.col("vec_id") * 37, F.lit(100)) / 100.0
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("vec_id") % 97).alias("photo_id"), quality.alias("quality"), (quality >= 0.58).alias("is_anchor"), F.col("label").alias("gallery")
    )
