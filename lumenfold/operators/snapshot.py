"""Live snapshot of running batches and its roll-up for each scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNING = ("receiving", "queued", "running", "finalizing")


def eta(remaining: Column, rate: Column, seconds: Column) -> Column:
    """Seconds until nothing remains: by the rate, else as estimated from the time of an item; null where neither is known."""
    whole = lambda c: F.greatest(F.lit(1), F.ceil(c)).cast("long")
    return F.when(remaining == 0, F.lit(0).cast("long")).when(rate > 0, whole(remaining / F.when(rate > 0, rate))).when(seconds > 0, whole(seconds))


def batches(df: DataFrame) -> DataFrame:
    """Running batches with `shown` (their total, or what a receiving batch expects if that is more), remaining, progress and eta_s.

    df: status, expected, total, completed, avg_ms, rate beside columns that pass through. A finalizing batch has no eta.
    """
    run = df.where(F.col("status").isin(*RUNNING))
    shown = F.when((F.col("status") == "receiving") & F.col("expected").isNotNull(), F.greatest("total", "expected")).otherwise(F.col("total"))
    sized = run.withColumn("shown", shown).withColumn("remaining", F.greatest(F.lit(0), F.col("shown") - F.col("completed")))
    progress = F.when(F.col("shown") == 0, 0.0).otherwise(F.round(F.least(F.lit(100.0), F.col("completed") * 100.0 / F.col("shown")), 1))
    left = F.when(F.col("status") != "finalizing", eta(F.col("remaining"), F.col("rate"), F.col("remaining") * F.col("avg_ms") / 1000))
    return sized.withColumn("progress", progress).withColumn("eta_s", left)


def summary(shown: DataFrame, scope: str, rates: DataFrame) -> DataFrame:
    """One row of measures for each scope that has a running batch. shown: batches() with scope, succeeded, failed, skipped, active, faces; rates: scope, images_per_s, faces_per_s.

    The eta is null while any batch is finalizing; else 0 where nothing remains, by the scope's rate, or by the time of an item if that is known of every batch with something left.
    """
    some = F.col("remaining") > 0
    known = F.coalesce(F.col("avg_ms") > 0, F.lit(False))
    sums = [F.sum(c).alias(c) for c in ("completed", "succeeded", "failed", "skipped", "active", "faces")]
    rolled = shown.groupBy(scope).agg(
        F.count("*").alias("running_batches"), F.sum("shown").alias("total"), *sums, F.bool_or(F.col("status") == "finalizing").alias("_finalizing"),
        F.sum(F.when(some & known, F.col("remaining") * F.col("avg_ms") / 1000).otherwise(0.0)).alias("_seconds"), F.coalesce(F.bool_or(some & ~known), F.lit(False)).alias("_unknown"),
    )
    met = rolled.join(rates, scope, "left").fillna(0.0, ["images_per_s", "faces_per_s"]).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("completed")))
    left = F.when(~F.col("_finalizing"), eta(F.col("remaining"), F.col("images_per_s"), F.when(~F.col("_unknown"), F.col("_seconds"))))
    return met.withColumn("eta_s", left).drop("_finalizing", "_seconds", "_unknown")
