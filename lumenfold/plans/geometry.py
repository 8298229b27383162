"""Boxes, tiles, scores and the selfie gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.geometry import iou, quality, suppressed, tiles
from lumenfold.plans.registry import query
from lumenfold.sources.roles import read

B = """b AS (SELECT l_orderkey AS image_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice))::INT AS idx, (l_partkey % 60)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1,
  l_partkey % 60 + 40 + l_quantity AS x2, l_suppkey % 40 + 40.0::DOUBLE + l_linenumber * 10 AS y2, 1 - l_discount AS score FROM lineitem)"""
IOU = """CASE WHEN (greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1) + greatest(0, c.x2 - c.x1) * greatest(0, c.y2 - c.y1) - greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))) > 0
  THEN greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) / (greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1) + greatest(0, c.x2 - c.x1) * greatest(0, c.y2 - c.y1)
    - greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))) ELSE 0 END"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, idx, x1, y1, x2, y2, score: a box for each line of an order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.row_number().over(order).alias("idx"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 40 + F.col("l_quantity")).cast("double").alias("x2"), (y + F.lit(40.0) + F.col("l_linenumber") * 10).alias("y2"), (1 - F.col("l_discount")).alias("score"),
    )


@query(f"WITH {B} SELECT a.image_id, a.idx AS a, c.idx AS b, round({IOU}, 9) AS iou FROM b a JOIN b c ON a.image_id = c.image_id AND a.idx < c.idx")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each two boxes of an image."""
    b = boxes(spark, sf_dir)
    one = b.select("image_id", F.col("idx").alias("a"), F.struct("x1", "y1", "x2", "y2").alias("p"))
    two = b.select("image_id", F.col("idx").alias("b"), F.struct("x1", "y1", "x2", "y2").alias("q"))
    return one.join(two, "image_id").where("a < b").select("image_id", "a", "b", F.round(iou(F.col("p"), F.col("q")), 9).alias("iou"))


@query(f"""WITH RECURSIVE {B}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, idx) AS i FROM b),
r AS (SELECT image_id, 1::BIGINT AS i, [{{'idx': idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM o WHERE i = 1
UNION ALL SELECT o.image_id, o.i, CASE WHEN len(list_filter(kept, lambda c: ({IOU.replace('a.', 'o.')}) >= 0.4)) > 0 THEN kept ELSE list_append(kept, {{'idx': o.idx, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END FROM r JOIN o ON o.image_id = r.image_id AND o.i = r.i + 1)
SELECT image_id, unnest(kept).idx AS idx FROM (SELECT image_id, arg_max(kept, i) AS kept FROM r GROUP BY 1)""")
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each image that greedy suppression keeps: a fold over the image's sorted boxes."""
    kept = boxes(spark, sf_dir).groupBy("image_id").agg(F.collect_list(F.struct("score", "idx", "x1", "y1", "x2", "y2")).alias("boxes"))
    return kept.select("image_id", F.explode(F.transform(suppressed(F.col("boxes"), 0.4), lambda x: x["idx"])).alias("idx"))


@query("""WITH i AS (SELECT p_partkey AS image_id, (p_size * 60)::INT AS width, (1200 + p_partkey % 800)::INT AS height FROM part), v AS (SELECT *, ceil(width * 0.56::DOUBLE)::INT AS w, ceil(height * 0.56::DOUBLE)::INT AS h FROM i),
t AS (SELECT image_id, width, height, w, h, unnest(CASE WHEN greatest(width, height) >= 1600 THEN [0, 1, 2, 3, 4] ELSE [0] END) AS view FROM v)
SELECT image_id, view::INT AS view, CASE WHEN view IN (2, 4) THEN width - w ELSE 0 END AS "left", CASE WHEN view IN (3, 4) THEN height - h ELSE 0 END AS top, CASE WHEN view IN (0, 2, 4) THEN width ELSE w END AS "right", CASE WHEN view IN (0, 3, 4) THEN height ELSE h END AS bottom FROM t""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views in which each image is searched."""
    i = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 60).cast("int").alias("width"), (1200 + F.col("p_partkey") % 800).cast("int").alias("height"))
    return i.select("image_id", F.posexplode(tiles(F.col("width"), F.col("height"))).alias("view", "t")).select("image_id", "view", "t.left", "t.top", "t.right", "t.bottom")


Q = """q AS (SELECT image_id, idx, score AS conf, least(1, least(x2 - x1, y2 - y1) / 112) AS size, (idx * 13 % 10) / 10.0::DOUBLE AS sharp, 1 - abs(image_id % 256 - 127.5) / 127.5 AS expo, 1 - (idx * 7 % 9) / 10.0::DOUBLE AS pose, least(x2 - x1, y2 - y1) AS px FROM b),
s AS (SELECT *, sqrt(conf * size) * (0.70 + 0.20 * sharp + 0.10 * expo) * (0.80 + 0.20 * pose) AS raw, conf >= 0.60 AND px >= 24 AS usable, conf >= 0.95 AND px >= 60 AND pose >= 0.5 AS anchor FROM q)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with their score and gates; a face that cannot be an anchor stays just under the anchor's score."""
    b = boxes(spark, sf_dir)
    px = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rows = b.select("image_id", "idx", F.col("score").alias("conf"), px.alias("px"), F.least(F.lit(1.0), px / 112).alias("size"), (F.col("idx") * 13 % 10 / 10.0).alias("sharp"), (1 - F.abs(F.col("image_id") % 256 - 127.5) / 127.5).alias("expo"), (1 - F.col("idx") * 7 % 9 / 10.0).alias("pose"))
    raw = quality(*(F.col(c) for c in ("conf", "size", "sharp", "expo", "pose")))
    usable, anchor = (F.col("conf") >= 0.60) & (F.col("px") >= 24), (F.col("conf") >= 0.95) & (F.col("px") >= 60) & (F.col("pose") >= 0.5)
    return rows.withColumn("usable", usable).withColumn("anchor", anchor).withColumn("quality", F.when(anchor, raw).otherwise(F.least(raw, F.lit(0.58 - 1e-3))))


@query(f"WITH {B}, {Q} SELECT image_id, idx, usable, anchor, round(CASE WHEN anchor THEN raw ELSE least(raw, 0.579) END, 9) AS quality FROM s")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each face."""
    return scored(spark, sf_dir).select("image_id", "idx", "usable", "anchor", F.round("quality", 9).alias("quality"))


@query(f"""WITH {B}, g AS (SELECT image_id, idx, score AS q, round((x2 - x1) * (y2 - y1), 6) AS area, idx % 3 = 0 AS low FROM b), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY low, q DESC, area DESC, idx) AS rn FROM g),
f AS (SELECT image_id, low, idx, greatest(1, area) AS area, q FROM t WHERE rn = 1)
SELECT image_id, CASE WHEN low THEN 'low_quality' WHEN EXISTS (SELECT 1 FROM g WHERE g.image_id = f.image_id AND g.idx <> f.idx AND NOT g.low AND g.area >= 0.4 * f.area AND g.q >= 0.7 * f.q) THEN 'ambiguous' ELSE 'ok' END AS outcome, CASE WHEN low THEN 0 ELSE idx END AS best FROM f""")
def selfie_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a selfie shows one face to search for."""
    area = F.round((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), 6)
    g = boxes(spark, sf_dir).select("image_id", F.struct((F.col("idx") % 3 == 0).alias("low"), (-F.col("score")).alias("nq"), (-area).alias("na"), "idx").alias("f"))
    per = g.groupBy("image_id").agg(F.array_sort(F.collect_list("f")).alias("faces")).withColumn("top", F.col("faces")[0])
    rival = F.exists("faces", lambda x: (x["idx"] != F.col("top.idx")) & ~x["low"] & (-x["na"] >= 0.4 * F.greatest(F.lit(1.0), -F.col("top.na"))) & (-x["nq"] >= 0.7 * -F.col("top.nq")))
    outcome = F.when(F.col("top.low"), "low_quality").when(rival, "ambiguous").otherwise("ok")
    return per.select("image_id", outcome.alias("outcome"), F.when(F.col("top.low"), 0).otherwise(F.col("top.idx")).alias("best"))


@query(f"""WITH {B}, s AS (SELECT image_id, idx, 1920.0::DOUBLE / greatest(1920, 800 + image_id % 4000) AS scale, x1, y1, x2, y2, score FROM b)
SELECT image_id, idx, greatest(0, floor(x1 / scale))::INT AS left_px, least(4000, ceil(x2 / scale))::INT AS right_px, round(greatest(0, y1 - 0.25 * (y2 - y1)), 6) AS crop_top, round(score * (0.65 + 0.35 * least(1, least(x2 - x1, y2 - y1) / 112)), 9) AS rank_score FROM s""")
def projected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a resized view in the image's own pixels, crop edge and rank score."""
    scale = 1920.0 / F.greatest(F.lit(1920), 800 + F.col("image_id") % 4000)
    b = boxes(spark, sf_dir)
    side = F.least(F.lit(1.0), F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 112)
    return b.select(
        "image_id", "idx", F.greatest(F.lit(0), F.floor(F.col("x1") / scale)).cast("int").alias("left_px"), F.least(F.lit(4000), F.ceil(F.col("x2") / scale)).cast("int").alias("right_px"),
        F.round(F.greatest(F.lit(0.0), F.col("y1") - 0.25 * (F.col("y2") - F.col("y1"))), 6).alias("crop_top"), F.round(F.col("score") * (0.65 + 0.35 * side), 9).alias("rank_score"),
    )
