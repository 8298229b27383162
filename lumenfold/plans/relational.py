"""Dashboards, listings, top-k windows, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.plans.registry import query
from lumenfold.sources.roles import clusters, detections, galleries, items, photos, read, tenants

#: "Now" of all queries over time.
AS_OF = "2024-01-31 00:00:00"
TERMINAL = ("succeeded", "failed", "skipped", "cancelled")


def now() -> Column:
    """AS_OF as a literal."""
    return F.expr(f"timestamp_ntz'{AS_OF}'")


@query("""SELECT (SELECT count(*) FROM tenants)::BIGINT AS tenants, (SELECT count(*) FROM galleries WHERE is_active)::BIGINT AS active_galleries, (SELECT count(*) FROM photos)::BIGINT AS photos,
  (SELECT count(*) FROM photos WHERE status = 'done')::BIGINT AS done_photos, (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM photos) AS storage_bytes""", "tenants galleries photos")
def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform counters: three one-row aggregates side by side."""
    t = tenants(spark, sf_dir).agg(F.count("*").alias("tenants"))
    g = galleries(spark, sf_dir).agg(F.count_if("is_active").alias("active_galleries"))
    p = photos(spark, sf_dir).agg(F.count("*").alias("photos"), F.count_if(F.col("status") == "done").alias("done_photos"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("storage_bytes"))
    one = F.lit(1).alias("one")
    return t.select("*", one).join(g.select("*", one), "one").join(p.select("*", one), "one").drop("one")


@query("""SELECT g.gallery_id, g.name, g.label, coalesce(c.total, 0)::BIGINT AS total, coalesce(c.done, 0)::BIGINT AS done, coalesce(c.queued, 0)::BIGINT AS queued, coalesce(c.processing, 0)::BIGINT AS processing, coalesce(c.failed, 0)::BIGINT AS failed
FROM galleries g LEFT JOIN (SELECT gallery_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'failed') AS failed FROM photos GROUP BY 1) c USING (gallery_id) WHERE g.is_active""", "galleries photos")
def gallery_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of each active gallery by status; all five counts in one scan."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = photos(spark, sf_dir).groupBy("gallery_id").agg(F.count("*").alias("total"), of("done"), of("queued"), of("processing"), of("failed"))
    rows = galleries(spark, sf_dir).where("is_active").join(counts, "gallery_id", "left")
    return rows.select("gallery_id", "name", "label", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "done", "queued", "processing", "failed")))


@query("""SELECT t.tenant_id, t.name, t.plan, coalesce(g.n, 0)::BIGINT AS galleries, coalesce(p.n, 0)::BIGINT AS photos, round(coalesce(p.bytes, 0) / 1073741824.0::DOUBLE, 6) AS storage_gb FROM tenants t
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM galleries GROUP BY 1) g USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM photos JOIN galleries USING (gallery_id) GROUP BY 1) p USING (tenant_id)""", "tenants galleries photos")
def tenant_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants with their galleries, photos and storage: photos are summed by gallery before they meet the galleries, so one row a gallery is joined."""
    g = galleries(spark, sf_dir)
    per_gallery = g.groupBy("tenant_id").agg(F.count("*").alias("galleries"))
    held = photos(spark, sf_dir).groupBy("gallery_id").agg(F.count("*").alias("photos"), F.sum("size_bytes").alias("bytes"))
    per_photo = held.join(g, "gallery_id").groupBy("tenant_id").agg(F.sum("photos").alias("photos"), F.sum("bytes").alias("bytes"))
    rows = tenants(spark, sf_dir).join(per_gallery, "tenant_id", "left").join(per_photo, "tenant_id", "left")
    return rows.select("tenant_id", "name", "plan", F.coalesce("galleries", F.lit(0)).alias("galleries"), F.coalesce("photos", F.lit(0)).alias("photos"), F.round(F.coalesce("bytes", F.lit(0)) / 1073741824.0, 6).alias("storage_gb"))


@query("""SELECT tenant_id, count(DISTINCT gallery_id)::BIGINT AS galleries, count(photo_id)::BIGINT AS photos, (count(*) FILTER (status = 'done'))::BIGINT AS done FROM galleries LEFT JOIN photos USING (gallery_id) GROUP BY 1""", "galleries photos")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a tenant's dashboard, from one row of counts a gallery."""
    held = photos(spark, sf_dir).groupBy("gallery_id").agg(F.count("photo_id").alias("photos"), F.count_if(F.col("status") == "done").alias("done"))
    rows = galleries(spark, sf_dir).join(held, "gallery_id", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.groupBy("tenant_id").agg(F.count_distinct("gallery_id").alias("galleries"), total("photos"), total("done"))


@query("SELECT cluster_id, count(DISTINCT photo_id)::BIGINT AS photos, count(*)::BIGINT AS faces FROM detections GROUP BY 1", "detections")
def cluster_photo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct photos and faces of each cluster."""
    return detections(spark, sf_dir).groupBy("cluster_id").agg(F.count_distinct("photo_id").alias("photos"), F.count("*").alias("faces"))


@query("SELECT gallery_id, count(*)::BIGINT AS legacy_faces FROM detections JOIN photos USING (photo_id) WHERE version <> 'F' GROUP BY 1", "detections photos")
def legacy_face_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of another pipeline version than the current one, by gallery."""
    return detections(spark, sf_dir).where(F.col("version") != "F").join(photos(spark, sf_dir), "photo_id").groupBy("gallery_id").agg(F.count("*").alias("legacy_faces"))


@query("""SELECT batch_id, (count(*) FILTER (status = 'processing'))::BIGINT AS active_items, round(avg(CASE WHEN status = 'succeeded' THEN processing_ms END), 6) AS avg_ms, count(*)::BIGINT AS items,
  ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS elapsed_ms FROM items GROUP BY 1""", "items")
def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active items, mean processing time of the succeeded ones and elapsed time of each batch."""
    ms = F.when(F.col("status") == "succeeded", F.col("processing_ms"))
    elapsed = F.timestamp_diff("MILLISECOND", F.min("ts"), F.max("ts"))
    return items(spark, sf_dir).groupBy("batch_id").agg(F.count_if(F.col("status") == "processing").alias("active_items"), F.round(F.avg(ms), 6).alias("avg_ms"), F.count("*").alias("items"), elapsed.alias("elapsed_ms"))


@query("SELECT gallery_id, count(*)::BIGINT AS pending FROM photos WHERE status IN ('queued', 'processing') AND status NOT IN ('done', 'failed') GROUP BY 1", "photos")
def pending_photo_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that wait, by gallery."""
    p = photos(spark, sf_dir)
    return p.where(p.status.isin("queued", "processing") & ~p.status.isin("done", "failed")).groupBy("gallery_id").agg(F.count("*").alias("pending"))


@query("""SELECT photo_id, gallery_id, filename, status, coalesce(f.faces, 0)::BIGINT AS faces FROM photos LEFT JOIN (SELECT photo_id, count(*) AS faces FROM detections GROUP BY 1) f USING (photo_id)
WHERE filename ILIKE '%ur%' AND status = 'done' ORDER BY uploaded_at DESC, photo_id LIMIT 50 OFFSET 100""", "photos detections")
def photo_page(spark: SparkSession, sf_dir: str, q: str = " ur ", status: str | None = "done", offset: int = 100, limit: int = 50) -> DataFrame:
    """A page of photos with their face counts; filters only where given. The page is cut before the join, so only its faces are counted."""
    p = photos(spark, sf_dir)
    p = p.where(F.col("filename").ilike(f"%{q.strip()[:120]}%")) if q else p
    p = p.where(F.col("status") == status) if status else p
    page = p.orderBy(F.desc("uploaded_at"), "photo_id").offset(offset).limit(max(1, min(limit, 200)))
    faces = detections(spark, sf_dir).join(page, "photo_id", "left_semi").groupBy("photo_id").agg(F.count("*").alias("faces"))
    return page.join(faces, "photo_id", "left").select("photo_id", "gallery_id", "filename", "status", F.coalesce("faces", F.lit(0)).alias("faces"))


@query("SELECT count(*)::BIGINT AS total, ceil(count(*) / 50.0)::BIGINT AS pages FROM photos WHERE filename ILIKE '%ur%' AND status = 'done'", "photos")
def photo_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and pages beside photo_page."""
    return photos(spark, sf_dir).where(F.col("filename").ilike("%ur%") & (F.col("status") == "done")).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 50.0).alias("pages"))


@query("SELECT event_id, event_type AS action, user_id, props AS payload, count(*) OVER () AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the audit log of one action, newest first, with the total in each row."""
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    page = rows.orderBy(F.desc("ts"), "event_id").offset(50).limit(50)
    total = rows.agg(F.count("*").alias("total"))
    return page.select("event_id", F.col("event_type").alias("action"), "user_id", F.col("props").alias("payload"), F.lit(1).alias("one")).join(total.select("total", F.lit(1).alias("one")), "one").drop("one")


@query("""SELECT photo_id, face_index, d.cluster_id, coalesce(c.label, '') AS label, coalesce(quality, 0) AS x1, confidence FROM detections d LEFT JOIN clusters c ON d.cluster_id = c.cluster_id AND NOT d.low_quality""", "detections clusters")
def photo_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with the label of their cluster, if any."""
    d, c = detections(spark, sf_dir), clusters(spark, sf_dir).withColumnRenamed("cluster_id", "_c")
    rows = d.join(c, (d.cluster_id == c["_c"]) & ~d.low_quality, "left")
    return rows.select("photo_id", "face_index", "cluster_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("quality", F.lit(0.0)).alias("x1"), "confidence")


@query("""SELECT c.cluster_id, coalesce(nullif(label, ''), concat('Person ', c.cluster_id::VARCHAR[1:6])) AS label, n::BIGINT AS faces FROM clusters c JOIN (SELECT cluster_id, count(*) AS n FROM detections GROUP BY 1) d USING (cluster_id)
WHERE contains(lower(coalesce(nullif(label, ''), concat('Person ', c.cluster_id::VARCHAR))), '00')""".replace("c.cluster_id::VARCHAR[1:6]", "(c.cluster_id::VARCHAR)[1:6]"), "clusters detections")
def people_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by label, or by the name that stands for a missing one."""
    shown = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Person "), F.substring(F.col("cluster_id").cast("string"), 1, 6)))
    counts = detections(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("faces"))
    return clusters(spark, sf_dir).where(F.lower(shown).contains("00")).join(counts, "cluster_id").select("cluster_id", shown.alias("label"), "faces")


@query("SELECT tenant_id, name FROM tenants WHERE contains(lower(name), '_1') OR contains(lower(replace(name, '_', '-')), 'n-2')", "tenants")
def tenant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants by name or slug."""
    t = tenants(spark, sf_dir)
    return t.where(F.lower("name").contains("_1") | F.lower(F.replace("name", F.lit("_"), F.lit("-"))).contains("n-2")).select("tenant_id", "name")


@query("SELECT gallery_id, name, upper(trim(name)) AS code FROM galleries WHERE upper(trim(name)) = upper(trim(' customer#000000007 ')) AND is_active", "galleries")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active gallery of an access code, whatever its case and the blanks around it; two rows would be an error to report."""
    g = galleries(spark, sf_dir)
    return g.where((F.upper(F.trim("name")) == F.upper(F.trim(F.lit(" customer#000000007 ")))) & g.is_active).limit(2).select("gallery_id", "name", F.upper(F.trim("name")).alias("code"))


@query("""SELECT 'platform' AS role, gallery_id, tenant_id, name FROM galleries UNION ALL SELECT 'tenant', gallery_id, tenant_id, name FROM galleries WHERE tenant_id = 3""", "galleries")
def scoped_galleries(spark: SparkSession, sf_dir: str, tenant: int = 3) -> DataFrame:
    """What each role sees: the platform all galleries, a tenant its own."""
    g = galleries(spark, sf_dir).select("gallery_id", "tenant_id", "name")
    see = {"platform": g, "tenant": g.where(F.col("tenant_id") == tenant)}
    parts = [rows.select(F.lit(role).alias("role"), "*") for role, rows in see.items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT batch_id, active, updated, row_number() OVER (ORDER BY active DESC, updated DESC, batch_id)::INT AS place FROM (SELECT batch_id, bool_or(status = 'processing') AS active, max(ts) AS updated FROM items GROUP BY 1)
QUALIFY place <= 12""", "items")
def live_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dozen batches on top of the overview: running first, then the latest."""
    b = items(spark, sf_dir).groupBy("batch_id").agg(F.bool_or(F.col("status") == "processing").alias("active"), F.max("ts").alias("updated"))
    top = b.orderBy(F.desc("active"), F.desc("updated"), "batch_id").limit(12)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("active"), F.desc("updated"), "batch_id")))


@query("""SELECT gallery_id, n::BIGINT AS total, ceil(n / 20.0)::BIGINT AS pages, least(n, 21)::BIGINT AS first_of_page2, least(n, 40)::BIGINT AS last_of_page2 FROM (SELECT gallery_id, count(*) AS n FROM photos GROUP BY 1)""", "photos")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 20 photos of each gallery, and the rows shown on the second."""
    n = photos(spark, sf_dir).groupBy("gallery_id").agg(F.count("*").alias("total"))
    return n.select("gallery_id", "total", F.ceil(F.col("total") / 20.0).alias("pages"), F.least("total", F.lit(21).cast("long")).alias("first_of_page2"), F.least("total", F.lit(40).cast("long")).alias("last_of_page2"))


@query("SELECT gallery_id, photo_id, uploaded_at FROM photos WHERE status = 'queued' ORDER BY uploaded_at, photo_id LIMIT 1", "photos")
def oldest_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gallery of the photo that waits longest: one pass with min_by, no sort."""
    first = F.min(F.struct("uploaded_at", "photo_id", "gallery_id")).alias("x")
    return photos(spark, sf_dir).where("status = 'queued'").agg(first).where("x is not null").select("x.gallery_id", "x.photo_id", "x.uploaded_at")


@query("""SELECT DISTINCT photo_id, concat('originals/', photo_id) AS url, coalesce(nullif(concat('previews/', filename), 'previews/'), concat('thumbs/', photo_id)) AS preview FROM photos WHERE filename <> '' AND status = 'done'""", "photos")
def downloadable_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with an original, and the address of their preview or else thumbnail."""
    p = photos(spark, sf_dir).where((F.col("filename") != "") & (F.col("status") == "done"))
    key = F.col("photo_id").cast("string")
    preview = F.coalesce(F.nullif(F.concat(F.lit("previews/"), "filename"), F.lit("previews/")), F.concat(F.lit("thumbs/"), key))
    return p.select("photo_id", F.concat(F.lit("originals/"), key).alias("url"), preview.alias("preview")).distinct()


@query("""SELECT cluster_id, string_agg(photo_id::VARCHAR, ',' ORDER BY rn) AS thumbnails FROM (SELECT cluster_id, photo_id, row_number() OVER (PARTITION BY cluster_id
  ORDER BY coalesce(quality, 0) DESC, confidence DESC, created_at, part_key, photo_id, face_index) AS rn FROM detections) WHERE rn <= 3 GROUP BY 1""", "detections")
def cluster_top_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best faces of each cluster in order. The rank filter reaches the map side, so a big cluster ships three rows a task."""
    order = W.partitionBy("cluster_id").orderBy(F.coalesce("quality", F.lit(0.0)).desc(), F.desc("confidence"), "created_at", "part_key", "photo_id", "face_index")
    top = detections(spark, sf_dir).withColumn("rn", F.row_number().over(order)).where("rn <= 3")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rn", "photo_id"))), lambda x: x["photo_id"].cast("string"))
    return top.groupBy("cluster_id").agg(F.array_join(shown, ",").alias("thumbnails"))


@query("""SELECT cluster_id, rn::INT AS rank, photo_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality DESC NULLS LAST, created_at, part_key, photo_id, face_index) AS rn
FROM (SELECT cluster_id, photo_id, face_index, created_at, part_key, CASE WHEN quality > 0.1 THEN quality END AS quality FROM detections WHERE NOT low_quality)) WHERE rn <= 5""", "detections")
def cluster_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five prototypes of each cluster: best quality first, unknown quality last."""
    d = detections(spark, sf_dir).where(~F.col("low_quality")).withColumn("quality", F.when(F.col("quality") > 0.1, F.col("quality")))
    order = W.partitionBy("cluster_id").orderBy(F.desc_nulls_last("quality"), "created_at", "part_key", "photo_id", "face_index")
    return d.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("cluster_id", "rank", "photo_id", "quality")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS item_id, max(ts) AS queued_at FROM events WHERE event_type = 'click' GROUP BY 1".replace("max_by(event_id, (ts, event_id))", "arg_max(event_id, row(ts, event_id))"))
def latest_source_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest item of each owner that carries a source reference."""
    rows = read(spark, sf_dir, "events").where("event_type = 'click'")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("item_id"), F.max("ts").alias("queued_at"))


@query("SELECT photo_id, gallery_id FROM photos WHERE photo_id IN (SELECT photo_id FROM detections WHERE quality >= 0.9 AND NOT low_quality)", "photos detections")
def matched_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with a face of high quality."""
    good = detections(spark, sf_dir).where((F.col("quality") >= 0.9) & ~F.col("low_quality"))
    return photos(spark, sf_dir).join(good, "photo_id", "left_semi").select("photo_id", "gallery_id")


@query("""SELECT photo_id, gallery_id, uploaded_at FROM photos p WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM detections d WHERE d.photo_id = p.photo_id AND d.version = 'O')""", "photos detections")
def untracked_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued photos without a row of the current version."""
    return photos(spark, sf_dir).where("status = 'queued'").join(detections(spark, sf_dir).where("version = 'O'"), "photo_id", "left_anti").select("photo_id", "gallery_id", "uploaded_at")


@query("""SELECT DISTINCT gallery_id, gallery_id::VARCHAR AS key FROM galleries g WHERE EXISTS (SELECT 1 FROM photos p WHERE p.gallery_id = g.gallery_id AND status = 'done')
  AND NOT EXISTS (SELECT 1 FROM photos p WHERE p.gallery_id = g.gallery_id AND status IN ('queued', 'processing'))""", "galleries photos")
def ready_finalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galleries with finished photos and none that waits."""
    p = photos(spark, sf_dir)
    done, waiting = p.where("status = 'done'"), p.where(F.col("status").isin("queued", "processing"))
    ready = galleries(spark, sf_dir).join(done, "gallery_id", "left_semi").join(waiting, "gallery_id", "left_anti")
    return ready.select("gallery_id", F.col("gallery_id").cast("string").alias("key")).distinct()


@query("SELECT cluster_id, label FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM detections WHERE quality >= 1 AND confidence >= 0.99 AND version = 'F')", "clusters detections")
def obsolete_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that no face of the kept set names."""
    used = detections(spark, sf_dir).where("quality >= 1 and confidence >= 0.99 and version = 'F'")
    return clusters(spark, sf_dir).join(used, "cluster_id", "left_anti").select("cluster_id", "label")


@query("""SELECT p.gallery_id, count(*)::BIGINT AS failed, (count(*) FILTER (d.photo_id IS NOT NULL))::BIGINT AS recoverable, (count(*) FILTER (d.photo_id IS NULL))::BIGINT AS lost
FROM photos p LEFT JOIN (SELECT DISTINCT photo_id FROM detections WHERE version = 'F') d USING (photo_id) WHERE status = 'processing' GROUP BY 1""", "photos detections")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuck photos by gallery: those whose original is known can be retried."""
    known = detections(spark, sf_dir).where("version = 'F'").select("photo_id").distinct().withColumn("known", F.lit(True))
    rows = photos(spark, sf_dir).where("status = 'processing'").join(known, "photo_id", "left")
    return rows.groupBy("gallery_id").agg(F.count("*").alias("failed"), F.count("known").alias("recoverable"), F.count_if(F.col("known").isNull()).alias("lost"))


@query("""SELECT item_id, batch_id, CASE WHEN status = 'skipped' THEN NULL ELSE processing_ms END AS embedding, CASE WHEN status = 'skipped' THEN TIMESTAMP '2024-01-31 00:00:00' END AS deleted_at, status IS NOT NULL AND processing_ms IS NOT NULL AS has_match FROM items""", "items")
def active_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans after erasure: biometric values nulled and stamped where consent was revoked."""
    i = items(spark, sf_dir)
    gone = F.col("status") == "skipped"
    return i.select("item_id", "batch_id", F.when(~gone, F.col("processing_ms")).alias("embedding"), F.when(gone, now()).alias("deleted_at"), (F.col("status").isNotNull() & F.col("processing_ms").isNotNull()).alias("has_match"))


@query("""SELECT item_id, batch_id, ts FROM items WHERE status = 'processing' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 17 MINUTE AND ts >= date_trunc('month', TIMESTAMP '2024-01-31 00:00:00') ORDER BY ts, item_id LIMIT 500""", "items")
def lease_expired(spark: SparkSession, sf_dir: str, limit: int = 1000) -> DataFrame:
    """The oldest 500 items at most whose lease ran out this month."""
    i = items(spark, sf_dir)
    old = (F.col("status") == "processing") & (F.col("ts") < now() - F.expr("INTERVAL 17 MINUTES")) & (F.col("ts") >= F.date_trunc("month", now()).cast("timestamp_ntz"))
    return i.where(old).orderBy("ts", "item_id").limit(max(1, min(limit, 500))).select("item_id", "batch_id", "ts")


def token() -> Column:
    """An item's claim: none, a claim in progress, or a published task."""
    key = F.col("item_id").cast("string")
    return F.when(F.col("item_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("dispatching:"), key)).otherwise(F.concat(F.lit("task-"), key))


@query("""WITH t AS (SELECT *, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('dispatching:', item_id) ELSE concat('task-', item_id) END AS token FROM items)
SELECT item_id, batch_id, token FROM t WHERE status = 'queued' AND (token IS NULL OR (token LIKE 'dispatching:%' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 SECOND)
  OR (token NOT LIKE 'dispatching:%' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR))""", "items")
def claimable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued items that nobody holds, whose claim is stale, or whose publication is a day old."""
    i = items(spark, sf_dir).withColumn("token", token())
    claim = F.col("token").startswith("dispatching:")
    free = F.col("token").isNull() | (claim & (F.col("ts") < now() - F.expr("INTERVAL 60 SECONDS"))) | (~claim & (F.col("ts") < now() - F.expr("INTERVAL 24 HOURS")))
    return i.where((F.col("status") == "queued") & free).select("item_id", "batch_id", "token")


@query("""SELECT i.item_id, i.batch_id, p.photo_id, CASE WHEN p.filename = '1-URGENT' THEN 'drive-downloads' ELSE 'face-processing' END AS queue, concat('dispatching:', i.item_id) AS token
FROM items i JOIN (SELECT batch_id, count(*) AS n FROM items GROUP BY 1) b USING (batch_id) JOIN photos p ON p.photo_id = i.item_id WHERE i.status = 'queued' ORDER BY i.ts, i.item_id LIMIT 100""", "items photos")
def claim_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred items with batch and photo, marked as claimed and routed to a queue."""
    i = items(spark, sf_dir)
    rows = i.where("status = 'queued' and batch_id is not null").join(photos(spark, sf_dir).select("photo_id", "filename"), F.col("item_id") == F.col("photo_id"))
    queue = F.when(F.col("filename") == "1-URGENT", "drive-downloads").otherwise("face-processing")
    return rows.orderBy("ts", "item_id").limit(100).select("item_id", "batch_id", "photo_id", queue.alias("queue"), F.concat(F.lit("dispatching:"), F.col("item_id").cast("string")).alias("token"))
