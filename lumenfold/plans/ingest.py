"""Ingestion rules: duplicates, gates, quotas, packing, names, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.text import digest, extension, nonempty
from lumenfold.operators.jumps import pages
from lumenfold.plans.registry import query
from lumenfold.sources.roles import galleries, photos, read, tenants

#: The accepted extensions and types.
EXTENSIONS = (".jpg", ".jpeg", ".jpe", ".jfif")
MAX_BYTES = 100 * 1024 * 1024


@query("""SELECT doc_id, source, h AS content_hash, n::BIGINT AS copies, doc_id <> first AS is_duplicate FROM (SELECT doc_id, source, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE n > 1""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content occurs more than once. Groups are counted before they meet the rows, so a hot group is no window."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", digest(F.col("text")).alias("content_hash"))
    groups = d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")
    return d.join(groups, "content_hash").select("doc_id", "source", "content_hash", "copies", (F.col("doc_id") != F.col("first")).alias("is_duplicate"))


def upload_names() -> Column:
    """A file name for each order, with several kinds of ending."""
    ends = F.array(*(F.lit(x) for x in (".jpg", ".JPEG", ".png", ".jfif", "", ".heic", ".jpe", ".tiff")))
    return F.concat(F.lit("IMG_"), F.col("photo_id").cast("string"), F.element_at(ends, (F.col("photo_id") % 8 + 1).cast("int")))


UPLOADS = """u AS (SELECT photo_id, gallery_id, concat('IMG_', photo_id, (['.jpg', '.JPEG', '.png', '.jfif', '', '.heic', '.jpe', '.tiff'])[photo_id % 8 + 1]) AS name, size_bytes * 400 AS bytes, md5(concat(filename, uploaded_at::DATE)) AS content_hash, uploaded_at FROM photos)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, gallery_id, name, bytes, content_hash, uploaded_at."""
    return photos(spark, sf_dir).select(
        "photo_id", "gallery_id", upload_names().alias("name"), (F.col("size_bytes") * 400).alias("bytes"), F.md5(F.concat("filename", F.to_date("uploaded_at").cast("string"))).alias("content_hash"), "uploaded_at"
    )


@query(f"""WITH {UPLOADS}, e AS (SELECT *, regexp_extract(lower(name), '(\\.[^./]+)$', 1) AS ext FROM u)
SELECT name, ext, ext IN ('.jpg', '.jpeg', '.jpe', '.jfif') AS allowed, CASE WHEN ext = '' THEN 'no extension' WHEN ext NOT IN ('.jpg', '.jpeg', '.jpe', '.jfif') THEN concat('unsupported ', ext) END AS reason FROM e""", "photos")
def extension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names pass the list of extensions, and why others do not."""
    ext = extension(F.col("name"))
    allowed = ext.isin(*EXTENSIONS)
    reason = F.when(ext == "", "no extension").when(~allowed, F.concat(F.lit("unsupported "), ext))
    return uploads(spark, sf_dir).select("name", ext.alias("ext"), allowed.alias("allowed"), reason.alias("reason"))


@query(f"""WITH {UPLOADS}, e AS (SELECT *, regexp_extract(lower(name), '(\\.[^./]+)$', 1) IN ('.jpg', '.jpeg', '.jpe', '.jfif') AS allowed, bytes > 104857600 AS big FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY gallery_id, content_hash, allowed AND NOT big ORDER BY uploaded_at, photo_id) AS rn FROM e)
SELECT photo_id, gallery_id, CASE WHEN NOT allowed THEN 'extension' WHEN big THEN 'size' WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM r""", "photos")
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, then size, then content already accepted in the gallery."""
    u = uploads(spark, sf_dir)
    allowed, big = extension(F.col("name")).isin(*EXTENSIONS), F.col("bytes") > MAX_BYTES
    u = u.withColumn("allowed", allowed).withColumn("big", big).withColumn("passes", F.col("allowed") & ~F.col("big"))
    first = F.row_number().over(W.partitionBy("gallery_id", "content_hash", "passes").orderBy("uploaded_at", "photo_id"))
    outcome = F.when(~F.col("allowed"), "extension").when(F.col("big"), "size").when(F.col("rn") > 1, "duplicate").otherwise("accepted")
    return u.withColumn("rn", first).select("photo_id", "gallery_id", outcome.alias("outcome"))


@query("""SELECT g.gallery_id, g.tenant_id, count(photo_id)::BIGINT AS existing, (count(*) FILTER (uploaded_at >= date_trunc('month', TIMESTAMP '1998-07-15 00:00:00')))::BIGINT AS this_month,
  CASE t.plan % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END::INT AS quota, count(photo_id) + 3 > CASE t.plan % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END AS rejected
FROM galleries g JOIN tenants t USING (tenant_id) LEFT JOIN photos p USING (gallery_id) GROUP BY g.gallery_id, g.tenant_id, t.plan""", "galleries tenants photos")
def quota_check(spark: SparkSession, sf_dir: str, incoming: int = 3) -> DataFrame:
    """Whether so many more photos pass the plan's limit; rejected files count too."""
    month = F.date_trunc("month", F.expr("timestamp_ntz'1998-07-15 00:00:00'")).cast("timestamp_ntz")
    counts = photos(spark, sf_dir).groupBy("gallery_id").agg(F.count("*").alias("existing"), F.count_if(F.col("uploaded_at") >= month).alias("this_month"))
    quota = F.when(F.col("plan") % 3 == 0, 5).when(F.col("plan") % 3 == 1, 10).otherwise(20)
    rows = galleries(spark, sf_dir).join(tenants(spark, sf_dir).select("tenant_id", "plan"), "tenant_id").join(counts, "gallery_id", "left")
    existing = F.coalesce("existing", F.lit(0))
    return rows.select("gallery_id", "tenant_id", existing.alias("existing"), F.coalesce("this_month", F.lit(0)).alias("this_month"), quota.alias("quota"), (existing + incoming > quota).alias("rejected"))


@query("""WITH k AS (SELECT gallery_id, concat('originals/', photo_id) AS key FROM photos UNION SELECT gallery_id, CASE WHEN status = 'done' THEN concat('thumbnails/', photo_id) ELSE '' END FROM photos)
SELECT gallery_id, key, ((row_number() OVER (PARTITION BY gallery_id ORDER BY key) - 1) // 5)::INT AS chunk, b.total_bytes FROM k JOIN (SELECT gallery_id, sum(size_bytes)::BIGINT AS total_bytes FROM photos GROUP BY 1) b USING (gallery_id) WHERE key <> ''""", "photos")
def asset_cleanup(spark: SparkSession, sf_dir: str, chunk: int = 5) -> DataFrame:
    """Keys to delete with a gallery, in chunks of a request, and the bytes that come free."""
    p = photos(spark, sf_dir)
    key = F.col("photo_id").cast("string")
    both = F.array(F.concat(F.lit("originals/"), key), F.when(F.col("status") == "done", F.concat(F.lit("thumbnails/"), key)).otherwise(F.lit("")))
    keys = p.select("gallery_id", F.explode(both).alias("key")).where("key <> ''").distinct()
    place = F.row_number().over(W.partitionBy("gallery_id").orderBy("key"))
    total = p.groupBy("gallery_id").agg(F.sum("size_bytes").alias("total_bytes"))
    return keys.withColumn("chunk", F.floor((place - 1) / chunk).cast("int")).join(total, "gallery_id").select("gallery_id", "key", "chunk", "total_bytes")


@query("""WITH n AS (SELECT gallery_id, photo_id, concat(lower(filename[3:]), '.jpg') AS name, row_number() OVER (PARTITION BY gallery_id ORDER BY photo_id) AS i, row_number() OVER (PARTITION BY gallery_id, filename ORDER BY photo_id) AS k FROM photos)
SELECT gallery_id, photo_id, CASE WHEN name = '.jpg' THEN concat('photo-', i, '.jpg') WHEN k = 1 THEN name ELSE concat(regexp_replace(name, '\\.jpg$', ''), '-', i, '.jpg') END AS archive_name FROM n""", "photos")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names inside an archive: the first of equal names keeps it, later ones get their place in the archive."""
    name = F.concat(F.lower(F.substring("filename", 3, 100)), F.lit(".jpg"))
    i = F.row_number().over(W.partitionBy("gallery_id").orderBy("photo_id"))
    k = F.row_number().over(W.partitionBy("gallery_id", "filename").orderBy("photo_id"))
    n = photos(spark, sf_dir).select("gallery_id", "photo_id", name.alias("name"), i.alias("i"), k.alias("k"))
    shown = F.when(F.col("name") == ".jpg", F.concat(F.lit("photo-"), "i", F.lit(".jpg"))).when(F.col("k") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.jpg$", ""), F.lit("-"), "i", F.lit(".jpg")))
    return n.select("gallery_id", "photo_id", shown.alias("archive_name"))


@query("""SELECT page_id, url, nullif(regexp_extract(concat('https://drive.example/folders/', regexp_extract(url, '//([^/]+)', 1)), '/folders/([a-zA-Z0-9_-]+)', 1), '') AS folder_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages""")
def drive_folder_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder id and host of an address; no id is an error row with null."""
    link = F.concat(F.lit("https://drive.example/folders/"), F.regexp_extract("url", "//([^/]+)", 1))
    return read(spark, sf_dir, "pages").select("page_id", "url", nonempty(F.regexp_extract(link, "/folders/([a-zA-Z0-9_-]+)", 1)).alias("folder_id"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("""WITH RECURSIVE f AS (SELECT gallery_id, photo_id, size_bytes, row_number() OVER (PARTITION BY gallery_id ORDER BY photo_id) AS i FROM photos),
p AS (SELECT gallery_id, photo_id, i, 0 AS page, 1 AS held, size_bytes AS bytes FROM f WHERE i = 1
UNION ALL SELECT f.gallery_id, f.photo_id, f.i, CASE WHEN p.held >= 2 OR p.bytes + f.size_bytes > 300000 THEN p.page + 1 ELSE p.page END, CASE WHEN p.held >= 2 OR p.bytes + f.size_bytes > 300000 THEN 1 ELSE p.held + 1 END,
  CASE WHEN p.held >= 2 OR p.bytes + f.size_bytes > 300000 THEN f.size_bytes ELSE p.bytes + f.size_bytes END FROM p JOIN f ON f.gallery_id = p.gallery_id AND f.i = p.i + 1)
SELECT gallery_id, photo_id, page::INT AS page FROM p""", "photos")
def upload_pages(spark: SparkSession, sf_dir: str, files: int = 2, most: int = 300_000) -> DataFrame:
    """Files of a gallery packed in order into pages of so many files and bytes: where a page ends depends on its first file alone, so the pages are a chain of jumps."""
    return pages(photos(spark, sf_dir), ["gallery_id"], "photo_id", "size_bytes", files, most)


@query("""SELECT photo_id, concat('tenants/', tenant_id, '/events/', gallery_id, '/photos/', photo_id, '/original.jpg') AS original_key, concat('tenants/', tenant_id, '/events/', gallery_id, '/photos/', photo_id, '/thumbnail.jpg') AS thumbnail_key FROM photos JOIN galleries USING (gallery_id)""", "photos galleries")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic keys of a photo's objects."""
    rows = photos(spark, sf_dir).select("photo_id", "gallery_id").join(galleries(spark, sf_dir).select("gallery_id", "tenant_id"), "gallery_id")
    key = lambda n: F.format_string(f"tenants/%d/events/%d/photos/%d/{n}.jpg", "tenant_id", "gallery_id", "photo_id")
    return rows.select("photo_id", key("original").alias("original_key"), key("thumbnail").alias("thumbnail_key"))


@query("""SELECT p.photo_id, p.gallery_id FROM photos p ANTI JOIN (SELECT filename, size_bytes FROM photos WHERE status = 'done') q USING (filename, size_bytes) WHERE p.status = 'queued'""", "photos")
def new_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued files whose name and size are not there yet; repeats inside the batch stay."""
    p = photos(spark, sf_dir)
    return p.where("status = 'queued'").join(p.where("status = 'done'").select("filename", "size_bytes"), ["filename", "size_bytes"], "left_anti").select("photo_id", "gallery_id")


@query("""SELECT doc_id, source, doc_id * 60 AS age_s, CASE WHEN doc_id * 60 >= 604800 THEN 'expired' WHEN doc_id % 4 = 1 AND doc_id * 60 < 900 THEN 'leased' ELSE 'due' END AS state FROM documents WHERE source LIKE 'src1%'""")
def pending_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored seals by prefix: expired after seven days, held for fifteen minutes by their owner, else due."""
    age = F.col("doc_id") * 60
    state = F.when(age >= 7 * 86400, "expired").when((F.col("doc_id") % 4 == 1) & (age < 900), "leased").otherwise("due")
    return read(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).select("doc_id", "source", age.alias("age_s"), state.alias("state"))
