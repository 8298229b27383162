"""Scalar families: text, status, JSON, coercion, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.status import finished, merged, phase, processor
from lumenfold.functions.text import digest, label, slug, truncated
from lumenfold.plans.registry import query
from lumenfold.sources.roles import galleries, items, photos, read


@query("""SELECT gallery_id, concat(replace(lower(name), ' ', '-')[1:50], '-', md5(gallery_id::VARCHAR)[1:8]) AS slug,
  coalesce(nullif(trim(regexp_replace(coalesce(nullif(trim(CASE WHEN gallery_id % 5 = 0 THEN ' ' ELSE name END), ''), concat('Person_', (gallery_id::VARCHAR)[1:8])), '[^A-Za-z0-9\\-_ ]', '_', 'g'))[1:80], ''), 'Person') AS label FROM galleries""", "galleries")
def slug_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and file-safe labels; blank names get one from the id."""
    name = F.when(F.col("gallery_id") % 5 == 0, " ").otherwise(F.col("name"))
    return galleries(spark, sf_dir).select("gallery_id", slug(F.col("name"), F.col("gallery_id")).alias("slug"), label(name, F.col("gallery_id")).alias("label"))


@query("SELECT doc_id, sha256(text) AS digest, nullif(text[1:500], '') AS head FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, and the text as an error message is kept: 500 characters, null for none."""
    return read(spark, sf_dir, "documents").select("doc_id", digest(F.col("text")).alias("digest"), truncated(F.col("text")).alias("head"))


@query("""SELECT concat('v', r_regionkey, ':model:', sha256(concat('{"anchor_quality":0.58,"dim":512,"name":"', r_name, '","tiles":true}'))[1:12])[1:100] AS pipeline_version, r_regionkey FROM region""")
def pipeline_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version string with a digest of the settings as canonical JSON: keys in order, no blanks."""
    r = read(spark, sf_dir, "region")
    settings = F.to_json(F.struct(F.lit(0.58).alias("anchor_quality"), F.lit(512).alias("dim"), F.col("r_name").alias("name"), F.lit(True).alias("tiles")))
    version = F.concat(F.lit("v"), F.col("r_regionkey").cast("string"), F.lit(":model:"), F.substring(digest(settings), 1, 12))
    return r.select(F.substring(version, 1, 100).alias("pipeline_version"), "r_regionkey")


@query("""SELECT item_id, status, CASE WHEN item_id % 11 = 0 THEN 'failed' WHEN status IN ('queued', 'receiving') THEN 'waiting' WHEN status = 'processing' THEN 'analysing' WHEN status = 'finalizing' THEN 'grouping' WHEN status IN ('succeeded', 'skipped') THEN 'done' ELSE 'failed' END AS phase FROM items""", "items")
def phase_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status to phase, with an error that goes before."""
    return items(spark, sf_dir).select("item_id", "status", phase(F.col("status"), F.when(F.col("item_id") % 11 == 0, F.lit("boom"))).alias("phase"))


@query("""SELECT photo_id, size_bytes * 977 AS bytes, CASE WHEN size_bytes * 977 < 1024 THEN concat(size_bytes * 977, ' B') WHEN size_bytes * 977 < 1048576 THEN concat(size_bytes * 977 // 1024, ' KB') WHEN size_bytes * 977 < 1073741824 THEN concat(size_bytes * 977 // 1048576, ' MB') ELSE concat(size_bytes * 977 // 1073741824, ' GB') END AS shown FROM photos""", "photos")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in whole units of 1024."""
    b = F.col("size_bytes") * 977
    unit = lambda n, u: F.concat(F.floor(b / n).cast("string"), F.lit(f" {u}"))
    shown = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, unit(1 << 10, "KB")).when(b < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))
    return photos(spark, sf_dir).select("photo_id", b.alias("bytes"), shown.alias("shown"))


@query("SELECT gallery_id, concat('***', right(lpad((gallery_id * 7919)::VARCHAR, 10, '0'), 4)) AS phone FROM galleries", "galleries")
def mask_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the last four digits masked."""
    phone = F.lpad((F.col("gallery_id") * 7919).cast("string"), 10, "0")
    return galleries(spark, sf_dir).select("gallery_id", F.concat(F.lit("***"), F.right(phone, F.lit(4))).alias("phone"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, concat('{\"action\":\"', event_type, '\",\"user\":', user_id, '}') AS payload FROM events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field read from JSON, and a payload built as JSON."""
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("action"), F.col("user_id").alias("user"))).alias("payload"))


@query("""WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(event_id, ':', user_id, ':', event_id % 7) WHEN 1 THEN concat('x:', user_id) WHEN 2 THEN concat('i:', event_id) ELSE concat('f:', event_id) END AS raw FROM events)
SELECT event_id, raw, CASE WHEN raw LIKE 'i:%' THEN 'images' WHEN raw LIKE 'f:%' THEN 'faces' WHEN len(string_split(raw, ':')) = 3 THEN 'bucket' ELSE 'malformed' END AS kind,
  try_cast(CASE WHEN raw LIKE 'i:%' OR raw LIKE 'f:%' THEN string_split(raw, ':')[2] WHEN len(string_split(raw, ':')) = 3 THEN string_split(raw, ':')[1] END AS BIGINT) AS second FROM b""")
def bucket_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate buckets in the old form (i:second, f:second) and the new (second:images:faces); what fits neither is named so."""
    e = read(spark, sf_dir, "events")
    key, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    four = F.col("event_id") % 4
    raw = F.when(four == 0, F.concat_ws(":", key, user, (F.col("event_id") % 7).cast("string"))).when(four == 1, F.concat(F.lit("x:"), user)).when(four == 2, F.concat(F.lit("i:"), key)).otherwise(F.concat(F.lit("f:"), key))
    b = e.select("event_id", raw.alias("raw")).withColumn("p", F.split("raw", ":"))
    old, new = F.col("raw").startswith("i:") | F.col("raw").startswith("f:"), F.size("p") == 3
    kind = F.when(F.col("raw").startswith("i:"), "images").when(F.col("raw").startswith("f:"), "faces").when(new, "bucket").otherwise("malformed")
    second = F.when(old, F.col("p")[1]).when(new, F.col("p")[0]).try_cast("bigint")
    return b.select("event_id", "raw", kind.alias("kind"), second.alias("second"))


@query("""SELECT photo_id, status, CASE WHEN coalesce(nullif(filename, ''), '') = '' THEN 'missing' WHEN status = 'done' AND size_bytes > 150000 THEN 'ready-large' WHEN status = 'done' THEN 'ready' WHEN status = 'processing' THEN 'scanning' WHEN status = 'queued' THEN 'waiting' ELSE 'error' END AS stage FROM photos""", "photos")
def photo_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage label of a photo."""
    s = F.col("status")
    stage = F.when(F.coalesce(F.nullif("filename", F.lit("")), F.lit("")) == "", "missing").when((s == "done") & (F.col("size_bytes") > 150000), "ready-large").when(s == "done", "ready").when(s == "processing", "scanning").when(s == "queued", "waiting").otherwise("error")
    return photos(spark, sf_dir).select("photo_id", "status", stage.alias("stage"))


@query("""WITH p AS (SELECT event_id, (['CPU', 'gpu', 'Mixed', 'tpu', NULL])[event_id % 5 + 1] AS raw, (['cpu', 'gpu', NULL])[event_id % 3 + 1] AS held FROM events)
SELECT event_id, CASE WHEN lower(raw) IN ('cpu', 'gpu', 'mixed') THEN lower(raw) ELSE 'unknown' END AS processor, CASE WHEN held IS NULL THEN lower(raw) WHEN held = lower(raw) THEN held ELSE 'mixed' END AS merged FROM p""")
def processor_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processor names in order, and the batch's after one more item."""
    raw = F.element_at(F.array(*map(F.lit, ("CPU", "gpu", "Mixed", "tpu", None))), (F.col("event_id") % 5 + 1).cast("int"))
    held = F.element_at(F.array(*map(F.lit, ("cpu", "gpu", None))), (F.col("event_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", processor(raw).alias("processor"), merged(held, F.lower(raw)).alias("merged"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value::VARCHAR END AS cpu_percent, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE user_id::VARCHAR END AS cpu, event_id * 1048576 AS memory_bytes FROM events)
SELECT event_id, coalesce(try_cast(cpu_percent AS DOUBLE), try_cast(cpu AS DOUBLE), 0) AS cpu, round(memory_bytes / 1073741824.0::DOUBLE, 6) AS memory_gb FROM r""")
def resource_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New field, else old field, else zero; text that is no number counts as missing; bytes to GB."""
    new = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).try_cast("double")
    old = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string")).try_cast("double")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(new, old, F.lit(0.0)).alias("cpu"), F.round(F.col("event_id") * 1048576 / 1073741824.0, 6).alias("memory_gb"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]*\\.example\\.(com|net)(/|$)') AS allowed FROM pages")
def origin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses under the allowed origins *.example.com and *.example.net: a glob as a pattern."""
    return read(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(r"^https?://[^/]*\.example\.(com|net)(/|$)").alias("allowed"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('Failed at ', event_id) WHEN 1 THEN concat('body.name: field required · user: ', event_type) ELSE 'Something went wrong' END AS message FROM events""")
def error_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of a failure body: a string, a list of (place, message), or anything else."""
    e = read(spark, sf_dir, "events")
    three, key = F.col("event_id") % 3, F.col("event_id").cast("string")
    listed = F.concat(F.lit('{"detail":[{"loc":["body","name"],"msg":"field required"},{"loc":["user"],"msg":"'), F.col("event_type"), F.lit('"}]}'))
    body = F.when(three == 0, F.concat(F.lit('{"detail":"Failed at '), key, F.lit('"}'))).when(three == 1, listed).otherwise('{"detail":{"code":7}}')
    rows = e.select("event_id", body.alias("body"))
    detail = F.get_json_object("body", "$.detail")
    items_ = F.from_json(detail, "array<struct<loc:array<string>,msg:string>>", {"mode": "PERMISSIVE"})
    lines = F.array_join(F.transform(items_, lambda x: F.concat(F.array_join(x["loc"], "."), F.lit(": "), x["msg"])), " · ")
    message = F.when(detail.startswith("["), lines).when(detail.startswith("{"), F.lit("Something went wrong")).otherwise(detail)
    return rows.select("event_id", message.alias("message"))


@query("""WITH h AS (SELECT p_partkey, p_size * 1024 AS total_mb, p_partkey % 3 = 0 AS gpu, p_size % 9 + 1 AS cpus FROM part)
SELECT p_partkey, greatest(1, least(4, CASE WHEN gpu THEN least((total_mb - 2048) // 1800, cpus // 2) ELSE (total_mb - 2048) // 1800 END, cpus))::INT AS processes FROM h""")
def worker_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes that a host can hold: memory after the reserve, cores, the hard limit, one at least."""
    total, gpu, cpus = F.col("p_size") * 1024, F.col("p_partkey") % 3 == 0, F.col("p_size") % 9 + 1
    memory = F.floor((total - 2048) / 1800).cast("int")
    held = F.when(gpu, F.least(memory, F.floor(cpus / 2).cast("int"))).otherwise(memory)
    return read(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(1), F.least(F.lit(4), held, cpus.cast("int"))).alias("processes"))


@query("SELECT event_type AS message, user_id AS session, count(*)::BIGINT AS repeats, arg_max(props, row(ts, event_id)) AS last_detail FROM events GROUP BY 1, 2")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal messages of a session as one, with a counter and the last detail."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("message"), F.col("user_id").alias("session")).agg(F.count("*").alias("repeats"), F.max_by("props", F.struct("ts", "event_id")).alias("last_detail"))


@query("""SELECT attempt::INT AS attempt, least(30000, 1000 * 2 ** least(attempt - 1, 5))::BIGINT AS reconnect_ms, least(300, 30 * 2 ** attempt)::BIGINT AS retry_s, greatest(1, ceil(attempt * 7 / 2.0))::BIGINT AS eta_s FROM range(1, 13) r(attempt)""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before each attempt."""
    n = F.col("attempt")
    two = lambda x: F.pow(F.lit(2.0), x)
    return spark.range(1, 13).select(F.col("id").cast("int").alias("attempt")).select(
        "attempt", F.least(F.lit(30000.0), 1000 * two(F.least(n - 1, F.lit(5)))).cast("long").alias("reconnect_ms"), F.least(F.lit(300.0), 30 * two(n)).cast("long").alias("retry_s"), F.greatest(F.lit(1), F.ceil(n * 7 / 2.0)).alias("eta_s")
    )


@query("""SELECT event_id AS audit_id, user_id, event_type AS action, concat('{"kind":"', event_type, '","value":', event_id, CASE WHEN event_id % 2 = 0 THEN concat(',"detail":"', props->>'$.k', '"') ELSE '' END, '}') AS payload, ts AS created_at FROM events""")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with a JSON payload; null fields are left out."""
    detail = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k"))
    payload = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("value"), detail.alias("detail")))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), "user_id", F.col("event_type").alias("action"), payload.alias("payload"), F.col("ts").alias("created_at"))


@query("""SELECT batch_id, n::BIGINT AS total, failed::BIGINT AS failed, CASE WHEN failed >= n THEN 'failed' WHEN failed > 0 THEN 'partial_failed' ELSE 'completed' END AS outcome FROM (SELECT batch_id, count(*) AS n, count(*) FILTER (status = 'failed' AND processing_ms > 60) AS failed FROM items GROUP BY 1)""", "items")
def finalize_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each batch when all its items are terminal."""
    b = items(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if((F.col("status") == "failed") & (F.col("processing_ms") > 60)).alias("failed"))
    return b.select("batch_id", "total", "failed", finished(F.col("failed"), F.col("total")).alias("outcome"))
