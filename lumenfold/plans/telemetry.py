"""Rates, resources, snapshots, pacing, limits, and the state of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.status import finished
from lumenfold.operators import snapshot
from lumenfold.operators.folds import autoscaled
from lumenfold.operators.jumps import anchored_windows
from lumenfold.operators.scans import paced, running, spread, trailing
from lumenfold.plans.registry import query
from lumenfold.plans.relational import now
from lumenfold.sources import changes
from lumenfold.sources.roles import items, photos, read
from lumenfold.sources.storage import fresh_path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its epoch second and microsecond."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.withColumn("us", F.unix_micros(ts)).withColumn("sec", F.unix_seconds(ts))


E = "e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec FROM events)"


@query(f"""WITH {E}, s AS (SELECT user_id, sec, count(*) AS images, sum((props->>'$.k')::BIGINT)::BIGINT AS faces FROM e GROUP BY 1, 2),
w AS (SELECT *, sum(images) OVER f AS ti, sum(faces) OVER f AS tf, min(sec) OVER f AS first FROM s WINDOW f AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))
SELECT user_id, sec, round(ti::DOUBLE / greatest(1, least(86400, sec - first + 1)), 9) AS images_per_s, round(tf::DOUBLE / greatest(1, least(86400, sec - first + 1)), 9) AS faces_per_s FROM w""")
def rolling_rate(spark: SparkSession, sf_dir: str, seconds: int = 86_400) -> DataFrame:
    """Images and faces a second over the trailing window of each scope; the clock starts at the first second seen in it."""
    e = events(spark, sf_dir).withColumn("k", F.from_json("props", "k bigint")["k"])
    s = e.groupBy("user_id", "sec").agg(F.count("*").alias("images"), F.sum("k").alias("faces"))
    spent = F.greatest(F.lit(1), F.least(F.lit(seconds), F.col("sec") - F.col("first") + 1))
    rate = lambda c: F.round(F.col(c) / spent, 9)
    return trailing(s, "user_id", "sec", seconds, "images", "faces").select("user_id", "sec", rate("images").alias("images_per_s"), rate("faces").alias("faces_per_s"))


H = """h AS (SELECT concat('host-', user_id % 5) AS host, user_id AS pid, CASE WHEN user_id % 4 = 0 THEN 'web' ELSE 'worker' END AS component, ts, value AS cpu, (1 + user_id % 2)::DOUBLE AS capacity, CASE WHEN user_id % 3 = 0 THEN 'gpu' ELSE 'cpu' END AS processor, event_id FROM events),
l AS (SELECT * FROM h WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOUR QUALIFY row_number() OVER (PARTITION BY host, pid ORDER BY ts DESC, event_id DESC) = 1)"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest fresh heartbeat of each process."""
    u = F.col("user_id")
    h = read(spark, sf_dir, "events").where(F.col("ts") > now() - F.expr("INTERVAL 6 HOURS")).select(
        F.concat(F.lit("host-"), (u % 5).cast("string")).alias("host"), u.alias("pid"), F.when(u % 4 == 0, "web").otherwise("worker").alias("component"), "ts", F.col("value").alias("cpu"),
        (1 + u % 2).cast("double").alias("capacity"), F.when(u % 3 == 0, "gpu").otherwise("cpu").alias("processor"), "event_id",
    )
    latest = F.max_by(F.struct(*h.columns), F.struct("ts", "event_id")).alias("x")
    return h.groupBy("host", "pid").agg(latest).select("x.*")


@query(f"WITH {H} SELECT host, pid, component, cpu, processor FROM l")
def live_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes that reported lately."""
    return heartbeats(spark, sf_dir).select("host", "pid", "component", "cpu", "processor")


@query(f"""WITH {H}, p AS (SELECT host, least(100, sum(cpu)) AS cpu, greatest(0.01, max(capacity)) AS w FROM l GROUP BY 1), k AS (SELECT count(*) AS workers, count(DISTINCT processor) AS kinds, min(processor) AS one FROM l WHERE component = 'worker'),
g AS (SELECT avg(cpu) AS gpu FROM (SELECT host, arg_min(cpu, pid) AS cpu FROM l WHERE component = 'worker' AND processor = 'gpu' GROUP BY 1))
SELECT round(sum(cpu * w) / sum(w), 6) AS cpu_percent, (SELECT round(gpu, 6) FROM g) AS gpu_percent, (SELECT workers FROM k)::BIGINT AS workers, (SELECT CASE WHEN kinds = 0 THEN 'unknown' WHEN kinds = 1 THEN one ELSE 'mixed' END FROM k) AS processor FROM p""")
def resource_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity-weighted processor load of the hosts, one GPU reading a host, workers and their kind."""
    h = heartbeats(spark, sf_dir)
    hosts = h.groupBy("host").agg(F.least(F.lit(100.0), F.sum("cpu")).alias("cpu"), F.greatest(F.lit(0.01), F.max("capacity")).alias("w"))
    w = h.where("component = 'worker'")
    gpu = w.where("processor = 'gpu'").groupBy("host").agg(F.min_by("cpu", "pid").alias("cpu")).agg(F.round(F.avg("cpu"), 6).alias("gpu_percent"))
    kinds = F.collect_set("processor")
    kind = F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("mixed")
    one = F.lit(1).alias("one")
    load = hosts.agg(F.round(F.sum(F.col("cpu") * F.col("w")) / F.sum("w"), 6).alias("cpu_percent"))
    return load.select("*", one).join(gpu.select("*", one), "one").join(w.agg(F.count("*").alias("workers"), kind.alias("processor")).select("*", one), "one").drop("one")


@query("""WITH b AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('succeeded', 'failed', 'skipped')) AS completed, avg(processing_ms) FILTER (status = 'succeeded') AS avg_ms, batch_id % 9 = 0 AS finalizing, count(*) FILTER (status = 'processing') / 100.0::DOUBLE AS rate FROM items GROUP BY 1),
r AS (SELECT *, greatest(0, total - completed) AS remaining FROM b)
SELECT batch_id, total::BIGINT AS total, completed::BIGINT AS completed, remaining::BIGINT AS remaining, round(CASE WHEN total = 0 THEN 0 ELSE least(100, completed * 100.0::DOUBLE / total) END, 6) AS progress,
  CASE WHEN finalizing THEN -1 WHEN remaining = 0 THEN 0 WHEN batch_id % 2 = 0 AND rate > 0 THEN greatest(1, ceil(remaining / rate)) WHEN avg_ms > 0 THEN greatest(1, ceil(remaining * round(avg_ms, 6) / 1000)) ELSE -1 END::BIGINT AS eta_s FROM r""", "items")
def processing_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress and remaining time of each batch: by the rate, else by the mean time of an item; -1 where neither is known."""
    done = F.col("status").isin("succeeded", "failed", "skipped")
    b = items(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.avg(F.when(F.col("status") == "succeeded", F.col("processing_ms"))).alias("avg_ms"), (F.count_if(F.col("status") == "processing") / 100.0).alias("rate"))
    left = F.greatest(F.lit(0), F.col("total") - F.col("completed"))
    by_rate = F.greatest(F.lit(1), F.ceil(left / F.when(F.col("rate") > 0, F.col("rate"))))
    by_time = F.greatest(F.lit(1), F.ceil(left * F.round("avg_ms", 6) / 1000))
    eta = F.when(F.col("batch_id") % 9 == 0, -1).when(left == 0, 0).when((F.col("batch_id") % 2 == 0) & (F.col("rate") > 0), by_rate).when(F.col("avg_ms") > 0, by_time).otherwise(-1)
    progress = F.when(F.col("total") == 0, 0.0).otherwise(F.least(F.lit(100.0), F.col("completed") * 100.0 / F.col("total")))
    return b.select("batch_id", "total", "completed", left.alias("remaining"), F.round(progress, 6).alias("progress"), eta.cast("long").alias("eta_s"))


SNAPSHOT = """i AS (SELECT *, batch_id % 10 AS tenant, floor(processing_ms)::BIGINT % 3 AS found, ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 HOUR AS late FROM items),
b AS (SELECT batch_id, any_value(tenant) AS tenant, count(*) AS total, count(*) FILTER (status IN ('succeeded', 'failed', 'skipped')) AS completed, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'processing') AS active, sum(CASE WHEN status = 'succeeded' THEN found ELSE 0 END) AS faces, CASE WHEN batch_id % 4 <> 1 THEN avg(processing_ms) FILTER (status = 'succeeded') END AS avg_ms, round((count(*) FILTER (late AND status = 'succeeded'))::DOUBLE / 30, 3) AS rate FROM i GROUP BY batch_id),
d AS (SELECT *, ['receiving', 'running', 'completed', 'receiving', 'running', 'running', CASE WHEN tenant < 3 THEN 'finalizing' ELSE 'queued' END][batch_id % 7 + 1] AS status, CASE WHEN batch_id % 3 > 0 THEN batch_id % 90 END AS expected FROM b),
e AS (SELECT *, CASE WHEN status = 'receiving' AND expected IS NOT NULL THEN greatest(total, expected) ELSE total END AS shown FROM d WHERE status <> 'completed'), f AS (SELECT *, greatest(0, shown - completed) AS remaining FROM e)"""


def snapshot_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Batches with their items' measures, and each tenant's rates over the last 30 hours, an hour standing for a second."""
    i = items(spark, sf_dir).withColumn("tenant", F.col("batch_id") % 10).withColumn("found", F.floor("processing_ms").cast("long") % 3).withColumn("late", F.col("ts") > now() - F.expr("INTERVAL 30 HOURS"))
    ok, late = F.col("status") == "succeeded", F.col("late")
    rate = lambda c: F.round(c / 30.0, 3)
    n = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    b = i.groupBy("batch_id", "tenant").agg(
        F.count("*").alias("total"), n("succeeded", "failed", "skipped").alias("completed"), n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("skipped").alias("skipped"), n("processing").alias("active"),
        F.sum(F.when(ok, F.col("found")).otherwise(0)).alias("faces"), F.avg(F.when(ok, F.col("processing_ms"))).alias("avg_ms"), rate(F.count_if(ok & late)).alias("rate"),
    )
    kinds = [F.lit(x) for x in ("receiving", "running", "completed", "receiving", "running", "running")]
    status = F.element_at(F.array(*kinds, F.when(F.col("tenant") < 3, "finalizing").otherwise("queued")), (F.col("batch_id") % 7 + 1).cast("int"))
    whole = b.withColumn("status", status).withColumn("expected", F.when(F.col("batch_id") % 3 > 0, F.col("batch_id") % 90)).withColumn("avg_ms", F.when(F.col("batch_id") % 4 != 1, F.col("avg_ms")))
    return whole, i.where(ok & late).groupBy("tenant").agg(rate(F.count("*")).alias("images_per_s"), rate(F.sum("found")).alias("faces_per_s"))


@query(f"""WITH {SNAPSHOT} SELECT tenant, batch_id, status, shown::BIGINT AS shown, remaining::BIGINT AS remaining, CASE WHEN shown = 0 THEN 0 ELSE round(least(100, completed * 100.0::DOUBLE / shown), 1) END AS progress,
  CASE WHEN status = 'finalizing' THEN NULL WHEN remaining = 0 THEN 0 WHEN rate > 0 THEN greatest(1, ceil(remaining / rate)) WHEN avg_ms > 0 THEN greatest(1, ceil(remaining * avg_ms / 1000)) END::BIGINT AS eta_s FROM f""", "items")
def snapshot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running batches as a snapshot shows them."""
    return snapshot.batches(snapshot_rows(spark, sf_dir)[0]).select("tenant", "batch_id", "status", "shown", "remaining", "progress", "eta_s")


@query(f"""WITH {SNAPSHOT}, g AS (SELECT tenant, count(*)::BIGINT AS running_batches, sum(shown)::BIGINT AS total, sum(completed)::BIGINT AS completed, sum(succeeded)::BIGINT AS succeeded, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped, sum(active)::BIGINT AS active, sum(faces)::BIGINT AS faces,
  bool_or(status = 'finalizing') AS finalizing, sum(CASE WHEN remaining > 0 AND avg_ms > 0 THEN remaining * avg_ms / 1000 ELSE 0 END) AS seconds, bool_or(remaining > 0 AND coalesce(avg_ms, 0) <= 0) AS unknown FROM f GROUP BY 1),
r AS (SELECT tenant, round(count(*)::DOUBLE / 30, 3) AS images_per_s, round(sum(found)::DOUBLE / 30, 3) AS faces_per_s FROM i WHERE late AND status = 'succeeded' GROUP BY 1),
h AS (SELECT * EXCLUDE (images_per_s, faces_per_s), coalesce(images_per_s, 0) AS images_per_s, coalesce(faces_per_s, 0) AS faces_per_s, greatest(0, total - completed)::BIGINT AS remaining FROM g LEFT JOIN r USING (tenant))
SELECT * EXCLUDE (finalizing, seconds, unknown), CASE WHEN finalizing THEN NULL WHEN remaining = 0 THEN 0 WHEN images_per_s > 0 THEN greatest(1, ceil(remaining / images_per_s)) WHEN NOT unknown AND seconds > 0 THEN greatest(1, ceil(seconds)) END::BIGINT AS eta_s FROM h""", "items")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve measures of each tenant's running batches."""
    rows, rates = snapshot_rows(spark, sf_dir)
    return snapshot.summary(snapshot.batches(rows), "tenant", rates)


@query("""WITH b AS (SELECT batch_id, count(*) AS n, count(*) FILTER (status IN ('succeeded', 'failed', 'skipped')) AS done, count(*) FILTER (status = 'failed') AS failed, max(ts) AS updated, bool_or(status = 'processing') AS running FROM items GROUP BY 1)
SELECT batch_id % 10 AS gallery, count(*)::BIGINT AS batches, sum(n)::BIGINT AS total, sum(done)::BIGINT AS completed, sum(greatest(0, n - done))::BIGINT AS remaining, sum(failed)::BIGINT AS failed, bool_or(running) AS running, max(updated) AS updated FROM b GROUP BY 1""", "items")
def client_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of a gallery's batches, each as its latest message says."""
    done = F.col("status").isin("succeeded", "failed", "skipped")
    b = items(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("ts").alias("updated"), F.bool_or(F.col("status") == "processing").alias("running"))
    return b.groupBy((F.col("batch_id") % 10).alias("gallery")).agg(F.count("*").alias("batches"), F.sum("n").alias("total"), F.sum("done").alias("completed"), F.sum(F.greatest(F.lit(0), F.col("n") - F.col("done"))).alias("remaining"), F.sum("failed").alias("failed"), F.bool_or("running").alias("running"), F.max("updated").alias("updated"))


@query(f"""WITH {E}, o AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM e)
SELECT user_id, event_id, ((i * 21600000000 + max(us - i * 21600000000) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) // 1000)::BIGINT AS slot_ms FROM o""")
def paced_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download slots six hours apart for each account."""
    p = paced(events(spark, sf_dir), ["user_id"], "us", "event_id", 21_600_000_000)
    return p.select("user_id", "event_id", F.floor(F.col("slot") / 1000).cast("long").alias("slot_ms"))


@query(f"""WITH {E}, d AS (SELECT event_id, us, row_number() OVER (ORDER BY us, event_id) - 1 AS i FROM e WHERE event_type = 'click'),
s AS (SELECT event_id, us, i * 3000000 * 300 + max(us - i * 3000000 * 300) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS slot FROM d)
SELECT event_id, true AS granted, (slot // 1000)::BIGINT AS slot_ms, ((slot - us) // 1000)::BIGINT AS wait_ms FROM s UNION ALL SELECT event_id, false, NULL, NULL FROM events WHERE event_type = 'error'""")
def global_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gate for the downloads of all accounts, a slot every three seconds (300 of the log's seconds are one); requests whose clock failed are refused and take no slot."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "error")).select("event_id", F.when(F.col("event_type") == "click", F.col("us")).alias("us"))
    p = paced(e, [], "us", "event_id", 3_000_000 * 300)
    ms = lambda c: F.floor(c / 1000).cast("long")
    return p.select("event_id", F.col("slot").isNotNull().alias("granted"), ms(F.col("slot")).alias("slot_ms"), ms(F.col("slot") - F.col("us")).alias("wait_ms"))


@query(f"""WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e),
r AS (SELECT user_id, event_id, i, us AS begin, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN o.us >= r.begin + 86400000000 THEN o.us ELSE r.begin END, CASE WHEN o.us >= r.begin + 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, n <= 2 AS allowed FROM r""")
def scan_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans a day for each user, the day starting with a scan."""
    return anchored_windows(events(spark, sf_dir), ["user_id"], "us", "event_id", 86_400, 2)


@query(f"""WITH {E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS session FROM g)
SELECT user_id, event_type AS message, min(event_id) AS first_event, count(*)::BIGINT AS repeats, (max(us) - min(us))::BIGINT AS lasted_us FROM s GROUP BY 1, 2, session""")
def toast_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a message within twelve hours of each other as one, with a counter."""
    e = events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.col("event_type").alias("message"), F.session_window("at", "12 hours")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("repeats"), (F.max("us") - F.min("us")).alias("lasted_us"))
    return s.select("user_id", "message", "first_event", "repeats", "lasted_us")


@query(f"""WITH {E}, d AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, us, lag(us) OVER w AS then_us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, event_id, round((value - before) / greatest(0.1, (us - then_us) / 1000000.0::DOUBLE), 9) AS speed FROM d WHERE before IS NOT NULL""")
def upload_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change since the sample before, over at least a tenth of a second."""
    rows = spread(events(spark, sf_dir).select("user_id", "event_id", "us", "value"), ["user_id"], ["us", "event_id"])
    d = running(rows, ["user_id"], ["us", "event_id"], last=("before", F.struct("value", "us"))).select("*", F.col("last.value").alias("before"), ((F.col("us") - F.col("last.us")) / 1_000_000.0).alias("dt"))
    return d.where("before is not null").select("user_id", "event_id", F.round((F.col("value") - F.col("before")) / F.greatest(F.lit(0.1), "dt"), 9).alias("speed"))


@query(f"""WITH RECURSIVE {E}, s AS (SELECT user_id, sec AS t, max(value) AS cpu, max((props->>'$.k')::BIGINT % 6) AS queue FROM e GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM s),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS t, 1 AS n, 0 AS good, NULL::BIGINT AS idle, -1000000000000 AS changed, '' AS reason FROM (SELECT DISTINCT user_id FROM s)
UNION ALL SELECT user_id, i, t, CASE WHEN reason IN ('cpu_busy', 'idle') THEN n - 1 WHEN reason = 'grow' THEN n + 1 ELSE n END, CASE WHEN reason = 'hold' THEN good ELSE 0 END, CASE WHEN reason = 'hold' THEN idle END, CASE WHEN reason = 'hold' THEN changed ELSE t END, reason
FROM (SELECT *, CASE WHEN cpu >= 92 AND n > 1 THEN 'cpu_busy' WHEN cpu < 92 AND queue < n AND n > 1 AND t - idle >= 20 AND t - changed >= 30 THEN 'idle' WHEN good >= 3 AND t - changed >= 15 THEN 'grow' ELSE 'hold' END AS reason
  FROM (SELECT o.user_id, o.i, o.t, o.cpu, o.queue, r.n, r.changed, CASE WHEN o.cpu < 92 AND o.queue > r.n AND r.n < 4 THEN r.good + 1 ELSE 0 END AS good, CASE WHEN o.cpu < 92 AND o.queue < r.n THEN coalesce(r.idle, o.t) END AS idle FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)))
SELECT user_id, t, n AS processes, reason FROM r WHERE i > 0""")
def autoscale_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool size of each host after each of its samples."""
    e = events(spark, sf_dir).withColumn("k", F.from_json("props", "k bigint")["k"] % 6)
    s = e.groupBy("user_id", F.col("sec").alias("t")).agg(F.max("value").alias("cpu"), F.max("k").alias("queue"))
    return autoscaled(s, ["user_id"], "t")


@query(f"WITH {E} SELECT user_id, (sec % 120)::INT AS slot, sec AS epoch, count(*)::BIGINT AS images, sum(value > 10)::BIGINT AS faces FROM e GROUP BY 1, 2, 3")
def bucket_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions by ring slot; the epoch in a slot tells rounds of the ring apart."""
    return events(spark, sf_dir).groupBy("user_id", F.pmod("sec", F.lit(120)).cast("int").alias("slot"), F.col("sec").alias("epoch")).agg(F.count("*").alias("images"), F.count_if(F.col("value") > 10).alias("faces"))


LOG = f"""{E}, g AS (SELECT user_id AS batch_id, user_id * 100 + event_id % 20 AS item_id, event_id, us, event_type AS kind, value FROM e),
f AS (SELECT * FROM g WHERE kind IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY us, event_id) = 1)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, item_id, event_id, us, kind: several transitions for each item."""
    return events(spark, sf_dir).select(F.col("user_id").alias("batch_id"), (F.col("user_id") * 100 + F.col("event_id") % 20).alias("item_id"), "event_id", "us", F.col("event_type").alias("kind"), "value")


@query(f"""WITH {LOG}, c AS (SELECT batch_id, count(DISTINCT item_id) AS total FROM g GROUP BY 1), t AS (SELECT batch_id, count(*) AS done, count(*) FILTER (kind = 'purchase') AS ok, count(*) FILTER (kind = 'error') AS failed, sum(CASE WHEN kind = 'purchase' THEN floor(value)::BIGINT % 4 ELSE 0 END) AS faces FROM f GROUP BY 1)
SELECT batch_id, total::BIGINT AS total, coalesce(done, 0)::BIGINT AS completed, coalesce(ok, 0)::BIGINT AS succeeded, coalesce(failed, 0)::BIGINT AS failed, coalesce(faces, 0)::BIGINT AS faces,
  CASE WHEN coalesce(done, 0) < total THEN 'running' WHEN failed >= total THEN 'failed' WHEN failed > 0 THEN 'partial_failed' ELSE 'completed' END AS status FROM c LEFT JOIN t USING (batch_id)""")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each batch from its transitions: an item counts once, by its first terminal transition."""
    g = transitions(spark, sf_dir)
    first = g.where(F.col("kind").isin("purchase", "error")).groupBy("batch_id", "item_id").agg(F.min_by(F.struct("kind", "value"), F.struct("us", "event_id")).alias("x"))
    ok, bad = F.col("x.kind") == "purchase", F.col("x.kind") == "error"
    t = first.groupBy("batch_id").agg(F.count("*").alias("completed"), F.count_if(ok).alias("succeeded"), F.count_if(bad).alias("failed"), F.sum(F.when(ok, F.floor("x.value") % 4).otherwise(0)).alias("faces"))
    rows = g.groupBy("batch_id").agg(F.count_distinct("item_id").alias("total")).join(t, "batch_id", "left").fillna(0)
    status = F.when(F.col("completed") < F.col("total"), "running").otherwise(finished(F.col("failed"), F.col("total")))
    return rows.select("batch_id", "total", "completed", "succeeded", "failed", "faces", status.alias("status"))


@query(f"""WITH {LOG}, l AS (SELECT batch_id, item_id, arg_max(kind, row(us, event_id)) AS kind, max(us) AS us FROM g GROUP BY 1, 2), a AS (SELECT epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS now)
SELECT batch_id, item_id, CASE WHEN kind = 'click' AND us < now - 1020000000 THEN 'requeue' WHEN kind = 'view' AND us < now - 1800000000 AND item_id % 7 = 0 THEN 'cancel_orphan' WHEN kind = 'signup' AND us < now - 21600000000 THEN 'seal' ELSE 'keep' END AS action FROM l, a""")
def stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recovery tick does with each item: expired leases go back to the queue, orphans are cancelled, idle receivers sealed."""
    g = transitions(spark, sf_dir)
    last = g.groupBy("batch_id", "item_id").agg(F.max_by("kind", F.struct("us", "event_id")).alias("kind"), F.max("us").alias("us"))
    age = F.unix_micros(now().cast("timestamp")) - F.col("us")
    kind = F.col("kind")
    action = F.when((kind == "click") & (age > 1_020_000_000), "requeue").when((kind == "view") & (age > 1_800_000_000) & (F.col("item_id") % 7 == 0), "cancel_orphan").when((kind == "signup") & (age > 21_600_000_000), "seal").otherwise("keep")
    return last.select("batch_id", "item_id", action.alias("action"))


@query("""SELECT photo_id, CASE WHEN filename LIKE '1-%' AND status = 'queued' THEN 'drive-downloads' ELSE 'face-processing' END AS queue, (status = 'queued') AS runnable FROM photos WHERE status <> 'done'""", "photos")
def dispatch_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue of each photo: those of a remote drive without an original are downloaded first."""
    remote = F.col("filename").startswith("1-") & (F.col("status") == "queued")
    return photos(spark, sf_dir).where("status <> 'done'").select("photo_id", F.when(remote, "drive-downloads").otherwise("face-processing").alias("queue"), (F.col("status") == "queued").alias("runnable"))


@query("""WITH RECURSIVE t AS (SELECT item_id, CASE WHEN item_id >= 10 THEN item_id // 10 END AS parent_id, status, item_id % 2 AS version FROM items),
s AS (SELECT item_id, parent_id, CASE WHEN status = 'queued' AND item_id % 3 = 0 AND version = 0 THEN 'processing' ELSE status END AS status, CASE WHEN status = 'queued' AND item_id % 3 = 0 AND version = 0 THEN 1 ELSE version END AS version FROM t),
gone AS (SELECT item_id FROM s WHERE status = 'failed' AND item_id % 7 = 0 UNION SELECT s.item_id FROM s JOIN gone ON s.parent_id = gone.item_id)
SELECT * FROM (SELECT item_id, parent_id, status, version FROM s UNION ALL SELECT -1 - item_id, NULL, 'queued', 0 FROM t WHERE item_id % 100 = 0) WHERE item_id NOT IN (SELECT item_id FROM gone)""", "items")
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of items after claims by compare-and-set, new items, and the deletion of failed ones with all below them; each change is applied twice and counts once."""
    path, tree = fresh_path(spark, "items"), F.when(F.col("item_id") >= 10, F.floor(F.col("item_id") / 10).cast("long"))
    rows = items(spark, sf_dir).select("item_id", tree.alias("parent_id"), "status", (F.col("item_id") % 2).alias("version"))
    changes.create(rows, path, "item_id")
    claims = rows.where("status = 'queued' and item_id % 3 = 0").select("item_id", F.lit(0).cast("long").alias("version"), F.lit("processing").alias("status"))
    fresh = rows.where("item_id % 100 = 0").select((-1 - F.col("item_id")).alias("item_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("version"))
    for _ in range(2):
        changes.compare_and_set(spark, path, "item_id", "version", claims)
        changes.insert(spark, path, "item_id", fresh)
        changes.delete_cascade(spark, path, "item_id", "parent_id", rows.where("status = 'failed' and item_id % 7 = 0").select("item_id"))
    return changes.read(spark, path)
