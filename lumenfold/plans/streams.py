"""Streaming queries; their twins are the batch results over the same log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.plans.registry import query
from lumenfold.streaming import events, lifecycle, rates


@query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type, as a stream."""
    return events.tumbling(spark, sf_dir)


@query("SELECT begin, count(*)::BIGINT AS n, round(count(*) / 10800.0::DOUBLE, 9) AS per_second FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS begin FROM events) GROUP BY 1")
def stream_sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate over three hours, each hour, as a stream."""
    return events.sliding(spark, sf_dir)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS begin, count(*)::BIGINT AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, as a stream."""
    return events.sessions(spark, sf_dir)


@query("SELECT user_id * 100 + event_id % 20 AS item_id, count(*)::BIGINT AS n, (count(*) FILTER (event_type = 'error'))::BIGINT AS failed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def stream_dedup_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal transitions delivered twice and counted once."""
    return events.terminal_once(spark, sf_dir)


@query("""WITH g AS (SELECT user_id AS batch_id, user_id * 100 + event_id % 20 AS item_id, event_id, ts, event_type FROM events), f AS (SELECT * FROM g WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts, event_id) = 1)
SELECT batch_id, n::BIGINT AS total, coalesce(ok, 0)::BIGINT AS succeeded, coalesce(bad, 0)::BIGINT AS failed FROM (SELECT batch_id, count(DISTINCT item_id) AS n FROM g GROUP BY 1) LEFT JOIN (SELECT batch_id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS bad FROM f GROUP BY 1) USING (batch_id)""")
def stream_batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each batch from keyed state."""
    return events.batch_state(spark, sf_dir)


#: The fold of every batch's commands in order, a step of the recursion for each; items in lists of six.
LIFECYCLE = """WITH RECURSIVE c AS (
  SELECT user_id AS batch_id, event_id % 6 AS s, epoch_us(ts) // 12000 AS ms, event_id % 4 AS token, CASE WHEN event_id % 2 = 1 THEN event_id % 8 END AS expects, floor(value)::BIGINT % 4 AS found, ['cpu', 'gpu', 'tpu'][event_id % 3 + 1] AS via,
    CASE event_type WHEN 'view' THEN 'append' WHEN 'signup' THEN ['seal', 'finalize', 'create', 'finalize', 'create', 'create', 'create', 'create'][event_id % 8 + 1] WHEN 'click' THEN ['retry', 'claim', 'confirm', 'start', 'start'][event_id % 5 + 1]
      WHEN 'purchase' THEN 'succeeded' ELSE ['skipped', 'failed', 'cancelled'][event_id % 3 + 1] END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 12000, event_id) AS i FROM events
), r AS (
  SELECT DISTINCT user_id AS batch_id, 0::BIGINT AS i, NULL::VARCHAR AS status, NULL::BIGINT AS expected, 0::BIGINT AS total, 0::BIGINT AS completed, 0::BIGINT AS succeeded, 0::BIGINT AS failed, 0::BIGINT AS skipped, 0::BIGINT AS faces, NULL::VARCHAR AS processor,
    0::BIGINT AS attempts, 0::BIGINT AS requeued, 0::BIGINT AS auto_sealed, 0::BIGINT AS rejected, 0::BIGINT AS last_ms, [NULL, NULL, NULL, NULL, NULL, NULL]::VARCHAR[] AS st, [NULL, NULL, NULL, NULL, NULL, NULL]::BIGINT[] AS tk, [NULL, NULL, NULL, NULL, NULL, NULL]::BIGINT[] AS sn FROM events
  UNION ALL
  SELECT batch_id, i,
    CASE WHEN NOT fine THEN status1 WHEN kind = 'create' THEN 'receiving' WHEN kind = 'seal' AND status1 = 'receiving' THEN CASE WHEN total = 0 THEN 'completed' WHEN completed >= total THEN 'finalizing' ELSE 'running' END
      WHEN kind = 'finalize' THEN CASE WHEN failed >= total THEN 'failed' WHEN failed > 0 THEN 'partial_failed' ELSE 'completed' END WHEN kind = 'start' AND status1 = 'finalizing' THEN 'running'
      WHEN ends AND status1 = 'receiving' AND (expected1 IS NULL OR total < expected1) THEN 'receiving' WHEN ends AND completed + 1 >= total THEN 'finalizing' WHEN ends THEN 'running' ELSE status1 END,
    CASE WHEN fine AND kind = 'create' THEN CASE WHEN expects IS NOT NULL THEN greatest(0, expects) END ELSE expected1 END, total + (fine AND kind = 'append')::BIGINT, completed + (fine AND ends)::BIGINT, succeeded + (fine AND kind = 'succeeded')::BIGINT, failed + (fine AND kind = 'failed')::BIGINT,
    skipped + (fine AND kind IN ('skipped', 'cancelled'))::BIGINT, faces + CASE WHEN fine AND ends THEN greatest(0, found) ELSE 0 END,
    CASE WHEN fine AND via <> 'tpu' AND (ends OR kind = 'start' AND status1 IN ('receiving', 'running', 'finalizing')) THEN CASE WHEN coalesce(processor, via) = via THEN via ELSE 'mixed' END ELSE processor END,
    attempts + (fine AND kind = 'start')::BIGINT, requeued + over::BIGINT, auto1, rejected + (NOT fine)::BIGINT,
    CASE WHEN fine AND (ends OR kind IN ('create', 'append', 'finalize') OR kind = 'seal' AND status1 = 'receiving' OR kind = 'start' AND status1 IN ('receiving', 'running', 'finalizing')) THEN ms ELSE last1 END,
    list_transform(range(6), lambda k: CASE WHEN k <> s OR NOT on_item THEN st[k + 1] WHEN NOT fine THEN is1 WHEN ends THEN kind WHEN kind = 'start' THEN 'processing' ELSE 'queued' END),
    list_transform(range(6), lambda k: CASE WHEN k <> s OR NOT on_item THEN tk[k + 1] WHEN NOT fine THEN tk1 WHEN kind IN ('claim', 'start') THEN token WHEN kind = 'confirm' THEN -1 END),
    list_transform(range(6), lambda k: CASE WHEN k <> s OR NOT on_item THEN sn[k + 1] WHEN NOT fine THEN sn1 WHEN kind IN ('claim', 'start', 'confirm') THEN ms END)
  FROM (SELECT *, coalesce(CASE kind WHEN 'create' THEN status1 IS NULL WHEN 'seal' THEN status1 <> 'cancelled' WHEN 'finalize' THEN status1 = 'finalizing' WHEN 'append' THEN status1 = 'receiving' AND is1 IS NULL
      WHEN 'claim' THEN is1 = 'queued' AND (tk1 IS NULL OR sn1 + 1020000 < ms) WHEN 'confirm' THEN is1 = 'queued' AND tk1 = token WHEN 'start' THEN is1 = 'queued' WHEN 'retry' THEN is1 = 'processing' ELSE is1 IN ('queued', 'processing') END, false) AS fine
    FROM (SELECT *, CASE WHEN due THEN CASE WHEN total = 0 THEN 'cancelled' WHEN completed >= total THEN 'finalizing' ELSE 'running' END ELSE status END AS status1, CASE WHEN due THEN total ELSE expected END AS expected1, CASE WHEN due THEN last_ms + 21600001 ELSE last_ms END AS last1,
        auto_sealed + due::BIGINT AS auto1, CASE WHEN over THEN 'queued' ELSE st[s + 1] END AS is1, CASE WHEN NOT over THEN tk[s + 1] END AS tk1, CASE WHEN NOT over THEN sn[s + 1] END AS sn1
      FROM (SELECT r.* EXCLUDE (i), c.* EXCLUDE (batch_id), kind IN ('succeeded', 'failed', 'skipped', 'cancelled') AS ends, kind NOT IN ('create', 'seal', 'finalize') AS on_item, coalesce(status = 'receiving' AND last_ms + 21600001 <= ms, false) AS due,
          coalesce(kind NOT IN ('create', 'seal', 'finalize') AND st[s + 1] = 'processing' AND sn[s + 1] + 1020001 <= ms, false) AS over FROM r JOIN c ON c.batch_id = r.batch_id AND c.i = r.i + 1)))
), z AS (
  SELECT *, coalesce(status = 'receiving' AND last_ms + 21600001 <= w, false) AS due, len(list_filter(range(6), lambda k: st[k + 1] = 'processing' AND sn[k + 1] + 1020001 <= w)) AS over, len(list_filter(st, lambda x: x = 'queued')) AS q, len(list_filter(st, lambda x: x = 'processing')) AS p
  FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY i DESC) = 1), (SELECT max(ms) - 600000 AS w FROM c)
)
SELECT batch_id, CASE WHEN due THEN CASE WHEN total = 0 THEN 'cancelled' WHEN completed >= total THEN 'finalizing' ELSE 'running' END ELSE status END AS status, CASE WHEN due THEN total ELSE expected END AS expected, total, completed, succeeded, failed, skipped, faces, processor,
  (q + over)::BIGINT AS queued, (p - over)::BIGINT AS processing, attempts, requeued + over AS requeued, auto_sealed + due::BIGINT AS auto_sealed, rejected, CASE WHEN due THEN last_ms + 21600001 ELSE last_ms END AS last_ms FROM z"""


@query(LIFECYCLE)
def stream_batch_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch after all its commands, leases and idle hours: create, guarded append, seal, claim, confirm, start, retry, terminal, finalize."""
    return lifecycle.states(events.commands(spark, sf_dir))


@query("""WITH c AS (SELECT user_id AS scope, epoch_us(ts) // 3600000000 AS second, floor(value)::BIGINT % 4 AS faces FROM events), n AS (SELECT scope, max(second) AS now FROM c GROUP BY 1),
w AS (SELECT scope, now, count(*) AS images, sum(faces) AS faces, greatest(1, least(30, now - min(second) + 1)) AS spent FROM c JOIN n USING (scope) WHERE second > now - 30 AND second <= now GROUP BY 1, 2)
SELECT scope, now, images::BIGINT AS images, faces::BIGINT AS faces, round(images::DOUBLE / spent, 3) AS images_per_s, round(faces::DOUBLE / spent, 3) AS faces_per_s FROM w""")
def stream_rate_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each user over the last 30 seconds, from a ring of stamped slots."""
    return rates.rates(events.counts(spark, sf_dir))
