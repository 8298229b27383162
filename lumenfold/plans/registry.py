"""Registry of named queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The roles of sources/roles.py in SQL; a twin names those that it reads.
ROLES = {
    "photos": """photos AS (SELECT o_orderkey AS photo_id, o_custkey AS gallery_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
  o_orderdate AS uploaded_at, floor(o_totalprice)::BIGINT AS size_bytes, o_orderpriority AS filename FROM orders)""",
    "galleries": "galleries AS (SELECT c_custkey AS gallery_id, c_nationkey AS tenant_id, c_name AS name, c_mktsegment AS label, c_acctbal >= 0 AS is_active FROM customer)",
    "tenants": "tenants AS (SELECT n_nationkey AS tenant_id, n_name AS name, n_regionkey AS plan FROM nation)",
    "detections": """detections AS (SELECT l_orderkey AS photo_id, l_suppkey AS cluster_id, l_linenumber AS face_index, l_quantity / 50 AS quality, 1 - l_discount AS confidence, l_returnflag = 'R' AS low_quality,
  l_linestatus AS version, l_shipdate AS created_at, l_partkey AS part_key FROM lineitem)""",
    "clusters": "clusters AS (SELECT s_suppkey AS cluster_id, s_name AS label, s_nationkey AS tenant_id FROM supplier)",
    "items": """items AS (SELECT event_id AS item_id, user_id AS batch_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS status,
  value AS processing_ms, ts FROM events)""",
}


def query(sql: str | None = None, roles: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name; sql: its twin, after the WITH list of the roles."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            heads = [ROLES[r] for r in roles.split()]
            body = sql.strip()
            head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
            if heads and body.startswith(head):
                body = head + ",\n".join(heads) + ",\n" + body[len(head) :]
            elif heads:
                body = "WITH " + ",\n".join(heads) + "\n" + body
            ORACLES[f.__name__] = body
        return f

    return add
