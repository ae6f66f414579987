"""Telemetry tables over the driver's tables. Each has one definition in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPANS_EVENTS = """
SELECT ts AS timestamp, CAST(event_id DIV 10 AS STRING) AS trace_id, CAST(event_id AS STRING) AS span_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id - 1 AS STRING) END AS parent_span_id,
  concat('svc-', CAST(user_id % 8 AS STRING)) AS service, event_type AS operation, CAST(round(value * 1000) AS BIGINT) AS duration_us,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, props AS tags FROM events
"""
_PARENTS = """
SELECT o_orderdate AS timestamp, CAST(o_orderkey AS STRING) AS trace_id, concat('o', CAST(o_orderkey AS STRING)) AS span_id,
  CAST(NULL AS STRING) AS parent_span_id, concat('cust-', CAST(o_custkey % 8 AS STRING)) AS service, o_orderpriority AS operation,
  CAST(round(o_totalprice) AS BIGINT) AS duration_us, CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE 'OK' END AS status FROM orders
"""
_CHILDREN = """
SELECT l_shipdate AS timestamp, CAST(l_orderkey AS STRING) AS trace_id,
  concat('l', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS span_id,
  concat('o', CAST(l_orderkey AS STRING)) AS parent_span_id, concat('supp-', CAST(l_suppkey % 8 AS STRING)) AS service, l_linestatus AS operation,
  CAST(l_quantity * 1000 AS BIGINT) AS duration_us, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END AS status FROM lineitem
"""
SPANS_ORDERS = f"{_PARENTS} UNION ALL {_CHILDREN}"
LOGS_EVENTS = """
SELECT ts AS timestamp, concat('svc-', CAST(user_id % 8 AS STRING)) AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  concat(event_type, ' for user ', CAST(user_id AS STRING)) AS message, props AS tags FROM events
"""
LOGS_DOCS = """
SELECT doc_id, source AS service, CASE WHEN doc_id % 2 = 1 THEN 'ERROR' ELSE 'INFO' END AS level, text AS message FROM documents
"""
METRICS_EVENTS = """
SELECT ts AS timestamp, concat('svc-', CAST(user_id % 8 AS STRING)) AS service, event_type AS name, value, props AS tags FROM events
"""
#: Events as requests that go through four services in a row: an event calls the one whose id is one less. On every fifth day some of the
#: services of a group fail, on each such day and in each group others, so that they fail alone, with callers, with callees and with both.
_MESH = """
SELECT event_id, ts, event_type, value, user_id, event_id % 4 AS hop, (event_id DIV 4) % 3 AS side,
  concat(CASE event_id % 4 WHEN 0 THEN 'edge' WHEN 1 THEN 'app' WHEN 2 THEN 'pay' ELSE 'store' END, CASE (event_id DIV 4) % 3 WHEN 0 THEN '-prod' WHEN 1 THEN '-staging' ELSE '-lab' END) AS service,
  CASE WHEN day(ts) % 5 = 0 AND ((1 + ((day(ts) DIV 5) * 3 + (event_id DIV 4) % 3) % 15) DIV CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) % 2 = 1
    AND event_type IN ('error', 'click') THEN 1 ELSE 0 END AS bad FROM events
"""
SPANS_MESH = f"""
SELECT ts AS timestamp, CAST(event_id DIV 4 AS STRING) AS trace_id, CAST(event_id AS STRING) AS span_id, CASE WHEN hop = 0 THEN NULL ELSE CAST(event_id - 1 AS STRING) END AS parent_span_id, service,
  concat('/', event_type, '/', CAST(user_id % 9 AS STRING), CASE WHEN user_id % 9 < 4 THEN '/list' ELSE '' END) AS operation, CAST(round(value * 1000) AS BIGINT) * (1 + 7 * bad) AS duration_us,
  CASE WHEN bad = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'ERROR' ELSE 'error' END ELSE 'OK' END AS status,
  CASE WHEN bad = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'exception: none left' WHEN user_id % 3 = 1 THEN 'timeout' ELSE 'k=v' END AS tags FROM ({_MESH})
"""
#: What failing services say: each kind of error that is told apart, and some that are not.
LOGS_MESH = f"""
SELECT event_id, ts AS timestamp, service, CASE WHEN bad = 0 THEN 'info' WHEN user_id % 5 = 0 THEN 'Warn' WHEN user_id % 5 = 1 THEN 'FATAL' ELSE 'error' END AS level,
  CASE WHEN bad = 0 THEN concat('served ', event_type, ' for user ', CAST(user_id AS STRING))
  WHEN user_id % 13 = 0 THEN concat('call ', CAST(1000000 + event_id AS STRING), ' timed out after ', CAST(user_id AS STRING), ' ms')
  WHEN user_id % 13 = 1 THEN concat('Connection refused by 10.0.', CAST(user_id % 4 AS STRING), '.7') WHEN user_id % 13 = 2 THEN 'no such host: db-main'
  WHEN user_id % 13 = 3 THEN 'TLS handshake failed' WHEN user_id % 13 = 4 THEN 'Out of memory in worker' WHEN user_id % 13 = 5 THEN concat('query failed for customer ', CAST(user_id AS STRING), '@example.com')
  WHEN user_id % 13 = 6 THEN 'permission denied' WHEN user_id % 13 = 7 THEN concat('too many requests from user ', CAST(user_id AS STRING)) WHEN user_id % 13 = 8 THEN 'Internal Server Error'
  WHEN user_id % 13 = 9 THEN concat('invalid order ', CAST(77000000 + event_id AS STRING)) WHEN user_id % 13 = 10 THEN 'status 500 from upstream' WHEN user_id % 13 = 11 THEN 'deadline exceeded' ELSE concat('gave up on ', event_type) END AS message
  FROM ({_MESH})
"""
#: What is known of services' infrastructure, now and then.
INFRA_MESH = f"SELECT service, ts AS timestamp, event_id, CAST(1 + user_id % 5 AS BIGINT) AS replicas, value AS memory_percent FROM ({_MESH}) WHERE user_id % 7 = 0"
#: Incidents that were settled, in services and with others that failed too.
INCIDENTS_MESH = """
SELECT CAST(o_orderkey AS STRING) AS id, concat(CASE o_custkey % 4 WHEN 0 THEN 'edge' WHEN 1 THEN 'app' WHEN 2 THEN 'pay' ELSE 'store' END, side) AS service,
  CASE WHEN o_orderkey % 3 = 0 THEN 'latency_spike' ELSE 'error_spike' END AS anomaly_type, CAST(concat('2024-01-', right(concat('0', CAST(1 + o_orderkey % 30 AS STRING)), 2)) AS TIMESTAMP) AS timestamp,
  CASE WHEN o_orderkey % 5 < 2 THEN '' WHEN o_custkey % 4 = 0 THEN concat('app', side) WHEN o_custkey % 4 = 3 THEN concat('pay', side) WHEN o_orderkey % 5 = 2 THEN concat(CASE o_custkey % 4 WHEN 1 THEN 'edge' ELSE 'app' END, side)
    WHEN o_orderkey % 5 = 3 THEN concat(CASE o_custkey % 4 WHEN 1 THEN 'pay' ELSE 'store' END, side) WHEN o_custkey % 4 = 1 THEN concat('edge', side, ',pay', side) ELSE concat('app', side, ',store', side) END AS failing,
  o_orderstatus <> 'F' AS fix_succeeded FROM (SELECT *, CASE o_orderkey % 2 WHEN 0 THEN '-prod' ELSE '-staging' END AS side FROM orders)
"""
#: Events as JSON objects with inner objects and lists, fields that some lack, and one that has two types; a few are no JSON.
EVENTS_JSON = """
SELECT event_id, CASE WHEN user_id % 11 = 10 THEN concat('{"cents":', CAST(user_id AS STRING)) ELSE concat('{"cents":', CAST(CAST(round(value * 100) AS BIGINT) AS STRING),
  CASE WHEN user_id % 3 = 0 THEN concat(',"items":[{"n":', CAST(user_id % 5 AS STRING), ',"sku":"s', CAST(event_id % 50 AS STRING), '"},{"n":1}]') WHEN user_id % 3 = 1 THEN ',"items":[]' ELSE '' END,
  CASE WHEN user_id % 7 = 0 THEN ',"note":null' WHEN user_id % 7 = 1 THEN ',"note":"a, {b} é"' ELSE '' END, ',"ref":', CASE WHEN user_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE concat('"r', CAST(event_id AS STRING), '"') END,
  ',"share":', CAST(user_id AS STRING), '.5,"user":{"id":', CAST(user_id AS STRING), ',"kind of":"', event_type, '","vip":', CASE WHEN user_id % 4 = 0 THEN 'true' ELSE 'false' END, '}}') END AS body FROM events
"""
VIEWS = {"events_json": EVENTS_JSON, "spans_mesh": SPANS_MESH, "logs_mesh": LOGS_MESH, "infra_mesh": INFRA_MESH, "incidents_mesh": INCIDENTS_MESH, "spans_events": SPANS_EVENTS, "spans_orders": SPANS_ORDERS, "logs_events": LOGS_EVENTS, "logs_docs": LOGS_DOCS, "metrics_events": METRICS_EVENTS}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows. Column pruning and filters reach the Parquet scans below it."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "lineitem", "documents") if f" {t}" in VIEWS[name]}
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    sql = sql.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    return spark.sql(sql, **tables)


def oracle(*names: str) -> str:
    """The views as common table expressions in DuckDB's words."""

    def words(sql: str) -> str:
        return sql.replace(" DIV ", " // ").replace("STRING", "VARCHAR")

    return "WITH " + ", ".join(f"{n} AS ({words(VIEWS[n])})" for n in names)
