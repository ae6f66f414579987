"""Named queries over the driver's tables, and their SQL.

The driver's events span a month, so windows are days here where they would be minutes in use; the functions take either.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia import shared, views
from obsidia.functions import redact
from obsidia.operators import anomaly, context, events, health, incidents, intervals, templates, tiering, topology
from obsidia.plans import catalog, payloads

Query = Callable[[SparkSession, str], DataFrame]
DAY = 86400
AS_OF = datetime(2024, 1, 30)
FAILED = "coalesce(upper(status), '') = 'ERROR'"
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None, *names: str):
    """Registers a function of views by their names, with its SQL over the same views."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _queries[f.__name__] = lambda spark, sf_dir: f(*[views.load(spark, sf_dir, n) for n in names])
        if sql:
            _sql[f.__name__] = f"{views.oracle(*names)} {sql}"
        return f

    return add


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles of divisions and interpolations, to six places: engines differ in the last bits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _sql_p(p: int) -> str:
    return f"round(quantile_cont(duration_us, {p / 100}) / 1000, 6) AS p{p}_ms"


_HEALTH = f"count(*) AS total, CAST(count(*) FILTER ({FAILED}) AS BIGINT) AS errors, round(count(*) FILTER ({FAILED}) / count(*), 6) AS error_rate"


@query(f"SELECT service, {_HEALTH}, {_sql_p(50)}, {_sql_p(99)}, round(count(*) / 43200.0, 6) AS per_minute FROM spans_events GROUP BY service", "spans_events")
def service_health(spans: DataFrame) -> DataFrame:
    return _r(health.service_health(spans, None, 30 * DAY), "error_rate", "p50_ms", "p99_ms", "per_minute")


@query(f"SELECT service, {_HEALTH}, {_sql_p(50)}, {_sql_p(99)}, round(count(*) / 1440.0, 6) AS per_minute FROM spans_events WHERE timestamp > TIMESTAMP '2024-01-29' AND timestamp <= TIMESTAMP '2024-01-30' GROUP BY service", "spans_events")
def service_health_recent(spans: DataFrame) -> DataFrame:
    return _r(health.service_health(spans, AS_OF, DAY), "error_rate", "p50_ms", "p99_ms", "per_minute")


@query(f"SELECT service, {_sql_p(50)}, {_sql_p(95)}, {_sql_p(99)} FROM spans_events GROUP BY service", "spans_events")
def latency_percentiles(spans: DataFrame) -> DataFrame:
    return _r(health.latency(spans, ["service"], 50, 95, 99).drop("total", "errors"), "p50_ms", "p95_ms", "p99_ms")


@query(f"SELECT service, round(100.0 * count(*) FILTER ({FAILED}) / count(*), 2) AS error_percent FROM spans_events GROUP BY service", "spans_events")
def error_rate_by_service(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service").agg(F.round(health.errors() * 100.0 / F.count("*"), 2).alias("error_percent"))


@query(f"SELECT service, count(*) AS errors FROM spans_events WHERE {FAILED} GROUP BY service", "spans_events")
def errors_by_service(spans: DataFrame) -> DataFrame:
    return spans.where(health.failed()).groupBy("service").agg(F.count("*").alias("errors"))


@query("SELECT level, count(*) AS total FROM logs_events GROUP BY level", "logs_events")
def log_volume_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("total"))


@query("SELECT timestamp, service, level, message FROM logs_events WHERE upper(level) IN ('ERROR', 'WARN', 'FATAL') ORDER BY timestamp DESC, service, message LIMIT 20", "logs_events")
def recent_errors(logs: DataFrame) -> DataFrame:
    return health.recent_errors(logs)


@query("SELECT service, operation, round(avg(duration_us) / 1000, 6) AS avg_ms, count(*) AS total FROM spans_events GROUP BY service, operation ORDER BY avg(duration_us) DESC, service, operation LIMIT 10", "spans_events")
def slow_operations(spans: DataFrame) -> DataFrame:
    return _r(health.slow_operations(spans), "avg_ms")


@query("SELECT caller, callee, count(*) AS calls FROM (SELECT p.service AS caller, c.service AS callee FROM spans_orders p JOIN spans_orders c ON p.span_id = c.parent_span_id) WHERE caller <> callee GROUP BY caller, callee", "spans_orders")
def service_edges(spans: DataFrame) -> DataFrame:
    return topology.edges(spans)


@query("SELECT DISTINCT c.service AS dependency FROM spans_orders p JOIN spans_orders c ON p.span_id = c.parent_span_id WHERE p.service = 'cust-1' AND c.service <> 'cust-1'", "spans_orders")
def dependencies_of(spans: DataFrame) -> DataFrame:
    return topology.dependencies(spans, "cust-1")


def _correlated_sql(direction: str) -> str:
    own, other, status = ("p", "c", "c") if direction == "downstream" else ("c", "p", "p")
    service = "cust-1" if direction == "downstream" else "supp-1"
    failed = f"upper({status}.status) = 'ERROR'"
    return f"""SELECT service, '{direction}' AS direction, total, errors, round(errors / total, 6) AS error_rate, round(avg_ms, 6) AS avg_ms FROM (
      SELECT {other}.service AS service, count(*) AS total, count(*) FILTER ({failed}) AS errors, avg(c.duration_us) / 1000 AS avg_ms
      FROM spans_orders p JOIN spans_orders c ON p.span_id = c.parent_span_id WHERE {own}.service = '{service}' AND {other}.service <> '{service}' GROUP BY ALL
      HAVING count(*) FILTER ({failed}) > 0 ORDER BY count(*) FILTER ({failed}) / count(*) DESC, service LIMIT 5) WHERE errors / total > 0.05"""


@query(_correlated_sql("downstream"), "spans_orders")
def downstream_correlation(spans: DataFrame) -> DataFrame:
    return _r(topology.downstream(spans, "cust-1"), "error_rate", "avg_ms")


@query(_correlated_sql("upstream"), "spans_orders")
def upstream_correlation(spans: DataFrame) -> DataFrame:
    return _r(topology.upstream(spans, "supp-1"), "error_rate", "avg_ms")


def _healthy_sql(own: str, other: str, status: str) -> str:
    return f"SELECT {other}.service, count(*) FILTER (upper({status}.status) = 'ERROR') / nullif(count(*), 0) AS error_rate FROM w p JOIN w c ON p.span_id = c.parent_span_id WHERE {own}.service = 'app-staging' AND {other}.service <> 'app-staging' GROUP BY {other}.service"


@query(
    f"""SELECT service, round(error_rate, 6) AS error_rate FROM (WITH w AS (SELECT * FROM spans_mesh WHERE timestamp > TIMESTAMP '2024-01-19' AND timestamp <= TIMESTAMP '2024-01-21')
      SELECT DISTINCT service, error_rate FROM ({_healthy_sql("p", "c", "c")} UNION ALL {_healthy_sql("c", "p", "p")}) WHERE error_rate < 0.01 OR error_rate IS NULL) ORDER BY service LIMIT 10""",
    "spans_mesh",
)
def healthy_neighbours(spans: DataFrame) -> DataFrame:
    """Around one service, while what it calls fails and what calls it does not."""
    return _r(topology.healthy_neighbours(health.within(spans, datetime(2024, 1, 21), 2 * DAY), "app-staging"), "error_rate")


_NOW, _BASE = "timestamp > TIMESTAMP '2024-01-29'", "timestamp > TIMESTAMP '2024-01-20' AND timestamp < TIMESTAMP '2024-01-27'"


def _interval_sql(name: str, part: str, minutes: int) -> str:
    n, bad = f"count(*) FILTER ({part})", f"count(*) FILTER ({part} AND {FAILED})"
    return f"{n} AS {name}_total, round(coalesce({bad} / nullif({n}, 0), 0), 6) AS {name}_error_rate, round(coalesce(quantile_cont(duration_us, 0.99) FILTER ({part}) / 1000, 0), 6) AS {name}_p99_ms, round({n} / {minutes}, 6) AS {name}_per_minute"


@query(f"SELECT service, {_interval_sql('current', _NOW, 1440)}, {_interval_sql('baseline', _BASE, 10080)} FROM spans_events WHERE timestamp > TIMESTAMP '2024-01-20' AND timestamp <= TIMESTAMP '2024-01-30' GROUP BY service", "spans_events")
def current_vs_baseline(spans: DataFrame) -> DataFrame:
    found = health.current_and_baseline(spans, AS_OF, DAY, 10 * DAY, 3 * DAY)
    return _r(found, *[c for c in found.columns if c.endswith(("rate", "ms", "minute"))])


@query(
    f"""SELECT service, round(r1, 6) AS recent_rate, round(r0, 6) AS earlier_rate, round(greatest(r1, r0), 6) AS peak_rate,
      CASE WHEN n1 = 0 OR n0 = 0 THEN 'unknown' WHEN r1 - r0 > 0.01 THEN 'worsening' WHEN r1 - r0 < -0.01 THEN 'improving' ELSE 'stable' END AS trend FROM (
      SELECT service, n1, n0, CASE WHEN n1 > 0 THEN e1 / n1 ELSE 0 END AS r1, CASE WHEN n0 > 0 THEN e0 / n0 ELSE 0 END AS r0 FROM (SELECT service,
      count(*) FILTER (timestamp > TIMESTAMP '2024-01-25') AS n1, count(*) FILTER (timestamp > TIMESTAMP '2024-01-25' AND {FAILED}) AS e1,
      count(*) FILTER (timestamp <= TIMESTAMP '2024-01-25') AS n0, count(*) FILTER (timestamp <= TIMESTAMP '2024-01-25' AND {FAILED}) AS e0
      FROM spans_events WHERE timestamp > TIMESTAMP '2024-01-15' AND timestamp <= TIMESTAMP '2024-01-30' GROUP BY service))""",
    "spans_events",
)
def error_trend(spans: DataFrame) -> DataFrame:
    return _r(health.error_trend(spans, AS_OF, 5 * DAY, 15 * DAY), "recent_rate", "earlier_rate", "peak_rate")


@query(f"SELECT operation, {_HEALTH}, {_sql_p(99)} FROM spans_orders GROUP BY operation HAVING count(*) FILTER ({FAILED}) > 0 ORDER BY count(*) FILTER ({FAILED}) / count(*) DESC, operation LIMIT 10", "spans_orders")
def affected_endpoints(spans: DataFrame) -> DataFrame:
    return _r(health.affected_endpoints(spans), "error_rate", "p99_ms")


@query(
    f"""SELECT service, operation, max(duration_us) / 1000 AS max_ms, arg_min(status, place) AS status, '' AS error_type, count(*) AS count, row_number() OVER (PARTITION BY service ORDER BY min(place)) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY service ORDER BY timestamp DESC NULLS LAST, operation, duration_us DESC, span_id) AS place FROM spans_orders WHERE {FAILED}) WHERE place <= 60 GROUP BY service, operation""",
    "spans_orders",
)
def failing_traces(spans: DataFrame) -> DataFrame:
    return context.failing_traces(spans).withColumn("place", F.col("place").cast("long"))


def _types_sql(text: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains(lower({text}), '{p}')" for p in phrases)} THEN '{name}'" for name, phrases in redact.ERROR_TYPES)
    return f"CASE {cases} ELSE 'unknown' END"


@query(f"SELECT {_types_sql('message')} AS error_type, count(*) AS total FROM logs_mesh GROUP BY 1", "logs_mesh")
def error_type_class(logs: DataFrame) -> DataFrame:
    return logs.groupBy(redact.error_type(F.col("message")).alias("error_type")).agg(F.count("*").alias("total"))


_DATED = "SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id AS timestamp FROM logs_docs"


def _dated(logs: DataFrame) -> DataFrame:
    return logs.withColumn("timestamp", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)"))


@query(
    f"""SELECT service, count(*) AS messages, {', '.join(f"round(100.0 * count(*) FILTER (kind = '{k}') / count(*), 6) AS {n}" for n, k in (("timeout", "timeout"), ("connection_error", "connection_error"), ("server_error_5xx", "server_error"), ("client_error_4xx", "validation_error")))},
      round(100.0 * count(*) FILTER (kind NOT IN ('timeout', 'connection_error', 'server_error', 'validation_error')) / count(*), 6) AS other FROM (SELECT service, {_types_sql('message')} AS kind FROM (
      SELECT *, row_number() OVER (PARTITION BY service ORDER BY timestamp DESC, message) AS place FROM logs_mesh WHERE upper(level) IN ('ERROR', 'WARN', 'FATAL')) WHERE place <= 100) GROUP BY service""",
    "logs_mesh",
)
def error_breakdown(logs: DataFrame) -> DataFrame:
    return _r(context.error_breakdown(logs), "timeout", "connection_error", "server_error_5xx", "client_error_4xx", "other")


def _re2(rules: list[tuple[str, str]], text: str) -> str:
    for pattern, to in rules:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{to.replace('$', chr(92))}', 'g')"
    return text


@query(f"SELECT doc_id, sha256({_re2(redact.PATTERNS, 'message')}) AS redacted_sha256 FROM logs_docs", "logs_docs")
def redact_text(logs: DataFrame) -> DataFrame:
    return logs.select("doc_id", F.sha2(redact.redact(F.col("message")), 256).alias("redacted_sha256"))


@query(
    f"""SELECT service, CAST(row_number() OVER (PARTITION BY service ORDER BY min(place)) AS INTEGER) AS place, substr(sha256(template), 1, 16) AS hash, arg_min(level, place) AS level, max(timestamp) AS timestamp, count(*) AS count FROM (
      SELECT *, {_re2([*redact.PATTERNS, redact.UUID, redact.NUMERIC_ID], 'message')} AS template FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY timestamp DESC, message) AS place FROM ({_DATED}) WHERE upper(level) IN ('ERROR', 'WARN', 'FATAL')) WHERE place <= 40)
      GROUP BY service, template QUALIFY row_number() OVER (PARTITION BY service ORDER BY min(place)) <= 20""",
    "logs_docs",
)
def log_templates(logs: DataFrame) -> DataFrame:
    return context.log_templates(_dated(logs)).drop("template")


def _mined_sql() -> str:
    """The rounds of merging one after the other, over messages of fewer tokens than the limit."""
    agree = "len(list_filter(list_zip(l.shape, t.top.shape), lambda x: x[1] = x[2] AND x[1] <> '<*>'))"
    steps = ["l0 AS (SELECT shape, count(*) AS n, struct_pack(a := len(shape), b := shape[1]) AS leaf FROM w GROUP BY ALL)"]
    for i in range(4):
        steps.append(f"c{i} AS MATERIALIZED (SELECT l.*, t.top.shape AS leader, l.shape = t.top.shape OR {agree} >= 0.5 * len(l.shape) AS joins FROM l{i} l JOIN (SELECT leaf, max(struct_pack(n := n, shape := shape)) AS top FROM l{i} GROUP BY leaf) t ON l.leaf = t.leaf)")
        steps.append(f"l{i + 1} AS (SELECT shape, n, leaf FROM c{i} WHERE NOT joins)")
    members = " UNION ALL ".join([f"SELECT shape, n, leader FROM c{i} WHERE joins" for i in range(4)] + ["SELECT shape, n, shape FROM l4"])
    return f"""w AS (SELECT list_transform(string_split(message, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') OR length(t) > 64 OR t = '<*>' THEN '<*>' ELSE t END) AS shape FROM logs_mesh WHERE message IS NOT NULL),
      {", ".join(steps)}, g AS (SELECT * FROM ({members})), k AS (SELECT leader FROM g GROUP BY leader HAVING sum(n) >= 5),
      p AS (SELECT leader, i, CASE WHEN count(DISTINCT shape[i]) = 1 THEN min(shape[i]) ELSE '<*>' END AS token FROM g, range(1, 65) t(i) WHERE i <= len(shape) AND leader IN (SELECT leader FROM k) GROUP BY ALL),
      y AS (SELECT leader, string_agg(token, ' ' ORDER BY i) AS template FROM p GROUP BY leader)
      SELECT coalesce(template, '<*>') AS template, substr(sha256(coalesce(template, '<*>')), 1, 16) AS template_id, CAST(sum(n) AS BIGINT) AS messages FROM g LEFT JOIN y ON g.leader = y.leader GROUP BY ALL"""


@query(None, "logs_mesh")
def mined_templates(logs: DataFrame) -> DataFrame:
    """The templates of all messages that services sent."""
    found, _ = templates.mine(logs)
    return found.select(F.array_join("template", " ").alias("template"), "template_id", "messages")


_sql["mined_templates"] = f"{views.oracle('logs_mesh')}, {_mined_sql()}"


@query("SELECT 'mesh' AS source, event_id AS id, sha256(message) AS message_sha256 FROM logs_mesh UNION ALL SELECT 'docs', doc_id, sha256(message) FROM logs_docs", "logs_mesh", "logs_docs")
def template_round_trip(logs: DataFrame, docs: DataFrame) -> DataFrame:
    """Every message, and every document as one, put together again from its template and variables."""
    out = None
    for name, rows in (("mesh", logs.select(F.col("event_id").alias("id"), "message")), ("docs", docs.select(F.col("doc_id").alias("id"), "message"))):
        found, shapes = templates.mine(rows)
        again = templates.decode(templates.encode(rows, shapes), found).select(F.lit(name).alias("source"), "id", F.sha2("message", 256).alias("message_sha256"))
        out = again if out is None else out.unionByName(again)
    return out


@query(
    """SELECT path, kind, count(*) AS occurrences FROM (SELECT regexp_replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '[*]', 'g'), '\\."kind of"', '[''kind of'']', 'g') AS path,
      CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'integer' END AS kind
      FROM (SELECT body::JSON AS j FROM events_json WHERE json_valid(body)) e, json_tree(e.j) t) GROUP BY ALL""",
    "events_json",
)
def event_paths(rows: DataFrame) -> DataFrame:
    """Every path in all events, with its kinds."""
    return events.paths(rows)


@query(
    """SELECT event_id, CAST(j->>'$.cents' AS BIGINT) AS cents, j->>'$.user."kind of"' AS type, CAST(j->>'$.user.vip' AS BOOLEAN) AS vip, CAST(j->>'$.share' AS DOUBLE) AS share, j->>'$.ref' AS ref, json_array_length(j, '$.items') AS items,
      CAST(json_extract_string(j, '$.items[0].n') AS BIGINT) AS first_n, NOT json_valid(body) OR coalesce(json_type(j, '$.note') = 'NULL', false) AS in_rest FROM (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM events_json)""",
    "events_json",
)
def event_columns(rows: DataFrame) -> DataFrame:
    """All events by the columns that their schema has."""
    found = events.shred(rows, events.discover(rows))
    return found.select(
        "event_id", "typed.cents", F.col("typed.user.`kind of`").alias("type"), "typed.user.vip", F.col("typed.share").cast("double").alias("share"), F.expr("variant_get(typed.ref, '$', 'string')").alias("ref"),
        F.when(F.col("typed.items").isNotNull(), F.size("typed.items")).cast("long").alias("items"), F.get("typed.items", F.lit(0))["n"].alias("first_n"), F.col("rest").isNotNull().alias("in_rest"),
    )


@query("SELECT event_id, sha256(body) AS body_sha256 FROM events_json", "events_json")
def event_round_trip(rows: DataFrame) -> DataFrame:
    """Every event, put together again from its columns."""
    return events.restore(events.shred(rows, events.discover(rows))).select("event_id", F.sha2("body", 256).alias("body_sha256"))


def redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", redact.redact_path(F.col("url")).alias("path"))


_queries["redact_paths"] = redact_paths
_sql["redact_paths"] = f"SELECT page_id, {_re2(redact.PATH, 'url')} AS path FROM pages"


@query(
    f"""SELECT window_start, service, {_HEALTH}, {_sql_p(50)}, {_sql_p(99)} FROM (SELECT *, unnest(range(0, 2)) AS k FROM spans_events) s,
      LATERAL (SELECT date_trunc('day', timestamp) - INTERVAL 1 DAY * k AS window_start) GROUP BY window_start, service""",
    "spans_events",
)
def window_health(spans: DataFrame) -> DataFrame:
    return _r(health.sliding_health(spans, "2 days", "1 day"), "error_rate", "p50_ms", "p99_ms")


def _cycles(spans: DataFrame) -> DataFrame:
    return anomaly.cycles(spans, "1 day", 1440)


_CYCLES = f"""c AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY t) AS n FROM (SELECT service, date_trunc('day', timestamp) AS t, count(*) FILTER ({FAILED}) / count(*) AS e,
  quantile_cont(duration_us, 0.99) / 1000 AS p, count(*) / 1440.0::DOUBLE AS r FROM spans_events GROUP BY 1, 2)),
f AS (SELECT service, t, n, e, p, r, e AS ae, p AS ap, r AS ar FROM c WHERE n = 1
  UNION ALL SELECT c.service, c.t, c.n, c.e, c.p, c.r, f.ae * 0.9 + f.e * 0.1, f.ap * 0.9 + f.p * 0.1, f.ar * 0.9 + f.r * 0.1 FROM f JOIN c ON c.service = f.service AND c.n = f.n + 1)"""


def _with_cycles(select: str) -> str:
    return f"{views.oracle('spans_events').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_CYCLES} {select}"


def ema_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(anomaly.baselines(_cycles(views.load(spark, sf_dir, "spans_events"))), "avg_error_rate", "avg_p99_ms", "avg_per_minute")


_queries["ema_baseline"] = ema_baseline
_sql["ema_baseline"] = _with_cycles("SELECT service, t, CAST(n AS INTEGER) AS count, round(ae, 6) AS avg_error_rate, round(ap, 6) AS avg_p99_ms, round(ar, 6) AS avg_per_minute FROM f")


_ANOMALIES = """SELECT service, anomaly_type, CASE WHEN anomaly_type = 'traffic_drop' THEN 'medium' WHEN value / threshold > 5 THEN 'critical' WHEN value / threshold > 3 THEN 'high' WHEN value / threshold > 2 THEN 'medium' ELSE 'low' END AS severity,
  round(value, 6) AS value, round(threshold, 6) AS threshold, t AS detected_at FROM (
  SELECT service, t, 'error_spike' AS anomaly_type, e AS value, greatest(3 * ae, 0.01) AS threshold FROM f WHERE n >= 5 AND ae > 0 AND e > greatest(3 * ae, 0.01)
  UNION ALL SELECT service, t, 'latency_spike', p, greatest(3 * ap, 100) FROM f WHERE n >= 5 AND ap > 0 AND p > greatest(3 * ap, 100)
  UNION ALL SELECT service, t, 'traffic_drop', r / ar, 0.5 FROM f WHERE n >= 5 AND ar > 0 AND r / ar < 0.5)"""


def anomalies_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of a day over all spans."""
    return _r(anomaly.anomalies(_cycles(views.load(spark, sf_dir, "spans_events"))), "value", "threshold")


_queries["anomalies_whole"] = anomalies_whole
_sql["anomalies_whole"] = _with_cycles(_ANOMALIES)


_HOURS = f"""{views.oracle('spans_events').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_CYCLES.replace("date_trunc('day', timestamp)", "date_trunc('hour', timestamp)").replace("1440.0", "60.0")},
o AS ({_ANOMALIES}),
x AS (SELECT a.service, a.anomaly_type, a.detected_at AS t, min(b.detected_at) AS next FROM o a LEFT JOIN o b ON a.service = b.service AND a.anomaly_type = b.anomaly_type AND b.detected_at >= a.detected_at + INTERVAL 6 HOUR GROUP BY ALL),
g AS (SELECT service, anomaly_type, min(t) AS t FROM x GROUP BY ALL UNION ALL SELECT x.service, x.anomaly_type, x.next FROM g JOIN x ON g.service = x.service AND g.anomaly_type = x.anomaly_type AND g.t = x.t WHERE x.next IS NOT NULL)
SELECT o.* FROM o JOIN g ON o.service = g.service AND o.anomaly_type = g.anomaly_type AND o.detected_at = g.t"""


def _hourly(spans: DataFrame) -> DataFrame:
    return anomaly.anomalies(anomaly.cycles(spans, "1 hour", 60), 6 * 3600)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of an hour over all spans, and six hours of quiet after each anomaly of a kind."""
    return _r(_hourly(views.load(spark, sf_dir, "spans_events")), "value", "threshold")


_queries["anomalies"] = anomalies
_sql["anomalies"] = _HOURS


_SILENT = f"""{views.oracle('spans_events').replace('WITH ', 'WITH RECURSIVE ', 1)},
k AS (SELECT service, date_trunc('hour', timestamp) AS t, count(*) FILTER ({FAILED}) / count(*) AS e, quantile_cont(duration_us, 0.99) / 1000 AS p, count(*) / 60.0::DOUBLE AS r FROM spans_events GROUP BY 1, 2),
h AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY service ORDER BY t), greatest(TIMESTAMP '2024-01-31', t + INTERVAL 1 HOUR)) AS next FROM k),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY service ORDER BY t) AS n FROM (SELECT service, t, e, p, r FROM k UNION ALL
  SELECT service, t + INTERVAL 1 HOUR * i, NULL, NULL, 0.0 FROM h, range(1, 31) g(i) WHERE t + INTERVAL 1 HOUR * i < next)),
f AS (SELECT service, t, n, e, p, r, e AS ae, p AS ap, r AS ar FROM c WHERE n = 1
  UNION ALL SELECT c.service, c.t, c.n, c.e, c.p, c.r, CASE WHEN f.e IS NULL THEN f.ae ELSE f.ae * 0.9 + f.e * 0.1 END, CASE WHEN f.p IS NULL THEN f.ap ELSE f.ap * 0.9 + f.p * 0.1 END, f.ar * 0.9 + f.r * 0.1 FROM f JOIN c ON c.service = f.service AND c.n = f.n + 1),
o AS ({_ANOMALIES}),
{_HOURS[_HOURS.index("x AS ("):]}"""


def silent_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As anomalies, and the hours in which a service sends nothing count as cycles without requests."""
    cycles = anomaly.filled(anomaly.cycles(views.load(spark, sf_dir, "spans_events"), "1 hour", 60), 3600, datetime(2024, 1, 31))
    return _r(anomaly.anomalies(cycles, 6 * 3600), "value", "threshold")


_queries["silent_anomalies"] = silent_anomalies
_sql["silent_anomalies"] = _SILENT


def active_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.active(anomalies(spark, sf_dir), AS_OF, DAY)


_queries["active_anomalies"] = active_anomalies
_sql["active_anomalies"] = f"SELECT * FROM ({_HOURS}) WHERE detected_at > TIMESTAMP '2024-01-29' AND detected_at <= TIMESTAMP '2024-01-30'"


def _correlated(spans: DataFrame) -> DataFrame:
    """A row a supplier: what calls it and fails."""
    services = spans.select("service").distinct()
    c = topology.correlations(spans, services).select(F.col("of").alias("service"), F.struct("service", "direction", "error_rate").alias("c"))
    grouped = c.groupBy("service").agg(F.sort_array(F.collect_list("c")).alias("correlations"))
    return services.join(grouped, "service", "left").withColumn("anomaly_type", F.lit("error_spike"))


_CORRELATIONS = """, k AS (SELECT p.service AS a, c.service AS b, upper(p.status) = 'ERROR' AS pe, upper(c.status) = 'ERROR' AS ce FROM spans_orders p JOIN spans_orders c ON p.span_id = c.parent_span_id WHERE p.service <> c.service),
x AS (SELECT a AS service, b AS other, 'downstream' AS direction, count(*) FILTER (ce) / count(*) AS rate FROM k GROUP BY a, b UNION ALL SELECT b, a, 'upstream', count(*) FILTER (pe) / count(*) FROM k GROUP BY a, b),
y AS (SELECT *, row_number() OVER (PARTITION BY service, direction ORDER BY rate DESC, other) AS place FROM x WHERE rate > 0),
z AS (SELECT s.service, coalesce(string_agg(other, ',' ORDER BY other), '') AS names, count(other) FILTER (direction = 'upstream') AS up, count(other) FILTER (direction = 'downstream') AS down
  FROM (SELECT DISTINCT service FROM spans_orders) s LEFT JOIN (SELECT * FROM y WHERE place <= 5 AND rate > 0.05) y ON y.service = s.service GROUP BY s.service)"""


@query(None, "spans_mesh")
def scope_class(spans: DataFrame) -> DataFrame:
    """Each service on each day: what around it failed, alone, with callers, with callees or with both."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    points = spans.select("service", day.alias("at")).distinct()
    c = topology.correlated(topology.around(spans, points, DAY)).groupBy("service", "at").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("service"), "direction", "error_rate"))).alias("correlations"))
    found = incidents.scope(points.join(c, ["service", "at"], "left"))
    return found.select("service", F.col("at").alias("until"), "scope", F.size("failing_deps").alias("failing"))


@query(None, "spans_orders")
def fingerprint(spans: DataFrame) -> DataFrame:
    c = F.coalesce("correlations", F.array().cast("array<struct<service:string,direction:string,error_rate:double>>"))
    return _correlated(spans).select("service", incidents.fingerprint(F.col("service"), F.col("anomaly_type"), c).alias("fingerprint"))


_sql["scope_class"] = f"""{views.oracle('spans_mesh')}, p AS (SELECT DISTINCT service, date_trunc('day', timestamp) + INTERVAL 1 DAY AS until FROM spans_mesh),
q AS (SELECT b.service AS caller, c.service AS callee, b.timestamp AS t, c.timestamp AS u, upper(b.status) = 'ERROR' AS be, upper(c.status) = 'ERROR' AS ce FROM spans_mesh b JOIN spans_mesh c ON b.span_id = c.parent_span_id WHERE b.service <> c.service),
r AS (SELECT p.service, p.until, o AS other, d, count(*) FILTER (bad) / count(*) AS rate FROM p JOIN (SELECT caller AS service, callee AS o, 'down' AS d, ce AS bad, t, u FROM q UNION ALL SELECT callee, caller, 'up', be, t, u FROM q) z
  ON z.service = p.service AND t > until - INTERVAL 1 DAY AND t <= until AND u <= until GROUP BY ALL),
y AS (SELECT * FROM r WHERE rate > 0.05 QUALIFY row_number() OVER (PARTITION BY service, until, d ORDER BY rate DESC, other) <= 5)
SELECT p.service, p.until, CASE WHEN bool_or(d = 'up') AND bool_or(d = 'down') THEN 'cascading' WHEN bool_or(d = 'up') THEN 'upstream' WHEN bool_or(d = 'down') THEN 'downstream' ELSE 'isolated' END AS scope, CAST(count(d) AS INTEGER) AS failing
FROM p LEFT JOIN y ON y.service = p.service AND y.until = p.until GROUP BY p.service, p.until"""
_sql["fingerprint"] = f"{views.oracle('spans_orders')}{_CORRELATIONS} SELECT service, substr(sha256(service || '|error_spike|' || names), 1, 16) AS fingerprint FROM z"

_INCIDENTS = "SELECT CAST(o_orderkey AS {s}) AS id, concat('f', CAST(o_custkey % 50 AS {s})) AS fingerprint, o_orderdate AS timestamp, concat('fix-', o_orderpriority) AS applied_fix, o_orderstatus <> 'F' AS fix_succeeded, CAST(floor(o_totalprice) AS INTEGER) AS time_to_resolve_seconds FROM {t}"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_INCIDENTS.format(s="STRING", t="{orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


_WITH_INCIDENTS = f"WITH i AS ({_INCIDENTS.format(s='VARCHAR', t='orders')})"


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(incidents.confidence(_history(spark, sf_dir)), "confidence")


def fix_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.successful_fixes(_history(spark, sf_dir))


def time_to_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.time_to_resolve(_history(spark, sf_dir))


def incident_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.history(_history(spark, sf_dir)).select("fingerprint", F.col("place").cast("long").alias("place"), "id", "timestamp", "fix_succeeded")


for _f in (confidence, fix_history, time_to_resolve, incident_lookup):
    _queries[_f.__name__] = _f
_PLACED = "SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY timestamp DESC, id) AS place FROM i QUALIFY place <= 10"
_sql["confidence"] = f"{_WITH_INCIDENTS} SELECT fingerprint, count(*) AS matches, round(least(1.0, count(*) FILTER (fix_succeeded) / count(*) + least(count(*) / 10, 0.2) + CASE WHEN max(CASE WHEN place = 1 THEN fix_succeeded END) THEN 0.1 ELSE 0 END), 6) AS confidence FROM ({_PLACED}) GROUP BY fingerprint"
_sql["fix_history"] = f"{_WITH_INCIDENTS} SELECT applied_fix, max(timestamp) AS last_worked FROM i WHERE fix_succeeded AND applied_fix <> '' GROUP BY applied_fix ORDER BY last_worked DESC, applied_fix LIMIT 5"
_sql["time_to_resolve"] = f"{_WITH_INCIDENTS} SELECT fingerprint, CAST(floor(coalesce(avg(time_to_resolve_seconds) FILTER (fix_succeeded), 0)) AS BIGINT) AS seconds FROM i GROUP BY fingerprint"
_sql["incident_lookup"] = f"{_WITH_INCIDENTS} SELECT fingerprint, place, id, timestamp, fix_succeeded FROM ({_PLACED})"


@query("SELECT service, name, date_trunc('day', timestamp) AS day, count(*) AS points, string_agg(CAST(value AS VARCHAR), ',' ORDER BY timestamp, value) AS series FROM metrics_events GROUP BY 1, 2, 3", "metrics_events")
def series_points(metrics: DataFrame) -> DataFrame:
    """All points of each series, in order of time: a row a day, so no group holds more than a day."""
    points = F.sort_array(F.collect_list(F.struct("timestamp", "value")))
    listed = F.array_join(F.transform(points, lambda p: p["value"].cast("string")), ",")
    return metrics.groupBy("service", "name", F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("points"), listed.alias("series"))


@query(
    """SELECT s.span_id, s.service, s.timestamp, m.value, m.timestamp AS measured_at FROM spans_events s ASOF LEFT JOIN
      (SELECT service, timestamp, max(value) AS value FROM metrics_events WHERE name = 'view' GROUP BY service, timestamp) m ON m.service = s.service AND m.timestamp <= s.timestamp""",
    "spans_events", "metrics_events",
)
def span_metrics(spans: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each span with the last value of its service's metric by then."""
    states = metrics.where("name = 'view'").select("service", "timestamp", "value")
    return intervals.as_of(spans.select("span_id", "service", "timestamp"), states, DAY).select("span_id", "service", "timestamp", "state.value", F.col("state.timestamp").alias("measured_at"))


@query("SELECT tier, count(*) AS rows, min(timestamp) AS oldest, max(timestamp) AS newest FROM (SELECT timestamp, CASE WHEN timestamp < TIMESTAMP '2024-01-23' THEN 'cold' WHEN timestamp < TIMESTAMP '2024-01-29 23:00:00' THEN 'warm' ELSE 'hot' END AS tier FROM spans_events) GROUP BY tier", "spans_events")
def tier_assign(spans: DataFrame) -> DataFrame:
    return tiering.assigned(spans, AS_OF).groupBy("tier").agg(F.count("*").alias("rows"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


_TIER = "CASE WHEN timestamp < TIMESTAMP '2024-01-23' THEN 'cold' WHEN timestamp < TIMESTAMP '2024-01-29 23:00:00' THEN 'warm' ELSE 'hot' END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS table, {_TIER} AS tier, count(*) AS rows FROM {t}_events GROUP BY 2" for t in ("spans", "logs", "metrics")), "spans_events", "logs_events", "metrics_events")
def tier_stats(spans: DataFrame, logs: DataFrame, metrics: DataFrame) -> DataFrame:
    return tiering.tier_stats({k: tiering.assigned(v, AS_OF) for k, v in (("spans", spans), ("logs", logs), ("metrics", metrics))})


def stored_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans written to storage and aged: what the files of each tier say of themselves."""
    path = shared.path(spark, "spans")
    tiering.append(views.load(spark, sf_dir, "spans_events"), path)
    tiering.run(spark, path, AS_OF)
    return tiering.stored(spark, path).select("tier", "rows", "oldest", "newest", ((F.col("packed") > 0) & (F.col("packed") <= F.col("bytes")) & (F.col("packed") < F.col("unpacked"))).alias("smaller"))


_queries["stored_tiers"] = stored_tiers
_sql["stored_tiers"] = f"""{views.oracle('spans_events')} SELECT tier, count(*) AS rows, min(timestamp) AS oldest, max(timestamp) AS newest, true AS smaller FROM (
  SELECT timestamp, CASE WHEN timestamp < TIMESTAMP '2024-01-23' THEN 'cold' WHEN timestamp < TIMESTAMP '2024-01-29 23:00:00' THEN 'warm' ELSE 'hot' END AS tier FROM spans_events) GROUP BY tier"""


@query("SELECT data_type, count(*) AS blocks, CAST(sum(b) AS BIGINT) AS original, CAST(sum(a) AS BIGINT) AS compressed, round(avg(b / a), 6) AS avg_ratio, round((1 - sum(a) / sum(b)) * 100, 6) AS saved_percent FROM (SELECT operation AS data_type, duration_us + 10 AS b, 5 + duration_us // 4 AS a FROM spans_events) GROUP BY ROLLUP (data_type)", "spans_events")
def block_stats(spans: DataFrame) -> DataFrame:
    """Blocks of known sizes, made from spans."""
    a, b = F.expr("5 + duration_us DIV 4"), F.col("duration_us") + 10
    blocks = spans.select(F.col("operation").alias("data_type"), b.alias("original_size"), a.alias("compressed_size"), (b / a).alias("compression_ratio"))
    return _r(tiering.block_stats(blocks), "avg_ratio", "saved_percent")


@query("SELECT min(timestamp) AS oldest, max(timestamp) AS newest FROM spans_events", "spans_events")
def time_bounds(spans: DataFrame) -> DataFrame:
    return spans.agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


@query("SELECT timestamp, trace_id, span_id, parent_span_id, service, operation, duration_us, status, tags FROM spans_events WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11'", "spans_events")
def hot_extract(spans: DataFrame) -> DataFrame:
    return spans.where("timestamp >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND timestamp < TIMESTAMP_NTZ '2024-01-11 00:00:00'")


_EXTRACT = "WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11'"


@query(f"SELECT timestamp, service, level, message, tags FROM logs_events {_EXTRACT}", "logs_events")
def hot_extract_logs(logs: DataFrame) -> DataFrame:
    return logs.where("timestamp >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND timestamp < TIMESTAMP_NTZ '2024-01-11 00:00:00'")


@query(f"SELECT timestamp, service, name, value, tags FROM metrics_events {_EXTRACT}", "metrics_events")
def hot_extract_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.where("timestamp >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND timestamp < TIMESTAMP_NTZ '2024-01-11 00:00:00'")


@query("SELECT date_trunc('day', timestamp) AS day, count(*) AS rows FROM spans_events WHERE timestamp >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY GROUP BY 1", "spans_events")
def retention_filter(spans: DataFrame) -> DataFrame:
    kept = tiering.retained(spans, datetime(2024, 2, 15), "FREE")
    return kept.groupBy(F.to_date("timestamp").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("rows"))


@query("SELECT DISTINCT service AS value FROM spans_events WHERE service IS NOT NULL ORDER BY 1 LIMIT 20", "spans_events")
def distinct_values(spans: DataFrame) -> DataFrame:
    return catalog.distinct_values(spans, "service")


@query("SELECT 'spans' AS table, count(*) AS rows FROM spans_events UNION ALL SELECT 'logs', count(*) FROM logs_events UNION ALL SELECT 'metrics', count(*) FROM metrics_events", "spans_events", "logs_events", "metrics_events")
def table_counts(spans: DataFrame, logs: DataFrame, metrics: DataFrame) -> DataFrame:
    return catalog.table_counts({"spans": spans, "logs": logs, "metrics": metrics})


@query("SELECT service AS service_id, count(*) AS calls, round(avg(duration_us / 1000), 6) AS latency, count(*) FILTER (upper(status) = 'ERROR') AS bad FROM spans_events GROUP BY service", "spans_events")
def compat_sql(spans: DataFrame) -> DataFrame:
    """SQL by other names of the columns."""
    catalog.register({"spans": spans})
    return catalog.run_sql(spans.sparkSession, "SELECT service_id, count(*) AS calls, round(avg(latency_ms), 6) AS latency, count_if(has_error) AS bad FROM spans GROUP BY service_id")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health summary as columns: how many services are healthy and degraded, each service's health, and active anomalies."""
    made = health.summary(health.service_health(views.load(spark, sf_dir, "spans_mesh"), datetime(2024, 1, 26), DAY), anomaly.active(_spells(spark, sf_dir), datetime(2024, 1, 26), DAY))
    services = F.transform("services", lambda s: F.concat_ws(" ", s["service"], s["total"], s["errors"], F.round(s["error_rate"], 6), F.round(s["p99_ms"], 3)))
    found = F.transform("anomalies", lambda a: F.concat_ws(" ", a["service"], a["anomaly_type"], a["severity"]))
    return made.select("healthy", "degraded", F.array_join(services, ";").alias("services"), F.array_join(found, ";").alias("anomalies"))


def summary_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health summary as it is sent: one JSON payload."""
    spans = views.load(spark, sf_dir, "spans_events")
    return health.summary_payload(health.summary(health.service_health(spans, AS_OF, DAY), active_anomalies(spark, sf_dir)))


def _spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of all requests, in cycles of six hours."""
    return anomaly.anomalies(anomaly.cycles(views.load(spark, sf_dir, "spans_mesh"), "6 hours", 360), 6 * 3600)


_LOOKBACK, _CYCLE = 18 * 3600, 6 * 3600


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = views.load(spark, sf_dir, "incidents_mesh").withColumn("fingerprint", redact.short_hash(F.concat_ws("|", "service", "anomaly_type", "failing")))
    spans, logs, infra = (views.load(spark, sf_dir, f"{n}_mesh") for n in ("spans", "logs", "infra"))
    return context.bundles(_spells(spark, sf_dir), spans, logs, past, None, _LOOKBACK, _CYCLE, infra)


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every anomaly of all requests, each at its own time, as columns."""
    b = _bundles(spark, sf_dir)
    listed = lambda c, *fields: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[f(x) for f in fields])), ";"), F.lit("")).alias(c)
    of = lambda k, places=None: (lambda x: x[k] if places is None else F.round(x[k], places))
    kinds = ("timeout", "connection_error", "server_error_5xx", "client_error_4xx", "other")
    return b.select(
        "service", "anomaly_type", "severity", "detected_at", *[F.round(c, 6).alias(c) for c in ("value", "threshold", "error_rate", "error_rate_baseline", "p99_ms", "p99_ms_baseline", "per_minute", "per_minute_baseline")],
        *[F.round(f"error_breakdown.{k}", 6).alias(k) for k in kinds], listed("logs", of("hash"), of("level"), of("count")), listed("traces", of("operation"), of("max_ms", 3), of("status"), of("error_type"), of("count")),
        listed("endpoints", of("operation"), of("total"), of("errors"), of("error_rate", 6), of("p99_ms", 3)), listed("correlations", of("service"), of("direction"), of("error_rate", 6)),
        *[F.round(f"trend.{k}_rate", 6).alias(f"{k}_rate") for k in ("recent", "earlier", "peak")], F.col("trend.trend").alias("trend"), "scope", F.array_join(F.sort_array("healthy_deps"), ",").alias("healthy_deps"),
        F.array_join("failing_deps", ",").alias("failing_deps"), "namespace", "fingerprint", "matches", F.round("confidence", 6).alias("confidence"), F.col("infra.replicas").alias("replicas"), F.col("infra.memory_percent").alias("memory_percent"),
    )


def bundle_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as it is sent: JSON."""
    return context.payloads(_bundles(spark, sf_dir)).select("service", "payload", "bytes")


_SPELLS = (
    f"{views.oracle('spans_mesh', 'logs_mesh', 'infra_mesh', 'incidents_mesh').replace('WITH ', 'WITH RECURSIVE ', 1)}, "
    + _CYCLES.replace("date_trunc('day', timestamp)", "time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '2024-01-01')").replace("1440.0", "360.0").replace("FROM spans_events", "FROM spans_mesh")
    + f""", o AS ({_ANOMALIES}),
x AS (SELECT a.service, a.anomaly_type, a.detected_at AS t, min(b.detected_at) AS next FROM o a LEFT JOIN o b ON a.service = b.service AND a.anomaly_type = b.anomaly_type AND b.detected_at >= a.detected_at + INTERVAL 6 HOUR GROUP BY ALL),
g AS (SELECT service, anomaly_type, min(t) AS t FROM x GROUP BY ALL UNION ALL SELECT x.service, x.anomaly_type, x.next FROM g JOIN x ON g.service = x.service AND g.anomaly_type = x.anomaly_type AND g.t = x.t WHERE x.next IS NOT NULL),
a AS MATERIALIZED (SELECT o.*, o.detected_at + INTERVAL 6 HOUR AS seen FROM o JOIN g ON o.service = g.service AND o.anomaly_type = g.anomaly_type AND o.detected_at = g.t),
s AS MATERIALIZED (SELECT * FROM spans_mesh)"""
)
_BAD_LEVEL = "upper(level) IN ('ERROR', 'WARN', 'FATAL')"
_BUNDLES = f"""{_SPELLS},
p AS MATERIALIZED (SELECT DISTINCT service, seen FROM a),
m AS (SELECT p.service, p.seen, {', '.join(f"count(*) FILTER ({part}) AS {k}n, count(*) FILTER ({part} AND {FAILED}) AS {k}e, quantile_cont(duration_us, 0.99) FILTER ({part}) / 1000 AS {k}p"
    for k, part in (("n", "timestamp > seen - INTERVAL 6 HOUR"), ("l", "timestamp > seen - INTERVAL 18 HOUR"), ("b", "timestamp < seen - INTERVAL 18 HOUR")))}
  FROM p JOIN s ON s.service = p.service AND timestamp > seen - INTERVAL 72 HOUR AND timestamp <= seen GROUP BY ALL),
m2 AS (SELECT *, ln - nn AS en, le - ne AS ee, CASE WHEN nn > 0 THEN ne / nn ELSE 0 END AS recent, CASE WHEN ln - nn > 0 THEN (le - ne) / (ln - nn) ELSE 0 END AS earlier FROM m),
w AS (SELECT p.service, p.seen, l.timestamp, l.level, l.message, row_number() OVER (PARTITION BY p.service, p.seen ORDER BY timestamp DESC, message) AS place FROM p JOIN logs_mesh l ON l.service = p.service AND timestamp > seen - INTERVAL 18 HOUR AND timestamp <= seen WHERE {_BAD_LEVEL}),
k AS (SELECT service, seen, {', '.join(f"round(100.0 * count(*) FILTER (kind = '{k}') / count(*), 6) AS {n}" for n, k in (("timeout", "timeout"), ("connection_error", "connection_error"), ("server_error_5xx", "server_error"), ("client_error_4xx", "validation_error")))},
  round(100.0 * count(*) FILTER (kind NOT IN ('timeout', 'connection_error', 'server_error', 'validation_error')) / count(*), 6) AS other FROM (SELECT service, seen, {_types_sql('message')} AS kind FROM w WHERE place <= 100) GROUP BY ALL),
t AS (SELECT service, seen, string_agg(substr(sha256(template), 1, 16) || ' ' || level || ' ' || n, ';' ORDER BY first) AS logs FROM (SELECT service, seen, template, arg_min(level, place) AS level, count(*) AS n, min(place) AS first
  FROM (SELECT *, {_re2([*redact.PATTERNS, redact.UUID, redact.NUMERIC_ID], 'message')} AS template FROM w WHERE place <= 40) GROUP BY service, seen, template QUALIFY row_number() OVER (PARTITION BY service, seen ORDER BY min(place)) <= 20) GROUP BY ALL),
f1 AS (SELECT p.service, p.seen, s.*, {_re2(redact.PATH, 'operation')} AS op, row_number() OVER (PARTITION BY p.service, p.seen ORDER BY timestamp DESC, operation, duration_us DESC, span_id) AS place FROM p JOIN s ON s.service = p.service AND timestamp > seen - INTERVAL 18 HOUR AND timestamp <= seen WHERE {FAILED}),
f2 AS (SELECT service, seen, op, max(duration_us) / 1000 AS ms, arg_min(status, place) AS status, arg_min(CASE WHEN contains(coalesce(tags, ''), 'error') OR contains(coalesce(tags, ''), 'exception') THEN 'exception' WHEN contains(coalesce(tags, ''), 'timeout') THEN 'timeout' ELSE '' END, place) AS kind, count(*) AS n, min(place) AS first
  FROM f1 WHERE place <= 60 GROUP BY service, seen, op QUALIFY row_number() OVER (PARTITION BY service, seen ORDER BY min(place)) <= 30),
tr AS (SELECT service, seen, string_agg(op || ' ' || round(ms, 3) || ' ' || status || ' ' || kind || ' ' || n, ';' ORDER BY first) AS traces FROM f2 GROUP BY ALL),
e1 AS (SELECT p.service, p.seen, operation, count(*) AS n, count(*) FILTER ({FAILED}) AS e, quantile_cont(duration_us, 0.99) / 1000 AS ms FROM p JOIN s ON s.service = p.service AND timestamp > seen - INTERVAL 18 HOUR AND timestamp <= seen GROUP BY ALL HAVING count(*) FILTER ({FAILED}) > 0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY service, seen ORDER BY e / n DESC, operation) AS place FROM e1 QUALIFY place <= 10),
ep AS (SELECT service, seen, string_agg({_re2(redact.PATH, 'operation')} || ' ' || n || ' ' || e || ' ' || round(e / n, 6) || ' ' || round(ms, 3), ';' ORDER BY place) AS endpoints FROM e2 GROUP BY ALL),
q AS (SELECT b.service AS caller, c.service AS callee, b.timestamp AS t, c.timestamp AS u, upper(b.status) = 'ERROR' AS be, upper(c.status) = 'ERROR' AS ce FROM s b JOIN s c ON b.span_id = c.parent_span_id WHERE b.service <> c.service),
r AS (SELECT p.service, p.seen, o AS other, d AS direction, count(*) AS n, count(*) FILTER (bad) AS e FROM p JOIN (SELECT caller AS service, callee AS o, 'downstream' AS d, ce AS bad, t, u FROM q UNION ALL SELECT callee, caller, 'upstream', be, t, u FROM q) z
  ON z.service = p.service AND t > seen - INTERVAL 18 HOUR AND t <= seen AND u <= seen GROUP BY ALL),
cr AS (SELECT *, e / n AS rate FROM r WHERE e > 0 QUALIFY row_number() OVER (PARTITION BY service, seen, direction ORDER BY e / n DESC, other) <= 5),
cs AS (SELECT service, seen, string_agg(other || ' ' || direction || ' ' || round(rate, 6), ';' ORDER BY other, direction) AS correlations, count(*) AS n, count(*) FILTER (direction = 'upstream') AS up, count(*) FILTER (direction = 'downstream') AS down,
  string_agg(other, ',' ORDER BY direction DESC, other) AS failing, string_agg(other, ',' ORDER BY other) AS names FROM cr WHERE rate > 0.05 GROUP BY ALL),
h AS (SELECT service, seen, string_agg(other, ',' ORDER BY other) AS healthy FROM (SELECT DISTINCT service, seen, other FROM r WHERE e / n < 0.01) GROUP BY ALL),
b AS (SELECT a.*, m2.* EXCLUDE (service, seen), k.* EXCLUDE (service, seen), t.logs, tr.traces, ep.endpoints, cs.correlations, cs.up, cs.down, cs.failing, h.healthy, substr(sha256(a.service || '|' || a.anomaly_type || '|' || coalesce(cs.names, '')), 1, 16) AS fingerprint
  FROM a LEFT JOIN m2 USING (service, seen) LEFT JOIN k USING (service, seen) LEFT JOIN t USING (service, seen) LEFT JOIN tr USING (service, seen) LEFT JOIN ep USING (service, seen) LEFT JOIN cs USING (service, seen) LEFT JOIN h USING (service, seen)),
i AS (SELECT *, substr(sha256(service || '|' || anomaly_type || '|' || failing), 1, 16) AS fingerprint FROM incidents_mesh),
c1 AS (SELECT b.service, b.anomaly_type, b.seen, i.fix_succeeded AS ok, row_number() OVER (PARTITION BY b.service, b.anomaly_type, b.seen ORDER BY i.timestamp DESC, i.id) AS place FROM b JOIN i ON i.fingerprint = b.fingerprint AND i.timestamp <= b.seen QUALIFY place <= 10),
cf AS (SELECT service, anomaly_type, seen, count(*) AS matches, least(1.0, count(*) FILTER (ok) / count(*) + least(count(*) / 10, 0.2) + CASE WHEN bool_or(ok AND place = 1) THEN 0.1 ELSE 0 END) AS confidence FROM c1 GROUP BY ALL),
n AS (SELECT service, timestamp, arg_max(replicas, event_id) AS replicas, arg_max(memory_percent, event_id) AS memory_percent FROM infra_mesh GROUP BY ALL)
SELECT b.service, b.anomaly_type, b.severity, b.detected_at, b.value, b.threshold, round(recent, 6) AS error_rate, round(CASE WHEN bn > 0 THEN be / bn ELSE 0 END, 6) AS error_rate_baseline, round(coalesce(np, 0), 6) AS p99_ms, round(coalesce(bp, 0), 6) AS p99_ms_baseline,
  round(nn / 360.0, 6) AS per_minute, round(bn / 3240.0, 6) AS per_minute_baseline, timeout, connection_error, server_error_5xx, client_error_4xx, other, coalesce(logs, '') AS logs, coalesce(traces, '') AS traces, coalesce(endpoints, '') AS endpoints, coalesce(correlations, '') AS correlations,
  CASE WHEN ln > 0 THEN round(recent, 6) END AS recent_rate, CASE WHEN ln > 0 THEN round(earlier, 6) END AS earlier_rate, CASE WHEN ln > 0 THEN round(greatest(recent, earlier), 6) END AS peak_rate,
  CASE WHEN ln = 0 THEN NULL WHEN en = 0 OR nn = 0 THEN 'unknown' WHEN recent - earlier > 0.01 THEN 'worsening' WHEN recent - earlier < -0.01 THEN 'improving' ELSE 'stable' END AS trend,
  CASE WHEN up > 0 AND down > 0 THEN 'cascading' WHEN up > 0 THEN 'upstream' WHEN down > 0 THEN 'downstream' ELSE 'isolated' END AS scope, CASE WHEN correlations IS NULL THEN coalesce(healthy, '') ELSE '' END AS healthy_deps, coalesce(failing, '') AS failing_deps,
  CASE WHEN contains(b.service, '-prod') THEN 'production' WHEN contains(b.service, '-staging') THEN 'staging' ELSE 'default' END AS namespace, fingerprint, coalesce(matches, 0) AS matches, round(coalesce(confidence, 0), 6) AS confidence, n.replicas, n.memory_percent
FROM (SELECT b.*, cf.matches, cf.confidence FROM b LEFT JOIN cf ON cf.service = b.service AND cf.anomaly_type = b.anomaly_type AND cf.seen = b.seen) b ASOF LEFT JOIN n ON n.service = b.service AND n.timestamp <= b.seen"""
_SUMMARY = f"""{_SPELLS},
v AS (SELECT service, count(*) AS n, count(*) FILTER ({FAILED}) AS e, quantile_cont(duration_us, 0.99) / 1000 AS p FROM s WHERE timestamp > TIMESTAMP '2024-01-25' AND timestamp <= TIMESTAMP '2024-01-26' GROUP BY service)
SELECT count(*) FILTER (e / n < 0.01) AS healthy, count(*) FILTER (e / n >= 0.01) AS degraded, string_agg(service || ' ' || n || ' ' || e || ' ' || round(e / n, 6) || ' ' || round(p, 3), ';' ORDER BY service) AS services,
  (SELECT coalesce(string_agg(service || ' ' || anomaly_type || ' ' || severity, ';' ORDER BY service, anomaly_type, severity), '') FROM a WHERE detected_at > TIMESTAMP '2024-01-25' AND detected_at <= TIMESTAMP '2024-01-26') AS anomalies FROM v"""


def parse_generic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payloads of generic JSON, through the router, back as metrics."""
    from obsidia.sources import router

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.to_json(F.struct(F.col("event_type").alias("name"), "value", F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service")))
    raw = events.select(body.alias("body"), F.lit("/ingest").alias("path"), F.lit("").alias("sender"), F.lit("application/json").alias("content_type"), F.col("ts").cast("timestamp_ntz").alias("received_at"))
    return router.core(raw, "metrics").groupBy("service", "name").agg(F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total"))


for _f in (summary, summary_payload, bundles, bundle_payloads, parse_generic_json):
    _queries[_f.__name__] = _f
_sql["summary"] = _SUMMARY
_sql["bundles"] = _BUNDLES
_sql["parse_generic_json"] = "SELECT 'svc-' || (user_id % 8) AS service, event_type AS name, count(*) AS points, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _parse(name: str) -> Query:
    return lambda spark, sf_dir: payloads.parsed(spark, sf_dir, name)


for _name in payloads.PAYLOADS:
    _queries[f"parse_{_name}"] = _parse(_name)
    _sql[f"parse_{_name}"] = payloads.rows_sql(_name)
for _f in (payloads.parse_otlp_proto, payloads.parse_remote_write):
    _queries[_f.__name__] = _f
_sql |= payloads.BINARY_SQL
_queries["detect_format"] = payloads.detected
_sql["detect_format"] = payloads.detected_sql()


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
