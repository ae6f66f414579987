"""Payloads of each format out of the driver's events, all of them, and the rows that they hold, in SQL over the same events.

Every event is a payload: of ten, one has no service, one is broken, and one has a second item. Payloads are written in Spark's SQL, rows in DuckDB's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia import schemas
from obsidia.sources import binary, router

#: What payloads and rows are made of: id, ts, came (when the payload was received), kind, value, usr, svc (null in one of ten), odd, us, msg, dur.
_EVENTS = """SELECT event_id AS id, ts, ts + INTERVAL 1 HOUR AS came, event_type AS kind, value, user_id AS usr, CASE WHEN event_id % 10 = 7 THEN NULL ELSE concat('svc-', user_id % 8) END AS svc, event_id % 10 AS odd,
  {us} AS us, concat(event_type, ' by ', user_id) AS msg, CAST(round(value * 1000) AS BIGINT) AS dur FROM {events}"""
_ROWS = f"""WITH e AS ({_EVENTS.format(us="epoch_us(ts)", events="events")}),
x AS (SELECT e.*, again, msg || CASE again WHEN 1 THEN ' again' ELSE '' END AS m, kind || CASE again WHEN 1 THEN '_again' ELSE '' END AS n FROM e, (VALUES (0), (1)) t(again) WHERE odd <> 8 AND (again = 0 OR odd = 9))"""


#: Payloads that no route names: path, sender, content type and body, and the format that they are of.
UNNAMED: list[tuple[str | None, str | None, str | None, str, str]] = [
    ("/x/otlp", "", "", "{}", "otlp"), ("/x/metrics", "", "", "{}", "prometheus"), ("/x/datadog", "", "", "{}", "datadog"), ("/", "datadogpy/0.49", "", "{}", "datadog"), ("/x/jaeger", "", "", "{}", "jaeger"),
    ("/", "jaeger", "", "{}", "jaeger"), ("/x/zipkin", "", "", "{}", "zipkin"), ("/x/loki", "", "", "{}", "loki"), ("/", "", "application/x-protobuf", "", "otlp"), (None, None, None, '{"resourceSpans":[]}', "otlp"),
    ("/", "", "", '{"series":[]}', "datadog"), ("/", "", "", '{"data":[]}', "jaeger"), ("/", "", "", '{"streams":[]}', "loki"), ("/", "", "", '[{"localEndpoint":{}}]', "zipkin"), ("/", "", "", '{"data":1,"series":2}', "datadog"),
    ("/", "", "", '{"a":1}', "json"), ("/", "", "", "{bad", "json"), ("/metrics", "datadog", "", '{"streams":[]}', "prometheus"),
]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def shown(rows: DataFrame) -> DataFrame:
    """Tags as text, in order of their keys."""
    pairs = F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.withColumn("tags", F.array_join(pairs, ","))


@dataclass(frozen=True)
class Payload:
    """wrap: the payload around `{items}`, an array; lines: it is text of lines. item: one item, of `{m}` (a message), `{n}` (a name) and `{a}` (0, or 1 for a second item).

    rows: what the payload holds, a select over x, in which an event stands once for each item."""

    path: str
    table: str
    item: str
    rows: str
    wrap: str = "{items}"
    lines: bool = False

    def body(self) -> str:
        first, second = (self.item.format(m=m, n=n, a=a) for m, n, a in (("msg", "kind", 0), ("concat(msg, ' again')", "concat(kind, '_again')", 1)))
        if self.lines:
            return f"CASE WHEN odd = 8 THEN 'bad' WHEN odd = 9 THEN concat_ws('\\n', {first}, '', {second}) ELSE {first} END"
        items = self.wrap.format(items=f"CASE WHEN odd = 9 THEN array({first}, {second}) ELSE array({first}) END")
        return f"CASE WHEN odd = 8 THEN '{{bad' ELSE to_json({items}) END"


def _s(**of: str) -> str:
    return "named_struct(" + ", ".join(f"'{k.replace('__', '.')}', {v}" for k, v in of.items()) + ")"


_MS, _NS, _SEC = "us DIV 1000", "concat(us, '000')", "us DIV 1000000"
_ISO = "date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
_RESOURCE = "named_struct('attributes', filter(array(named_struct('key', 'service.name', 'value', named_struct('stringValue', svc))), a -> svc IS NOT NULL))"
_ID, _TRACE = "CAST(id AS STRING)", "CAST(id DIV 10 AS STRING)"
_PARENT = "CASE WHEN id % 3 <> 0 THEN CAST(id - 1 AS STRING) END"
_T_S, _T_MS = "date_trunc('second', ts)", "date_trunc('millisecond', ts)"
_KEYS = "CAST(id // 10 AS VARCHAR) AS trace_id, CAST(id AS VARCHAR) AS span_id"
_UP = "CASE WHEN id % 3 <> 0 THEN CAST(id - 1 AS VARCHAR) END AS parent_span_id"
_STATUS = "CASE WHEN kind = 'error' THEN 'ERROR' ELSE 'OK' END AS status"
_NONE = "CAST(NULL AS VARCHAR)"


def _log(t: str, service: str, level: str, message: str = "m", tags: str = _NONE) -> str:
    return f"SELECT {t} AS timestamp, {service} AS service, {level} AS level, {message} AS message, {tags} AS tags FROM x"


def _metric(t: str, service: str, name: str = "n", value: str = "value", tags: str = _NONE) -> str:
    return f"SELECT {t} AS timestamp, {service} AS service, {name} AS name, CAST({value} AS DOUBLE) AS value, {tags} AS tags FROM x"


def _span(t: str, service: str, duration: str = "dur", parent: str = f"{_NONE} AS parent_span_id", keys: str = _KEYS, status: str = _STATUS, tags: str = _NONE, operation: str = "m") -> str:
    return f"SELECT {t} AS timestamp, {keys}, {parent}, {service} AS service, {operation} AS operation, CAST({duration} AS BIGINT) AS duration_us, {status}, {tags} AS tags FROM x"


_OTLP = "named_struct('resource{k}s', array(named_struct('resource', " + _RESOURCE + ", 'scope{k}s', array(named_struct('{of}', {items})))))"


def _otlp(k: str, of: str) -> str:
    return _OTLP.replace("{k}", k).replace("{of}", of)


PAYLOADS: dict[str, Payload] = {
    "otlp": Payload("/v1/traces", "spans", _s(traceId=_TRACE, spanId=_ID, parentSpanId=f"coalesce({_PARENT}, '')", name="{m}", startTimeUnixNano=_NS, endTimeUnixNano="concat(us + dur, '000')",
        status="named_struct('code', CASE WHEN kind = 'error' THEN 'STATUS_CODE_ERROR' WHEN usr % 2 = 0 THEN '1' END)", attributes="array(named_struct('key', 'k', 'value', named_struct('intValue', CAST(usr AS STRING))))"),
        _span("ts", "coalesce(svc, 'unknown')", parent=_UP, tags="'k=' || usr"), _otlp("Span", "spans")),
    "otlp_logs": Payload("/v1/logs", "logs", _s(timeUnixNano=_NS, severityText="CASE WHEN usr % 2 = 0 THEN 'WARN' END", body="named_struct('stringValue', {m})"), _log("ts", "coalesce(svc, 'unknown')", "CASE WHEN usr % 2 = 0 THEN 'WARN' ELSE 'info' END"), _otlp("Log", "logRecords")),
    "otlp_metrics": Payload("/v1/metrics", "metrics", _s(name="{n}", gauge=f"CASE WHEN {{a}} = 0 THEN named_struct('dataPoints', array(named_struct('timeUnixNano', {_NS}, 'asDouble', value))) END", sum=f"CASE WHEN {{a}} = 1 THEN named_struct('dataPoints', array(named_struct('timeUnixNano', {_NS}, 'asInt', CAST(usr AS STRING)))) END"),
        _metric("ts", "coalesce(svc, 'unknown')", value="CASE again WHEN 0 THEN value ELSE usr END"), _otlp("Metric", "metrics")),
    "prometheus": Payload("/api/v1/write", "metrics", f"concat('# HELP x\\n', {{n}}, CASE WHEN svc IS NULL THEN '' ELSE concat('{{{{job=\"', svc, '\",code=\"200\"}}}}') END, ' ', value, CASE WHEN {{a}} = 0 THEN concat(' ', {_MS}) ELSE '' END)",
        _metric(f"CASE again WHEN 0 THEN {_T_MS} ELSE came END", "coalesce(svc, 'unknown')", tags="CASE WHEN svc IS NULL THEN '' ELSE 'code=200,job=' || svc END"), lines=True),
    "datadog": Payload("/api/v2/series", "metrics", _s(metric="{n}", points=f"array(array(CAST({_SEC} AS DOUBLE), value), array(1.0D))", host="svc", tags="array(concat('env:', kind), 'x', 'url:http://a')"), _metric(_T_S, "svc", tags="'env=' || kind || ',url=http://a'"), "named_struct('series', {items})"),
    "datadog_logs": Payload("/api/v2/logs", "logs", _s(message="{m}", ddsource="'nginx'", hostname="svc", service="svc"), _log("came", "svc", "'info'", tags="'hostname=' || coalesce(svc, '') || ',source=nginx'")),
    "jaeger": Payload("/api/traces", "spans", _s(traceID=_TRACE, spanID=_ID, operationName="{m}", processID="CASE WHEN usr % 2 = 0 THEN 'p1' END", references=f"filter(array(named_struct('refType', 'FOLLOWS_FROM', 'spanID', 'z'), named_struct('refType', 'CHILD_OF', 'spanID', {_PARENT})), r -> r.spanID IS NOT NULL)",
        startTime="us", duration="dur", tags="filter(array(named_struct('key', 'error', 'value', true)), t -> kind = 'error')"), _span("ts", "CASE WHEN usr % 2 = 0 THEN coalesce(svc, 'zero') ELSE 'zero' END", parent=_UP),
        "named_struct('data', array(named_struct('spans', {items}, 'processes', map('p1', named_struct('serviceName', svc), 'p0', named_struct('serviceName', 'zero')))))"),
    "zipkin": Payload("/api/v2/spans", "spans", _s(traceId=_TRACE, id=_ID, parentId=_PARENT, name="{m}", timestamp="us", duration="dur", localEndpoint="named_struct('serviceName', svc)", tags="map_filter(map('error', 'boom', 'k', kind), (k, v) -> k <> 'error' OR kind = 'error')"),
        _span("ts", "coalesce(svc, 'unknown')", parent=_UP, tags="CASE WHEN kind = 'error' THEN 'error=boom,' ELSE '' END || 'k=' || kind")),
    "loki": Payload("/loki/api/v1/push", "logs", f"array({_NS}, {{m}})", _log("ts", "coalesce(svc, 'unknown')", "'warn'", tags="CASE WHEN svc IS NULL THEN '' ELSE 'job=' || svc || ',' END || 'severity=warn'"), "named_struct('streams', array(named_struct('stream', map_filter(map('job', svc, 'severity', 'warn'), (k, v) -> v IS NOT NULL), 'values', {items})))"),
    "splunk_hec": Payload("/services/collector", "logs", _s(time="CASE WHEN usr % 3 > 0 THEN us / 1000000 END", host="'h'", source="svc", sourcetype="'st'", event="{m}"), _log(f"CASE WHEN usr % 3 > 0 THEN {_T_S} ELSE came END", "svc", "'info'", tags="'host=h,sourcetype=st'")),
    "elasticsearch": Payload("/_bulk", "logs", "concat('{{\"index\":{{}}}}\\n', to_json(named_struct('message', CASE WHEN usr % 2 = 0 THEN {m} END, 'log', CASE WHEN usr % 2 = 1 THEN {m} END, 'service', svc, 'level', 'WARN')))", _log("came", "coalesce(svc, 'elasticsearch')", "'WARN'"), lines=True),
    "influx": Payload("/write", "metrics", "CASE WHEN {a} = 1 THEN concat('mem free=', value) ELSE concat('# c\\ncpu', CASE WHEN svc IS NULL THEN '' ELSE concat(',host=', svc) END, ',dc=x usage=', value, ',n=', usr, 'i,s=\"t\" ', us, '000') END",
        _metric("ts", "coalesce(svc, 'influxdb')", "f", "CASE f WHEN 'cpu_usage' THEN value ELSE usr END", "'dc=x' || CASE WHEN svc IS NULL THEN '' ELSE ',host=' || svc END") + ", (VALUES ('cpu_usage'), ('cpu_n')) t(f) WHERE again = 0 UNION ALL " + _metric("came", "'influxdb'", "'mem_free'", tags="''") + " WHERE again = 1", lines=True),
    "graphite": Payload("/graphite/metrics", "metrics", f"concat({{n}}, ' ', value, CASE WHEN {{a}} = 0 THEN concat(' ', {_SEC}) ELSE '' END)", _metric(f"CASE again WHEN 0 THEN {_T_S} ELSE came END", "'graphite'"), lines=True),
    "statsd": Payload("/statsd", "metrics", "CASE WHEN {a} = 1 THEN concat({n}, ':', value, '|g') ELSE concat({n}, ':', usr, '|c|@0.5|#env:p', CASE WHEN svc IS NULL THEN '' ELSE concat(',service:', svc) END) END",
        _metric("came", "CASE again WHEN 0 THEN coalesce(svc, 'statsd') ELSE 'statsd' END", value="CASE again WHEN 0 THEN usr / 0.5 ELSE value END", tags="CASE again WHEN 0 THEN 'env=p' || CASE WHEN svc IS NULL THEN '' ELSE ',service=' || svc END END"), lines=True),
    "fluentd": Payload("/fluentd", "logs", _s(message="CASE WHEN usr % 2 = 0 THEN {m} END", log="CASE WHEN usr % 2 = 1 THEN {m} END", tag="svc"), _log("came", "coalesce(svc, 'fluentd')", "'info'")),
    "syslog": Payload("/syslog", "logs", "CASE WHEN usr % 2 = 0 THEN to_json(named_struct('severity', 'err', 'message', {m}, 'hostname', svc)) ELSE concat('<13>', {m}) END",
        _log("came", "CASE WHEN usr % 2 = 0 THEN coalesce(svc, 'syslog') ELSE 'syslog' END", "CASE WHEN usr % 2 = 0 THEN 'err' ELSE 'info' END", "CASE WHEN usr % 2 = 0 THEN m ELSE '<13>' || m END") + " UNION ALL " + _log("came", "'syslog'", "'info'", "'bad'").replace("FROM x", "FROM e") + " WHERE odd = 8", lines=True),
    "newrelic_logs": Payload("/log/v1", "logs", _s(message="{m}", timestamp=_MS, attributes="map('k', kind)"), _log(_T_MS, "'newrelic'", "'info'", tags="'k=' || kind")),
    "newrelic_metrics": Payload("/metric/v1", "metrics", _s(name="{n}", type="'gauge'", value="value", timestamp=_MS), _metric(_T_MS, "'newrelic'"), "array(named_struct('metrics', {items}))"),
    "newrelic_traces": Payload("/trace/v1", "spans", _s(trace__id=_TRACE, id=_ID, name="{m}", timestamp=_MS, duration__ms="value + 0.9D"), _span(_T_MS, "'newrelic'", "trunc(value + 0.9) * 1000", status="'OK' AS status"), "array(named_struct('spans', {items}))"),
    "honeycomb": Payload("/1/batch/x", "spans", _s(trace__trace_id=f"CASE WHEN usr % 2 = 0 THEN {_TRACE} END", trace__span_id=_ID, trace__parent_id=_PARENT, name="{m}", service__name="svc"), _span("came", "coalesce(svc, 'honeycomb')", "0", _UP, status="'OK' AS status") + " WHERE usr % 2 = 0"),
    "honeycomb_logs": Payload("/1/events/x", "logs", _s(trace__trace_id=f"CASE WHEN usr % 2 = 0 THEN {_TRACE} END", message="{m}", service__name="svc"), _log("came", "coalesce(svc, 'honeycomb')", "'info'") + " WHERE usr % 2 = 1"),
    "xray": Payload("/xray", "spans", "to_json(" + _s(trace_id=_TRACE, id=_ID, name="svc", start_time="us / 1000000", end_time="(us + dur) / 1000000", fault="kind = 'error'") + ")",
        _span(_T_S, "svc", "trunc(((us + dur) / 1000000 - us / 1000000) * 1000000)", operation="svc"), "named_struct('TraceSegmentDocuments', concat({items}, array('bad')))"),
    "cloudwatch": Payload("/cloudwatch", "logs", _s(timestamp=_MS, message="{m}"), _log(_T_MS, "svc", "'info'", tags="'logStream=st'"), "named_struct('logEvents', {items}, 'logGroupName', svc, 'logStreamName', 'st')"),
    "gcp_trace": Payload("/v2/traces", "spans", _s(spanId=_ID, displayName="named_struct('value', {m})", startTime=_ISO.format(t="ts"), endTime=_ISO.format(t="ts + make_dt_interval(0, 0, 0, CAST(dur AS DECIMAL(18,6)) / 1000000)")),
        _span("ts", "'gcp'", keys="'' AS trace_id, CAST(id AS VARCHAR) AS span_id", status="'OK' AS status"), "named_struct('spans', {items})"),
    "gcp_logging": Payload("/google/logging", "logs", _s(logName="svc", severity="upper(kind)", timestamp="CASE WHEN usr % 3 = 0 THEN 'no time' ELSE " + _ISO.format(t="ts") + " END", textPayload="CASE WHEN usr % 2 = 0 THEN {m} END", jsonPayload="CASE WHEN usr % 2 = 1 THEN named_struct('a', {m}) END"),
        _log("CASE WHEN usr % 3 = 0 THEN came ELSE ts END", "svc", "kind", "CASE WHEN usr % 2 = 0 THEN m ELSE '{\"a\":\"' || m || '\"}' END"), "named_struct('entries', {items})"),
    "azure": Payload("/azure/logs", "logs", _s(time=_ISO.format(t="ts"), category="svc", level="'Warning'", properties="named_struct('k', {m})"), _log("ts", "svc", "'warning'", "'{\"k\":\"' || m || '\"}'"), "named_struct('records', {items})"),
    "dynatrace_metrics": Payload("/api/v2/metrics/ingest", "metrics", "concat({n}, CASE WHEN svc IS NULL THEN '' ELSE concat(',host=', svc) END, ' ', value)", _metric("came", "'dynatrace'"), lines=True),
    "dynatrace_logs": Payload("/api/v2/logs/ingest", "logs", _s(content="{m}", timestamp=_ISO.format(t="ts"), severity="'WARN'"), _log("ts", "'dynatrace'", "'warn'")),
    "appdynamics": Payload("/appdynamics/events", "logs", _s(eventType="kind", eventTime=_MS, summary="{m}"), _log(_T_MS, "'appdynamics'", "'info'", tags="'eventType=' || kind")),
    "signalfx": Payload("/v2/datapoint", "metrics", _s(metric="{n}", value="value", timestamp=_MS, dimensions="map('k', kind)"), _metric(_T_MS, "'signalfx'", tags="'k=' || kind"), "named_struct('gauge', filter({items}, x -> NOT endswith(x.metric, '_again')), 'counter', filter({items}, x -> endswith(x.metric, '_again')))"),
    "logstash": Payload("/logstash", "logs", _s(host="svc", message="{m}", level="'warn'"), _log("came", "coalesce(svc, 'logstash')", "'warn'")),
    "sumologic": Payload("/receiver/v1/http", "logs", "CASE WHEN usr % 2 = 0 THEN to_json(array(named_struct('_source', svc, 'message', {m}))) ELSE concat(' ', {m}) END",
        _log("came", "CASE WHEN usr % 2 = 0 THEN coalesce(svc, 'sumologic') ELSE 'sumologic' END", "'info'") + " WHERE odd < 8 UNION ALL " + _log("came", "'sumologic'", "'info'", "'bad'").replace("FROM x", "FROM e") + " WHERE odd = 8 UNION ALL "
        + _log("came", "'sumologic'", "'info'", "CASE WHEN usr % 2 = 0 THEN '[{' || CASE WHEN svc IS NULL THEN '' ELSE '\"_source\":\"' || svc || '\",' END || '\"message\":\"' || m || '\"}]' ELSE m END") + " WHERE odd = 9", lines=True),
    "json_logs": Payload("/ingest", "logs", _s(message="{m}", service="svc", level="CASE WHEN usr % 2 = 0 THEN 'warn' END", value="value"), _log("came", "coalesce(svc, 'unknown')", "CASE WHEN usr % 2 = 0 THEN 'warn' ELSE 'info' END") + " WHERE again = 0", "element_at({items}, 1)"),
    "json_metrics": Payload("/", "metrics", _s(name="{n}", service="svc", value="value"), _metric("came", "coalesce(svc, 'unknown')") + " WHERE again = 0", "element_at({items}, 1)"),
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All events as payloads of a format."""
    p = PAYLOADS[name]
    events = spark.sql(_EVENTS.format(us="unix_micros(CAST(ts AS TIMESTAMP))", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    given = {"body": p.body(), "path": f"'{p.path}'", "sender": "''", "content_type": "'application/json'", "received_at": "came"}
    return events.select(*[F.expr(given[f.name]).cast(f.dataType).alias(f.name) for f in schemas.RAW if f.name in given])


def parsed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of all events' payloads of a format, through the router, with tags as text."""
    return shown(router.core(raw(spark, sf_dir, name), PAYLOADS[name].table))


def rows_sql(name: str) -> str:
    return f"{_ROWS} {PAYLOADS[name].rows}"


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as payloads that no route names, dealt to the kinds of them that there are, each with its format."""
    values = ", ".join(f"({i}, {', '.join(map(_quoted, x))})" for i, x in enumerate(UNNAMED))
    kinds = spark.sql(f"SELECT * FROM VALUES {values} AS v(i, path, sender, content_type, body, want)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("received_at"), (F.col("event_id") % len(UNNAMED)).alias("i"))
    payloads = events.join(F.broadcast(kinds), "i")  # a row a kind
    return router.routed(payloads).select("event_id", "format")


def detected_sql() -> str:
    values = ", ".join(f"({i}, {_quoted(x[-1])})" for i, x in enumerate(UNNAMED))
    return f"SELECT event_id, format FROM events JOIN (VALUES {values}) v(i, format) ON event_id % {len(UNNAMED)} = i"


_PROTO_SPANS = """SELECT ts AS timestamp, lpad(lower(hex(event_id DIV 10)), 32, '0') AS trace_id, lpad(lower(hex(event_id)), 16, '0') AS span_id, CASE WHEN event_id % 10 <> 0 THEN lpad(lower(hex(event_id - 1)), 16, '0') END AS parent_span_id,
  concat('svc-', user_id % 8) AS service, event_type AS operation, CAST(round(value * 1000) AS BIGINT) AS duration_us, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, map('user', CAST(user_id AS STRING)) AS tags FROM {events}"""


def _sent(data: DataFrame, path: str) -> DataFrame:
    given = {"path": F.lit(path), "content_type": F.lit("application/x-protobuf"), "received_at": F.lit("2024-02-01 00:00:00"), "data": F.col("data")}
    return data.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RAW_BINARY])


def parse_otlp_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as spans in OTLP's binary requests, through the router, back as spans."""
    spans = spark.sql(_PROTO_SPANS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return shown(router.core(_sent(binary.export_spans(spans), "/v1/traces"), "spans"))


def parse_remote_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as samples in packed remote write requests, through the router, back as metrics."""
    metrics = spark.sql("SELECT ts AS timestamp, concat('svc-', user_id % 8) AS service, event_type AS name, value, map('user', CAST(user_id AS STRING)) AS tags FROM {events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return shown(router.core(_sent(binary.export_samples(metrics), "/api/v1/write"), "metrics"))


BINARY_SQL = {
    "parse_otlp_proto": """SELECT ts AS timestamp, printf('%032x', event_id // 10) AS trace_id, printf('%016x', event_id) AS span_id, CASE WHEN event_id % 10 <> 0 THEN printf('%016x', event_id - 1) END AS parent_span_id,
      'svc-' || (user_id % 8) AS service, event_type AS operation, CAST(round(value * 1000) AS BIGINT) AS duration_us, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, 'user=' || user_id AS tags FROM events""",
    "parse_remote_write": "SELECT date_trunc('millisecond', ts) AS timestamp, 'svc-' || (user_id % 8) AS service, event_type AS name, value, 'service=svc-' || (user_id % 8) || ',user=' || user_id AS tags FROM events",
}
