"""A payload of each format by hand, from the formats' public descriptions, with the rows that it holds, through the router."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

import pytest

from obsidia import schemas
from obsidia.plans.payloads import shown
from obsidia.sources import router
from tests.oracle import plain

COLUMNS = {k: [f.name for f in v] for k, v in schemas.TABLES.items()}

#: When the payloads came, and the time that stands in them, in the units that formats use.
CAME, TIME = "2024-05-01 12:00:00", "2024-01-01 00:00:00"
S, MS, US, NS = 1704067200, 1704067200000, 1704067200000000, "1704067200000000000"


def _attr(key: str, value: str) -> dict:
    return {"key": key, "value": {"stringValue": value}}


def _resource(service: str) -> dict:
    return {"attributes": [_attr("service.name", service)]}


def span(service: str | None, operation: str | None, us: int | None, status: str = "OK", at: str = TIME, trace: str | None = "t", id: str | None = "s", parent: str | None = None, tags: str | None = None) -> tuple:
    return at, trace, id, parent, service, operation, us, status, tags


#: By name: path, sender, content type, payload, table and the table's rows with tags as text. Names that begin with a format's are of it.
SAMPLES: dict[str, tuple[str, str, str, Any, str, list[tuple]]] = {
    "otlp": ("/v1/traces", "", "", {"resourceSpans": [{"resource": _resource("api"), "scopeSpans": [{"spans": [
        {"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "GET", "startTimeUnixNano": NS, "endTimeUnixNano": "1704067200050000000", "status": {"code": "STATUS_CODE_ERROR"}, "attributes": [_attr("k", "first"), _attr("k", "last")]},
        {"traceId": "t", "spanId": "u", "parentSpanId": "s", "name": "SET"}]}]}]}, "spans",
        [span("api", "GET", 50000, "ERROR", tags="k=last"), span("api", "SET", 0, at=CAME, id="u", parent="s")]),
    "otlp_logs": ("/v1/logs", "", "", {"resourceLogs": [{"resource": _resource("api"), "scopeLogs": [{"logRecords": [{"timeUnixNano": NS, "severityText": "WARN", "body": {"stringValue": "hi"}}, {"body": {"stringValue": "ho"}}]}]}]}, "logs",
        [(TIME, "api", "WARN", "hi", None), (CAME, "api", "info", "ho", None)]),
    "otlp_metrics": ("/v1/metrics", "", "", {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [{"timeUnixNano": NS, "asDouble": 1.5}]}}, {"name": "n", "sum": {"dataPoints": [{"timeUnixNano": NS, "asInt": "7"}]}},
        {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": NS, "count": "3", "sum": 4.5}]}}, {"name": "y", "summary": {"dataPoints": [{"timeUnixNano": NS, "count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.25}]}]}}]}]}]}, "metrics",
        [(TIME, "unknown", "m", 1.5, None), (TIME, "unknown", "n", 7.0, None), (TIME, "unknown", "h_count", 3.0, None), (TIME, "unknown", "h_sum", 4.5, None), (TIME, "unknown", "y_count", 2.0, None), (TIME, "unknown", "y_sum", 3.0, None), (TIME, "unknown", "y", 1.25, "quantile=0.5")]),
    "prometheus": ("/api/v1/write", "", "", 'a{job="api",code="200",code="201"} 12 1704067200000\n# HELP x\nbare 3.5\nlate 1 9223372036854775807\nbad\n', "metrics",
        [(TIME, "api", "a", 12.0, "code=201,job=api"), (CAME, "unknown", "bare", 3.5, ""), (CAME, "unknown", "late", 1.0, "")]),
    "datadog": ("/api/v2/series", "", "", {"series": [{"metric": "cpu", "points": [[S, 1.5], [S], [1e300, 2.5]], "host": "h1", "tags": ["env:a", "env:b", "x", "url:http://a"]}]}, "metrics",
        [(TIME, "h1", "cpu", 1.5, "env=b,url=http://a"), (CAME, "h1", "cpu", 2.5, "env=b,url=http://a")]),
    "datadog_logs": ("/api/v2/logs", "", "", [{"message": "m", "ddsource": "nginx", "hostname": "h", "service": "web"}], "logs", [(CAME, "web", "info", "m", "hostname=h,source=nginx")]),
    "jaeger": ("/api/traces", "", "", {"data": [{"traceID": "t", "spans": [
        {"traceID": "t", "spanID": "s", "operationName": "op", "processID": "p2", "references": [{"refType": "FOLLOWS_FROM", "spanID": "z"}, {"refType": "CHILD_OF", "spanID": "p"}], "startTime": US, "duration": 42, "tags": [{"key": "error", "type": "bool", "value": True}]},
        {"traceID": "t", "spanID": "v", "operationName": "ok", "startTime": 9223372036854775807, "duration": 1}], "processes": {"p1": {"serviceName": "one"}, "p2": {"serviceName": "two"}}}]}, "spans",
        [span("two", "op", 42, "ERROR", parent="p"), span("one", "ok", 1, at=CAME, id="v")]),
    "zipkin": ("/api/v2/spans", "", "", [{"traceId": "t", "id": "s", "parentId": "p", "name": "n", "timestamp": US, "duration": 9, "localEndpoint": {"serviceName": "z"}, "tags": {"error": "boom"}}, {"traceId": "t", "id": "u", "name": "m", "timestamp": US}], "spans",
        [span("z", "n", 9, "ERROR", parent="p", tags="error=boom"), span("unknown", "m", 0, id="u")]),
    "loki": ("/loki/api/v1/push", "", "", {"streams": [{"stream": {"job": "j", "severity": "error"}, "values": [[NS, "line"], ["only"], ["soon", "now"]]}]}, "logs", [(TIME, "j", "error", "line", "job=j,severity=error"), (CAME, "j", "error", "now", "job=j,severity=error")]),
    "splunk_hec": ("/services/collector", "", "", [{"time": S, "host": "h", "source": "s", "sourcetype": "st", "event": "text"}, {"source": "s2", "event": {"message": "inner"}}, {"source": "s3", "event": {"a": 1}}, {"time": 1e300, "source": "s4", "event": "far"}], "logs",
        [(TIME, "s", "info", "text", "host=h,sourcetype=st"), (CAME, "s2", "info", "inner", "host=,sourcetype="), (CAME, "s3", "info", '{"a":1}', "host=,sourcetype="), (CAME, "s4", "info", "far", "host=,sourcetype=")]),
    "elasticsearch": ("/_bulk", "", "", '{"index":{}}\n{"message":"a","service":"s"}\n{"delete":{"_id":"1"}}\n{"create":{"_id":"2"}}\n{"log":"b","level":"warn"}\n{"index":{}}\nbad\n', "logs", [(CAME, "s", "info", "a", None), (CAME, "elasticsearch", "warn", "b", None)]),
    "influx": ("/write", "", "", '# c\ncpu,host=h0,host=h1,dc=x usage=1.5,n=3i,s="t" 1704067200000000000\n\nmem free=2\n', "metrics", [(TIME, "h1", "cpu_usage", 1.5, "dc=x,host=h1"), (TIME, "h1", "cpu_n", 3.0, "dc=x,host=h1"), (CAME, "influxdb", "mem_free", 2.0, "")]),
    "graphite": ("/graphite/metrics", "", "", f"a.b 1.5 {S}\nbad x\nc 2\n", "metrics", [(TIME, "graphite", "a.b", 1.5, None), (CAME, "graphite", "c", 2.0, None)]),
    "statsd": ("/statsd", "", "", "hits:2|c|@0.5|#service:old,service:web,env:p\nload:1.5|g\nbad\n", "metrics", [(CAME, "web", "hits", 4.0, "env=p,service=web"), (CAME, "statsd", "load", 1.5, None)]),
    "fluentd": ("/fluentd", "", "", [{"message": "m", "tag": "t"}, {"log": "l"}], "logs", [(CAME, "t", "info", "m", None), (CAME, "fluentd", "info", "l", None)]),
    "syslog": ("/syslog", "", "", '{"severity":"err","message":"m","hostname":"h"}\n<13>plain line\n', "logs", [(CAME, "h", "err", "m", None), (CAME, "syslog", "info", "<13>plain line", None)]),
    "newrelic_logs": ("/log/v1", "", "", [{"message": "m", "timestamp": MS}, {"message": "n", "timestamp": 9223372036854775807}], "logs", [(TIME, "newrelic", "info", "m", None), (CAME, "newrelic", "info", "n", None)]),
    "newrelic_metrics": ("/metric/v1", "", "", [{"metrics": [{"name": "x", "value": 2.5, "timestamp": MS, "attributes": {"a": "b"}}]}], "metrics", [(TIME, "newrelic", "x", 2.5, "a=b")]),
    "newrelic_traces": ("/trace/v1", "", "", [{"spans": [{"trace.id": "t", "id": "s", "name": "n", "timestamp": MS, "duration.ms": 12.9}, {"trace.id": "t", "id": "u", "name": "o", "timestamp": MS, "duration.ms": 1e300}]}], "spans", [span("newrelic", "n", 12000), span("newrelic", "o", None, id="u")]),
    "honeycomb": ("/1/batch/x", "", "", [{"trace.trace_id": "t", "trace.span_id": "s", "name": "n"}], "spans", [span("honeycomb", "n", 0, at=CAME)]),
    "honeycomb_logs": ("/1/events/x", "", "", [{"message": "m", "service.name": "w"}, {"trace.trace_id": "t"}], "logs", [(CAME, "w", "info", "m", None)]),
    "xray": ("/xray", "", "", {"TraceSegmentDocuments": [json.dumps({"trace_id": "t", "id": "s", "name": "svc", "start_time": S + 0.5, "end_time": S + 0.75, "fault": True}), "bad", json.dumps({"trace_id": "t", "id": "u", "name": "svc", "start_time": 1e300, "end_time": 2e300})]}, "spans",
        [span("svc", "svc", 250000, "ERROR"), span("svc", "svc", None, at=CAME, id="u")]),
    "cloudwatch": ("/cloudwatch", "", "", {"logGroupName": "g", "logStreamName": "st", "logEvents": [{"timestamp": MS, "message": "m"}]}, "logs", [(TIME, "g", "info", "m", "logStream=st")]),
    "gcp_trace": ("/v2/traces", "", "", {"spans": [{"spanId": "s", "displayName": {"value": "d"}, "startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T00:00:00.250Z"}]}, "spans", [span("gcp", "d", 250000, trace="")]),
    "gcp_logging": ("/google/logging", "", "", {"entries": [{"logName": "l", "severity": "ERROR", "timestamp": "2024-01-01T00:00:00Z", "textPayload": "t"}, {"logName": "l2", "severity": "INFO", "timestamp": "bad", "jsonPayload": {"a": 1}}]}, "logs", [(TIME, "l", "error", "t", None), (CAME, "l2", "info", '{"a":1}', None)]),
    "azure": ("/azure/logs", "", "", {"records": [{"time": "2024-01-01T00:00:00Z", "category": "c", "level": "Warning", "properties": {"k": "v"}}]}, "logs", [(TIME, "c", "warning", '{"k":"v"}', None)]),
    "dynatrace_metrics": ("/api/v2/metrics/ingest", "", "", "cpu.load,host=a 2.5\nbad\n", "metrics", [(CAME, "dynatrace", "cpu.load", 2.5, None)]),
    "dynatrace_logs": ("/api/v2/logs/ingest", "", "", [{"content": "c", "severity": "WARN", "timestamp": "2024-01-01T00:00:00Z"}], "logs", [(TIME, "dynatrace", "warn", "c", None)]),
    "appdynamics": ("/appdynamics/events", "", "", [{"eventType": "E", "eventTime": MS, "summary": "s"}], "logs", [(TIME, "appdynamics", "info", "s", "eventType=E")]),
    "signalfx": ("/v2/datapoint", "", "", {"gauge": [{"metric": "g", "value": 1.0, "timestamp": MS, "dimensions": {"d": "e"}}], "counter": [{"metric": "k", "value": 2.0, "timestamp": MS}]}, "metrics", [(TIME, "signalfx", "g", 1.0, "d=e"), (TIME, "signalfx", "k", 2.0, None)]),
    "logstash": ("/logstash", "", "", {"host": "h", "message": "m", "level": "warn"}, "logs", [(CAME, "h", "warn", "m", None)]),
    "sumologic": ("/receiver/v1/http/x", "", "", [{"_source": "s", "message": "m"}], "logs", [(CAME, "s", "info", "m", None)]),
    "json_logs": ("/", "", "", {"message": "m", "service": "s", "level": "warn", "value": 3}, "logs", [(CAME, "s", "warn", "m", None)]),
    "json_metrics": ("/", "", "", {"value": 3, "name": "n"}, "metrics", [(CAME, "unknown", "n", 3.0, None)]),
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_sample(spark, name):
    path, sender, kind, body, table, rows = SAMPLES[name]
    text = body if isinstance(body, str) else json.dumps(body, separators=(",", ":"))
    raw = spark.createDataFrame([(text, path, sender, kind, datetime.fromisoformat(CAME))], schemas.RAW)
    found = shown(router.core(raw, table)).select(*COLUMNS[table]).collect()
    want = [tuple(datetime.fromisoformat(v) if c == "timestamp" else v for c, v in zip(COLUMNS[table], r, strict=True)) for r in rows]
    assert sorted(repr(tuple(map(plain, r))) for r in found) == sorted(repr(tuple(map(plain, r))) for r in want)
