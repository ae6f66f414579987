from __future__ import annotations

import json
from datetime import datetime

import pytest

from obsidia import schemas
from obsidia.sources import router
from obsidia.sources.parsers import FORMATS

CAME = datetime(2024, 5, 1, 12)
T0 = datetime(2024, 1, 1)
S, MS, US, NS = 1704067200, 1704067200000, 1704067200000000, "1704067200000000000"
attr = lambda k, v: {"key": k, "value": {"stringValue": v}}

#: format: payload, table, expected fields of its rows in order.
GOLDEN = {
    "otlp": (
        {"resourceSpans": [{"resource": {"attributes": [attr("service.name", "api")]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "GET", "startTimeUnixNano": NS, "endTimeUnixNano": "1704067200050000000", "status": {"code": "STATUS_CODE_ERROR"}}]}]}]},
        "spans", [{"service": "api", "trace_id": "t", "span_id": "s", "parent_span_id": None, "operation": "GET", "duration_us": 50000, "status": "ERROR", "timestamp": T0}],
    ),
    "otlp_logs": ({"resourceLogs": [{"resource": {"attributes": [attr("service.name", "api")]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": NS, "severityText": "WARN", "body": {"stringValue": "hi"}}]}]}]}, "logs", [{"service": "api", "level": "WARN", "message": "hi", "timestamp": T0}]),
    "otlp_metrics": ({"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [{"timeUnixNano": NS, "asDouble": 1.5}]}}, {"name": "n", "sum": {"dataPoints": [{"timeUnixNano": NS, "asInt": "7"}]}}]}]}]}, "metrics", [{"service": "unknown", "name": "m", "value": 1.5}, {"name": "n", "value": 7.0}]),
    "prometheus": ('# HELP x\nhttp_total{job="api",code="200"} 12 1704067200000\nbare 3.5\nbad\n', "metrics", [{"service": "api", "name": "http_total", "value": 12.0, "timestamp": T0, "tags": {"job": "api", "code": "200"}}, {"service": "unknown", "name": "bare", "value": 3.5, "timestamp": CAME}]),
    "datadog": ({"series": [{"metric": "cpu", "points": [[S, 1.5], [S]], "host": "h1", "tags": ["env:prod", "x", "url:http://a"]}]}, "metrics", [{"service": "h1", "name": "cpu", "value": 1.5, "timestamp": T0, "tags": {"env": "prod", "url": "http://a"}}]),
    "datadog_logs": ([{"message": "m", "ddsource": "nginx", "hostname": "h", "service": "web"}], "logs", [{"service": "web", "level": "info", "message": "m", "timestamp": CAME, "tags": {"hostname": "h", "source": "nginx"}}]),
    "jaeger": (
        {"data": [{"traceID": "t", "spans": [{"traceID": "t", "spanID": "s", "operationName": "op", "processID": "p2", "references": [{"refType": "FOLLOWS_FROM", "spanID": "z"}, {"refType": "CHILD_OF", "spanID": "p"}], "startTime": US, "duration": 42, "tags": [{"key": "error", "type": "bool", "value": True}]}], "processes": {"p1": {"serviceName": "one"}, "p2": {"serviceName": "two"}}}]},
        "spans", [{"service": "two", "parent_span_id": "p", "operation": "op", "duration_us": 42, "status": "ERROR", "timestamp": T0}],
    ),
    "zipkin": ([{"traceId": "t", "id": "s", "parentId": "p", "name": "n", "timestamp": US, "duration": 9, "localEndpoint": {"serviceName": "z"}, "tags": {"error": "boom"}}, {"traceId": "t", "id": "u", "name": "m", "timestamp": US}], "spans", [{"service": "unknown", "span_id": "u", "status": "OK", "duration_us": 0}, {"service": "z", "parent_span_id": "p", "status": "ERROR", "tags": {"error": "boom"}}]),
    "loki": ({"streams": [{"stream": {"job": "j", "severity": "error"}, "values": [[NS, "line"], ["only"]]}]}, "logs", [{"service": "j", "level": "error", "message": "line", "timestamp": T0}]),
    "splunk_hec": ([{"time": S, "host": "h", "source": "s", "sourcetype": "st", "event": "text"}, {"source": "s2", "event": {"message": "inner"}}, {"source": "s3", "event": {"a": 1}}], "logs", [{"service": "s", "message": "text", "timestamp": T0, "tags": {"host": "h", "sourcetype": "st"}}, {"service": "s2", "message": "inner", "timestamp": CAME}, {"service": "s3", "message": '{"a":1}'}]),
    "elasticsearch": ('{"index":{}}\n{"message":"a","service":"s"}\n{"index":{}}\n{"log":"b"}\n{"index":{}}\nbad\n', "logs", [{"service": "elasticsearch", "message": "b"}, {"service": "s", "message": "a"}]),
    "influx": ("# c\ncpu,host=h1,dc=x usage=1.5,n=3i,s=\"t\" 1704067200000000000\n\nmem free=2\n", "metrics", [{"service": "h1", "name": "cpu_n", "value": 3.0, "timestamp": T0}, {"service": "h1", "name": "cpu_usage", "value": 1.5}, {"service": "influxdb", "name": "mem_free", "value": 2.0, "timestamp": CAME}]),
    "graphite": (f"a.b 1.5 {S}\nbad x\nc 2\n", "metrics", [{"service": "graphite", "name": "a.b", "value": 1.5, "timestamp": T0}, {"name": "c", "value": 2.0, "timestamp": CAME}]),
    "statsd": ("hits:2|c|@0.5|#service:web,env:p\nload:1.5|g\nbad\n", "metrics", [{"service": "statsd", "name": "load", "value": 1.5}, {"service": "web", "name": "hits", "value": 4.0}]),
    "fluentd": ([{"message": "m", "tag": "t"}, {"log": "l"}], "logs", [{"service": "fluentd", "message": "l"}, {"service": "t", "message": "m"}]),
    "syslog": ('{"severity":"err","message":"m","hostname":"h"}\n<13>plain line\n', "logs", [{"service": "h", "level": "err", "message": "m"}, {"service": "syslog", "level": "info", "message": "<13>plain line"}]),
    "newrelic_logs": ([{"message": "m", "timestamp": MS}], "logs", [{"service": "newrelic", "message": "m", "timestamp": T0}]),
    "newrelic_metrics": ([{"metrics": [{"name": "x", "value": 2.5, "timestamp": MS}]}], "metrics", [{"service": "newrelic", "name": "x", "value": 2.5, "timestamp": T0}]),
    "newrelic_traces": ([{"spans": [{"trace.id": "t", "id": "s", "name": "n", "timestamp": MS, "duration.ms": 12.9}]}], "spans", [{"trace_id": "t", "span_id": "s", "duration_us": 12000, "status": "OK"}]),
    "honeycomb": ([{"trace.trace_id": "t", "trace.span_id": "s", "name": "n"}], "spans", [{"trace_id": "t", "span_id": "s", "operation": "n", "duration_us": 0}]),
    "xray": ({"TraceSegmentDocuments": [json.dumps({"trace_id": "t", "id": "s", "name": "svc", "start_time": S + 0.5, "end_time": S + 0.75, "fault": True}), "bad"]}, "spans", [{"service": "svc", "trace_id": "t", "duration_us": 250000, "status": "ERROR", "timestamp": T0}]),
    "cloudwatch": ({"logGroup": "x", "logGroupName": "g", "logStreamName": "st", "logEvents": [{"timestamp": MS, "message": "m"}]}, "logs", [{"service": "g", "message": "m", "timestamp": T0, "tags": {"logStream": "st"}}]),
    "gcp_trace": ({"spans": [{"spanId": "s", "displayName": {"value": "d"}, "startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T00:00:00.250Z"}]}, "spans", [{"service": "gcp", "trace_id": "", "operation": "d", "duration_us": 250000, "timestamp": T0}]),
    "gcp_logging": ({"entries": [{"logName": "l", "severity": "ERROR", "timestamp": "2024-01-01T00:00:00Z", "textPayload": "t"}, {"logName": "l2", "severity": "INFO", "timestamp": "bad", "jsonPayload": {"a": 1}}]}, "logs", [{"service": "l", "level": "error", "message": "t", "timestamp": T0}, {"service": "l2", "level": "info", "message": '{"a":1}', "timestamp": CAME}]),
    "azure": ({"records": [{"time": "2024-01-01T00:00:00Z", "category": "c", "level": "Warning", "properties": {"k": "v"}}]}, "logs", [{"service": "c", "level": "warning", "message": '{"k":"v"}', "timestamp": T0}]),
    "dynatrace_metrics": ("cpu.load,host=a 2.5\nbad\n", "metrics", [{"service": "dynatrace", "name": "cpu.load", "value": 2.5}]),
    "dynatrace_logs": ([{"content": "c", "severity": "WARN", "timestamp": "2024-01-01T00:00:00Z"}], "logs", [{"service": "dynatrace", "level": "warn", "message": "c", "timestamp": T0}]),
    "appdynamics": ([{"eventType": "E", "eventTime": MS, "summary": "s"}], "logs", [{"service": "appdynamics", "message": "s", "timestamp": T0, "tags": {"eventType": "E"}}]),
    "signalfx": ({"gauge": [{"metric": "g", "value": 1.0, "timestamp": MS}], "counter": [{"metric": "k", "value": 2.0, "timestamp": MS}]}, "metrics", [{"service": "signalfx", "name": "g", "value": 1.0}, {"name": "k", "value": 2.0, "timestamp": T0}]),
    "logstash": ({"host": "h", "message": "m", "level": "warn"}, "logs", [{"service": "h", "level": "warn", "message": "m"}]),
    "sumologic": ([{"_source": "s", "message": "m"}], "logs", [{"service": "s", "message": "m"}]),
    "json": ({"message": "m", "service": "s", "level": "warn", "value": 3}, "logs", [{"service": "s", "level": "warn", "message": "m"}]),
}


def raw(spark, *bodies, path="/", sender="", kind=""):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b, separators=(",", ":")), path, sender, kind, CAME) for b in bodies], schemas.RAW)


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_payload(spark, name):
    body, table, expected = GOLDEN[name]
    df = FORMATS[name][table](raw(spark, body))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.TABLES[table]]
    found = sorted(df.collect(), key=lambda r: (r.service or "", r.asDict().get("name") or "", r.asDict().get("message") or ""))
    assert len(found) == len(expected)
    for row, want in zip(found, expected, strict=True):
        assert {k: row[k] for k in want} == want


@pytest.mark.parametrize("name", sorted(FORMATS))
def test_bad_and_empty_payloads(spark, name):
    for parse in FORMATS[name].values():
        parse(raw(spark, "", "{bad", "[]", "{}", "null", "[1]")).collect()


def test_all_formats_have_a_golden_payload():
    assert set(GOLDEN) == set(FORMATS)


def test_router(spark):
    rows = [
        ("/v1/traces", "", "", "{}", "otlp"), ("/api/v2/series", "", "", "{}", "datadog"), ("/loki/api/v1/push", "", "", "{}", "loki"), ("/1/batch/x", "", "", "[]", "honeycomb"),
        ("/x/metrics", "", "", "{}", "prometheus"), ("/", "datadogpy/0.49", "", "{}", "datadog"), ("/", "", "application/x-protobuf", "", "otlp"), ("/", "", "", '{"series":[]}', "datadog"),
        ("/", "", "", '{"data":[]}', "jaeger"), ("/", "", "", '{"streams":[]}', "loki"), ("/", "", "", '[{"localEndpoint":{}}]', "zipkin"), ("/", "", "", '{"a":1}', "json"), ("/", "", "", "{bad", "json"),
        (None, None, None, '{"resourceSpans":[]}', "otlp"), ("/services/collector", "", "", "{}", "splunk_hec"),
    ]
    df = spark.createDataFrame([(b, p, s, k, CAME) for p, s, k, b, _ in rows], schemas.RAW)
    assert [r.format for r in router.routed(df).collect()] == [r[-1] for r in rows]


def test_core_and_rejects(spark):
    df = raw(spark, {"message": "m"}, {"value": 2, "name": "n"}, {"other": 1}, "{bad")
    assert router.core(df, "logs").count() == 1
    assert router.core(df, "metrics").count() == 1
    assert [r.body for r in router.rejects(df).collect()] == ["{bad"]
