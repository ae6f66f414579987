"""Which format a payload has, and all payloads as rows of the core tables."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia import schemas, shared
from obsidia.sources import binary
from obsidia.sources.parsers import FORMATS, whole_json

# Paths that belong to one format, as vendors' senders use them; /td-agent is the path of a fluentd distribution of that name.
ROUTES = {
    "/v1/traces": "otlp", "/v1/logs": "otlp_logs", "/v1/metrics": "otlp_metrics",
    "/api/v1/prom/write": "prometheus", "/api/v1/write": "prometheus", "/prometheus/api/v1/write": "prometheus",
    "/api/v2/series": "datadog", "/api/v1/series": "datadog", "/api/v1/check_run": "datadog",
    "/api/v2/logs": "datadog_logs", "/api/v1/logs": "datadog_logs", "/v1/input": "datadog_logs",
    "/api/traces": "jaeger", "/jaeger/api/traces": "jaeger", "/api/v2/spans": "zipkin", "/api/v1/spans": "zipkin", "/zipkin/api/v2/spans": "zipkin",
    "/loki/api/v1/push": "loki", "/services/collector/event": "splunk_hec", "/services/collector": "splunk_hec", "/_bulk": "elasticsearch", "/elasticsearch/_bulk": "elasticsearch",
    "/write": "influx", "/api/v2/write": "influx", "/influx/write": "influx", "/graphite/metrics": "graphite", "/events/": "graphite",
    "/statsd": "statsd", "/telegraf/statsd": "statsd", "/fluent": "fluentd", "/fluentd": "fluentd", "/td-agent": "fluentd", "/syslog": "syslog",
    "/log/v1": "newrelic_logs", "/metric/v1": "newrelic_metrics", "/trace/v1": "newrelic_traces", "/xray": "xray", "/cloudwatch": "cloudwatch", "/firehose": "cloudwatch",
    "/v2/traces": "gcp_trace", "/google/logging": "gcp_logging", "/azure/metrics": "azure", "/azure/logs": "azure",
    "/api/v2/metrics/ingest": "dynatrace_metrics", "/api/v2/logs/ingest": "dynatrace_logs", "/appdynamics/events": "appdynamics",
    "/v2/datapoint": "signalfx", "/v2/event": "signalfx", "/logstash": "logstash", "/receiver/v1/http": "sumologic",
}
PREFIXES = {"/1/events/": "honeycomb", "/1/batch/": "honeycomb", "/receiver/v1/http/": "sumologic"}


def detected() -> Column:
    """The format of a payload that no route names: by path, then sender, then content type, then what the JSON holds."""
    path, sender, kind = (F.coalesce(c, F.lit("")) for c in ("path", "sender", "content_type"))

    def by_body(body: Column) -> Column:
        """body: the payload, if it is JSON. It is parsed once, for its keys."""
        keys = F.json_object_keys(F.when(F.startswith(body, F.lit("{")), body))
        first = F.get_json_object(F.when(F.startswith(body, F.lit("[")), body), "$[0].localEndpoint")
        held = [("resourceSpans", "otlp"), ("series", "datadog"), ("data", "jaeger"), ("streams", "loki")]
        named = F.get(F.transform(F.array(keys), lambda k: reduce(lambda out, x: out.when(F.array_contains(k, x[0]), x[1]), held, F)), F.lit(0))
        return F.coalesce(named, F.when(first.isNotNull(), "zipkin"), F.lit("json"))

    rules = [
        (path.contains("/otlp") | path.contains("/v1/traces"), "otlp"),
        (path.contains("/prometheus") | path.contains("/metrics"), "prometheus"),
        (path.contains("/datadog") | sender.contains("datadog"), "datadog"),
        (path.contains("/jaeger") | sender.contains("jaeger"), "jaeger"),
        (path.contains("/zipkin") | sender.contains("zipkin"), "zipkin"),
        (path.contains("/loki"), "loki"),
        (kind.contains("application/x-protobuf"), "otlp"),
    ]
    whole = F.when(F.try_parse_json("body").isNotNull(), F.col("body"))
    from_body = F.get(F.transform(F.array(whole), by_body), F.lit(0))
    return reduce(lambda out, rule: out.when(*rule), rules, F).otherwise(from_body)


def routed(raw: DataFrame) -> DataFrame:
    """Adds format; rows that have one already keep it."""
    if "format" in raw.columns:
        return raw
    path = F.coalesce("path", F.lit(""))
    exact = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])[path]
    by_prefix = reduce(lambda out, pair: out.when(path.startswith(pair[0]), pair[1]), PREFIXES.items(), F)
    named = F.coalesce(exact, by_prefix, detected())
    if "data" in raw.columns:  # bodies of bytes are told by what they are sent as
        proto = F.col("data").isNotNull() & F.coalesce("content_type", F.lit("")).contains("protobuf")
        named = F.when(proto & (named == "prometheus"), "remote_write").when(proto & (named == "otlp"), "otlp_proto").otherwise(named)
    return raw.withColumn("format", named)


def kept(raw: DataFrame) -> DataFrame:
    """Payloads with their formats, each told once, in a folder a format of the shared folder: a parser then reads its own and no others."""
    path = shared.path(raw.sparkSession, "payloads")
    named = routed(raw)
    named.write.partitionBy("format").parquet(path)
    return raw.sparkSession.read.schema(named.schema).parquet(path)


def core(raw: DataFrame, table: str, formats: Collection[str] | None = None) -> DataFrame:
    """All rows of one core table that payloads of any format hold, or of the formats that are known to be there.

    Where the formats are not known, payloads are read once, and kept by their formats; only the parsers of formats that are there
    are asked. A stream has no end at which to tell what there is: all parsers of the table read it, so ingest() does this by micro-batch.
    """
    named = routed(raw)
    if formats is None and not raw.isStreaming:
        named = kept(raw)
        formats = present(named)
    parts = [parse(named.where(F.col("format") == name)) for name, tables in FORMATS.items() for t, parse in tables.items() if t == table and (formats is None or name in formats)]
    if "data" in named.columns:
        parts += [binary.parse(named.where(F.col("format") == name), name) for name, (t, _) in binary.BINARY.items() if t == table and (formats is None or name in formats)]
    nothing = raw.sparkSession.createDataFrame([], schemas.TABLES[table])
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def present(routed: DataFrame) -> list[str]:
    """The formats that payloads have: a list no longer than that of the formats."""
    return sorted(r.format for r in routed.select("format").distinct().collect())


LINE_FORMATS = ("prometheus", "influx", "graphite", "statsd", "syslog", "dynatrace_metrics", "elasticsearch", "sumologic")


def rejected() -> Column:
    """Of a routed payload, whether it should be JSON and is not."""
    return ~F.col("format").isin(*LINE_FORMATS, *binary.BINARY) & ~F.coalesce(whole_json(F.col("body")), F.lit(False))


def rejects(raw: DataFrame) -> DataFrame:
    """Payloads of JSON formats that are no JSON, and of binary ones that are no message. Formats of lines skip bad lines instead."""
    named = routed(raw)
    bad = named.where(rejected())
    return bad.unionByName(binary.broken(named)) if "data" in named.columns else bad
