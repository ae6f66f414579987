"""Vendor payloads as rows of the core tables.

Each parser takes rows of schemas.RAW and gives rows of one core table, by expressions alone, so batches and streams share it. What a
payload leaves out is its default; where it has no time of its own, received_at stands. Field names are matched in their case. A
payload that is no JSON of the expected shape gives no rows; rejects() has those. No payload fails a batch: a number or a time out of
range is null or its default, and of a key that comes again the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia import schemas
from obsidia.functions.maps import deduped, last_wins


def NOW() -> Column:
    """When the payload came."""
    return F.col("received_at")


def text(c: Column | str, default: str) -> Column:
    """The string, or the default where it is null or empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def at(parsed: Column) -> Column:
    return F.coalesce(parsed.cast("timestamp_ntz"), NOW())


#: Microseconds of the years 1 to 9999: what is outside is no time.
FIRST, LAST = -62_135_596_800_000_000, 253_402_300_799_999_999


def micros(c: Column) -> Column:
    return F.when(c.between(FIRST, LAST), F.timestamp_micros(c))


def millis(c: Column) -> Column:
    return micros(F.try_multiply(c, F.lit(1000).cast("long")))


def seconds(c: Column) -> Column:
    """Whole seconds of a number."""
    return micros(F.try_multiply(c.try_cast("long"), F.lit(1_000_000).cast("long")))


def nanos(c: Column) -> Column:
    """Nanoseconds since the epoch in a string that may end in something else."""
    whole = F.regexp_extract(c, r"^-?\d+", 0).try_cast("decimal(20,0)")
    return micros(F.floor(whole / 1000).cast("long"))


def iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def tags(**of: Column) -> Column:
    """A map of what is there."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in of.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


NO_TAGS = None


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("p", F.from_json("body", schema)).where("p IS NOT NULL")


def whole_json(body: Column) -> Column:
    """Whether all of a text is one JSON value: parsers stop at its end, so a text of several would look like its first."""
    return F.try_parse_json(F.concat(F.lit('{"a":'), body, F.lit("}"))).isNotNull()


def one_or_many(raw: DataFrame, element: str) -> DataFrame:
    """A payload that is an object or an array of them, as a row p for each."""
    return raw.withColumn("p", F.explode(F.from_json("body", f"array<{element}>"))).where("p IS NOT NULL")


def lines(raw: DataFrame) -> DataFrame:
    """The body's lines that are not blank, trimmed, with their place."""
    return raw.select("*", F.posexplode(F.split("body", "\n")).alias("pos", "l")).withColumn("line", F.trim(F.regexp_replace("l", r"^\s+|\s+$", ""))).where("line <> ''").drop("l")


def _core(df: DataFrame, table: str, **of: Column) -> DataFrame:
    schema = schemas.TABLES[table]
    nothing = F.lit(None)
    return df.select(*[(nothing if of.get(f.name) is None else of[f.name]).cast(f.dataType).alias(f.name) for f in schema])


def metrics(df: DataFrame, timestamp: Column, service: Column, name: Column, value: Column, tags: Column | None = NO_TAGS) -> DataFrame:
    return _core(df, "metrics", timestamp=timestamp, service=service, name=name, value=value, tags=tags)


def logs(df: DataFrame, timestamp: Column, service: Column, level: Column, message: Column, tags: Column | None = NO_TAGS) -> DataFrame:
    return _core(df, "logs", timestamp=timestamp, service=service, level=level, message=message, tags=tags)


def spans(df: DataFrame, **of: Column) -> DataFrame:
    return _core(df, "spans", **of)


def _value(v: str) -> str:
    return f"struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>{v}>"


def _attribute(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]["stringValue"]


def _attributes(attributes: Column) -> Column:
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return last_wins(F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value"))))


def otlp_status(code: Column) -> Column:
    return F.when(code.isin("STATUS_CODE_ERROR", "2"), "ERROR").when(code.isNull() | code.isin("STATUS_CODE_OK", "STATUS_CODE_UNSET", "0", "1", ""), "OK").otherwise(code)


def otlp_traces(raw: DataFrame) -> DataFrame:
    """Times come from the payload; a span without them starts when it was received and lasts 0."""
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,attributes:array<{_value('')}>>"
    p = parsed(raw, f"struct<resourceSpans:array<struct<resource:struct<attributes:array<{_value('')}>>,scopeSpans:array<struct<spans:array<{span}>>>>>>")
    r = p.select("received_at", F.explode("p.resourceSpans").alias("r"))
    s = r.select("received_at", text(_attribute(F.col("r.resource.attributes"), "service.name"), "unknown").alias("service"), F.explode("r.scopeSpans").alias("ss"))
    s = s.select("received_at", "service", F.explode("ss.spans").alias("s"))
    start, end = (F.col(f"s.{k}TimeUnixNano").try_cast("decimal(20,0)") for k in ("start", "end"))
    return spans(s, timestamp=at(nanos(F.col("s.startTimeUnixNano"))), trace_id=F.col("s.traceId"), span_id=F.col("s.spanId"), parent_span_id=F.nullif(F.col("s.parentSpanId"), F.lit("")), service=F.col("service"), operation=F.col("s.name"), duration_us=F.coalesce(F.floor((end - start) / 1000), F.lit(0)), status=otlp_status(F.col("s.status.code")), tags=_attributes(F.col("s.attributes")))


def otlp_logs(raw: DataFrame) -> DataFrame:
    record = f"struct<timeUnixNano:string,severityText:string,body:struct<stringValue:string>,attributes:array<{_value('')}>>"
    p = parsed(raw, f"struct<resourceLogs:array<struct<resource:struct<attributes:array<{_value('')}>>,scopeLogs:array<struct<logRecords:array<{record}>>>>>>")
    r = p.select("received_at", F.explode("p.resourceLogs").alias("r")).select("received_at", "r", F.explode("r.scopeLogs").alias("s")).select("received_at", "r", F.explode("s.logRecords").alias("x"))
    return logs(r, at(nanos(F.col("x.timeUnixNano"))), text(_attribute(F.col("r.resource.attributes"), "service.name"), "unknown"), text("x.severityText", "info"), F.col("x.body.stringValue"), _attributes(F.col("x.attributes")))


def otlp_metrics(raw: DataFrame) -> DataFrame:
    """Points of gauges and sums; of histograms and summaries the count and the sum, and of summaries each quantile."""
    head = f"timeUnixNano:string,attributes:array<{_value('')}>"
    point = f"struct<{head},asDouble:double,asInt:string>"
    spread = f"struct<{head},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>"
    metric = f"struct<name:string,gauge:struct<dataPoints:array<{point}>>,sum:struct<dataPoints:array<{point}>>,histogram:struct<dataPoints:array<{spread}>>,summary:struct<dataPoints:array<{spread}>>>"
    p = parsed(raw, f"struct<resourceMetrics:array<struct<resource:struct<attributes:array<{_value('')}>>,scopeMetrics:array<struct<metrics:array<{metric}>>>>>>")
    r = p.select("received_at", F.explode("p.resourceMetrics").alias("r")).select("received_at", "r", F.explode("r.scopeMetrics").alias("s")).select("received_at", "r", F.explode("s.metrics").alias("m"))
    row = f"struct<name:string,{head},value:double,quantile:string>"

    def made(x: Column, suffix: str, value: Column, quantile: Column | None = None) -> Column:
        return F.struct(F.concat(F.col("m.name"), F.lit(suffix)).alias("name"), x["timeUnixNano"].alias("timeUnixNano"), x["attributes"].alias("attributes"), value.cast("double").alias("value"), (F.lit(None) if quantile is None else quantile).cast("string").alias("quantile")).cast(row)

    def numbers(points: str) -> Column:
        return F.coalesce(F.transform(points, lambda x: made(x, "", F.coalesce(x["asDouble"], x["asInt"].try_cast("double")))), F.array().cast(f"array<{row}>"))

    def spreads(points: str) -> Column:
        both = lambda x: F.filter(F.array(made(x, "_count", x["count"].try_cast("double")), made(x, "_sum", x["sum"])), lambda y: y["value"].isNotNull())
        quantiles = lambda x: F.coalesce(F.transform(x["quantileValues"], lambda q: made(x, "", q["value"], q["quantile"])), F.array().cast(f"array<{row}>"))
        return F.coalesce(F.flatten(F.transform(points, lambda x: F.concat(both(x), quantiles(x)))), F.array().cast(f"array<{row}>"))

    rows = F.concat(numbers("m.gauge.dataPoints"), numbers("m.sum.dataPoints"), spreads("m.histogram.dataPoints"), spreads("m.summary.dataPoints"))
    r = r.select("received_at", "r", F.explode(rows).alias("x"))
    own = _attributes(F.col("x.attributes"))
    of = F.when(F.col("x.quantile").isNotNull(), F.map_concat(F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("quantile"), F.col("x.quantile")))).otherwise(own)
    return metrics(r, at(nanos(F.col("x.timeUnixNano"))), text(_attribute(F.col("r.resource.attributes"), "service.name"), "unknown"), F.col("x.name"), F.col("x.value"), of)


def prometheus(raw: DataFrame) -> DataFrame:
    """The public text exposition format: name{labels} value [milliseconds]; comments are skipped."""
    head = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{.*\})?\s+(\S+)(?:\s+(-?\d+))?$'
    x = lines(raw).where("NOT startswith(line, '#')").withColumns({k: F.regexp_extract("line", head, i) for i, k in enumerate(("name", "labels", "value", "ms"), 1)}).where("name <> ''")
    labels = last_wins(F.transform(F.regexp_extract_all("labels", F.lit(r'[a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\]|\\.)*"'), F.lit(0)), lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.regexp_extract(s, r'="((?:[^"\\]|\\.)*)"', 1).alias("value"))))
    x = x.withColumn("labels", labels).withColumn("number", F.col("value").try_cast("double")).where("number IS NOT NULL")
    return metrics(x, at(millis(F.nullif(F.col("ms"), F.lit("")).try_cast("long"))), text(F.coalesce(F.col("labels")["service"], F.col("labels")["job"]), "unknown"), F.col("name"), F.col("number"), F.col("labels"))


def _colon_tags(list_of: Column) -> Column:
    """key:value strings; those without a colon are dropped."""
    split = F.transform(F.filter(list_of, lambda t: t.contains(":")), lambda t: F.split(t, ":", 2))
    return last_wins(F.transform(split, lambda s: F.struct(s[0].alias("key"), s[1].alias("value"))))


def datadog_series(raw: DataFrame) -> DataFrame:
    p = parsed(raw, "struct<series:array<struct<metric:string,points:array<array<double>>,host:string,tags:array<string>>>>")
    s = p.select("received_at", F.explode("p.series").alias("s")).select("received_at", "s", F.explode("s.points").alias("x")).where("size(x) >= 2")
    return metrics(s, at(seconds(F.col("x")[0])), F.col("s.host"), F.col("s.metric"), F.col("x")[1], _colon_tags(F.col("s.tags")))


def datadog_logs(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw.where("startswith(ltrim(body), '[')"), "struct<message:string,ddsource:string,ddtags:string,hostname:string,service:string>")
    return logs(p, NOW(), F.col("p.service"), F.lit("info"), F.col("p.message"), tags(hostname=F.coalesce("p.hostname", F.lit("")), source=F.coalesce("p.ddsource", F.lit(""))))


def jaeger(raw: DataFrame) -> DataFrame:
    """A span's own process names its service; one without takes the first process by name."""
    kv = "struct<key:string,type:string,value:string>"
    span = f"struct<traceID:string,spanID:string,operationName:string,processID:string,references:array<struct<refType:string,traceID:string,spanID:string>>,startTime:bigint,duration:bigint,tags:array<{kv}>>"
    p = parsed(raw, f"struct<data:array<struct<traceID:string,spans:array<{span}>,processes:map<string,struct<serviceName:string>>>>>")
    s = p.select("received_at", F.explode("p.data").alias("d")).select("received_at", "d", F.explode("d.spans").alias("s"))
    service = F.coalesce(F.col("d.processes")[F.col("s.processID")]["serviceName"], F.col("d.processes")[F.array_min(F.map_keys("d.processes"))]["serviceName"])
    parent = F.get(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    bad = F.coalesce(F.exists("s.tags", lambda t: (t["key"] == "error") & (t["value"] == "true")), F.lit(False))
    return spans(s, timestamp=at(micros(F.col("s.startTime"))), trace_id=F.col("s.traceID"), span_id=F.col("s.spanID"), parent_span_id=parent, service=text(service, "unknown"), operation=F.col("s.operationName"), duration_us=F.col("s.duration"), status=F.when(bad, "ERROR").otherwise("OK"))


def zipkin(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<traceId:string,id:string,parentId:string,name:string,timestamp:bigint,duration:bigint,localEndpoint:struct<serviceName:string>,tags:map<string,string>>")
    bad = F.coalesce(deduped(F.col("p.tags"))["error"], F.lit("")) != ""
    return spans(p, timestamp=at(micros(F.col("p.timestamp"))), trace_id=F.col("p.traceId"), span_id=F.col("p.id"), parent_span_id=F.nullif(F.col("p.parentId"), F.lit("")), service=text("p.localEndpoint.serviceName", "unknown"), operation=F.col("p.name"), duration_us=F.coalesce("p.duration", F.lit(0)), status=F.when(bad, "ERROR").otherwise("OK"), tags=deduped(F.col("p.tags")))


def loki(raw: DataFrame) -> DataFrame:
    p = parsed(raw, "struct<streams:array<struct<stream:map<string,string>,values:array<array<string>>>>>")
    s = p.select("received_at", F.explode("p.streams").alias("s")).select("received_at", deduped(F.col("s.stream")).alias("t"), F.explode("s.values").alias("v")).where("size(v) >= 2")
    first = lambda *keys: F.coalesce(*[F.nullif(F.col("t")[k], F.lit("")) for k in keys])
    return logs(s, at(nanos(F.col("v")[0])), F.coalesce(first("service", "job", "app"), F.lit("unknown")), F.coalesce(first("level", "severity"), F.lit("info")), F.col("v")[1], F.col("t"))


def splunk_hec(raw: DataFrame) -> DataFrame:
    """event is a string, or an object with a message, or any other JSON."""
    p = one_or_many(raw, "struct<time:double,host:string,source:string,sourcetype:string,event:string>")
    message = F.coalesce(F.get_json_object(F.when(F.startswith("p.event", F.lit("{")), F.col("p.event")), "$.message"), F.col("p.event"))
    return logs(p, at(F.when(F.col("p.time") > 0, seconds(F.col("p.time")))), F.col("p.source"), F.lit("info"), message, tags(host=F.coalesce("p.host", F.lit("")), sourcetype=F.coalesce("p.sourcetype", F.lit(""))))


def elasticsearch_bulk(raw: DataFrame) -> DataFrame:
    """Lines in pairs of which the first, the action, is skipped. A delete has no document, so its line, an object of that one key, is no pair."""
    alone = lambda x: F.trim(x).rlike(r'^\{\s*"delete"\s*:\s*\{[^{}]*\}\s*\}$')
    numbered = raw.select("received_at", F.posexplode(F.filter(F.split("body", "\n"), lambda x: (F.trim(x) != "") & ~alone(x))).alias("pos", "line"))
    body = numbered.where("pos % 2 = 1").where(F.try_parse_json("line").isNotNull() & F.startswith(F.ltrim("line"), F.lit("{")))
    get = lambda k: F.get_json_object("line", f"$.{k}")
    return logs(body, NOW(), text(get("service"), "elasticsearch"), text(get("level"), "info"), F.coalesce(get("message"), get("log"), F.col("line")))


def influx(raw: DataFrame) -> DataFrame:
    """measurement[,tags] fields [nanoseconds]; a row for each numeric field."""
    x = lines(raw).where("NOT startswith(line, '#')").withColumn("w", F.split("line", r"\s+")).where("size(w) >= 2")
    x = x.withColumns({"head": F.split(F.col("w")[0], ","), "ns": F.get("w", F.lit(2))})
    pairs = lambda list_of: last_wins(F.transform(F.filter(list_of, lambda t: t.contains("=")), lambda t: F.struct(F.split(t, "=", 2)[0].alias("key"), F.split(t, "=", 2)[1].alias("value"))))
    x = x.select("received_at", "ns", F.col("head")[0].alias("m"), pairs(F.expr("slice(head, 2, size(head))")).alias("t"), F.explode(pairs(F.split(F.col("w")[1], ","))).alias("k", "v"))
    x = x.withColumn("number", F.regexp_replace("v", "[iu]$", "").try_cast("double")).where("number IS NOT NULL")
    return metrics(x, at(nanos(F.col("ns"))), text(F.col("t")["host"], "influxdb"), F.concat_ws("_", "m", "k"), F.col("number"), F.col("t"))


def graphite(raw: DataFrame) -> DataFrame:
    x = lines(raw).withColumn("w", F.split("line", r"\s+")).where("size(w) >= 2").withColumn("number", F.col("w")[1].try_cast("double")).where("number IS NOT NULL")
    return metrics(x, at(seconds(F.get("w", F.lit(2)).try_cast("long"))), F.lit("graphite"), F.col("w")[0], F.col("number"))


def statsd(raw: DataFrame) -> DataFrame:
    """name:value|type[|@rate][|#k:v,...]; a counter's value is divided by its sample rate."""
    x = lines(raw).withColumn("w", F.split("line", r"\|")).withColumn("n", F.split(F.col("w")[0], ":", 2)).where("size(n) = 2 AND size(w) >= 2")
    x = x.withColumn("number", F.col("n")[1].try_cast("double")).where("number IS NOT NULL")
    part = lambda mark: F.get(F.filter("w", lambda p: p.startswith(mark)), F.lit(0))
    x = x.withColumns({"t": _colon_tags(F.split(F.substr(part("#"), F.lit(2)), ",")), "rate": F.substr(part("@"), F.lit(2)).try_cast("double")})
    value = F.when((F.col("w")[1] == "c") & (F.col("rate") > 0), F.col("number") / F.col("rate")).otherwise(F.col("number"))
    return metrics(x, NOW(), text(F.col("t")["service"], "statsd"), F.col("n")[0], value, F.col("t"))


def fluentd(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<message:string,log:string,tag:string,level:string>")
    return logs(p, NOW(), text("p.tag", "fluentd"), text("p.level", "info"), F.coalesce("p.message", "p.log", F.lit("")))


def syslog(raw: DataFrame) -> DataFrame:
    """A line is JSON with severity, message and hostname, or a message as it is."""
    x = lines(raw).withColumn("p", F.from_json(F.when(F.startswith("line", F.lit("{")) & F.try_parse_json("line").isNotNull(), F.col("line")), "struct<severity:string,message:string,hostname:string>"))
    return logs(x, NOW(), text("p.hostname", "syslog"), text("p.severity", "info"), F.coalesce("p.message", "line"))


def newrelic_logs(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<message:string,timestamp:bigint,attributes:map<string,string>>")
    return logs(p, at(millis(F.col("p.timestamp"))), F.lit("newrelic"), F.lit("info"), F.col("p.message"), deduped(F.col("p.attributes")))


def newrelic_metrics(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<metrics:array<struct<name:string,type:string,value:double,timestamp:bigint,attributes:map<string,string>>>>").select("received_at", F.explode("p.metrics").alias("m"))
    return metrics(p, at(millis(F.col("m.timestamp"))), F.lit("newrelic"), F.col("m.name"), F.col("m.value"), deduped(F.col("m.attributes")))


def newrelic_traces(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<spans:array<struct<`trace.id`:string,id:string,name:string,timestamp:bigint,`duration.ms`:double,attributes:map<string,string>>>>").select("received_at", F.explode("p.spans").alias("s"))
    return spans(p, timestamp=at(millis(F.col("s.timestamp"))), trace_id=F.col("s.`trace.id`"), span_id=F.col("s.id"), service=F.lit("newrelic"), operation=F.col("s.name"), duration_us=F.try_multiply(F.col("s.`duration.ms`").try_cast("long"), F.lit(1000).cast("long")), status=F.lit("OK"), tags=deduped(F.col("s.attributes")))


def _objects(raw: DataFrame) -> DataFrame:
    """The JSON of each object of a payload that is one or an array of them, as e."""
    many = F.expr("CASE WHEN startswith(ltrim(body), '[') THEN from_json(body, 'array<string>') ELSE array(body) END")
    return raw.withColumn("e", F.explode(many)).where(F.startswith(F.ltrim("e"), F.lit("{")) & F.try_parse_json("e").isNotNull())


def honeycomb_spans(raw: DataFrame) -> DataFrame:
    """Events with a trace id."""
    get = lambda k: F.coalesce(F.get_json_object("e", f"$['{k}']"), F.get_json_object("e", f"$.data['{k}']"))
    e = _objects(raw).where(get("trace.trace_id").isNotNull())
    return spans(e, timestamp=NOW(), trace_id=get("trace.trace_id"), span_id=get("trace.span_id"), parent_span_id=get("trace.parent_id"), service=text(get("service.name"), "honeycomb"), operation=get("name"), duration_us=F.lit(0), status=F.lit("OK"))


def honeycomb_logs(raw: DataFrame) -> DataFrame:
    get = lambda k: F.coalesce(F.get_json_object("e", f"$['{k}']"), F.get_json_object("e", f"$.data['{k}']"))
    e = _objects(raw).where(get("trace.trace_id").isNull())
    return logs(e, NOW(), text(get("service.name"), "honeycomb"), text(get("level"), "info"), F.coalesce(get("message"), F.col("e")))


def xray(raw: DataFrame) -> DataFrame:
    """An array of strings that are JSON themselves."""
    p = parsed(raw, "struct<TraceSegmentDocuments:array<string>>").select("received_at", F.explode("p.TraceSegmentDocuments").alias("d"))
    s = p.withColumn("s", F.from_json("d", "struct<trace_id:string,id:string,name:string,start_time:double,end_time:double,fault:boolean,error:boolean>")).where("s.id IS NOT NULL OR s.trace_id IS NOT NULL")
    bad = F.coalesce("s.fault", F.lit(False)) | F.coalesce("s.error", F.lit(False))
    return spans(s, timestamp=at(seconds(F.col("s.start_time"))), trace_id=F.col("s.trace_id"), span_id=F.col("s.id"), service=F.col("s.name"), operation=F.col("s.name"), duration_us=((F.col("s.end_time") - F.col("s.start_time")) * 1_000_000).try_cast("long"), status=F.when(bad, "ERROR").otherwise("OK"))


def cloudwatch(raw: DataFrame) -> DataFrame:
    p = parsed(raw, "struct<logEvents:array<struct<timestamp:bigint,message:string>>,logGroupName:string,logStreamName:string>").select("received_at", "p", F.explode("p.logEvents").alias("e"))
    return logs(p, at(millis(F.col("e.timestamp"))), F.col("p.logGroupName"), F.lit("info"), F.col("e.message"), tags(logStream=F.coalesce("p.logStreamName", F.lit(""))))


def gcp_trace(raw: DataFrame) -> DataFrame:
    s = parsed(raw, "struct<spans:array<struct<spanId:string,displayName:struct<value:string>,startTime:string,endTime:string>>>").select("received_at", F.explode("p.spans").alias("s"))
    length = F.unix_micros(iso(F.col("s.endTime"))) - F.unix_micros(iso(F.col("s.startTime")))
    return spans(s, timestamp=at(iso(F.col("s.startTime"))), trace_id=F.lit(""), span_id=F.col("s.spanId"), service=F.lit("gcp"), operation=F.col("s.displayName.value"), duration_us=F.coalesce(length, F.lit(0)), status=F.lit("OK"))


def gcp_logging(raw: DataFrame) -> DataFrame:
    e = parsed(raw, "struct<entries:array<struct<logName:string,severity:string,timestamp:string,textPayload:string,jsonPayload:string>>>").select("received_at", F.explode("p.entries").alias("e"))
    return logs(e, at(iso(F.col("e.timestamp"))), F.col("e.logName"), F.lower("e.severity"), F.coalesce(F.nullif(F.col("e.textPayload"), F.lit("")), "e.jsonPayload"))


def azure_monitor(raw: DataFrame) -> DataFrame:
    r = parsed(raw, "struct<records:array<struct<time:string,category:string,level:string,properties:string>>>").select("received_at", F.explode("p.records").alias("r"))
    return logs(r, at(iso(F.col("r.time"))), F.col("r.category"), F.lower("r.level"), F.coalesce("r.properties", F.lit("null")))


def dynatrace_metrics(raw: DataFrame) -> DataFrame:
    """name[,dimensions] value"""
    x = lines(raw).withColumn("w", F.split("line", r"\s+")).where("size(w) >= 2").withColumn("number", F.col("w")[1].try_cast("double")).where("number IS NOT NULL")
    return metrics(x, NOW(), F.lit("dynatrace"), F.substring_index(F.col("w")[0], ",", 1), F.col("number"))


def dynatrace_logs(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<content:string,timestamp:string,severity:string>")
    return logs(p, at(iso(F.col("p.timestamp"))), F.lit("dynatrace"), F.lower("p.severity"), F.col("p.content"))


def appdynamics(raw: DataFrame) -> DataFrame:
    p = one_or_many(raw, "struct<eventType:string,eventTime:bigint,summary:string>")
    return logs(p, at(millis(F.col("p.eventTime"))), F.lit("appdynamics"), F.lit("info"), F.col("p.summary"), tags(eventType=F.coalesce("p.eventType", F.lit(""))))


def signalfx(raw: DataFrame) -> DataFrame:
    point = "array<struct<metric:string,value:double,timestamp:bigint,dimensions:map<string,string>>>"
    p = parsed(raw, f"struct<gauge:{point},counter:{point}>")
    none = F.array().cast(point)
    x = p.select("received_at", F.explode(F.concat(F.coalesce("p.gauge", none), F.coalesce("p.counter", none))).alias("x"))
    return metrics(x, at(millis(F.col("x.timestamp"))), F.lit("signalfx"), F.col("x.metric"), F.col("x.value"), deduped(F.col("x.dimensions")))


def logstash(raw: DataFrame) -> DataFrame:
    e = _objects(raw)
    get = lambda k: F.get_json_object("e", f"$.{k}")
    return logs(e, NOW(), text(get("host"), "logstash"), text(get("level"), "info"), F.coalesce(get("message"), F.col("e")))


def sumologic(raw: DataFrame) -> DataFrame:
    """A JSON array of objects, or lines as they are."""
    array = F.startswith(F.ltrim("body"), F.lit("[")) & whole_json(F.col("body"))
    many = _objects(raw.where(array))
    get = lambda k: F.get_json_object("e", f"$.{k}")
    objects = logs(many, NOW(), text(get("_source"), "sumologic"), text(get("level"), "info"), F.coalesce(get("message"), F.col("e")))
    plain = logs(lines(raw.where(~F.coalesce(array, F.lit(False)))), NOW(), F.lit("sumologic"), F.lit("info"), F.col("line"))
    return objects.unionByName(plain)


def _generic(raw: DataFrame) -> DataFrame:
    """Payloads that are one object, with which of the two keys it has."""
    keys = F.coalesce(F.json_object_keys(F.when(F.try_parse_json("body").isNotNull(), F.col("body"))), F.array().cast("array<string>"))
    has = F.get(F.transform(F.array(keys), lambda k: F.struct(F.array_contains(k, "message").alias("log"), F.array_contains(k, "value").alias("metric"))), F.lit(0))
    objects = raw.where("startswith(ltrim(body), '{')").withColumn("has", has)
    return objects.select("*", "has.*").withColumn("p", F.from_json("body", "struct<level:string,message:string,service:string,name:string,value:double>"))


def json_logs(raw: DataFrame) -> DataFrame:
    """An object with a message is a log."""
    return logs(_generic(raw).where("log"), NOW(), F.coalesce("p.service", F.lit("unknown")), F.coalesce("p.level", F.lit("info")), F.coalesce("p.message", F.lit("")))


def json_metrics(raw: DataFrame) -> DataFrame:
    """An object with a value and no message is a metric."""
    return metrics(_generic(raw).where("metric AND NOT log"), NOW(), F.coalesce("p.service", F.lit("unknown")), F.coalesce("p.name", F.lit("unknown")), F.coalesce("p.value", F.lit(0.0)))


#: Formats by name: the parsers of each core table that a payload of the format can hold.
FORMATS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "otlp": {"spans": otlp_traces}, "otlp_logs": {"logs": otlp_logs}, "otlp_metrics": {"metrics": otlp_metrics}, "prometheus": {"metrics": prometheus},
    "datadog": {"metrics": datadog_series}, "datadog_logs": {"logs": datadog_logs}, "jaeger": {"spans": jaeger}, "zipkin": {"spans": zipkin}, "loki": {"logs": loki},
    "splunk_hec": {"logs": splunk_hec}, "elasticsearch": {"logs": elasticsearch_bulk}, "influx": {"metrics": influx}, "graphite": {"metrics": graphite},
    "statsd": {"metrics": statsd}, "fluentd": {"logs": fluentd}, "syslog": {"logs": syslog}, "newrelic_logs": {"logs": newrelic_logs},
    "newrelic_metrics": {"metrics": newrelic_metrics}, "newrelic_traces": {"spans": newrelic_traces}, "honeycomb": {"spans": honeycomb_spans, "logs": honeycomb_logs},
    "xray": {"spans": xray}, "cloudwatch": {"logs": cloudwatch}, "gcp_trace": {"spans": gcp_trace}, "gcp_logging": {"logs": gcp_logging}, "azure": {"logs": azure_monitor},
    "dynatrace_metrics": {"metrics": dynatrace_metrics}, "dynatrace_logs": {"logs": dynatrace_logs}, "appdynamics": {"logs": appdynamics}, "signalfx": {"metrics": signalfx},
    "logstash": {"logs": logstash}, "sumologic": {"logs": sumologic}, "json": {"logs": json_logs, "metrics": json_metrics},
}
