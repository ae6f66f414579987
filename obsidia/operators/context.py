"""Evidence for anomalies: what failed, how, and since when, redacted, one nested row an anomaly.

Evidence is that of the anomaly's own time. Each part is made for all anomalies at once: a point is a service and a time at which one of
its anomalies is looked at, and an interval join by buckets of time puts each row to the points whose window it lies in. Spans are counted
once by point, operation and duration, and metrics, trend and endpoints are sums of those counts.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia import shared
from obsidia.functions import redact
from obsidia.operators import health, incidents, intervals, topology

LOGS, TRACES, ENDPOINTS, BREAKDOWN, LOOKBACK_SECONDS = 20, 30, 10, 100, 900


def error_breakdown(logs: DataFrame, limit: int = BREAKDOWN, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    """A row a service: per cent of timeouts, connection errors, server errors, client errors and others among its newest error messages."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("timestamp"), "message"))
    newest = logs.where(F.upper("level").isin(*health.ERROR_LEVELS)).withColumn("place", place).where(F.col("place") <= limit)
    kind = redact.error_type(F.col("message"))
    shares = {"timeout": "timeout", "connection_error": "connection_error", "server_error_5xx": "server_error", "client_error_4xx": "validation_error"}
    typed = newest.select(*keys, kind.alias("kind")).groupBy(*keys)
    percent = lambda part: F.sum(part.cast("long")) * 100.0 / F.count("*")
    rest = ~F.col("kind").isin(*shares.values())
    return typed.agg(F.count("*").alias("messages"), *[percent(F.col("kind") == v).alias(k) for k, v in shares.items()], percent(rest).alias("other"))


def log_templates(logs: DataFrame, limit: int = LOGS, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    """service, template, hash, level, timestamp of the newest message and count, of each service's newest 2 * limit error messages.

    Templates come in order of their newest message; limit of them stay.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), "message")
    taken = logs.where(F.upper("level").isin(*health.ERROR_LEVELS)).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= 2 * limit)
    named = taken.withColumn("template", redact.template(F.col("message")))
    grouped = named.groupBy(*keys, "template").agg(F.min("place").alias("first"), F.max("timestamp").alias("timestamp"), F.min_by("level", "place").alias("level"), F.count("*").alias("count"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    return grouped.withColumn("place", order).where(F.col("place") <= limit).select(*keys, "place", "template", redact.short_hash(F.col("template")).alias("hash"), "level", "timestamp", "count")


def tag_error(tags: Column) -> Column:
    return F.when(tags.contains("error") | tags.contains("exception"), "exception").when(tags.contains("timeout"), "timeout").otherwise("")


def failing_traces(spans: DataFrame, limit: int = TRACES, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    """service, operation with its path redacted, the longest duration, status and error type of the newest, and count."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), "operation", F.desc("duration_us"), "span_id")
    taken = spans.where(health.failed()).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= 2 * limit)
    tags = F.coalesce(F.col("tags") if dict(spans.dtypes).get("tags") == "string" else F.to_json("tags"), F.lit("")) if "tags" in spans.columns else F.lit("")
    named = taken.withColumns({"operation": redact.redact_path(F.col("operation")), "error_type": tag_error(tags)})
    grouped = named.groupBy(*keys, "operation").agg(F.min("place").alias("first"), (F.max("duration_us") / 1000).alias("max_ms"), F.min_by("status", "place").alias("status"), F.min_by("error_type", "place").alias("error_type"), F.count("*").alias("count"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    return grouped.withColumn("place", order).where(F.col("place") <= limit).select(*keys, "place", "operation", "max_ms", "status", "error_type", "count")


def endpoints(spans: DataFrame, limit: int = ENDPOINTS) -> DataFrame:
    """Each service's operations with errors, by error ratio; paths are redacted after the limit, so two may look alike."""
    return _rated(health.latency(spans, ["service", "operation"], 99), ("service",), limit)


def _rated(grouped: DataFrame, keys: tuple[str, ...], limit: int) -> DataFrame:
    rated = grouped.where("errors > 0").withColumn("error_rate", health.ratio(F.col("errors"), F.col("total")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("error_rate"), "operation"))
    return rated.withColumn("place", place).where(F.col("place") <= limit).withColumn("operation", redact.redact_path(F.col("operation")))


_POINT = ("service", "at")


def _nested(df: DataFrame, name: str) -> DataFrame:
    """A point's rows in order of their place, bounded by the limits above."""
    fields = [c for c in df.columns if c not in _POINT]
    return df.groupBy(*_POINT).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _counted(spans: DataFrame, points: DataFrame, lookback: int) -> DataFrame:
    """service, at, operation, duration_us, and by span of time before the point how many spans and errors: now, before that, and as baseline."""
    rows = spans.select("service", "timestamp", "operation", "duration_us", health.failed().alias("bad"))
    met = intervals.within(rows, points, 4 * lookback)
    after = lambda s: F.col("timestamp") > intervals.ago(F.col("at"), s)
    spans_of_time = {"now": after(lookback // 3), "look": after(lookback), "base": F.col("timestamp") < intervals.ago(F.col("at"), lookback)}
    n = lambda part: F.sum(part.cast("long"))
    sums = [c for k, part in spans_of_time.items() for c in (n(part).alias(f"{k}_total"), n(part & F.col("bad")).alias(f"{k}_errors"))]
    return met.groupBy(*_POINT, "operation", "duration_us").agg(*sums)


def _metrics(counted: DataFrame, lookback: int) -> DataFrame:
    """A row a point: rates, p99 and spans a minute now and as baseline, and the trend within the lookback."""
    names = [f"{k}_{x}" for k in ("now", "look", "base") for x in ("total", "errors")]
    rows = health.percentile_table(counted, list(_POINT), {"now_p99": (0.99, "now_total"), "base_p99": (0.99, "base_total")}, {k: F.sum(k) for k in names})
    rate = lambda e, t: health.ratio(F.col(e), F.col(t))
    minutes = {"now": lookback / 180, "base": lookback / 20}
    early_n, early_e = F.col("look_total") - F.col("now_total"), F.col("look_errors") - F.col("now_errors")
    recent, earlier = rate("now_errors", "now_total"), health.ratio(early_e, early_n)
    change = recent - earlier
    trend = F.when((early_n == 0) | (F.col("now_total") == 0), "unknown").when(change > 0.01, "worsening").when(change < -0.01, "improving").otherwise("stable")
    one = [(rate("now_errors", "now_total"), "error_rate"), (rate("base_errors", "base_total"), "error_rate_baseline"), (F.coalesce("now_p99", F.lit(0.0)), "p99_ms"), (F.coalesce("base_p99", F.lit(0.0)), "p99_ms_baseline")]
    one += [(F.col(f"{k}_total") / m, name) for (k, m), name in zip(minutes.items(), ("per_minute", "per_minute_baseline"), strict=True)]
    shown = F.struct(recent.alias("recent_rate"), earlier.alias("earlier_rate"), F.greatest(recent, earlier).alias("peak_rate"), trend.alias("trend")).alias("trend")
    return rows.select(*_POINT, *[c.alias(k) for c, k in one], F.when(F.col("look_total") > 0, shown).alias("trend"))


def _endpoints(counted: DataFrame) -> DataFrame:
    rows = health.percentile_table(counted.where("look_total > 0"), [*_POINT, "operation"], {"p99_ms": (0.99, "total")}, {"total": F.sum("look_total"), "errors": F.sum("look_errors")})
    return _rated(rows, _POINT, ENDPOINTS).select(*_POINT, "place", "operation", "total", "errors", "error_rate", "p99_ms")


def bundles(anomalies: DataFrame, spans: DataFrame, logs: DataFrame, history: DataFrame, as_of: datetime | None = None, lookback: int = LOOKBACK_SECONDS, after: int = 0, snapshots: DataFrame | None = None) -> DataFrame:
    """A row an anomaly with all its evidence: metrics, breakdown, logs, traces, endpoints, correlations, trend, scope, fingerprint, matches, confidence.

    anomalies: service, anomaly_type, severity, value, threshold, detected_at. Each is looked at `after` seconds after it was detected, the
    length of a cycle where that is known by its start, or all at as_of if that is given; nothing later is evidence, incidents of the
    history neither. The last third of the lookback is the present: it is compared with three lookbacks before the lookback, and for the
    trend with the rest of it. Parts without rows are empty, or null where they are one value. snapshots: service, timestamp and what
    else is known of a service's infrastructure at that time; each anomaly gets the last one before it as infra.

    What several parts read is written to the shared folder once: the anomalies, the counts of spans, the calls around each point, the
    newest error messages, and the evidence before it meets the history. Only rows in some anomaly's reach are read of each table.
    """
    at = F.lit(as_of).cast("timestamp_ntz") if as_of else F.col("detected_at").cast("timestamp_ntz") + F.expr(f"INTERVAL {after} SECONDS")
    found = shared.written(anomalies.withColumn("at", at), "anomalies")
    points = found.select(*_POINT).where("service IS NOT NULL AND at IS NOT NULL").distinct()
    reach, near = intervals.span(points, 4 * lookback), intervals.span(points, lookback)
    counted = shared.written(_counted(intervals.between(spans, reach), points, lookback), "counts")
    linked = shared.written(topology.around(_by(spans, near), points, lookback), "calls")
    c = topology.correlated(linked).select(*_POINT, F.struct(F.col("other").alias("service"), "direction", "error_rate").alias("c"))
    correlations = c.groupBy(*_POINT).agg(F.sort_array(F.collect_list("c")).alias("correlations"))  # ten at most
    bad = intervals.within(intervals.between(logs.where(F.upper("level").isin(*health.ERROR_LEVELS)), near).select("service", "timestamp", "level", "message"), points, lookback)
    newest = F.row_number().over(Window.partitionBy(*_POINT).orderBy(F.desc("timestamp"), "message"))
    messages = shared.written(bad.withColumn("place", newest).where(F.col("place") <= max(BREAKDOWN, 2 * LOGS)).drop("place"), "messages")
    breakdown = error_breakdown(messages, keys=_POINT).select(*_POINT, F.struct("timeout", "connection_error", "server_error_5xx", "client_error_4xx", "other").alias("error_breakdown"))
    failing = intervals.within(intervals.between(spans.where(health.failed()), near), points, lookback)
    parts = [
        correlations, topology.healthy(linked), _metrics(counted, lookback), breakdown, _nested(log_templates(messages, keys=_POINT), "logs"),
        _nested(failing_traces(failing, keys=_POINT), "traces"), _nested(_endpoints(counted), "endpoints"),
    ]
    out = found.join(_together(parts), list(_POINT), "left")
    out = incidents.scope(out).drop("neighbours").withColumn("namespace", redact.namespace(F.col("service")))
    named = F.coalesce("correlations", F.array().cast("array<struct<service:string,direction:string,error_rate:double>>"))
    out = out.withColumn("fingerprint", incidents.fingerprint(F.col("service"), F.col("anomaly_type"), named))
    out = incidents.matched(shared.written(out, "evidence"), history, "at")
    if snapshots is not None:
        out = intervals.as_of(out, snapshots.withColumnRenamed("timestamp", "at"), 4 * lookback, time="at", name="infra")
    return out


def _together(parts: list[DataFrame]) -> DataFrame:
    """The parts' columns beside each other, a row a point: one grouping of all rows in place of a join for each part."""
    held = [p.select(*_POINT, F.struct(*[c for c in p.columns if c not in _POINT]).alias(f"_{i}")) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held)
    one = rows.groupBy(*_POINT).agg(*[F.first(f"_{i}", ignorenulls=True).alias(f"_{i}") for i in range(len(parts))])  # each part has a row a point
    return one.select(*_POINT, *[f"_{i}.{c}" for i, p in enumerate(parts) for c in p.columns if c not in _POINT])


def _by(spans: DataFrame, reach: tuple | None) -> DataFrame:
    """Spans that began by the end of a span of time: a callee may have begun before its caller, but not after the point."""
    return spans.where("false") if reach is None else spans.where(F.col("timestamp") <= F.lit(reach[1]).cast("timestamp_ntz"))


def payloads(bundle: DataFrame) -> DataFrame:
    """service, the bundle as JSON and its size in bytes."""
    text = F.to_json(F.struct(*bundle.columns))
    return bundle.select("service", text.alias("payload"), F.octet_length(text).alias("bytes"))
