"""Service health: counts, error rates and exact latency percentiles, over windows that the caller places in time."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR_LEVELS = ("ERROR", "WARN", "FATAL")


def failed(status: str = "status") -> Column:
    """Statuses are compared without regard to case."""
    return F.upper(F.coalesce(F.col(status), F.lit(""))) == "ERROR"


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def errors(status: str = "status") -> Column:
    return F.coalesce(F.sum(failed(status).cast("long")), F.lit(0))


def within(df: DataFrame, as_of: datetime | None, seconds: int, until: int = 0, column: str = "timestamp") -> DataFrame:
    """Rows later than as_of - seconds and no later than as_of - until; all rows if as_of is None."""
    if as_of is None:
        return df
    at = F.lit(as_of).cast("timestamp_ntz")
    low, high = (at - F.expr(f"INTERVAL {s} SECONDS") for s in (seconds, until))
    return df.where((F.col(column) > low) & (F.col(column) <= high))


#: Leading bits of a value by which values are put in buckets: no bucket is wider than a thousandth of what it holds.
_BITS = 10


def _leading(value: Column) -> Column:
    """A bucket of neighbouring values, in their order: how many bits they have and the first of them."""
    whole = F.floor(F.abs(value)).cast("long")
    more = F.greatest(F.floor(F.log2(F.greatest(whole, F.lit(1)).cast("double"))).cast("int") + 1 - _BITS, F.lit(0))
    place = F.shiftleft(more.cast("long"), _BITS + 1) + F.call_function("shiftright", whole, more)
    return F.when(value < 0, -place - 1).otherwise(place)


def percentile_table(df: DataFrame, keys: list[str], of: dict[str, tuple[float, str]], sums: dict[str, Column], value: str = "duration_us") -> DataFrame:
    """A row a group: keys, the sums, and percentiles of value in thousandths, exact and interpolated between neighbours.

    sums: aggregates that add up. of: by name the share and which of the sums counts the rows; null where it counts none. Rows are
    counted by group and value first, then by buckets of values. Running sums over a group's buckets, of which there are a few
    thousand, tell which bucket holds a rank, and only the values of those are ranked, bucket by bucket. So no task holds a group.
    """
    counted = df.groupBy(*keys, value).agg(*[c.alias(k) for k, c in sums.items()])
    there = F.col(value).isNotNull()
    weights = sorted({w for _, w in of.values()})
    n = {w: F.when(there, F.coalesce(w, F.lit(0))).otherwise(0) for w in weights}
    spot = F.coalesce(_leading(F.col(value)), F.lit(-(1 << 62)))
    counted = counted.withColumn("_spot", spot)
    buckets = counted.groupBy(*keys, "_spot").agg(*[F.sum(k).alias(k) for k in sums], *[F.sum(n[w]).alias(f"_n_{w}") for w in weights])
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_spot").rowsBetween(Window.unboundedPreceding, 0)
    ranked = buckets.select(*keys, "_spot", *[F.sum(k).over(group).alias(k) for k in sums], F.row_number().over(group.orderBy("_spot")).alias("_first"),
        *[(F.sum(f"_n_{w}").over(upto) - F.col(f"_n_{w}")).alias(f"_before_{w}") for w in weights], *[F.col(f"_n_{w}") for w in weights], *[F.sum(f"_n_{w}").over(group).alias(f"_all_{w}") for w in weights])
    place = {name: share * (F.col(f"_all_{w}") - 1) for name, (share, w) in of.items()}
    ends = {(name, k): F.when(F.col(f"_all_{of[name][1]}") > 0, f(place[name])) for name in of for k, f in (("low", F.floor), ("high", F.ceil))}

    def holds(name: str, k: str) -> Column:
        before, own = F.col(f"_before_{of[name][1]}"), F.col(f"_n_{of[name][1]}")
        return (ends[name, k] >= before) & (ends[name, k] < before + own)

    # A group's first bucket stays with those that hold a rank: each group gives a row.
    some = reduce(lambda a, b: a | b, [F.coalesce(holds(*e), F.lit(False)) for e in ends], F.col("_first") == 1)
    held = ranked.where(some).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_spot").alias("_at"), *[F.col(k).alias(f"_sum_{k}") for k in sums], *[f"_before_{w}" for w in weights], *[x.alias(f"_{k}_{name}") for (name, k), x in ends.items()], *[(place[name] - F.floor(place[name])).alias(f"_part_{name}") for name in of])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_spot") == F.col("_at"))
    inside = Window.partitionBy(*keys, "_spot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    values = counted.join(held, same).select("*", *[(F.col(f"_before_{w}") + F.sum(n[w]).over(inside)).alias(f"_upto_{w}") for w in weights])
    at = [F.min(F.when(there & (F.col(f"_upto_{of[name][1]}") > F.col(f"_{k}_{name}")), F.col(value))).alias(f"_{k}_value_{name}") for name, k in ends]
    grouped = values.groupBy(*keys).agg(*[F.max(f"_sum_{k}").alias(k) for k in sums], *at, *[F.max(f"_part_{name}").alias(f"_part_{name}") for name in of])
    found = [((F.col(f"_low_value_{name}") + F.col(f"_part_{name}") * (F.col(f"_high_value_{name}") - F.col(f"_low_value_{name}"))) / 1000).alias(name) for name in of]
    return grouped.select(*keys, *sums, *found)


def _percentiles(*of: int, weight: str = "total") -> dict[str, tuple[float, str]]:
    return {f"p{p}_ms": (p / 100, weight) for p in of}


def latency(spans: DataFrame, keys: list[str], *of: int) -> DataFrame:
    """A row a group: keys, total, errors and the percentiles pN_ms of durations."""
    return percentile_table(spans, keys, _percentiles(*of), {"total": F.count("*"), "errors": errors()})


def service_health(spans: DataFrame, as_of: datetime | None = None, seconds: int = 300) -> DataFrame:
    """A row a service: spans, errors, error_rate, p50_ms, p99_ms, per_minute. Percentiles interpolate between neighbours."""
    grouped = latency(within(spans, as_of, seconds), ["service"], 50, 99)
    return grouped.withColumn("error_rate", ratio(F.col("errors"), F.col("total"))).withColumn("per_minute", F.col("total") / (seconds / 60))


def sliding_health(spans: DataFrame, window: str = "5 minutes", slide: str = "10 seconds") -> DataFrame:
    """service_health in each sliding window, a whole number of slides long. Windows are closed at their start and open at their end.

    Rows are counted by slide and value first; only the counts are sent to the windows that the slide is part of.
    """
    panes = spans.groupBy(F.window("timestamp", slide)["start"].alias("pane"), "service", "duration_us").agg(F.count("*").alias("total"), errors().alias("errors"))
    length, step = F.expr(f"INTERVAL '{window}'"), F.expr(f"INTERVAL '{slide}'")
    first = F.col("pane") - length + step
    opened = panes.withColumn("window_start", F.explode(F.sequence(first, F.col("pane"), step)))
    grouped = percentile_table(opened, ["window_start", "service"], _percentiles(50, 99), {"total": F.sum("total"), "errors": F.sum("errors")})
    return grouped.select("window_start", "service", "total", "errors", ratio(F.col("errors"), F.col("total")).alias("error_rate"), "p50_ms", "p99_ms")


def recent_errors(logs: DataFrame, service: str | None = None, limit: int = 20) -> DataFrame:
    """The newest error messages; ties by service and message."""
    found = logs.where(F.upper("level").isin(*ERROR_LEVELS))
    found = found.where(F.col("service") == service) if service else found
    return found.select("timestamp", "service", "level", "message").orderBy(F.desc("timestamp"), "service", "message").limit(limit)


def slow_operations(spans: DataFrame, limit: int = 10) -> DataFrame:
    return spans.groupBy("service", "operation").agg((F.avg("duration_us") / 1000).alias("avg_ms"), F.count("*").alias("total")).orderBy(F.desc("avg_ms"), "service", "operation").limit(limit)


def affected_endpoints(spans: DataFrame, service: str | None = None, limit: int = 10) -> DataFrame:
    """Operations with errors, by error ratio."""
    found = spans.where(F.col("service") == service) if service else spans
    grouped = latency(found, ["operation"], 99).where("errors > 0")
    return grouped.withColumn("error_rate", ratio(F.col("errors"), F.col("total"))).orderBy(F.desc("error_rate"), "operation").limit(limit)


def current_and_baseline(spans: DataFrame, as_of: datetime, current: int = 300, since: int = 3600, until: int = 900) -> DataFrame:
    """A row a service: rates and p99 now, and over the open interval that is the baseline, in one pass."""
    at = F.lit(as_of).cast("timestamp_ntz")
    ago = lambda s: at - F.expr(f"INTERVAL {s} SECONDS")
    now = F.col("timestamp") > ago(current)
    base = (F.col("timestamp") > ago(since)) & (F.col("timestamp") < ago(until))

    found = spans.where((F.col("timestamp") > ago(max(current, since))) & (F.col("timestamp") <= at))
    sums, minutes = {}, {"current": current / 60, "baseline": (since - until) / 60}
    for name, part in (("current", now), ("baseline", base)):
        sums |= {f"{name}_total": F.sum(part.cast("long")), f"{name}_errors": F.sum((part & failed()).cast("long"))}
    grouped = percentile_table(found, ["service"], {f"{name}_p99_ms": (0.99, f"{name}_total") for name in minutes}, sums)
    of = lambda name: [f"{name}_total", ratio(F.col(f"{name}_errors"), F.col(f"{name}_total")).alias(f"{name}_error_rate"), F.coalesce(f"{name}_p99_ms", F.lit(0.0)).alias(f"{name}_p99_ms"), (F.col(f"{name}_total") / minutes[name]).alias(f"{name}_per_minute")]
    return grouped.select("service", *of("current"), *of("baseline"))


def error_trend(spans: DataFrame, as_of: datetime, recent: int = 300, before: int = 900) -> DataFrame:
    """A row a service: error rates of the recent and the earlier span of time, their peak, and worsening, improving, stable or unknown."""
    at = F.lit(as_of).cast("timestamp_ntz")
    split, start = (at - F.expr(f"INTERVAL {s} SECONDS") for s in (recent, before))
    late, early = F.col("timestamp") > split, F.col("timestamp") <= split
    n = lambda part: F.sum(part.cast("long"))
    found = spans.where((F.col("timestamp") > start) & (F.col("timestamp") <= at)).groupBy("service")
    counts = found.agg(n(late).alias("n1"), n(late & failed()).alias("e1"), n(early).alias("n0"), n(early & failed()).alias("e0"))
    rates = counts.select("service", "n0", "n1", ratio(F.col("e1"), F.col("n1")).alias("recent_rate"), ratio(F.col("e0"), F.col("n0")).alias("earlier_rate"))
    change = F.col("recent_rate") - F.col("earlier_rate")
    trend = F.when((F.col("n0") == 0) | (F.col("n1") == 0), "unknown").when(change > 0.01, "worsening").when(change < -0.01, "improving").otherwise("stable")
    return rates.select("service", "recent_rate", "earlier_rate", F.greatest("recent_rate", "earlier_rate").alias("peak_rate"), trend.alias("trend"))


def summary(health: DataFrame, active: DataFrame) -> DataFrame:
    """One row: how many services are below and above one error in a hundred, each service's health, and active anomalies."""
    services = health.agg(
        F.count(F.when(F.col("error_rate") < 0.01, 1)).alias("healthy"), F.count(F.when(F.col("error_rate") >= 0.01, 1)).alias("degraded"),
        F.sort_array(F.collect_list(F.struct("service", "total", "errors", "error_rate", "p99_ms"))).alias("services"),
    )
    found = active.agg(F.sort_array(F.collect_list(F.struct("service", "anomaly_type", "severity"))).alias("anomalies"))
    return services.join(F.broadcast(found))  # one row each


def summary_payload(summary: DataFrame) -> DataFrame:
    """A summary as JSON."""
    return summary.select(F.to_json(F.struct("healthy", "degraded", "services", "anomalies")).alias("payload"))
