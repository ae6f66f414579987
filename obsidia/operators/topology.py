"""Who calls whom: edges between services from parents and children of spans, and how errors go along them.

A child's row joins its parent's on the span id; where ids repeat, the join's rows are counted as they come. A hot id is split by
adaptive execution, as nothing stands between the join and its exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsidia.operators import intervals
from obsidia.operators.health import errors, ratio


def calls(spans: DataFrame) -> DataFrame:
    """A row a matched child: caller and callee with their status and the child's duration."""
    p = spans.where("span_id IS NOT NULL").select(F.col("span_id").alias("id"), F.col("service").alias("caller"), F.col("status").alias("caller_status"))
    c = spans.where("parent_span_id IS NOT NULL").select(F.col("parent_span_id").alias("id"), F.col("service").alias("callee"), F.col("status").alias("callee_status"), F.col("duration_us").alias("callee_us"))
    return c.join(p, "id").drop("id")


def edges(spans: DataFrame) -> DataFrame:
    """caller, callee and the number of calls between different services."""
    return calls(spans).where("caller <> callee").groupBy("caller", "callee").agg(F.count("*").alias("calls"))


def dependencies(spans: DataFrame, service: str) -> DataFrame:
    return edges(spans.where("service IS NOT NULL")).where(F.col("caller") == service).select(F.col("callee").alias("dependency"))


def _correlated(found: DataFrame, service: str, status: str, direction: str, limit: int) -> DataFrame:
    grouped = found.groupBy(F.col(service).alias("service")).agg(F.count("*").alias("total"), errors(status).alias("errors"), (F.avg("callee_us") / 1000).alias("avg_ms")).where("errors > 0")
    best = grouped.withColumn("error_rate", ratio(F.col("errors"), F.col("total"))).orderBy(F.desc("error_rate"), "service").limit(limit)
    return best.where("error_rate > 0.05").select("service", F.lit(direction).alias("direction"), "total", "errors", "error_rate", "avg_ms")


def downstream(spans: DataFrame, service: str, limit: int = 5) -> DataFrame:
    """What a service calls and fails: the limit highest error ratios, of those the ones over 0.05."""
    return _correlated(calls(spans).where((F.col("caller") == service) & (F.col("callee") != service)), "callee", "callee_status", "downstream", limit)


def upstream(spans: DataFrame, service: str, limit: int = 5) -> DataFrame:
    """What calls a service and fails; a caller's span counts once for each of its matching children."""
    return _correlated(calls(spans).where((F.col("callee") == service) & (F.col("caller") != service)), "caller", "caller_status", "upstream", limit)


def correlations(spans: DataFrame, services: DataFrame, limit: int = 5) -> DataFrame:
    """downstream and upstream of many services from one join: of, service, direction, total, errors, error_rate, avg_ms."""
    both = calls(spans).where("caller <> callee")
    down = both.select(F.col("caller").alias("of"), F.col("callee").alias("service"), F.lit("downstream").alias("direction"), F.col("callee_status").alias("status"), "callee_us")
    up = both.select(F.col("callee").alias("of"), F.col("caller").alias("service"), F.lit("upstream").alias("direction"), F.col("caller_status").alias("status"), "callee_us")
    found = down.unionByName(up).groupBy("of", "service", "direction").agg(F.count("*").alias("total"), errors().alias("errors"), (F.avg("callee_us") / 1000).alias("avg_ms")).where("errors > 0")
    found = found.join(services.select(F.col("service").alias("of")).distinct(), "of").withColumn("error_rate", ratio(F.col("errors"), F.col("total")))
    place = F.row_number().over(Window.partitionBy("of", "direction").orderBy(F.desc("error_rate"), "service"))
    return found.withColumn("place", place).where((F.col("place") <= limit) & (F.col("error_rate") > 0.05)).drop("place")


def healthy_neighbours(spans: DataFrame, service: str, limit: int = 10) -> DataFrame:
    """Services one call away in either direction whose calls fail in less than one of a hundred cases."""
    both = calls(spans).where("caller <> callee")
    down = both.where(F.col("caller") == service).groupBy(F.col("callee").alias("service")).agg(F.count("*").alias("n"), errors("callee_status").alias("e"))
    up = both.where(F.col("callee") == service).groupBy(F.col("caller").alias("service")).agg(F.count("*").alias("n"), errors("caller_status").alias("e"))
    rates = down.unionByName(up).select("service", (F.col("e") / F.nullif(F.col("n"), F.lit(0))).alias("error_rate")).distinct()
    return rates.where("error_rate IS NULL OR error_rate < 0.01").orderBy("service", "error_rate").limit(limit)


def healthy_around(spans: DataFrame, services: DataFrame, limit: int = 10) -> DataFrame:
    """healthy_neighbours of many services from one join: of, and neighbours in order of their names."""
    both = calls(spans).where("caller <> callee")
    down = both.select(F.col("caller").alias("of"), F.col("callee").alias("service"), F.lit("down").alias("side"), F.col("callee_status").alias("status"))
    up = both.select(F.col("callee").alias("of"), F.col("caller").alias("service"), F.lit("up").alias("side"), F.col("caller_status").alias("status"))
    rates = down.unionByName(up).groupBy("of", "service", "side").agg((errors() / F.count("*")).alias("error_rate")).where("error_rate < 0.01")
    named = rates.select("of", "service").distinct().join(services.select(F.col("service").alias("of")).distinct(), "of")
    place = F.row_number().over(Window.partitionBy("of").orderBy("service"))
    return named.withColumn("place", place).where(F.col("place") <= limit).groupBy("of").agg(F.sort_array(F.collect_list("service")).alias("neighbours"))


def around(spans: DataFrame, points: DataFrame, before: int) -> DataFrame:
    """service, at, other, direction, total, errors and avg_ms: what was called by each point's service, and what called it, in its window.

    points: service and at, each once. A call counts whose caller began in (at - before, at] and whose callee began by then. Callers
    outside all windows are left out before calls are matched.
    """
    buckets = points.select(F.explode(F.sequence(intervals.bucket(intervals.ago(F.col("at"), before), before), intervals.bucket(F.col("at"), before))).alias("_near")).distinct()
    p = spans.where("span_id IS NOT NULL").select(F.col("span_id").alias("id"), F.col("service").alias("caller"), F.col("status").alias("caller_status"), "timestamp")
    p = p.withColumn("_near", intervals.bucket(F.col("timestamp"), before)).join(buckets, "_near", "left_semi").drop("_near")
    c = spans.where("parent_span_id IS NOT NULL").select(F.col("parent_span_id").alias("id"), F.col("service").alias("callee"), F.col("status").alias("callee_status"), F.col("duration_us").alias("callee_us"), F.col("timestamp").alias("callee_at"))
    both = c.join(p, "id").where("caller <> callee").drop("id")
    side = lambda own, other, d: F.struct(F.col(own).alias("service"), F.col(other).alias("other"), F.lit(d).alias("direction"), F.col(f"{other}_status").alias("status"))
    each = both.select("timestamp", "callee_at", "callee_us", F.explode(F.array(side("caller", "callee", "downstream"), side("callee", "caller", "upstream"))).alias("s")).select("timestamp", "callee_at", "callee_us", "s.*")
    met = intervals.within(each, points.select("service", "at"), before).where("callee_at <= at")
    return met.groupBy("service", "at", "other", "direction").agg(F.count("*").alias("total"), errors().alias("errors"), (F.avg("callee_us") / 1000).alias("avg_ms"))


def correlated(linked: DataFrame, limit: int = 5) -> DataFrame:
    """Of around(): a point's others by direction with the `limit` highest error ratios, of those the ones over 0.05."""
    rated = linked.where("errors > 0").withColumn("error_rate", ratio(F.col("errors"), F.col("total")))
    place = F.row_number().over(Window.partitionBy("service", "at", "direction").orderBy(F.desc("error_rate"), "other"))
    return rated.withColumn("place", place).where((F.col("place") <= limit) & (F.col("error_rate") > 0.05)).drop("place")


def healthy(linked: DataFrame, limit: int = 10) -> DataFrame:
    """Of around(): service, at and neighbours, the names of others that fail in less than one of a hundred calls in some direction."""
    named = linked.where(F.col("errors") / F.col("total") < 0.01).select("service", "at", "other").distinct()
    place = F.row_number().over(Window.partitionBy("service", "at").orderBy("other"))
    return named.withColumn("place", place).where(F.col("place") <= limit).groupBy("service", "at").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
