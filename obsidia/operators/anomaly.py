"""Anomalies against a moving baseline of each service.

Health is taken in cycles. A service's first cycle seeds its averages, and each cycle, that one and anomalous ones too, moves them.
A cycle is compared with the averages before it moves them. A moved average is a factor times the average before plus something, so
cycles are folded in chunks whose start need not be known, the chunks' factors are folded once a service, and each cycle's average
follows from its chunk's start. What fires is then one fold over what is beyond its bounds. No fold copies more than a chunk or what fired.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia.operators.health import errors, percentile_table, ratio

# Fixed values of detection.
ALPHA, LEAST_CYCLES, FACTOR, DROP = 0.1, 5, 3.0, 0.5
ERROR_FLOOR, LATENCY_FLOOR, COOLDOWN_SECONDS = 0.01, 100.0, 300
KINDS = ("error_spike", "latency_spike", "traffic_drop")
#: Cycles that one fold takes.
CHUNK = 128
_VALUES = ("error_rate", "p99_ms", "per_minute")


def cycles(spans: DataFrame, length: str = "10 seconds", minutes: float = 1 / 6) -> DataFrame:
    """service, t, error_rate, p99_ms and per_minute in windows of one length, one after the other."""
    timed = spans.withColumn("w", F.window("timestamp", length))
    grouped = percentile_table(timed, ["service", "w"], {"p99_ms": (0.99, "n")}, {"n": F.count("*"), "e": errors()})
    return grouped.select("service", F.col("w.start").alias("t"), ratio(F.col("e"), F.col("n")).alias("error_rate"), F.col("p99_ms"), (F.col("n") / minutes).alias("per_minute"))


#: Cycles of silence after which a service counts as gone and has no more of them.
PATIENCE = 30


def filled(cycle: DataFrame, length: int, until: datetime | None = None, patience: int = PATIENCE) -> DataFrame:
    """The cycles, and for each service those in which it sent nothing, of no requests a minute and without the other values.

    length: seconds of a cycle. A service's silence begins after its first cycle and counts for `patience` cycles in a row at most.
    After its last cycle it counts in cycles that have ended by `until`, which None leaves out.
    """
    step, t = F.expr(f"INTERVAL {length} SECONDS"), F.col("t").cast("timestamp_ntz")
    clean = cycle.withColumn("t", t)
    end = F.lit(until).cast("timestamp_ntz") if until else F.lit(None).cast("timestamp_ntz")
    following = F.coalesce(F.lead("t").over(Window.partitionBy("service").orderBy("t")), F.greatest(end, F.col("t") + step))
    last = F.least(following - step, F.col("t") + F.expr(f"INTERVAL {length * patience} SECONDS"))
    gaps = clean.select("service", "t", last.alias("last")).where((F.col("last") >= F.col("t") + step) & F.col("last").isNotNull())
    silent = gaps.select("service", F.explode(F.sequence(F.col("t") + step, F.col("last"), step)).alias("t"))
    return clean.unionByName(silent.withColumn("per_minute", F.lit(0.0)), allowMissingColumns=True)


def severity(value: Column, threshold: Column) -> Column:
    times = value / threshold
    return F.when(times > 5, "critical").when(times > 3, "high").when(times > 2, "medium").otherwise("low")


def _chunked(rows: Column) -> Column:
    """For each cycle of a chunk its values and, for each value, the factor and the addend that give the average before it from the chunk's start."""
    line = ", ".join(f"{v}:struct<a:double,b:double>" for v in _VALUES)
    cycle = "struct<t:timestamp_ntz,n:bigint,error_rate:double,p99_ms:double,per_minute:double>"
    state = f"struct<now:struct<{line}>,out:array<struct<x:{cycle},before:struct<{line}>>>>"

    def step(s: Column, x: Column) -> Column:
        moved = [F.struct(F.when(x[v].isNull(), s["now"][v]["a"]).otherwise(s["now"][v]["a"] * (1 - ALPHA)).alias("a"), F.when(x[v].isNull(), s["now"][v]["b"]).otherwise(s["now"][v]["b"] * (1 - ALPHA) + x[v] * ALPHA).alias("b")).alias(v) for v in _VALUES]
        return F.struct(F.struct(*moved).alias("now"), F.concat(s["out"], F.array(F.struct(x.alias("x"), s["now"].alias("before")))).alias("out")).cast(state)

    none = F.struct(*[F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).alias(v) for v in _VALUES])
    return F.aggregate(rows, F.struct(none.alias("now"), F.array().alias("out")).cast(state), step)


def _averages(cycle: DataFrame) -> DataFrame:
    """service, t, n (from 1), the cycle's values, and as avg_ the averages before it."""
    number = F.row_number().over(Window.partitionBy("service").orderBy("t")).cast("long")
    clean = cycle.select("service", F.col("t").cast("timestamp_ntz").alias("t"), *[F.col(v).cast("double").alias(v) for v in _VALUES]).withColumn("n", number)
    chunks = clean.groupBy("service", F.expr(f"(n - 1) DIV {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("t", "n", *_VALUES))).alias("rows"))
    chunks = chunks.withColumn("f", _chunked(F.col("rows"))).select("service", "chunk", "f.now", "f.out", F.col("rows")[0].alias("first"))
    line = ", ".join(f"{v}:double" for v in _VALUES)
    state = f"struct<now:struct<{line}>,starts:array<struct<chunk:bigint,{line}>>>"

    def step(s: Column, x: Column) -> Column:
        """Where a chunk starts: the first with its first cycle, the others where the one before ends."""
        start = [F.when(x["chunk"] == 0, x["first"][v]).otherwise(s["now"][v]) for v in _VALUES]
        after = [(a * x["now"][v]["a"] + x["now"][v]["b"]).alias(v) for a, v in zip(start, _VALUES, strict=True)]
        row = F.struct(x["chunk"].alias("chunk"), *[a.alias(v) for a, v in zip(start, _VALUES, strict=True)])
        return F.struct(F.struct(*after).alias("now"), F.concat(s["starts"], F.array(row)).alias("starts")).cast(state)

    nothing = F.struct(F.struct(*[F.lit(None).cast("double").alias(v) for v in _VALUES]).alias("now"), F.array().alias("starts")).cast(state)
    carried = chunks.groupBy("service").agg(F.sort_array(F.collect_list(F.struct("chunk", "now", "first"))).alias("ends"))  # one a chunk
    carried = carried.select("service", F.explode(F.aggregate("ends", nothing, step)["starts"]).alias("s")).select("service", "s.chunk", F.col("s").alias("start"))
    each = chunks.join(carried, ["service", "chunk"]).select("service", "start", F.explode("out").alias("o"))
    return each.select("service", "o.x.*", *[(F.col(f"start.{v}") * F.col(f"o.before.{v}.a") + F.col(f"o.before.{v}.b")).alias(f"avg_{v}") for v in _VALUES])


def baselines(cycle: DataFrame) -> DataFrame:
    """service, t, count and the averages that the cycle at t is compared with."""
    return _averages(cycle).select("service", "t", F.col("n").cast("int").alias("count"), *[f"avg_{v}" for v in _VALUES])


def anomalies(cycle: DataFrame, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """service, anomaly_type, severity, value, threshold and detected_at. A kind that fired is quiet for the cooldown."""
    e, p, r = (F.col(f"avg_{v}") for v in _VALUES)
    error, latency = F.greatest(e * FACTOR, F.lit(ERROR_FLOOR)), F.greatest(p * FACTOR, F.lit(LATENCY_FLOOR))
    share = F.col("per_minute") / F.nullif(r, F.lit(0.0))
    kinds = [
        ("error_spike", F.col("error_rate"), error, severity(F.col("error_rate"), error), (e > 0) & (F.col("error_rate") > error)),
        ("latency_spike", F.col("p99_ms"), latency, severity(F.col("p99_ms"), latency), (p > 0) & (F.col("p99_ms") > latency)),
        ("traffic_drop", share, F.lit(DROP), F.lit("medium"), (r > 0) & (share < DROP)),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("anomaly_type"), F.struct("t", v.alias("value"), b.alias("threshold"), s.alias("severity")).alias("x"), over.alias("over")) for k, v, b, s, over in kinds])
    beyond = _averages(cycle).where(F.col("n") >= LEAST_CYCLES).select("service", F.explode(each).alias("a")).where("a.over")
    one = "struct<t:timestamp_ntz,value:double,threshold:double,severity:string>"
    state = f"struct<quiet:timestamp_ntz,out:array<{one}>>"

    def step(s: Column, x: Column) -> Column:
        fires = s["quiet"].isNull() | (s["quiet"] <= x["t"])
        fired = F.struct((x["t"] + F.expr(f"INTERVAL {cooldown} SECONDS")).alias("quiet"), F.concat(s["out"], F.array(x)).alias("out")).cast(state)
        return F.when(fires, fired).otherwise(s)

    nothing = F.struct(F.lit(None).cast("timestamp_ntz").alias("quiet"), F.array().alias("out")).cast(state)
    found = beyond.groupBy("service", "a.anomaly_type").agg(F.sort_array(F.collect_list(F.col("a.x").cast(one))).alias("xs"))
    found = found.select("service", "anomaly_type", F.explode(F.aggregate("xs", nothing, step)["out"]).alias("x"))
    return found.select("service", "anomaly_type", "x.severity", "x.value", "x.threshold", F.col("x.t").alias("detected_at"))


def active(found: DataFrame, as_of: datetime, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Anomalies of the last seconds before as_of."""
    at = F.lit(as_of).cast("timestamp_ntz")
    return found.where((F.col("detected_at") > at - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("detected_at") <= at))
