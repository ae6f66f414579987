from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsidia.operators import anomaly, health, topology
from obsidia.streaming import pipelines

T0 = datetime(2024, 1, 5)
R = random.Random(8)
SCHEMA = "timestamp timestamp, trace_id string, span_id string, parent_span_id string, service string, duration_us long, status string"


def spans(n, minutes):
    """In order of arrival: near that of time, and parents as often after their children as before."""
    rows = []
    for i in range(n):
        t = T0 + timedelta(seconds=round(60 * minutes * i / n + R.uniform(0, 40), 3))
        parent = f"s{max(0, i + R.randint(-6, 6))}" if R.random() < 0.7 else None
        rows.append((t, "t", f"s{i}", parent, R.choice("abc"), R.choice([None, R.randint(1, 30) * 1000]) if R.random() < 0.1 else R.randint(1, 10**6), R.choice(["OK", "error", "OK"])))
    rows.append((T0 + timedelta(days=1), "t", "end", None, "end", 1, "OK"))  # closes what is open
    return rows


def arriving(spark, tmp_path, rows, files):
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ended(spark, tmp_path, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.sql(f"SELECT * FROM {name}").collect()


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def shown(rows, keys, *values):
    return sorted((*(str(r[k]) for k in keys), *(None if r[v] is None else round(float(r[v]), 6) for v in values)) for r in rows)


def test_exact_percentiles(spark, tmp_path):
    rows = spans(900, 60)
    got = ended(spark, tmp_path, pipelines.windowed_health(arriving(spark, tmp_path, rows, 6), "10 minutes", "5 minutes", "2 minutes"), "exact")
    want = [r for r in health.sliding_health(table(spark, rows[:-1]), "10 minutes", "5 minutes").collect()]
    names = ("total", "errors", "error_rate", "p50_ms", "p99_ms")
    assert shown([r for r in got if r.service != "end"], ("window_start", "service"), *names) == shown(want, ("window_start", "service"), *names)
    assert len(want) > 30


def test_anomalies_from_spans(spark, tmp_path):
    """Spans, cycles and anomalies in one stream: what fires, silence among it, is what fires of the table."""
    rows = [r for r in spans(1500, 90) if not (r[4] == "b" and timedelta(minutes=50) < r[0] - T0 < timedelta(minutes=80))]
    found = pipelines.detect(pipelines.stream_cycles(arriving(spark, tmp_path, rows, 6), "1 minute", 1, "2 minutes"), 60)
    got = ended(spark, tmp_path, found, "fired")
    batch = anomaly.anomalies(anomaly.filled(anomaly.cycles(table(spark, rows), "1 minute", 1), 60, rows[-1][0] - timedelta(minutes=2)))
    keys = ("service", "anomaly_type", "detected_at")
    own = lambda of: shown([r for r in of if r.service != "end"], keys, "value", "threshold")
    assert own(got) == own(batch.collect())
    assert any(r.service == "b" and r.anomaly_type == "traffic_drop" for r in got)


def test_cycles(spark, tmp_path):
    """The windows' values are those of the table."""
    rows = [r for r in spans(1500, 90) if not (r[4] == "b" and timedelta(minutes=50) < r[0] - T0 < timedelta(minutes=80))]
    cycles = pipelines.stream_cycles(arriving(spark, tmp_path, rows, 6), "1 minute", 1, "2 minutes")
    got = ended(spark, tmp_path, cycles, "cycles")
    want = anomaly.cycles(table(spark, rows[:-1]), "1 minute", 1)
    assert shown([r for r in got if r.service != "end"], ("service", "t"), "error_rate", "p99_ms", "per_minute") == shown(want.collect(), ("service", "t"), "error_rate", "p99_ms", "per_minute")


@pytest.mark.parametrize("late", [False, True])
def test_call_graph(spark, tmp_path, late):
    """Late parents: each file's children come a file before their parents."""
    rows = spans(600, 60)
    if late:
        rows = sorted(rows, key=lambda r: (r[0] - T0).total_seconds() + (0 if r[3] else 300))
    got = ended(spark, tmp_path, pipelines.stream_edges(arriving(spark, tmp_path, rows, 5), "15 minutes", "10 minutes", "20 minutes"), f"edges_{late}")
    start = F.date_trunc("hour", "at") + F.expr("make_dt_interval(0, 0, 15 * (minute(at) DIV 15), 0)")
    both = table(spark, rows)
    child = both.select(F.col("parent_span_id").alias("of"), F.col("timestamp").alias("at"), F.col("service").alias("callee"), F.col("status").alias("s"))
    parent = both.select("span_id", F.col("service").alias("caller"))
    batch = child.join(parent, child["of"] == parent["span_id"]).where("caller <> callee").groupBy(start.alias("window_start"), "caller", "callee").agg(F.count("*").alias("calls"), F.count(F.when(F.upper("s") == "ERROR", 1)).alias("errors"))
    assert shown(got, ("window_start", "caller", "callee"), "calls", "errors") == shown(batch.collect(), ("window_start", "caller", "callee"), "calls", "errors")
    total = {(r.caller, r.callee): r.calls for r in topology.edges(both).collect()}
    assert {k: sum(r.calls for r in got if (r.caller, r.callee) == k) for k in total} == total
