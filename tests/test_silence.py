from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsidia.operators import anomaly
from obsidia.streaming import pipelines

T0 = datetime(2024, 1, 5)
R = random.Random(6)
SCHEMA = "service string, t timestamp, error_rate double, p99_ms double, per_minute double"


def cycle(service, i, rate=0.0, p99=50.0, n=60.0):
    return service, T0 + timedelta(seconds=10 * i), rate, p99, n


ROWS = (
    [cycle("steady", i) for i in range(200)] + [cycle("gone", i) for i in range(20)] + [cycle("gap", i, n=R.choice([50.0, 60.0])) for i in [*range(12), *range(30, 50), *range(120, 160), 199]]
    + [cycle("spiky", i, rate=0.9 if i % 37 == 36 else 0.01, p99=900.0 if i % 41 == 40 else 50.0) for i in range(0, 200, 3)] + [cycle("once", 7)]
)


def by_hand(rows, until, length=10, patience=30):
    """Cycle after cycle, with those between and after that had no rows."""
    out = []
    for s in {r[0] for r in rows}:
        own = {r[1]: r[2:] for r in rows if r[0] == s}
        t, last, avg, n, fired, silent = min(own), max(own), None, 0, {}, 0
        while t <= max(last, until - timedelta(seconds=length)):
            silent = 0 if t in own else silent + 1
            now = own.get(t, (None, None, 0.0))
            if silent <= patience:
                if avg is None:
                    avg, n = list(now), 1
                bounds = (max(avg[0] * 3, 0.01), max(avg[1] * 3, 100.0), 0.5)
                values = (now[0], now[1], now[2] / avg[2] if avg[2] else None)
                for i, kind in enumerate(anomaly.KINDS):
                    over = values[i] is not None and avg[i] > 0 and (values[i] < bounds[i] if i == 2 else values[i] > bounds[i])
                    if n >= 5 and over and (kind not in fired or fired[kind] + timedelta(seconds=300) <= t):
                        fired[kind] = t
                        out.append((s, kind, t, pytest.approx(values[i])))
                avg = [a if v is None else a * 0.9 + v * 0.1 for a, v in zip(avg, now, strict=True)]
                n += 1
            t += timedelta(seconds=length)
    return sorted(out, key=lambda x: x[:3])


def test_batch_and_stream_tell_silence(spark, tmp_path):
    until = T0 + timedelta(seconds=10 * 199)  # where the stream's watermark ends
    table = spark.createDataFrame(ROWS, SCHEMA)
    found = anomaly.anomalies(anomaly.filled(table, 10, until))
    batch = sorted((r.service, r.anomaly_type, r.detected_at, r.value) for r in found.collect())
    assert batch == by_hand(ROWS, until)
    assert {s for s, k, *_ in batch if k == "traffic_drop"} == {"gone", "gap", "spiky", "once"}
    (tmp_path / "in").mkdir()
    for i in range(0, 200, 25):  # files in order of time: each is a micro-batch
        part = [r for r in ROWS if timedelta(seconds=10 * i) <= r[1] - T0 < timedelta(seconds=10 * (i + 25))]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("t", "0 seconds")
    q = pipelines.detect(stream, 10).writeStream.format("memory").queryName("silence").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r.service, r.anomaly_type, r.detected_at, r.value) for r in spark.sql("SELECT * FROM silence").collect())
    assert got == batch


def test_filled(spark):
    rows = [cycle("a", 0), cycle("a", 3), cycle("b", 5), cycle(None, 1)]
    found = anomaly.filled(spark.createDataFrame(rows, SCHEMA), 10, T0 + timedelta(seconds=70), 2)
    seconds = lambda t: (t - T0).total_seconds()
    got = sorted((r.service or "", seconds(r.t), r.per_minute, r.error_rate) for r in found.where("per_minute = 0").collect())
    assert got == [("", 20, 0, None), ("", 30, 0, None), ("a", 10, 0, None), ("a", 20, 0, None), ("a", 40, 0, None), ("a", 50, 0, None), ("b", 60, 0, None)]
    assert anomaly.filled(spark.createDataFrame(rows, SCHEMA), 10).where("per_minute = 0").count() == 2
    assert anomaly.filled(spark.createDataFrame(rows, SCHEMA).where(F.lit(False)), 10).count() == 0
