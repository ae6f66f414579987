"""The same functions on streams: payloads to tables, windowed health, and anomalies with state.

Sources bound their own rate (maxFilesPerTrigger, maxOffsetsPerTrigger), so nothing is dropped; checkpoints make each sink continue
where it stopped. Rows later than the watermark are left out of windows that are closed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from obsidia import schemas
from obsidia.operators import anomaly, tiering
from obsidia.operators.health import errors, ratio
from obsidia.sources import router

WATERMARK = "10 minutes"


def payloads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw payloads as JSON files come into a folder."""
    return spark.readStream.schema(schemas.RAW).option("maxFilesPerTrigger", files_per_trigger).json(path)


def broker(spark: SparkSession, servers: str, topic: str, rows_per_trigger: int = 100_000) -> DataFrame:
    """Raw payloads from a Kafka topic: the value is the payload, headers name path, sender and content type. Needs Spark's Kafka package."""
    read = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return from_records(read.option("maxOffsetsPerTrigger", rows_per_trigger).option("includeHeaders", "true").load())


def from_records(records: DataFrame) -> DataFrame:
    """RAW_BINARY rows of a broker's records: value, headers (array of key and value) and timestamp. A value that is sent as protobuf is data and no text."""
    header = lambda k: F.get(F.filter("headers", lambda h: h["key"] == k), F.lit(0))["value"].cast("string")
    proto = F.coalesce(header("content_type"), F.lit("")).contains("protobuf")
    return records.select(F.when(~proto, F.col("value").cast("string")).alias("body"), header("path").alias("path"), header("sender").alias("sender"), header("content_type").alias("content_type"), F.col("timestamp").cast("timestamp_ntz").alias("received_at"), F.when(proto, F.col("value")).alias("data"))


def take(batch: DataFrame, number: int, root: str, source: str) -> None:
    """One micro-batch of payloads to the three core tables' hot tier, each table once, however often the batch is run.

    The batch is read and its formats are told once, and each payload is parsed as its format alone. A payload without a time of
    receipt was received now. root/counts has the batch's payloads by format, how many are rejects and how many had no time.
    """
    timed = batch.withColumn("_undated", F.col("received_at").isNull()).withColumn("received_at", F.coalesce("received_at", F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")))
    named = router.routed(timed).persist()
    try:
        formats = router.present(named)
        for table in schemas.TABLES:
            tiering.append_once(router.core(named, table, formats), f"{root}/{table}", source, number)
        counts = named.groupBy("format").agg(F.count("*").alias("payloads"), F.count(F.when(F.col("_undated"), 1)).alias("undated"))
        bad = router.rejects(named).groupBy("format").agg(F.count("*").alias("rejects"))
        counts.join(bad, "format", "left").select(F.lit(number).cast("long").alias("batch"), "format", "payloads", F.coalesce("rejects", F.lit(0)).alias("rejects"), "undated").coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/run={source}-{number}")
    finally:
        named.unpersist()


def ingest(raw: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Payloads to the core tables, a micro-batch at a time. A batch that Spark runs again, as it does after a failure, changes nothing that it has done."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]  # batches are numbered by checkpoint
    return raw.writeStream.foreachBatch(lambda batch, number: take(batch, number, root, source)).option("checkpointLocation", checkpoint)


def ingest_stats(spark: SparkSession, root: str) -> DataFrame:
    """format, payloads, rejects, undated and batches of all that ingest() took."""
    counts = spark.read.parquet(f"{root}/counts")
    return counts.groupBy("format").agg(F.sum("payloads").alias("payloads"), F.sum("rejects").alias("rejects"), F.sum("undated").alias("undated"), F.count("*").alias("batches"))


def _by_value(spans: DataFrame, length: str, watermark: str) -> DataFrame:
    """w, service, duration_us, n and e: the spans of each closed window, counted by value."""
    grouped = spans.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", length).alias("w"), "service", "duration_us")
    return grouped.agg(F.count("*").alias("n"), errors().alias("e"))


def _ms(share: float) -> Column:
    """An exact percentile of counted values, in thousandths."""
    return F.percentile("duration_us", share, F.col("n")) / 1000


def stream_cycles(spans: DataFrame, length: str = "10 seconds", minutes: float = 1 / 6, watermark: str = WATERMARK) -> DataFrame:
    """What detect() reads, from a stream of spans: service, t, error_rate, p99_ms and per_minute of each closed window, as anomaly.cycles() gives them.

    Spans are counted by window and value first, and a window's counts go on to its percentile when it is closed; closed_at is its last
    moment, by which what follows knows how far time has come.
    """
    out = _by_value(spans, length, watermark).groupBy("w", "service").agg(F.sum("n").alias("total"), F.sum("e").alias("errors"), _ms(0.99).alias("p99_ms"))
    return out.select("service", F.col("w.start").alias("t"), ratio(F.col("errors"), F.col("total")).alias("error_rate"), "p99_ms", (F.col("total") / minutes).alias("per_minute"), F.window_time("w").alias("closed_at"))


def windowed_health(spans: DataFrame, window: str = "5 minutes", slide: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """health.sliding_health on a stream: counts, errors and exact percentiles in sliding windows, put out when a window is closed.

    A window is a whole number of slides, and spans are counted by slide and value before they go to the windows. timestamp must be a TIMESTAMP.
    """
    panes = _by_value(spans, slide, watermark)
    out = panes.groupBy(F.window(F.window_time("w"), window, slide).alias("of"), "service").agg(F.sum("n").alias("total"), F.sum("e").alias("errors"), _ms(0.5).alias("p50_ms"), _ms(0.99).alias("p99_ms"))
    return out.select(F.col("of.start").alias("window_start"), "service", "total", "errors", ratio(F.col("errors"), F.col("total")).alias("error_rate"), "p50_ms", "p99_ms")


def stream_calls(spans: DataFrame, apart: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """topology.calls on a stream: a row a matched child, with called_at, its time. Either may come first.

    A child and its parent begin at most `apart` from each other; each is kept until the other can't come any more. timestamp must be a TIMESTAMP.
    """
    timed = spans.withWatermark("timestamp", watermark)
    p = timed.where("span_id IS NOT NULL").select(F.col("span_id").alias("id"), F.col("service").alias("caller"), F.col("status").alias("caller_status"), F.col("timestamp").alias("caller_at"))
    c = timed.where("parent_span_id IS NOT NULL").select(F.col("parent_span_id").alias("of"), F.col("service").alias("callee"), F.col("status").alias("callee_status"), F.col("duration_us").alias("callee_us"), F.col("timestamp").alias("called_at"))
    near = F.expr(f"of = id AND called_at >= caller_at - INTERVAL {apart} AND called_at <= caller_at + INTERVAL {apart}")
    return c.join(p, near).select("caller", "caller_status", "callee", "callee_status", "callee_us", "called_at")


def stream_edges(spans: DataFrame, window: str = "1 hour", apart: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Calls and failed calls between different services in windows of one length, put out when a window is closed."""
    grouped = stream_calls(spans, apart, watermark).where("caller <> callee").groupBy(F.window("called_at", window).alias("w"), "caller", "callee")
    return grouped.agg(F.count("*").alias("calls"), errors("callee_status").alias("errors")).select(F.col("w.start").alias("window_start"), "caller", "callee", "calls", "errors")


_FOUND = T.StructType([T.StructField("service", T.StringType()), T.StructField("anomaly_type", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("detected_at", T.TimestampType())])


_VALUES = ("error_rate", "p99_ms", "per_minute")


class Detector(StatefulProcessor):
    """anomaly.anomalies on a stream of cycles: a service's averages, its count, when each kind last fired, its last cycle and its silence are its state.

    With a length, cycles in which a service sends nothing are told by timers of event time, as anomaly.filled() does for a table.
    """

    def __init__(self, length: int | None = None, patience: int = anomaly.PATIENCE):
        self.length, self.patience = length, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [T.StructField(k, T.DoubleType()) for k in ("e", "p", "r")]
        fired = [T.StructField(f"f{i}", T.DoubleType()) for i in range(3)]
        self.state = handle.getValueState("baseline", T.StructType([T.StructField("count", T.LongType()), *kinds, *fired, T.StructField("last", T.DoubleType()), T.StructField("silent", T.LongType())]))

    def _load(self) -> None:
        held = self.state.get()
        self.count, self.avg, self.fired, self.last, self.silent = (held[0], list(held[1:4]), list(held[4:7]), held[7], held[8]) if held is not None else (0, [0.0] * 3, [float("-inf")] * 3, float("nan"), 0)

    def _cycle(self, t: float, now: list[float | None]) -> Iterator[tuple]:
        """One cycle: what fires, before the averages move. A value that is missing fires nothing and moves nothing."""
        if not self.count:
            self.avg, self.count = [0.0 if v is None else v for v in now], 1
        avg, fired = self.avg, self.fired
        bounds = [max(avg[0] * anomaly.FACTOR, anomaly.ERROR_FLOOR), max(avg[1] * anomaly.FACTOR, anomaly.LATENCY_FLOOR), anomaly.DROP]
        values = [now[0], now[1], now[2] / avg[2] if avg[2] > 0 and now[2] is not None else None]
        for i, kind in enumerate(anomaly.KINDS):
            over = values[i] is not None and (values[i] < bounds[i] if i == 2 else values[i] > bounds[i])
            if self.count >= anomaly.LEAST_CYCLES and avg[i] > 0 and over and fired[i] <= t - anomaly.COOLDOWN_SECONDS:
                fired[i] = t
                times = values[i] / bounds[i]
                level = "medium" if i == 2 else "critical" if times > 5 else "high" if times > 3 else "medium" if times > 2 else "low"
                yield kind, level, values[i], bounds[i], pd.Timestamp(t, unit="s")
        self.avg = [a if v is None else a * (1 - anomaly.ALPHA) + v * anomaly.ALPHA for a, v in zip(avg, now, strict=True)]
        self.count += 1

    def _silence(self, until: float) -> Iterator[tuple]:
        """The cycles after the last one that start before `until`, and in which nothing came."""
        while self.length and self.count and self.silent < self.patience and self.last + self.length < until:
            self.last, self.silent = self.last + self.length, self.silent + 1
            yield from self._cycle(self.last, [None, None, 0.0])

    def _done(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        self.state.update((self.count, *self.avg, *self.fired, self.last, self.silent))
        if self.length and self.silent < self.patience:
            self.handle.registerTimer(int((self.last + 2 * self.length) * 1000))  # when the next cycle has ended
        return pd.DataFrame([(key[0], *x) for x in out], columns=_FOUND.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._load()
        cycles = pd.concat(rows).sort_values("t")
        at = cycles["t"].to_numpy("datetime64[us]").astype("int64") / 1e6
        values = cycles[list(_VALUES)].to_numpy(float)
        out: list[tuple] = []
        for t, row in zip(at.tolist(), values.tolist(), strict=True):
            out += self._silence(t)
            self.last, self.silent = t, 0
            out += self._cycle(t, [None if v != v else v for v in row])
        yield self._done(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._load()
        out = list(self._silence(timerValues.getCurrentWatermarkInMs() / 1000 - self.length + 1e-6))  # cycles that have ended by the watermark
        yield self._done(key, out)

    def close(self) -> None:
        pass


def detect(cycles: DataFrame, length: int | None = None, patience: int = anomaly.PATIENCE) -> DataFrame:
    """Anomalies of a stream of cycles: service, t, error_rate, p99_ms, per_minute. Needs the RocksDB state store.

    With a length, the seconds of a cycle, services that fall silent raise drops of traffic too; the stream must have a watermark on t.
    """
    return cycles.groupBy("service").transformWithStateInPandas(Detector(length, patience), outputStructType=_FOUND, outputMode="Append", timeMode="EventTime" if length else "None")
