"""Joins by time: rows with the moments in whose window they lie, and rows with the last state before them.

Both cut time into buckets, so that an equality of key and bucket does the joining and a shuffle by both deals out the work: no key is
one task's, however many rows it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the rows of one key and bucket are dealt to.
SPLIT = 8


def seconds(t: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without a zone, the lower of two."""
    return F.unix_date(F.to_date(t)) * F.lit(86400).cast("long") + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def bucket(t: Column, width: int) -> Column:
    return F.floor(seconds(t) / width).cast("long")


def ago(t: Column, s: int) -> Column:
    return t - F.expr(f"INTERVAL {s} SECONDS")


def within(rows: DataFrame, points: DataFrame, before: int, key: str = "service", time: str = "timestamp", at: str = "at", split: int = SPLIT) -> DataFrame:
    """Each row beside each point of its key in whose (at - before, at] it lies; rows and points without a key or time find nothing.

    Both have the column key; points' other columns must have names that rows do not have. A point is sent to each bucket that its
    window touches, two or three as buckets are as long as the window, and in them to each of `split` parts that a busy key's rows are
    dealt to; a row is in one bucket and one part. What shares both is compared by its time.
    """
    low = bucket(ago(F.col(at), before), before)
    sent = points.where(F.col(at).isNotNull()).withColumn("_bucket", F.explode(F.sequence(low, bucket(F.col(at), before))))
    sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), F.lit(split)).cast("int")
    dealt = rows.where(F.col(time).isNotNull()).withColumns({"_bucket": bucket(F.col(time), before), "_part": part})
    met = dealt.join(sent, [key, "_bucket", "_part"]).where((F.col(time) > ago(F.col(at), before)) & (F.col(time) <= F.col(at)))
    return met.drop("_bucket", "_part")


def span(points: DataFrame, before: int, at: str = "at") -> tuple | None:
    """The earliest and the latest moment that any point's window reaches, for filters that reach the scan; None without points."""
    row = points.agg(F.min(ago(F.col(at), before)).alias("low"), F.max(at).alias("high")).first()  # one row
    return None if row.low is None else (row.low, row.high)


def between(rows: DataFrame, reach: tuple | None, time: str = "timestamp") -> DataFrame:
    """Rows of a span of time; none without one."""
    if reach is None:
        return rows.where("false")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in reach)
    return rows.where((F.col(time) > low) & (F.col(time) <= high))


def as_of(rows: DataFrame, states: DataFrame, width: int, keys: list[str] | None = None, time: str = "timestamp", ties: list[str] | None = None, name: str = "state") -> DataFrame:
    """Each row with the last of the states of its keys that is not later than it, as the struct `name`; null where there is none.

    Rows keep all their columns. Of states of one key and time the largest in the order of `ties`, then of all its columns, counts. A
    row without a key or time has no state; states without one are not read.

    Time is cut into chunks of `width` seconds. Within a chunk of a key, rows and states are put in one order of time and the last state is
    carried along; the last state of each chunk is carried over chunks, one row a chunk. So a task holds a chunk of a key at a time and no key.
    """
    keys = keys or ["service"]
    fields = [c for c in states.columns if c not in (*keys, time)]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, time)])
    order = [F.col(f"`{c}`") for c in (ties or [])] + [F.col(f"`{c}`") for c, t in states.dtypes if c in fields and c not in (ties or []) and not t.startswith(("map", "variant"))]
    held = F.struct(F.col(time).alias(time), *[F.col(f"`{c}`") for c in fields])
    given = states.where(known).select(*keys, F.col(time).alias("_t"), bucket(F.col(time), width).alias("_chunk"), F.struct(*order).alias("_order"), held.alias("_state"))
    ends = given.groupBy(*keys, "_chunk").agg(F.max_by("_state", F.struct("_t", "_order")).alias("_end"))
    asked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *keys, F.col(time).alias("_t")).withColumn("_chunk", bucket(F.col("_t"), width))
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "_t")])
    chunks = asked.where(there).select(*keys, "_chunk").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    # One row a chunk of a key, be it of states, of rows or both; what stands before each of them.
    line = ends.unionByName(chunks).groupBy(*keys, "_chunk").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = line.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_chunk", "_before")
    merged = asked.where(there).select(*keys, "_chunk", "_t", "_row").unionByName(given, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t", F.col("_row").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, 0)  # states before rows of their time
    last = merged.withColumn("_last", F.last("_state", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull())
    found = last.join(carried, [*keys, "_chunk"], "left").select("_row", F.coalesce("_last", "_before").alias(name))
    alone = asked.where(~F.coalesce(there, F.lit(False))).select("_row", F.lit(None).cast(found.schema[name].dataType).alias(name))
    return found.unionByName(alone).select("_row.*", name)
