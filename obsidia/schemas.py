"""The core tables: three of raw telemetry, one of incidents."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


METRICS = _table(timestamp=T.TimestampNTZType(), service=T.StringType(), name=T.StringType(), value=T.DoubleType(), tags=TAGS)
LOGS = _table(timestamp=T.TimestampNTZType(), service=T.StringType(), level=T.StringType(), message=T.StringType(), tags=TAGS)
SPANS = _table(
    timestamp=T.TimestampNTZType(), trace_id=T.StringType(), span_id=T.StringType(), parent_span_id=T.StringType(), service=T.StringType(),
    operation=T.StringType(), duration_us=T.LongType(), status=T.StringType(), tags=TAGS,
)
INCIDENTS = _table(
    id=T.StringType(), fingerprint=T.StringType(), service=T.StringType(), anomaly_type=T.StringType(), timestamp=T.TimestampNTZType(),
    duration_seconds=T.IntegerType(), applied_fix=T.StringType(), fix_succeeded=T.BooleanType(), time_to_resolve_seconds=T.IntegerType(),
)
#: What sources read: a payload, where it was sent, what sent it, and when it came.
RAW = _table(body=T.StringType(), path=T.StringType(), sender=T.StringType(), content_type=T.StringType(), received_at=T.TimestampNTZType())
#: The same with bodies of bytes beside those of text.
RAW_BINARY = T.StructType([*RAW.fields, T.StructField("data", T.BinaryType(), True)])

TABLES = {"spans": SPANS, "logs": LOGS, "metrics": METRICS}
