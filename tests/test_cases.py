"""Rows written by hand that hold every case of what is told apart."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from obsidia.functions import redact
from obsidia.operators import context, incidents, tiering

#: Messages and the type of error that each tells.
MESSAGES = [
    ("upstream Timed Out after 3 s", "timeout"), ("context deadline exceeded", "timeout"), ("dial: connection refused", "connection_error"), ("read: Connection reset by peer", "connection_error"), ("lookup x: no such host", "dns_error"),
    ("bad certificate", "tls_error"), ("container OOM killed", "memory_error"), ("SQL state 42P01", "database_error"), ("403 Forbidden", "auth_error"), ("too many requests", "rate_limit"), ("HTTP 500", "server_error"), ("malformed body", "validation_error"),
    ("it broke", "unknown"), ("timeout while the database was locked", "timeout"),
]
#: Services with what is correlated with them, as name, direction and error rate, and the scope, failing and healthy names that follow.
SCOPES = [
    ("alone", [], "isolated", "", ""), ("calm", [("a", "upstream", 0.01), ("b", "downstream", 0.0)], "isolated", "", "a,b"), ("fed", [("a", "upstream", 0.5), ("b", "downstream", 0.005)], "upstream", "a", "b"),
    ("feeds", [("c", "downstream", 0.2), ("d", "downstream", 0.011)], "downstream", "c,d", ""), ("amid", [("a", "upstream", 0.3), ("c", "downstream", 0.2)], "cascading", "a,c", ""),
]
#: Blocks of packed telemetry: kind, bytes before and after.
BLOCKS = [("spans", 1000, 250), ("spans", 3000, 750), ("logs", 500, 100), ("logs_cold", 0, 0)]



def test_error_types(spark):
    rows = spark.createDataFrame([(m,) for m, _ in MESSAGES], "message string").select("message", redact.error_type(F.col("message")).alias("kind")).collect()
    assert {r.message: r.kind for r in rows} == dict(MESSAGES)


def test_error_breakdown(spark):
    logs = spark.createDataFrame([(datetime(2024, 5, 1), "s", "ERROR", m) for m, _ in MESSAGES], "timestamp timestamp_ntz, service string, level string, message string")
    (row,) = context.error_breakdown(logs).collect()
    kinds = [t for _, t in MESSAGES]
    share = lambda *of: pytest.approx(100 * sum(k in of for k in kinds) / len(kinds))
    assert (row.timeout, row.connection_error, row.server_error_5xx, row.client_error_4xx) == (share("timeout"), share("connection_error"), share("server_error"), share("validation_error"))
    assert row.other == share(*(set(kinds) - {"timeout", "connection_error", "server_error", "validation_error"}))


def test_scopes(spark):
    rows = spark.createDataFrame([(s, c) for s, c, *_ in SCOPES], "service string, correlations array<struct<service:string,direction:string,error_rate:double>>")
    found = {r.service: (r.scope, ",".join(r.failing_deps), ",".join(r.healthy_deps)) for r in incidents.scope(rows).collect()}
    assert found == {s: (k, f, h) for s, _, k, f, h in SCOPES}


def test_blocks(spark):
    rows = spark.createDataFrame([(k, a, b, b / a if a else None) for k, a, b in BLOCKS], "data_type string, original_size long, compressed_size long, compression_ratio double")
    found = {r.data_type: r for r in tiering.block_stats(rows).collect()}
    assert found["logs_cold"].saved_percent == 0 and found["logs_cold"].avg_ratio is None
    assert (found["spans"].original, found["spans"].compressed, found["spans"].saved_percent) == (4000, 1000, 75.0)
    assert found[None].blocks == 4 and found[None].saved_percent == pytest.approx(100 * (1 - 1100 / 4500))
