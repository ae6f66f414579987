from __future__ import annotations

import json
import struct
from datetime import datetime

import pyarrow as pa
import pytest

from obsidia import schemas
from obsidia.operators import tiering
from obsidia.plans.payloads import shown
from obsidia.sources import binary, router
from obsidia.streaming import pipelines

CAME, T0 = datetime(2024, 5, 1, 12), datetime(2024, 1, 1)
NS = 1704067200000000000
f, key, number = binary._field, binary._key, binary._number
word = lambda k, v: f(1, k.encode()) + f(2, f(1, v.encode()))


def span(code=2, extra=b""):
    attributes = [word("a", "x"), f(1, b"n") + f(2, key(3, 0) + number(-5)), f(1, b"d") + f(2, key(4, 1) + struct.pack("<d", 1.5)), f(1, b"b") + f(2, key(2, 0) + number(1)), f(1, b"list") + f(2, f(5, b"")), word("a", "last")]
    body = f(1, b"\x01" * 16) + f(2, b"\x02" * 8) + f(4, b"\x03" * 8) + f(5, "GET é".encode()) + key(6, 0) + number(3) + key(7, 1) + struct.pack("<Q", NS) + key(8, 1) + struct.pack("<Q", NS + 250_000_000)
    return body + b"".join(f(9, a) for a in attributes) + f(15, f(2, b"message") + key(3, 0) + number(code)) + extra


def request(*spans, service="api"):
    return f(1, f(1, f(1, word("other", "y")) + f(1, word("service.name", service))) + f(2, f(1, b"") + b"".join(f(2, s) for s in spans)) + f(3, b"url"))


def raw(spark, *bodies, path="/v1/traces", kind="application/x-protobuf"):
    return spark.createDataFrame([(None, path, "", kind, CAME, bytearray(b)) for b in bodies], schemas.RAW_BINARY)


def test_as_json(spark):
    """A request and its JSON form give the same rows."""
    text = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [{
        "traceId": "01" * 16, "spanId": "02" * 8, "parentSpanId": "03" * 8, "name": "GET é", "startTimeUnixNano": str(NS), "endTimeUnixNano": str(NS + 250_000_000), "status": {"code": "2"},
        "attributes": [{"key": "a", "value": {"stringValue": "x"}}, {"key": "n", "value": {"intValue": "-5"}}, {"key": "d", "value": {"doubleValue": 1.5}}, {"key": "b", "value": {"boolValue": True}}, {"key": "list", "value": {}}, {"key": "a", "value": {"stringValue": "last"}}]}]}]}]}
    as_text = spark.createDataFrame([(json.dumps(text), "/v1/traces", "", "application/json", CAME, None)], schemas.RAW_BINARY)
    want = [tuple(r) for r in shown(router.core(as_text, "spans")).collect()]
    assert [tuple(r) for r in shown(router.core(raw(spark, request(span())), "spans")).collect()] == want
    assert router.core(as_text.unionByName(raw(spark, request(span()))), "spans").count() == 2


def test_what_a_span_may_lack(spark):
    rows = router.core(raw(spark, request(f(5, b"op"), span(0), span(1), span(7, key(99, 0) + number(1) + f(98, b"new") + key(97, 5) + b"1234"), service=""), b"", f(1, b"")), "spans").collect()
    assert [(r.service, r.status) for r in rows] == [("unknown", "OK"), ("unknown", "OK"), ("unknown", "OK"), ("unknown", "7")]
    assert (rows[0].timestamp, rows[0].duration_us, rows[0].parent_span_id, rows[0].tags) == (CAME, 0, None, {})


def test_every_cut_is_told(spark):
    """A body that ends anywhere but after a whole field has no rows and is rejected, and so is what is no message at all."""
    whole = request(span())
    cuts = [whole[:n] for n in range(1, len(whole), 7)] + [b"\xff" * 20, b"\x0b", b"\x08", whole + b"\x07", f(1, f(1, f(1, f(1, b"\xff\xfe") + f(2, f(1, b"\xff")))))]
    df = router.routed(raw(spark, *cuts, whole))
    assert router.core(df, "spans").count() == 1
    assert router.rejects(df).count() == len(cuts)


def test_remote_write(spark):
    label = lambda k, v: f(1, f(1, k.encode()) + f(2, v.encode()))
    sample = lambda v, ms: f(2, key(1, 1) + struct.pack("<d", v) + key(2, 0) + number(ms))
    body = f(1, label("__name__", "up") + label("job", "api") + label("x", "é") + sample(1.0, NS // 10**6) + sample(-2.5, -1000)) + f(1, label("__name__", "bare") + sample(0.0, 0)) + f(3, b"metadata")
    packed = pa.compress(body, codec="snappy", asbytes=True)
    df = router.routed(raw(spark, packed, body, packed[:-3], b"\xff\xff\xff\xff\x7f", path="/api/v1/write"))
    rows = router.core(df, "metrics").collect()
    assert [(r.timestamp, r.service, r.name, r.value, r.tags) for r in rows] == [(T0, "api", "up", 1.0, {"job": "api", "x": "é"}), (datetime(1969, 12, 31, 23, 59, 59), "api", "up", -2.5, {"job": "api", "x": "é"}), (CAME, "unknown", "bare", 0.0, {})]
    assert router.rejects(df).count() == 3


@pytest.mark.parametrize("value", [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1, -1])
def test_numbers(value):
    assert binary.varint(number(value) + b"x", 0) == (value % 2**64, len(number(value)))


def test_ingest_of_both(spark, tmp_path):
    df = raw(spark, request(span(), span()), b"\xff").unionByName(spark.createDataFrame([('{"message":"m"}', "/", "", "", CAME, None)], schemas.RAW_BINARY))
    pipelines.take(df, 0, str(tmp_path), "s")
    assert tiering.read(spark, str(tmp_path / "spans")).count() == 2 and tiering.read(spark, str(tmp_path / "logs")).count() == 1
    assert {r.format: (r.payloads, r.rejects) for r in pipelines.ingest_stats(spark, str(tmp_path)).collect()} == {"otlp_proto": (2, 1), "json": (1, 0)}


def test_there_and_back(spark):
    rows = [(T0, "0a" * 16, "0b" * 8, None, "api", "op é", 5, "error", {"k": "v", "none": None}), (None, None, None, "0c" * 8, None, None, None, None, None)]
    back = router.core(raw(spark, *[bytes(r.data) for r in binary.export_spans(spark.createDataFrame(rows, schemas.SPANS)).collect()]), "spans").collect()
    assert sorted((r.timestamp, r.trace_id, r.span_id, r.parent_span_id, r.service, r.operation, r.duration_us, r.status, r.tags) for r in back) == [
        (T0, "0a" * 16, "0b" * 8, None, "api", "op é", 5, "ERROR", {"k": "v"}), (CAME, "", "", "0c" * 8, "unknown", "", 0, "OK", {})]
