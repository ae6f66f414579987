from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidia import schemas
from obsidia.operators import context, health, intervals, topology

T0 = datetime(2024, 1, 5, 12)
R = random.Random(2)


def moments(n, hours):
    return [T0 + timedelta(seconds=round(R.uniform(-3600 * hours, 3600 * hours), 3)) for _ in range(n)]


@pytest.mark.parametrize("split", [1, 5])
def test_within_by_loops(spark, split):
    rows = [(R.choice("abc"), t, i) for i, t in enumerate(moments(300, 5))] + [(None, T0, 900), ("a", None, 901), ("a", datetime(1969, 12, 31, 23, 59, 59), 902)]
    points = [(R.choice("abd"), t) for t in moments(30, 6)] + [("a", None), (None, T0), ("a", datetime(1970, 1, 1, 0, 0, 10))] + [("a", rows[0][1]), (rows[1][0], rows[1][1] + timedelta(hours=1))]
    points = list(dict.fromkeys(points))
    found = intervals.within(spark.createDataFrame(rows, "service string, timestamp timestamp_ntz, i int"), spark.createDataFrame(points, "service string, at timestamp_ntz"), 3600, split=split)
    want = [(i, a) for s, t, i in rows for p, a in points if s and t and a and s == p and a - timedelta(hours=1) < t <= a]
    assert sorted((r.i, r["at"]) for r in found.collect()) == sorted(want)
    assert any(i == 902 for i, _ in want)


@pytest.mark.parametrize("width", [60, 1800, 10**6])
def test_as_of_by_loops(spark, width):
    rows = [(R.choice("abc"), t, i) for i, t in enumerate(moments(120, 5))] + [(None, T0, 900), ("a", None, 901)]
    states = [(R.choice("abd"), t, i) for i, t in enumerate(moments(60, 5))] + [("a", None, 70), (None, T0, 71), ("b", rows[0][1], 72), ("b", rows[0][1], 73), ("c", T0 - timedelta(days=400), 74)]
    df = spark.createDataFrame([(*r, {"x": "y"}) for r in rows], "service string, timestamp timestamp_ntz, i int, tags map<string,string>")
    got = intervals.as_of(df, spark.createDataFrame([(*s, {"k": "v"}) for s in states], "service string, timestamp timestamp_ntz, n int, held map<string,string>"), width).collect()

    def last(s, t):
        known = [(u, n) for p, u, n in states if p and u and t and p == s and u <= t]
        return max(known)[1] if known else None

    assert sorted((r.i, -1 if r.state is None else r.state.n) for r in got) == sorted((i, -1 if last(s, t) is None else last(s, t)) for s, t, i in rows)
    assert all(r.tags == {"x": "y"} for r in got)
    assert intervals.as_of(df, spark.createDataFrame([], "service string, timestamp timestamp_ntz, n int"), width).where("state IS NOT NULL").count() == 0


def test_as_of_gives_no_key_to_one_task(spark):
    df = spark.createDataFrame([("a", T0, 1)], "service string, timestamp timestamp_ntz, i int")
    plan = intervals.as_of(df, df.withColumnRenamed("i", "n"), 60)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan.split("Window")[-1] or "hashpartitioning(service" in plan
    by_key = [line for line in plan.split("\n") if "Window [last(_state" in line]
    assert by_key and all("_chunk" in line for line in by_key)


def test_percentiles_by_numpy(spark):
    values = [None, 0, 1, -1, -5, 2**40, 2**62, -(2**62), 7, 7, 7] + [R.randint(-3000, 3000) for _ in range(300)] + [R.randint(0, 10**9) for _ in range(300)] + [1023, 1024, 1025, 2047, 2048]
    rows = [(R.choice(["a", "b", None]), v, "error" if R.random() < 0.3 else "OK") for v in values] + [("none", None, "OK"), ("one", 5, "OK")]
    spans = spark.createDataFrame(rows, "service string, duration_us long, status string").repartition(3)
    of = {"p0_ms": (0.0, "total"), "p50_ms": (0.5, "total"), "p99_ms": (0.99, "total"), "p100_ms": (1.0, "total"), "bad_ms": (0.9, "errors")}
    got = {r.service: r for r in health.percentile_table(spans, ["service"], of, {"total": F.count("*"), "errors": health.errors()}).collect()}
    for s in {r[0] for r in rows}:
        own = [(v, e) for k, v, e in rows if k == s]
        assert got[s].total == len(own) and got[s].errors == sum(e == "error" for _, e in own)
        for name, (share, weight) in of.items():
            held = [float(v) for v, e in own if v is not None and (weight == "total" or e == "error")]
            if not held:
                assert got[s][name] is None
            else:
                assert got[s][name] == pytest.approx(np.quantile(held, share) / 1000, rel=1e-9)


def test_around_by_loops(spark):
    spans = []
    for i in range(200):
        t = T0 + timedelta(minutes=R.uniform(-300, 0))
        spans.append((t, "t", f"s{i}", f"s{R.randint(0, 199)}" if i % 3 else None, R.choice("abcd"), "op", 1000 * i, R.choice(["OK", "error"]), None))
    points = [("a", T0), ("b", T0 - timedelta(hours=2)), ("a", T0 - timedelta(hours=3)), ("z", T0)]
    got = topology.around(spark.createDataFrame(spans, schemas.SPANS), spark.createDataFrame(points, "service string, at timestamp_ntz"), 5400).collect()
    want = {}
    by_id = {s[2]: s for s in spans}
    for c in spans:
        p = by_id.get(c[3])
        if p and p[4] != c[4]:
            for own, other, d, status in ((p[4], c[4], "downstream", c[7]), (c[4], p[4], "upstream", p[7])):
                for s, at in points:
                    if s == own and at - timedelta(minutes=90) < p[0] <= at and c[0] <= at:
                        n, e, us = want.get((s, at, other, d), (0, 0, 0))
                        want[s, at, other, d] = (n + 1, e + (status == "error"), us + c[6])
    assert {(r.service, r["at"], r.other, r.direction): (r.total, r.errors, r.avg_ms) for r in got} == {k: (n, e, us / n / 1000) for k, (n, e, us) in want.items()}


ANOMALY = "service string, anomaly_type string, severity string, value double, threshold double, detected_at timestamp_ntz"


def test_two_anomalies_of_one_service(spark):
    """Each has its own metrics, logs, trend, matches and infrastructure; what comes later is not seen."""
    early, late = T0 - timedelta(hours=6), T0
    rows = [(t - timedelta(seconds=s), "t", f"{n}{s}", None, "web", f"GET /{n}", 1000 * (1 + s), "ERROR" if s < bad else "OK", None) for n, t, bad in (("a", early, 30), ("b", late, 200)) for s in range(0, 900, 10)]
    logs = [(early - timedelta(seconds=5), "web", "error", "timeout early", None), (late - timedelta(seconds=5), "web", "warn", "invalid late", None), (late + timedelta(seconds=5), "web", "error", "after", None)]
    found = spark.createDataFrame([("web", "error_spike", "high", 0.5, 0.1, early), ("web", "error_spike", "high", 0.5, 0.1, late), (None, "error_spike", "low", 0.1, 0.1, late), ("quiet", "traffic_drop", "medium", 0.1, 0.5, late)], ANOMALY)
    print_of = context.incidents.fingerprint(F.lit("web"), F.lit("error_spike"), F.array().cast("array<struct<service:string,direction:string,error_rate:double>>"))
    past = spark.createDataFrame([("1", late - timedelta(hours=1), True), ("2", late + timedelta(hours=1), False)], "id string, timestamp timestamp_ntz, fix_succeeded boolean").withColumn("fingerprint", print_of)
    infra = spark.createDataFrame([("web", early - timedelta(days=3), 1), ("web", early + timedelta(hours=1), 2), ("web", late + timedelta(seconds=1), 3)], "service string, timestamp timestamp_ntz, replicas int")
    made = context.bundles(found, spark.createDataFrame(rows, schemas.SPANS), spark.createDataFrame(logs, schemas.LOGS), past, None, 900, 0, infra).collect()
    assert len(made) == 4
    a, b = (next(r for r in made if r.service == "web" and r.detected_at == t) for t in (early, late))
    assert [x.template for x in a.logs] == ["timeout early"] and [x.template for x in b.logs] == ["invalid late"]
    assert (a.error_breakdown.timeout, b.error_breakdown.client_error_4xx) == (100.0, 100.0)
    assert [e.operation for e in a.endpoints] == ["GET /a"] and [e.operation for e in b.endpoints] == ["GET /b"]
    assert (a.error_rate, b.error_rate) == (pytest.approx(3 / 30), pytest.approx(20 / 30))
    assert (a.matches, b.matches) == (0, 1) and b.confidence == 1.0 and a.confidence == 0.0
    assert (a.infra.replicas, b.infra.replicas) == (1, 2)
    assert a.trend.trend == b.trend.trend == "worsening"
    quiet = next(r for r in made if r.service == "quiet")
    assert quiet.logs is None and quiet.trend is None and quiet.scope == "isolated" and quiet.infra is None
    assert context.bundles(found.where("false"), spark.createDataFrame(rows, schemas.SPANS), spark.createDataFrame(logs, schemas.LOGS), past).count() == 0
