from __future__ import annotations

import json

import pytest

from obsidia.plans import registry
from tests.oracle import same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_duckdb(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), SQL[name], sf_dir)


def test_bundles_are_small_and_redacted(spark, sf_dir):
    rows = registry.queries()["bundle_payloads"](spark, sf_dir).collect()
    for r in rows:
        found = json.loads(r.payload)
        assert r.bytes < 50_000
        assert len(found["fingerprint"]) == 16
        assert found["scope"] in {"isolated", "upstream", "downstream", "cascading"}


def test_summary(spark, sf_dir):
    (row,) = registry.queries()["summary_payload"](spark, sf_dir).collect()
    found = json.loads(row.payload)
    assert found["healthy"] + found["degraded"] == len(found["services"])


def test_entry_imports_and_runs(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["service_health"](spark, sf_dir).count() > 0


def test_series_and_detector_take_the_whole_table(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    days = registry.queries()["series_points"](spark, sf_dir).collect()
    assert sum(r.points for r in days) == events
    assert all(len(r.series.split(",")) == r.points for r in days)
    assert {"anomalies", "anomalies_whole"} <= set(SQL)


def test_evidence_is_of_each_anomalys_time(spark, sf_dir):
    """Two anomalies of one service have different evidence, and all scopes, healthy neighbours and matches occur."""
    rows = registry.queries()["bundles"](spark, sf_dir).collect()
    assert {r.scope for r in rows} == {"isolated", "upstream", "downstream", "cascading"}
    assert any(r.healthy_deps for r in rows) and any(r.matches for r in rows) and any(r.replicas for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.service, {})[r.detected_at] = (r.error_rate, r.p99_ms, r.logs, r.endpoints)
    for held in by.values():
        assert len(set(held.values())) > len(held) // 2


def test_evidence_joins_by_keys(spark, sf_dir):
    plan = registry.queries()["bundles"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
