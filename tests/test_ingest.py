from __future__ import annotations

import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from obsidia import schemas
from obsidia.operators import tiering
from obsidia.streaming import pipelines

T0 = datetime(2024, 1, 5, 12)


def batch(spark, numbers, received=T0):
    rows = [(json.dumps({"message": f"m{n}"} if n % 2 else {"name": "n", "value": n}), "/", "", "", received) for n in numbers]
    return spark.createDataFrame([*rows, ("{bad", "/", "", "", received)], schemas.RAW)


def held(spark, root):
    return sorted(r.message for r in tiering.read(spark, f"{root}/logs").collect()), sorted(r.value for r in tiering.read(spark, f"{root}/metrics").collect())


def stats(spark, root):
    return {r.format: (r.payloads, r.rejects, r.undated, r.batches) for r in pipelines.ingest_stats(spark, root).collect()}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    pipelines.take(batch(spark, range(4)), 0, root, "s")
    pipelines.take(batch(spark, range(4)), 0, root, "s")
    assert held(spark, root) == (["m1", "m3"], [0.0, 2.0])
    pipelines.take(batch(spark, range(4, 6)), 1, root, "s")
    pipelines.take(batch(spark, range(4)), 0, root, "other")  # another source's batch of the same number
    assert held(spark, root) == (["m1", "m1", "m3", "m3", "m5"], [0.0, 0.0, 2.0, 2.0, 4.0])
    assert stats(spark, root) == {"json": (5 + 3 + 5, 3, 0, 3)}


@pytest.mark.parametrize("step", ["_write", "_note", "_place"])
@pytest.mark.parametrize("at", [0, 1, 2])
def test_failure_between_and_within_tables(spark, tmp_path, monkeypatch, step, at):
    """Whatever step fails, and at whichever table, readers see a table's batch whole or not at all, and the next run ends it."""
    root = str(tmp_path)
    pipelines.take(batch(spark, range(4)), 0, root, "s")
    real, calls = getattr(tiering, step), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == at + 1:
            raise OSError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(tiering, step, failing)
    with pytest.raises(OSError):
        pipelines.take(batch(spark, range(4, 8)), 1, root, "s")
    monkeypatch.setattr(tiering, step, real)
    logs, metrics = held(spark, root)
    assert logs in (["m1", "m3"], ["m1", "m3", "m5", "m7"]) and metrics in ([0.0, 2.0], [0.0, 2.0, 4.0, 6.0])
    tiering.run(spark, f"{root}/logs", T0 + timedelta(hours=2))  # a tier move meanwhile
    pipelines.take(batch(spark, range(4, 8)), 1, root, "s")
    assert held(spark, root) == (["m1", "m3", "m5", "m7"], [0.0, 2.0, 4.0, 6.0])
    assert stats(spark, root) == {"json": (10, 2, 0, 2)}
    assert not os.listdir(f"{root}/logs/_moves") or all(x.startswith(".") for x in os.listdir(f"{root}/logs/_moves"))


def test_stream_that_lost_its_last_commit(spark, tmp_path):
    (tmp_path / "raw").mkdir()

    def run():
        q = pipelines.ingest(pipelines.payloads(spark, str(tmp_path / "raw")), str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for i in range(2):
        (tmp_path / "raw" / f"{i}.json").write_text(json.dumps({"body": json.dumps({"message": f"m{i}", "value": 1}), "path": "/", "received_at": "2024-01-05T12:00:00"}) + "\n")
        run()
    last = max(int(x) for x in os.listdir(tmp_path / "c" / "commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if (tmp_path / "c" / "commits" / name).exists():
            (tmp_path / "c" / "commits" / name).unlink()
    run()
    assert sorted(r.message for r in tiering.read(spark, str(tmp_path / "t" / "logs")).collect()) == ["m0", "m1"]
    assert stats(spark, str(tmp_path / "t")) == {"json": (2, 0, 0, 2)}


def test_rows_without_a_time_stay(spark, tmp_path):
    """They are of now, are counted, and the next tier run keeps them."""
    root = str(tmp_path)
    before = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(minutes=1)
    pipelines.take(batch(spark, range(4), None), 0, root, "s")
    assert held(spark, root) == (["m1", "m3"], [0.0, 2.0]) and stats(spark, root) == {"json": (5, 1, 5, 1)}
    assert all(before < r.timestamp < before + timedelta(minutes=10) for r in tiering.read(spark, f"{root}/logs").collect())
    tiering.run(spark, f"{root}/logs", datetime.now(timezone.utc).replace(tzinfo=None))
    assert held(spark, root)[0] == ["m1", "m3"]


def test_old_notes_go(spark, tmp_path):
    df = spark.createDataFrame([(T0, "s", "info", "m", None)], schemas.LOGS)
    for n in range(5):
        tiering.append_once(df, str(tmp_path), "s", n, remembered=2)
    assert sorted(x for x in os.listdir(tmp_path / "_batches") if not x.startswith(".")) == [f"s-{n:012d}" for n in (2, 3, 4)]
    assert tiering.read(spark, str(tmp_path)).count() == 5


def test_a_busy_service_is_many_files(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, id % 80000) AS timestamp", "'busy' AS service", "CAST(id AS DOUBLE) AS value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tiering.append(rows, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(tmp_path / "t" / "tier=hot" / "date=2024-01-05") if f.endswith(".parquet")]) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_footers(spark, tmp_path):
    """Rows, bytes and bounds of each file are those of its rows, without their pages."""
    rows = [(T0 - timedelta(hours=3 * h), f"s{h % 3}", None if h == 5 else float(h)) for h in range(200)]
    tiering.append(spark.createDataFrame(rows, "timestamp timestamp_ntz, service string, value double"), str(tmp_path / "t t"))
    tiering.run(spark, str(tmp_path / "t t"), T0)
    whole = tiering.read(spark, str(tmp_path / "t t"))
    got = {r.tier: r for r in tiering.stored(spark, str(tmp_path / "t t")).collect()}
    for tier in ("hot", "warm", "cold"):
        own = sorted(r.timestamp for r in whole.where(f"tier = '{tier}'").collect())
        assert (got[tier].rows, got[tier].oldest, got[tier].newest) == (len(own), own[0], own[-1])
        files = [p for p in (tmp_path / "t t" / f"tier={tier}").rglob("*.parquet")]
        assert (got[tier].files, got[tier].bytes) == (len(files), sum(p.stat().st_size for p in files))
        assert 0 < got[tier].packed < got[tier].bytes
    values = tiering.footers(spark, str(tmp_path / "t t"), "service").collect()
    assert all(r.rows > 0 for r in values)
