from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from obsidia.sources import snapshots


def captured(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def value(spark, expr, v, kind="string"):
    return spark.createDataFrame([(v,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_properties(spark):
    assert value(spark, snapshots.properties, "A=1\n\n bad\nB=x=y\r\nA=2") == {"A": "2", "B": "x=y"}
    assert value(spark, snapshots.properties, None) is None


def test_redis(spark):
    row = snapshots.redis(captured(spark, "# Memory\r\nused_memory:50\r\nmaxmemory:200\r\nkeyspace_hits:3\r\nkeyspace_misses:1\r\nrole:slave\r\nmaster_link_down_since_seconds:9\r\n")).first()
    assert (row.memory_percent, row.hit_rate, row.miss_rate, row.role, row.lag) == (25.0, 75.0, 25.0, "slave", 9)
    assert snapshots.redis(captured(spark, "")).first().hit_rate == 0.0


def test_memcached(spark):
    row = snapshots.memcached(captured(spark, "STAT bytes 2048\nSTAT limit_maxbytes 67108864\nSTAT get_hits 1\nSTAT get_misses 3\nEND")).first()
    assert (row.used, row.limit, row.hit_rate) == ("2.0Ki", "64.0Mi", 25.0)
    assert snapshots.memcached(captured(spark, "STAT evictions 1\nSTAT evictions 2")).first().evicted == 2


def test_units(spark):
    rows = snapshots.units(captured(spark, "LoadState=loaded\nActiveState=active\nSubState=running\nCPUUsageNSec=7200000000000", "LoadState=not-found")).collect()
    assert [(r.state, r.sub_state, r.cpu) for r in rows] == [("active", "running", "2h")]


def test_pods_and_events(spark):
    pod = {"metadata": {"name": "web-1", "namespace": "d"}, "status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "True"}], "containerStatuses": [{"restartCount": 2}, {"restartCount": 3}]}}
    rows = snapshots.pods(captured(spark, json.dumps({"items": [pod, {"metadata": {"name": "web-2"}}]}), "bad")).collect()
    assert [(r.name, r.ready, r.restarts) for r in rows] == [("web-1", True, 5), ("web-2", False, 0)]

    def event(kind, reason, minute, name="web-1"):
        return {"type": kind, "reason": reason, "message": "m", "count": 1, "lastTimestamp": f"2024-01-01T00:{minute:02d}:00Z", "involvedObject": {"name": name}}

    items = [event("Warning", "X", 50), event("Normal", "BackOff", 55), event("Normal", "Pulled", 55), event("Warning", "Old", 10), event("Warning", "Other", 55, "db")]
    items += [event("Warning", f"W{i:02d}", 46) for i in range(12)]
    found = snapshots.events(captured(spark, json.dumps({"items": items})), "web", datetime(2024, 1, 1, 1)).collect()
    assert [r.reason for r in found[:2]] == ["BackOff", "X"] and len(found) == 10


def test_pod_containers(spark):
    waiting = {"name": "c", "restartCount": 4, "state": {"waiting": {"reason": "CrashLoopBackOff"}}, "lastState": {"terminated": {"reason": "OOMKilled"}}}
    pod = {"metadata": {"name": "web-1", "creationTimestamp": "2024-01-01T00:00:00Z"}, "spec": {"nodeName": "n1"}, "status": {"containerStatuses": [waiting, {"name": "d", "ready": True, "state": {"running": {}}}]}}
    row = snapshots.pods(captured(spark, json.dumps({"items": [pod]})), datetime(2024, 1, 1, 3)).first()
    assert (row.node, row.age, row.restarts) == ("n1", "3h", 4)
    assert [tuple(c) for c in row.containers] == [("c", False, 4, "waiting", "CrashLoopBackOff", "OOMKilled"), ("d", True, 0, "running", None, None)]


def test_workloads(spark):
    env = [{"name": "DB_PASSWORD", "value": "x"}, {"name": "MODE", "value": "a"}, {"name": "MODE", "value": "b"}, {"name": "", "value": "n"}, {"name": "FROM"}]
    container = {"image": "i:1", "imagePullPolicy": "Always", "resources": {"requests": {"cpu": "100m"}, "limits": {"memory": "1Gi"}}, "env": env}
    deployment = {
        "kind": "Deployment", "metadata": {"name": "web", "creationTimestamp": "2024-01-01T00:00:00Z"},
        "spec": {"replicas": 3, "strategy": {"type": "RollingUpdate", "rollingUpdate": {"maxSurge": 1, "maxUnavailable": "25%"}}, "template": {"spec": {"containers": [container, {"image": "side"}]}}},
        "status": {"readyReplicas": 2},
    }
    texts = json.dumps(deployment), json.dumps({"items": [{"kind": "StatefulSet", "metadata": {"name": "db"}}]}), "bad", "", None
    web, db = sorted(snapshots.workloads(captured(spark, *texts)).collect(), key=lambda r: r.name, reverse=True)
    assert (web.replicas, web.ready, web.available, web.strategy, web.max_surge, web.max_unavailable) == (3, 2, 0, "RollingUpdate", "1", "25%")
    assert (web.image, web.pull_policy, web.cpu_request, web.memory_request, web.cpu_limit, web.memory_limit) == ("i:1", "Always", "100m", None, None, "1Gi")
    assert web.env == {"DB_PASSWORD": "[REDACTED]", "MODE": "b", "FROM": ""} and web.created == datetime(2024, 1, 1)
    assert (db.kind, db.replicas, db.image, db.env) == ("StatefulSet", 0, None, None)


def test_autoscalers_and_services(spark):
    def load(key, **resources):
        return [{"resource": {"name": k, key: {"averageUtilization": v}}} for k, v in resources.items()]

    scaler = {"metadata": {"name": "web"}, "spec": {"minReplicas": 1, "maxReplicas": 9, "metrics": load("target", cpu=70, memory=80)}, "status": {"currentReplicas": 2, "desiredReplicas": 4, "currentMetrics": load("current", cpu=95)}}
    row = snapshots.autoscalers(captured(spark, json.dumps(scaler), "bad")).first()
    assert tuple(row)[2:] == (1, 9, 2, 4, 70, 80, 95, None)
    service = {"metadata": {"name": "web"}, "spec": {"type": "ClusterIP", "clusterIP": "10.0.0.1", "ports": [{"name": "http", "port": 80, "protocol": "TCP"}, {"port": 53, "protocol": "UDP"}]}}
    row = snapshots.services(captured(spark, json.dumps(service))).first()
    assert (row.type, row.cluster_ip, row.ports) == ("ClusterIP", "10.0.0.1", ["http:80/TCP", "53/UDP"])


@pytest.mark.parametrize("kind,text,want", [
    ("postgres", "  5 | 10 | 100 | 2\n", (5, 10, 100, 2)), ("postgres", "5 | 10", (0, 0, 0, 0)), ("mysql", "3\t4\t151\n", (3, 4, 151, 0)),
    ("mongodb", "{ current: 7, available: 800 }", (7, 0, 0, 0)), ("mongodb", "none", (0, 0, 0, 0)), ("postgres", None, (0, 0, 0, 0)),
])
def test_connections(spark, kind, text, want):
    assert tuple(snapshots.connections(spark.createDataFrame([(text,)], "text string"), kind).first())[1:] == want


def test_containers(spark):
    rows = snapshots.containers(captured(spark, '{"Names":"a","Image":"i","State":"running"}\nbad\n{"Name":"b","CPUPerc":"1.50%","MemPerc":"20%"}')).collect()
    assert [(r.name, r.image, r.cpu_percent, r.memory_percent) for r in rows] == [("a", "i", None, None), ("b", None, 1.5, 20.0)]


def test_container_usage(spark):
    row = snapshots.containers(captured(spark, '{"ID":"0123456789abcdef","Names":"a","Status":"Up 2 hours","Ports":"80/tcp, 443/tcp","MemUsage":"10MiB / 1GiB"}')).first()
    assert (row.id, row.status, row.ports, row.memory_used, row.memory_limit) == ("0123456789ab", "Up 2 hours", ["80/tcp", "443/tcp"], "10MiB", "1GiB")
    details = [{"Id": "f" * 64, "Name": "/web", "RestartCount": 3, "State": {"StartedAt": "2024-01-01T00:00:00Z", "Health": {"Status": "healthy"}}, "HostConfig": {"Memory": 1 << 29}, "Config": {"Env": ["A=b=c", "API_KEY=1", "bad", "A=d"]}}, {"Id": "0" * 64}]
    web, bare = snapshots.inspected(captured(spark, json.dumps(details), "bad", "", None)).collect()
    assert (web.id, web.name, web.restarts, web.health, web.started, web.memory_limit, web.env) == ("f" * 12, "web", 3, "healthy", datetime(2024, 1, 1), "512.0Mi", {"A": "d", "API_KEY": "[REDACTED]"})
    assert tuple(bare)[1:] == (None, 0, None, None, None, None)


@pytest.mark.parametrize("text,want", [("2Gi", 2 << 30), (" 64Mi ", 64 << 20), ("8Ki", 8192), ("500m", 500), ("3", 3), ("x", None), ("", None), (None, None)])
def test_quantity(spark, text, want):
    assert value(spark, snapshots.quantity, text) == want


def test_for_readers(spark):
    assert [value(spark, snapshots.bytes_text, n, "long") for n in (5, 1536, 3 << 30)] == ["5B", "1.5Ki", "3.0Gi"]
    assert [value(spark, snapshots.duration_text, n, "long") for n in (59, 61, 7300, 200_000)] == ["59s", "1m", "2h", "2d"]
    assert [value(spark, snapshots.store_kind, n) for n in ("user-pg", "MariaDB", "mongo1", "redis", "memcache", "web")] == ["postgres", "mysql", "mongodb", "redis", "memcached", ""]


def test_database_answers(spark):
    rows = [("a", " 99.12\n", " 12 MB\n", " replica | 0/3000"), ("b", "", "x", "primary"), ("c", None, None, None)]
    got = snapshots.database(spark.createDataFrame(rows, "db string, hits string, size string, role string")).collect()
    assert [tuple(r) for r in got] == [("a", 99.12, "12 MB", "replica"), ("b", None, "x", "primary"), ("c", None, None, None)]


def test_kubernetes_in_one_row(spark):
    def listing(*items):
        return captured(spark, json.dumps({"items": list(items)}))

    workloads = snapshots.workloads(listing({"kind": "Deployment", "metadata": {"name": "web", "namespace": "prod"}, "spec": {"replicas": 2}}, {"kind": "StatefulSet", "metadata": {"name": "db"}}))
    pods = snapshots.pods(listing(*[{"metadata": {"name": n, "namespace": s}, "status": {"phase": "Running"}} for n, s in (("web-b", "prod"), ("web-a", "prod"), ("web-c", "test"), ("website-a", "prod"))]))
    scalers = snapshots.autoscalers(listing({"metadata": {"name": "web", "namespace": "prod"}, "spec": {"maxReplicas": 9}}))
    services = snapshots.services(listing({"metadata": {"name": "db"}, "spec": {"type": "ClusterIP"}}))
    got = {r.name: r for r in snapshots.kubernetes(workloads, pods, scalers, services).collect()}
    assert [p.name for p in got["web"].pods] == ["web-a", "web-b"] and got["web"].autoscaler.max_replicas == 9 and got["web"].service is None
    assert got["db"].pods == [] and got["db"].service.type == "ClusterIP" and got["db"].namespace == "default"


def test_networks_and_names(spark):
    df = spark.createDataFrame([("bridge\nhost\n web_net \n\nnone\r\ndb-net\r",), (None,)], "text string")
    assert sorted(r.network for r in snapshots.networks(df).collect()) == ["db-net", "web_net"]
    listed = spark.createDataFrame([('{"Names":"prod-Checkout-1","ID":"a"}\n{"Names":"redis","ID":"b"}\nbad\n{"Names":"checkout","ID":"c"}',)], "text string")
    assert sorted(r.name for r in snapshots.containers_of(snapshots.containers(listed), "checkOUT").collect()) == ["checkout", "prod-Checkout-1"]
