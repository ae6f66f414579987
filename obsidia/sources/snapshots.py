"""State of infrastructure from text that was captured elsewhere: JSON listings and key-value reports. Nothing is executed here."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.functions.maps import last_wins
from obsidia.functions.redact import redact_env

# Reasons of normal events that still matter, and how many events and minutes are looked at.
REASONS = ("Unhealthy", "BackOff", "Failed", "OOMKilling", "Evicted")
EVENTS, MINUTES = 10, 15


def properties(text: Column, between: str = "=") -> Column:
    """Lines of key and value as a map; of a key that comes again the last counts, other lines are skipped."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.contains(between))
    return last_wins(F.transform(lines, lambda x: F.struct(F.substring_index(x, between, 1).alias("key"), F.substr(x, F.length(F.substring_index(x, between, 1)) + 2).alias("value"))))


def stats(text: Column) -> Column:
    """Lines "STAT key value" as a map; of a key that comes again the last counts."""
    found = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+", 3)), lambda p: (F.size(p) == 3) & (p[0] == "STAT"))
    return last_wins(F.transform(found, lambda p: F.struct(p[1].alias("key"), p[2].alias("value"))))


def _long(m: Column, key: str) -> Column:
    return F.coalesce(m[key].try_cast("long"), F.lit(0))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def redis(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds memory_percent, hit_rate, miss_rate, evicted, clients, blocked, role and lag of an INFO report."""
    i = F.col("info")
    hits, misses = _long(i, "keyspace_hits"), _long(i, "keyspace_misses")
    made = df.withColumn("info", properties(F.col(text), ":"))
    lag = F.when(i["role"] == "slave", _long(i, "master_link_down_since_seconds")).otherwise(F.lit(0))
    return made.select(*df.columns, _percent(_long(i, "used_memory"), _long(i, "maxmemory")).alias("memory_percent"), _percent(hits, hits + misses).alias("hit_rate"), _percent(misses, hits + misses).alias("miss_rate"), _long(i, "evicted_keys").alias("evicted"), _long(i, "connected_clients").alias("clients"), _long(i, "blocked_clients").alias("blocked"), i["role"].alias("role"), lag.alias("lag"))


def memcached(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds used, limit, hit_rate, evicted and clients of a stats report."""
    i = F.col("info")
    hits, misses = _long(i, "get_hits"), _long(i, "get_misses")
    made = df.withColumn("info", stats(F.col(text)))
    return made.select(*df.columns, bytes_text(_long(i, "bytes")).alias("used"), bytes_text(_long(i, "limit_maxbytes")).alias("limit"), _percent(hits, hits + misses).alias("hit_rate"), _long(i, "evictions").alias("evicted"), _long(i, "curr_connections").alias("clients"))


def units(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds state and cpu of a service manager's properties; a unit that was not found is left out."""
    i = F.col("info")
    made = df.withColumn("info", properties(F.col(text))).where(F.coalesce(i["LoadState"], F.lit("")) != "not-found")
    return made.select(*df.columns, i["ActiveState"].alias("state"), i["SubState"].alias("sub_state"), duration_text(F.floor(_long(i, "CPUUsageNSec") / 1_000_000_000)).alias("cpu"))


def connections(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Adds active, idle, most and waiting connections of a database's report; what it does not tell is 0.

    kind: postgres, "active | idle | most | waiting"; mysql, the first three of these between white space; mongodb, a status text
    with its current connections.
    """
    names = ["active", "idle", "most", "waiting"]
    if kind == "mongodb":
        told = F.array(F.regexp_extract(text, r"\bcurrent\b[\"']?\s*:\s*(\d+)", 1))
        least = 1
    elif kind in ("postgres", "mysql"):
        told = F.split(F.trim(F.col(text)), r"\s*\|\s*" if kind == "postgres" else r"\s+")
        least = 4 if kind == "postgres" else 3
    else:
        raise ValueError(f"no report of {kind} is known")
    given = {"mongodb": 1, "mysql": 3, "postgres": 4}[kind]
    number = lambda i: F.when(F.size(told) >= least, F.get(told, F.lit(i)).try_cast("long")) if i < given else F.lit(None)
    return df.select("*", *[F.coalesce(number(i), F.lit(0).cast("long")).alias(n) for i, n in enumerate(names)])


def database(df: DataFrame, hits: str = "hits", size: str = "size", role: str = "role") -> DataFrame:
    """Adds cache_hit_percent, database_size and replication from a database's answers: a number, a size, and "role | position".

    What an answer does not tell is null; the answers' own columns go.
    """
    answered = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    found = {"cache_hit_percent": answered(hits).try_cast("double"), "database_size": answered(size), "replication": F.nullif(F.trim(F.substring_index(answered(role), "|", 1)), F.lit(""))}
    return df.select(*[c for c in df.columns if c not in (hits, size, role)], *[c.alias(k) for k, c in found.items()])


def kubernetes(workloads: DataFrame, pods: DataFrame, autoscalers: DataFrame, services: DataFrame) -> DataFrame:
    """A row a workload with all that is known of it: its pods, whose names begin with its own, its autoscaler and its service, of one name with it.

    A workload without a namespace is of "default", as are its parts. Without parts: no pods, and null for the others.
    """
    placed = lambda df: df.withColumn("namespace", F.coalesce("namespace", F.lit("default")))
    nested = lambda df, name: placed(df).groupBy("namespace", "name").agg(F.first(F.struct(*[c for c in df.columns if c not in ("namespace", "name")])).alias(name))
    own = placed(workloads)
    p = placed(pods).select(F.col("namespace").alias("of"), F.struct(*[c for c in pods.columns if c != "namespace"]).alias("pod"))
    matched = own.select("namespace", "name").join(p, (F.col("namespace") == F.col("of")) & F.startswith("pod.name", F.concat("name", F.lit("-"))))
    by_name = matched.groupBy("namespace", "name").agg(F.array_sort(F.collect_list("pod"), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("pods"))  # those of one workload
    out = own.join(by_name, ["namespace", "name"], "left").withColumn("pods", F.coalesce("pods", F.array()))
    return out.join(nested(autoscalers, "autoscaler"), ["namespace", "name"], "left").join(nested(services, "service"), ["namespace", "name"], "left")


def _items(df: DataFrame, kind: str, text: str) -> DataFrame:
    """A row for each named object of a JSON listing, or for the one object that the text is; other texts give none."""
    one = F.from_json(text, kind)
    found = F.coalesce(F.from_json(text, f"struct<items:array<{kind}>>")["items"], F.array(one))
    return df.select(F.explode(found).alias("x")).where("x.metadata.name IS NOT NULL")


_AMOUNTS = "struct<cpu:string,memory:string>"
_WORKLOAD = (
    "struct<kind:string,metadata:struct<name:string,namespace:string,creationTimestamp:string>,spec:struct<replicas:int,"
    "strategy:struct<type:string,rollingUpdate:struct<maxSurge:string,maxUnavailable:string>>,template:struct<spec:struct<containers:array<"
    f"struct<image:string,imagePullPolicy:string,resources:struct<requests:{_AMOUNTS},limits:{_AMOUNTS}>,env:array<struct<name:string,value:string>>>>>>>,"
    "status:struct<readyReplicas:int,availableReplicas:int,updatedReplicas:int>>"
)


def workloads(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a deployment or stateful set: replicas, rollout, and of its first container image, resources and redacted environment.

    Counts that are not stated are 0, other fields null; variables without a name are left out.
    """
    c = F.get("x.spec.template.spec.containers", F.lit(0))
    named = F.filter(c["env"], lambda e: F.coalesce(e["name"], F.lit("")) != "")
    env = last_wins(F.transform(named, lambda e: F.struct(e["name"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    count = lambda path: F.coalesce(path, F.lit(0))
    return _items(df, _WORKLOAD, text).select(
        "x.kind", "x.metadata.name", "x.metadata.namespace", count("x.spec.replicas").alias("replicas"),
        *[count(f"x.status.{k}Replicas").alias(k) for k in ("ready", "available", "updated")],
        F.col("x.spec.strategy.type").alias("strategy"), F.col("x.spec.strategy.rollingUpdate.maxSurge").alias("max_surge"), F.col("x.spec.strategy.rollingUpdate.maxUnavailable").alias("max_unavailable"),
        c["image"].alias("image"), c["imagePullPolicy"].alias("pull_policy"),
        *[c["resources"][side + "s"][k].alias(f"{k}_{side}") for side in ("request", "limit") for k in ("cpu", "memory")],
        redact_env(env).alias("env"), F.try_to_timestamp("x.metadata.creationTimestamp").cast("timestamp_ntz").alias("created"),
    )


def _load(value: str) -> str:
    return f"array<struct<resource:struct<name:string,{value}:struct<averageUtilization:int>>>>"


_SCALER = f"struct<metadata:struct<name:string,namespace:string>,spec:struct<minReplicas:int,maxReplicas:int,metrics:{_load('target')}>,status:struct<currentReplicas:int,desiredReplicas:int,currentMetrics:{_load('current')}>>"


def autoscalers(df: DataFrame, text: str = "text") -> DataFrame:
    """A row an autoscaler: bounds, current and desired replicas, target and current load in per cent; what is not stated is null."""

    def load(metrics: str, value: str, resource: str) -> Column:
        own = F.filter(F.col(metrics), lambda m: m["resource"]["name"] == resource)
        return F.try_element_at(own, F.lit(-1))["resource"][value]["averageUtilization"]

    return _items(df, _SCALER, text).select(
        "x.metadata.name", "x.metadata.namespace",
        *[F.col(f"x.{part}.{k}Replicas").alias(f"{k}_replicas") for part, k in (("spec", "min"), ("spec", "max"), ("status", "current"), ("status", "desired"))],
        *[load("x.spec.metrics", "target", k).alias(f"target_{k}") for k in ("cpu", "memory")],
        *[load("x.status.currentMetrics", "current", k).alias(f"current_{k}") for k in ("cpu", "memory")],
    )


_SERVICE = "struct<metadata:struct<name:string,namespace:string>,spec:struct<type:string,clusterIP:string,ports:array<struct<name:string,port:int,protocol:string>>>>"


def services(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a service: type, cluster_ip and ports, each as name:port/protocol or port/protocol."""
    shown = lambda p: F.concat(F.when(p["name"] != "", F.concat(p["name"], F.lit(":"))).otherwise(""), F.coalesce(p["port"], F.lit(0)).cast("string"), F.lit("/"), F.coalesce(p["protocol"], F.lit("")))
    return _items(df, _SERVICE, text).select("x.metadata.name", "x.metadata.namespace", F.col("x.spec.type").alias("type"), F.col("x.spec.clusterIP").alias("cluster_ip"), F.transform("x.spec.ports", shown).alias("ports"))


_STATES = "map<string,struct<reason:string>>"
_CONTAINER = f"struct<name:string,ready:boolean,restartCount:bigint,state:{_STATES},lastState:{_STATES}>"
_POD = f"struct<metadata:struct<name:string,namespace:string,creationTimestamp:string>,spec:struct<nodeName:string>,status:struct<phase:string,conditions:array<struct<type:string,status:string>>,containerStatuses:array<{_CONTAINER}>>>"


def pods(df: DataFrame, as_of: datetime | None = None, text: str = "text") -> DataFrame:
    """A row a pod: name, namespace, phase, ready, restarts, node, age at as_of, and containers with their state and why they last ended."""
    listed = F.coalesce("x.status.containerStatuses", F.array().cast(f"array<{_CONTAINER}>"))
    ready = F.coalesce(F.exists("x.status.conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True")), F.lit(False))
    restarts = F.aggregate(listed, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["restartCount"], F.lit(0)))
    state = lambda c: (F.get(F.map_keys(c["state"]), F.lit(0)).alias("state"), F.get(F.map_values(c["state"]), F.lit(0))["reason"].alias("reason"), c["lastState"]["terminated"]["reason"].alias("last_end"))
    containers_ = F.transform(listed, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["ready"], F.lit(False)).alias("ready"), F.coalesce(c["restartCount"], F.lit(0)).alias("restarts"), *state(c)))
    made = F.try_to_timestamp("x.metadata.creationTimestamp").cast("timestamp_ntz")
    age = duration_text(F.timestamp_diff("SECOND", made, F.lit(as_of).cast("timestamp_ntz"))) if as_of else F.lit(None).cast("string")
    return _items(df, _POD, text).select("x.metadata.name", "x.metadata.namespace", F.col("x.status.phase").alias("phase"), ready.alias("ready"), restarts.alias("restarts"), F.col("x.spec.nodeName").alias("node"), age.alias("age"), containers_.alias("containers"))


_EVENT = "struct<type:string,reason:string,message:string,count:int,lastTimestamp:string,involvedObject:struct<name:string>>"


def events(df: DataFrame, service: str, as_of: datetime, text: str = "text") -> DataFrame:
    """A service's warnings and notable events of the last MINUTES, the EVENTS newest. Events without a readable time stay, as oldest."""
    e = df.select(F.explode(F.from_json(text, f"struct<items:array<{_EVENT}>>")["items"]).alias("e")).select("e.*", F.try_to_timestamp("e.lastTimestamp").cast("timestamp_ntz").alias("last_seen"))
    near = F.col("last_seen").isNull() | (F.col("last_seen") >= F.lit(as_of - timedelta(minutes=MINUTES)).cast("timestamp_ntz"))
    found = e.where(F.startswith("involvedObject.name", F.lit(service)) & near & ((F.col("type") == "Warning") | F.col("reason").isin(*REASONS)))
    return found.select("type", "reason", "message", "count", "last_seen").orderBy(F.desc_nulls_last("last_seen"), "reason", "message").limit(EVENTS)


_LISTED = "struct<ID:string,Names:string,Name:string,Image:string,State:string,Status:string,Ports:string,CPUPerc:string,MemPerc:string,MemUsage:string>"


def containers(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each named JSON line of a container listing or usage report; what a report does not tell is null."""
    x = df.select(F.explode(F.split(text, "\n")).alias("l")).withColumn("c", F.from_json("l", _LISTED)).where("c.Names IS NOT NULL OR c.Name IS NOT NULL")
    number = lambda c: F.regexp_replace(c, "%", "").try_cast("double")
    used = F.split("c.MemUsage", r"\s*/\s*")
    return x.select(
        F.coalesce("c.Names", "c.Name").alias("name"), F.col("c.Image").alias("image"), F.col("c.State").alias("state"), number(F.col("c.CPUPerc")).alias("cpu_percent"), number(F.col("c.MemPerc")).alias("memory_percent"),
        F.substring("c.ID", 1, 12).alias("id"), F.col("c.Status").alias("status"), F.split(F.nullif(F.col("c.Ports"), F.lit("")), ",\\s*").alias("ports"), F.get(used, F.lit(0)).alias("memory_used"), F.get(used, F.lit(1)).alias("memory_limit"),
    )


def containers_of(containers: DataFrame, service: str) -> DataFrame:
    """Containers whose name holds the service's, whatever the case."""
    return containers.where(F.contains(F.lower("name"), F.lit(service.lower())))


#: Networks that every host has.
OWN_NETWORKS = ("bridge", "host", "none")


def networks(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each network of a listing of names, but those that every host has."""
    name = F.trim(F.regexp_replace("l", r"^\s+|\s+$", ""))
    return df.select(F.explode(F.split(text, "\n")).alias("l")).select(name.alias("network")).where((F.col("network") != "") & ~F.col("network").isin(*OWN_NETWORKS))


_INSPECTED = "struct<Id:string,Name:string,RestartCount:int,State:struct<Status:string,RestartCount:int,StartedAt:string,Health:struct<Status:string>>,HostConfig:struct<Memory:bigint>,Config:struct<Env:array<string>>>"


def inspected(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a container of a JSON array of details: restarts, health, started, memory_limit (null: none) and redacted environment."""
    x = df.select(F.explode(F.from_json(text, f"array<{_INSPECTED}>")).alias("x")).where("x.Id IS NOT NULL")
    pairs = F.transform(F.filter("x.Config.Env", lambda e: e.contains("=")), lambda e: F.struct(F.substring_index(e, "=", 1).alias("key"), F.substr(e, F.length(F.substring_index(e, "=", 1)) + 2).alias("value")))
    limit = F.col("x.HostConfig.Memory")
    return x.select(
        F.substring("x.Id", 1, 12).alias("id"), F.ltrim(F.col("x.Name"), F.lit("/")).alias("name"), F.coalesce("x.State.RestartCount", "x.RestartCount", F.lit(0)).alias("restarts"), F.col("x.State.Health.Status").alias("health"),
        F.try_to_timestamp("x.State.StartedAt").cast("timestamp_ntz").alias("started"), F.when(limit > 0, bytes_text(limit)).alias("memory_limit"), redact_env(last_wins(pairs)).alias("env"),
    )


def bytes_text(n: Column) -> Column:
    """Bytes for a reader."""
    k = 1024
    return F.when(n >= k**3, F.format_string("%.1fGi", n / k**3)).when(n >= k**2, F.format_string("%.1fMi", n / k**2)).when(n >= k, F.format_string("%.1fKi", n / k)).otherwise(F.format_string("%dB", n.cast("long")))


def duration_text(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days for a reader."""
    s = seconds.cast("long")
    part = lambda size: F.floor(s / size).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(part(60), F.lit("m"))).when(s < 86400, F.concat(part(3600), F.lit("h"))).otherwise(F.concat(part(86400), F.lit("d")))


def quantity(text: Column) -> Column:
    """A resource quantity as a number: Ki, Mi and Gi are multiplied out, m is thousandths of a core; null if it is none."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^(-?\d+)(Ki|Mi|Gi|m)?$", 1).try_cast("long")
    unit = F.regexp_extract(t, "(Ki|Mi|Gi)$", 1)
    return number * F.when(unit == "Ki", 1024).when(unit == "Mi", 1024**2).when(unit == "Gi", 1024**3).otherwise(1)


def store_kind(service: Column) -> Column:
    """The database or cache that a name speaks of, else an empty string. What names it is fixed, and so is the order."""
    name = F.lower(service)
    return (
        F.when(name.contains("postgres") | name.contains("pg"), "postgres").when(name.contains("mysql") | name.contains("mariadb"), "mysql").when(name.contains("mongo"), "mongodb")
        .when(name.contains("redis"), "redis").when(name.contains("memcache"), "memcached").otherwise("")
    )
