"""What a session holds, in words and rows, and views that answer to other names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other names that questions use for the core columns, as SQL over the core table; levels as numbers, for thresholds.
LEVEL_ID = "CASE upper(level) WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'WARNING' THEN 3 WHEN 'ERROR' THEN 4 WHEN 'FATAL' THEN 5 WHEN 'CRITICAL' THEN 5 ELSE 0 END"
ALIASES = {
    "spans": {
        "service_id": "service", "operation_id": "operation", "name": "operation", "endpoint": "operation", "latency": "duration_us / 1000",
        "latency_ms": "duration_us / 1000", "parent_service": "service", "has_error": "upper(status) = 'ERROR'", "status_code": "CASE WHEN upper(status) = 'ERROR' THEN 500 ELSE 200 END",
    },
    "logs": {"service_id": "service", "severity": "level", "level_id": LEVEL_ID},
    "metrics": {"service_id": "service", "metric_name": "name"},
}
# Words in a question, and the columns whose values answer it: table, column, how many.
TOPICS = [
    (("service",), [("spans", "service", 20), ("logs", "service", 20)]),
    (("level", "severity", "log"), [("logs", "level", 10)]),
    (("status", "error"), [("spans", "status", 10)]),
    (("operation", "endpoint"), [("spans", "operation", 20)]),
]


def register(tables: dict[str, DataFrame]) -> None:
    """Views by name for any SQL. Core tables also answer to their aliases, which cost nothing unless a query names them."""
    for name, df in tables.items():
        own = set(df.columns)
        extra = [F.expr(sql).alias(k) for k, sql in ALIASES.get(name, {}).items() if k not in own]
        df.select("*", *extra).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def distinct_values(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """A column's values that are not null, in order, limit of them at most."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(limit)


def introspect(tables: dict[str, DataFrame], question: str) -> DataFrame:
    """table, column and value for the columns that a question is about."""
    found = [c for words, columns in TOPICS if any(w in question.lower() for w in words) for c in columns if c[0] in tables]
    parts = [distinct_values(tables[t], c, n).select(F.lit(t).alias("table"), F.lit(c).alias("column"), "value") for t, c, n in found]
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "`table` string, `column` string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def columns(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "`table` string, `column` string, `type` string, position int")


def schema_text(tables: dict[str, DataFrame]) -> str:
    """Markdown for a reader who writes SQL: tables with rows and their columns, empty tables, hints."""
    counts = {r["table"]: r["rows"] for r in table_counts(tables).collect()}  # a row a table
    full = [t for t in tables if counts[t]]
    out = ["# Tables", *[f"- {t}: {counts[t]} rows" for t in full]]
    out += ["", "Empty: " + ", ".join(t for t in tables if not counts[t])] if len(full) < len(tables) else []
    for t in full:
        out += ["", f"## {t}", "| column | type |", "|---|---|", *[f"| {f.name} | {f.dataType.simpleString()} |" for f in tables[t].schema]]
    out += ["", "Spark SQL. timestamp is a TIMESTAMP without zone; duration_us is in microseconds; compare status and level with upper()."]
    return "\n".join(out)


def column_type(value: object) -> T.DataType:
    """The type of a column that would hold a value."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, (dict, list)):
        return T.VariantType()
    return T.StringType()


def ensure_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df with the columns that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in df.columns])


def ensure_table(spark: SparkSession, name: str, wanted: T.StructType) -> DataFrame:
    """The table of the session's catalog, made if it is not there, with the columns that it lacks added at its end; rows from before have nulls there."""
    quoted = ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
    if not spark.catalog.tableExists(quoted):
        spark.createDataFrame([], wanted).write.format("parquet").saveAsTable(quoted)
    there = {c.lower() for c in spark.table(quoted).columns}
    missing = [f for f in wanted if f.name.lower() not in there]
    if missing:
        added = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {quoted} ADD COLUMNS ({added})")
    return spark.table(quoted)


def printed(df: DataFrame, limit: int = 1000) -> str:
    """Rows with a header, parted by tabs, for a terminal; of more than limit rows the rest is named, not shown."""
    rows = df.limit(limit + 1).collect()
    lines = ["\t".join("NULL" if v is None else str(v) for v in r) for r in [df.columns, *rows[:limit]]]
    return "\n".join(lines + ["..."] * (len(rows) > limit))
