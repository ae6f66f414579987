"""Schemas of events that come as JSON: what paths there are, with which types and how often; typed columns; and the events again.

JSON is parsed into VARIANT once. Paths are counted level by level, so that an event's size and depth do not matter; the columns are those
of the schema that all events merge into, where paths of several types stay VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsidia import shared

_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null"}


def kind(value: Column) -> Column:
    """What a VARIANT is, in JSON's words."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    out: Column = F
    for k, v in _KINDS.items():
        out = out.when(name == k, v)
    return out.otherwise(F.lower(name))


def paths(events: DataFrame, column: str = "body") -> DataFrame:
    """path, kind and occurrences: `$` is the event, `.key` and `['key']` lead into objects, `[*]` to all elements of an array.

    Text that is no JSON and null have no paths. Values that hold others are written to the shared folder level by level.
    """
    level = events.select(F.lit("$").alias("path"), F.try_parse_json(F.col(f"`{column}`")).alias("v")).where("v IS NOT NULL").withColumn("kind", kind(F.col("v")))
    counts = None
    while True:
        level = shared.written(level, "level")
        own = level.groupBy("path", "kind").agg(F.count("*").alias("occurrences"))
        counts = own if counts is None else counts.unionByName(own)
        inner = level.where("kind IN ('object', 'array')")
        if inner.isEmpty():
            return counts.groupBy("path", "kind").agg(F.sum("occurrences").alias("occurrences"))
        spread = inner.sparkSession.sql("SELECT path, kind AS of, e.key AS key, e.value AS v FROM {inner}, LATERAL variant_explode(v) AS e", inner=inner)
        step = F.when(F.col("of") == "array", "[*]").when(F.col("key").rlike("^[A-Za-z_][A-Za-z_0-9]*$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']")))
        level = spread.select(F.concat("path", step).alias("path"), "v", kind(F.col("v")).alias("kind"))


def _storable(t: T.DataType) -> T.DataType:
    """What was null wherever it came is a string."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_storable(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _storable(f.dataType)) for f in t.fields])
    return t


def discover(events: DataFrame, column: str = "body") -> T.StructType:
    """The columns of all events that are objects: one aggregate, whose one row is as long as there are paths.

    Names that differ in case alone are columns of their own; to select one of them the session must tell cases apart.
    """
    v = F.try_parse_json(F.col(f"`{column}`"))
    found = events.select(v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).agg(F.schema_of_variant_agg("v").alias("s")).first().s
    if not found or not found.startswith("OBJECT<"):
        return T.StructType([])
    # Names are in backquotes where they could be mistaken; what is not between those names is type.
    parts = found.split("`")
    ddl = "`".join(p if i % 2 else p.replace("OBJECT<", "STRUCT<") for i, p in enumerate(parts))
    return _storable(events.sparkSession.range(1).select(F.from_json(F.lit("{}"), ddl).alias("t")).schema["t"].dataType)


def _canonical(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def shred(events: DataFrame, schema: T.StructType, column: str = "body") -> DataFrame:
    """The rows with typed, a struct of the schema's columns, and rest in place of the text.

    rest is null where the columns hold all of the event, and its whole text where they do not: no object, no JSON, a field or a type
    that the schema does not have, a null that is written out, or a number with an exponent or more digits than are kept. typed is null in rows without an object.
    """
    text = F.col(f"`{column}`")
    read = F.from_json(text, schema, {"mode": "PERMISSIVE"}) if schema.fields else F.lit(None).cast(T.StructType([T.StructField("none", T.StringType())]))
    v = F.try_parse_json(text)
    typed = F.when(F.schema_of_variant(v).startswith("OBJECT"), read)
    rows = events.withColumn("typed", typed)
    same = _canonical(F.to_json("typed")) == _canonical(text)
    rest = F.when(F.coalesce(same, F.lit(False)) & ~text.rlike("[0-9.]{16,}|[0-9][eE]"), F.lit(None)).otherwise(text)
    return rows.withColumn("rest", rest).drop(column)


def restore(rows: DataFrame, column: str = "body") -> DataFrame:
    """The rows of shred() with the JSON again: of events that the columns hold, compact and with keys in order; of others their text."""
    return rows.withColumn(column, F.coalesce("rest", _canonical(F.to_json("typed")))).drop("typed", "rest")
