from __future__ import annotations

import json
from collections import Counter

from obsidia.operators import events

BODIES = [
    '{"a": 1, "b": {"c d": [1, {"x": null}, [true]]}, "m": 1}', '{"a": 2.50, "m": "s"}', '{"a": 1e400}', '{"k": 12345678901234567890.123456789012345678901234567890}', '{"a":"it\'s","it\'s":0}', "[1, 2]", '"s"', "3", "not json", "", None,
    '{"a": 1, "a": 2}', "{}", '{"deep": [[[[[1]]]]]}', '{"b": null}', '{"B": 1, "b": {"c d": []}}', '{"é": "日本 {x}"}', '{"long": "' + "x" * 5000 + '"}',
]


def walked(v, path="$"):
    kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "integer" if isinstance(v, int) else "number"
    yield path, kind
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walked(x, path + (f".{k}" if k.isascii() and k.isidentifier() else "['" + k.replace("'", "\\'") + "']"))
    if isinstance(v, list):
        for x in v:
            yield from walked(x, path + "[*]")


def parsed(body):
    """A body's value; what has a key twice is none."""
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    try:
        return json.loads(body, object_pairs_hook=once)
    except ValueError:
        return Ellipsis


def test_paths_by_walking(spark):
    taken = [b for b in BODIES if b is None or "1e400" not in b]
    got = {(r.path, r.kind): r.occurrences for r in events.paths(spark.createDataFrame([(b,) for b in taken], "body string")).collect()}
    assert got == dict(Counter(x for b in taken if b is not None and parsed(b) is not Ellipsis for x in walked(parsed(b))))
    assert events.paths(spark.createDataFrame([], "body string")).count() == 0


def test_nothing_is_lost(spark):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in enumerate(BODIES)], "i int, body string, `typed.x` string, `rest of` string")
    schema = events.discover(df)
    rows = events.shred(df, schema)
    back = {r.i: r.body for r in events.restore(rows).collect()}
    for i, b in enumerate(BODIES):
        if b is None:
            assert back[i] is None
        elif isinstance(parsed(b), dict):
            assert parsed(back[i]) == parsed(b)
        else:
            assert back[i] == b
    held = {r.i: r.rest for r in rows.collect()}
    assert held[1] is None and held[12] is None and held[13] is None and held[16] is None  # columns hold them
    assert held[3] == BODIES[3] and held[5] == BODIES[5] and held[14] == BODIES[14]
    assert {"a", "b", "m", "deep", "é"} <= set(schema.fieldNames())


def test_rows_that_come_later(spark):
    """A field and a type that the schema does not have go to the rest."""
    schema = events.discover(spark.createDataFrame([('{"a": 1}',)], "body string"))
    later = spark.createDataFrame([(1, '{"a": 7}'), (2, '{"a": "x"}'), (3, '{"a": 1, "z": 1}')], "i int, body string")
    rows = events.shred(later, schema)
    assert {r.i: r.rest for r in rows.collect()} == {1: None, 2: '{"a": "x"}', 3: '{"a": 1, "z": 1}'}
    none = events.discover(later.where("false"))
    assert none.fieldNames() == [] and {r.i: r.body for r in events.restore(events.shred(later, none)).collect()} == {1: '{"a": 7}', 2: '{"a": "x"}', 3: '{"a": 1, "z": 1}'}


def test_columns_can_be_stored(spark, tmp_path):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES) if b != BODIES[15]], "i int, body string")  # without names that differ in case alone
    rows = events.shred(df, events.discover(df)).drop("none")
    plain = [f for f in rows.schema["typed"].dataType.fieldNames() if "variant" not in rows.select(f"typed.`{f}`").dtypes[0][1]]
    rows.select("i", "rest", *[f"typed.`{f}`" for f in plain]).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(BODIES) - 1
