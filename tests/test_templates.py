from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from obsidia.operators import templates
from obsidia.operators.templates import ANY, Settings

R = random.Random(4)
ODD = [None, "", " ", "  two  spaces ", "<*>", "a <*> b", "1", "x" * 200, "tab\there\nand line", "é 日本 7", "one " * 100, "w " * 63, "w " * 64, "trailing ", "[]{}()\\ $1"]
LOGS = [f"user {R.randint(0, 99)} logged in from 10.0.0.{R.randint(0, 9)}" for _ in range(40)] + [f"disk {d} is full" for d in "abcdefg" for _ in range(3)] + [f"worker {w} stopped after {n} jobs" for w in ("red", "blue") for n in range(6)] + ["rare message of its own"]


def mined(messages, s):
    """Template of each message by plain loops over shapes."""

    def tokens(m):
        return m.split(" ", s.tokens - 1)

    def shape(m):
        return tuple(ANY if re.search("[0-9]", t) or len(t) > s.longest or t == ANY or i == s.tokens - 1 else t for i, t in enumerate(tokens(m)))

    counts = Counter(shape(m) for m in messages if m is not None)
    leaves = defaultdict(list)
    for x in counts:
        leaves[len(x), x[: s.lead]].append(x)
    leader = {}
    for left in leaves.values():
        for _ in range(s.rounds):
            if left:
                top = max(left, key=lambda x: (counts[x], [t.encode() for t in x]))
                joins = {x for x in left if x == top or sum(a == b != ANY for a, b in zip(x, top, strict=True)) >= s.agree * len(x)}
                leader |= {x: top for x in joins}
                left = [x for x in left if x not in joins]
        leader |= {x: x for x in left}
    groups = defaultdict(list)
    for x, top in leader.items():
        groups[top].append(x)
    template = {}
    for held in groups.values():
        enough = sum(counts[x] for x in held) >= s.support
        made = tuple(c[0] if len(set(c)) == 1 else ANY for c in zip(*held, strict=True)) if enough else (ANY,)
        template |= {x: made for x in held}
    return [None if m is None else template[shape(m)] for m in messages]


@pytest.mark.parametrize("settings", [Settings(), replace(Settings(), lead=2, rounds=1, support=1), replace(Settings(), tokens=4, longest=6, agree=0.7, support=2), replace(Settings(), rounds=0)])
def test_by_loops(spark, settings):
    texts = ODD + LOGS + LOGS[:5]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, message string, template string").drop("template").repartition(3)
    found, shapes = templates.mine(df, settings)
    rows = templates.encode(df, shapes, settings)
    named = {r.template_id: tuple(r.template) for r in found.collect()}
    want = mined(texts, settings)
    got = {r.i: r for r in rows.collect()}
    assert [None if got[i].template_id is None else named[got[i].template_id] for i in range(len(texts))] == want
    assert Counter({tuple(r.template): r.messages for r in found.collect()}) == Counter(t for t in want if t is not None)
    for i, t in enumerate(texts):
        if t is not None:
            assert len(got[i].variables) == want[i].count(ANY)
    assert sorted((r.i, r.message or "", r.message is None) for r in templates.decode(rows, found).collect()) == sorted((i, t or "", t is None) for i, t in enumerate(texts))


def test_few_templates(spark):
    found, _ = templates.mine(spark.createDataFrame([(t,) for t in LOGS], "message string"))
    assert {" ".join(r.template): r.messages for r in found.collect()} == {"user <*> logged in from <*>": 40, "disk <*> is full": 21, "worker <*> stopped after <*> jobs": 12, ANY: 1}


def test_later_messages_and_none(spark):
    df = spark.createDataFrame([(t,) for t in LOGS], "message string")
    found, shapes = templates.mine(df)
    later = spark.createDataFrame([("a shape that nobody knows",), ("user 7 logged in from 1.2.3.4",), (None,)], "message string")
    rows = templates.encode(later, shapes)
    assert sorted(r.message or "" for r in templates.decode(rows, found).collect()) == ["", "a shape that nobody knows", "user 7 logged in from 1.2.3.4"]
    assert rows.where("template_id IS NULL").count() == 1
    none, empty = templates.mine(df.where("false"))
    assert none.count() == 0 and templates.encode(df.where("false"), empty).count() == 0


def test_documents_come_back(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, shapes = templates.mine(df, column="text")
    again = templates.decode(templates.encode(df, shapes, column="text"), found, "text")
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).digest() for r in again.collect()} == {r.doc_id: hashlib.sha256((r.text or "").encode()).digest() for r in df.collect()}
    assert found.count() * 5 <= df.count()
