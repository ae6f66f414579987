from __future__ import annotations

import hashlib
import random
import re
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obsidia.llm import middle, queries
from tests.oracle import same

R = random.Random(5)
ODD = [None, "", "\n", "\n\n\n", "one", "a\nb", "a\nb\n", "é\n€uro\n\U0001f600 x\n", "has <P> in it\nb", "<", "<S", "x <\n<S\nM>\n<", "tail\r\nb c\n", " \n", "w " * 3000 + "\n" + "z\n" * 500]
TEXTS = ODD + ["".join(R.choices(["a", "é", "\n", "<", "P>", "日", " "], k=R.randint(0, 60))) for _ in range(200)]


def by_hand(doc_id, text, s=middle.LINES):
    """n, form, prefix_chars, middle_chars and output by strings alone."""
    text = text or ""
    ends = re.escape(s.ends.decode())
    units = re.findall(f"[^{ends}]*[{ends}]|[^{ends}]+", text)
    digest = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, rest = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in s.marks) or h[2] % 100 >= s.rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < s.spm:
        return len(units), "spm", len(p), len(m), s.suffix + rest + s.prefix + p + s.middle + m
    return len(units), "psm", len(p), len(m), s.prefix + p + s.suffix + rest + s.middle + m


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 7 else i, t, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (5, "other\ntext", "x")], "doc_id long, text string, output string").repartition(3)


@pytest.mark.parametrize("settings", [middle.LINES, replace(middle.LINES, rate=40, spm=10, seed=3), middle.Settings("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", b" \n")])
def test_by_hand(docs, settings):
    got = middle.restore(middle.transform(docs, settings), settings).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(repr, ((r.doc_id, *by_hand(r.doc_id, r.text, settings)) for r in rows)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_passes_do_not_matter(docs, monkeypatch):
    rows = pa.RecordBatch.from_pydict({"text": pa.array([t or "" for t in TEXTS])})
    monkeypatch.setattr(middle, "PASS_BYTES", 50)
    parts = list(middle._passes(rows, "text"))
    assert sum(p.num_rows for p in parts) == len(TEXTS) and len(parts) > 50
    assert pa.concat_arrays([p.column("text") for p in parts]).to_pylist() == rows.column("text").to_pylist()


def test_very_long_and_empty(spark):
    text = "".join(f"line {i} é\n" for i in range(200_000))
    long = spark.createDataFrame([(1, text), (2, "x" * 2_000_000)], "doc_id long, text string")
    for r in middle.restore(middle.transform(long)).collect():
        want = by_hand(r.doc_id, r.restored)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
    assert middle.digests(long.where("false")).count() == 0


def test_marks_that_could_be_mistaken():
    for bad in (("", "<S>", "<M>"), ("aba", "bab", "c"), ("<P>", "<P>>", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            middle.Settings(*bad)


def test_as_duckdb(spark, sf_dir):
    found = queries.op12_fill_in_middle(spark, sf_dir)
    same(found, queries.oracle_sql()["op12_fill_in_middle"], sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    assert found.join(texts, "doc_id").where("h <> restored_sha256").count() == 0
