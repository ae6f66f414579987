from __future__ import annotations

import random

import numpy as np
import pytest

from obsidia.llm import codes, queries
from tests.oracle import same

SMALL = codes.Settings(parts=4, entries=5, rounds=2, scale=256)


def by_hand(rows, s, width):
    """Codes, errors and codebooks of (id, label, vector) by loops over whole numbers."""
    whole = [(i, label, [*(int(x * s.scale // 1) for x in v), *[0] * (width - len(v))]) for i, label, v in rows]
    size = width // s.parts
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[: s.entries]
    books = [[r[2][p * size : (p + 1) * size] for r in first] for p in range(s.parts)]

    def coded(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(s.rounds):
        held = [[[] for _ in first] for _ in range(s.parts)]
        for _, _, v in whole:
            for p in range(s.parts):
                held[p][coded(v, p)[0]].append(v[p * size : (p + 1) * size])
        books = [[[sum(c) // len(of) for c in zip(*of, strict=True)] if of else e for of, e in zip(held[p], books[p], strict=True)] for p in range(s.parts)]
    out = []
    for i, label, v in whole:
        found = [coded(v, p) for p in range(s.parts)]
        out.append((i, label, "".join(f"{c:02x}" for c, _ in found), sum(e for _, e in found)))
    return out, books


def checked(spark, rows, s=SMALL, width=8, parts=3):
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, code string").repartition(parts)
    coded, books = codes.compress(vectors, s)
    usable = [(r[0], r[1], r[2]) for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    want, by = by_hand(usable, s, width)
    assert books.tolist() == by
    got = codes.with_labels(coded, books).collect()
    assert sorted(map(repr, ((r.vec_id, r.code, r.error) for r in got))) == sorted(map(repr, ((i, c, e) for i, _, c, e in want)))
    total = {}
    for _, label, _, e in want:
        total[label] = total.get(label, 0) + e
    assert sorted(r.label_error for r in got) == sorted(total[label] for _, label, _, _ in want)
    assert {r.codebooks_sha256 for r in got} == {codes.digest(books)}


def test_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, None]), [round(rng.uniform(-3, 3), 2) for _ in range(8)], "x") for i in range(150)]
    odd = [(150, 1, None, "x"), (151, 1, [None] * 8, "x"), (152, 1, [float("nan")] * 8, "x"), (153, 1, [float("inf")] * 8, "x"), (154, 2, [], "x"), (155, 2, [1.0, 2.0, 3.0], "x"), (None, None, [0.5] * 8, "x"), (3, 1, [9.0] * 8, "x")]
    checked(spark, rows + odd + rows[:20])
    checked(spark, [(i, 1, [1.0] * 8, "x") for i in range(40)], parts=5)  # all entries alike: the lowest index
    checked(spark, rows[:3], parts=2)  # fewer vectors than entries
    checked(spark, [(i, i % 2, v[:6], "x") for i, _, v, _ in rows])  # a width that is no multiple of the parts


def test_beyond_64_bits(spark):
    rng = random.Random(4)
    checked(spark, [(i, 1, [rng.choice([-1, 1]) * rng.random() * 1e6 for _ in range(8)], "x") for i in range(60)])  # still within
    rows = [(i, 1, [rng.choice([-1, 1]) * rng.random() * 2.0**45 for _ in range(8)], "x") for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, code string")
    coded, books = codes.compress(vectors, SMALL)
    want, by = by_hand([r[:3] for r in rows], SMALL, 8)
    assert books.tolist() == by
    got = codes.with_labels(coded, books).collect()
    most = (1 << 63) - 1
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, c, min(e, most)) for i, _, c, e in want)
    assert {r.label_error for r in got} == {min(most, sum(min(e, most) for *_, e in want))}


def test_blocks_and_partitions_do_not_matter(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = codes.digest(codes.compress(vectors)[1])
    monkeypatch.setattr(codes, "BLOCK", 7)
    monkeypatch.setattr(codes, "TILE", 3)
    assert codes.digest(codes.compress(vectors.repartition(5))[1]) == want


def test_empty(spark):
    vectors = spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>")
    coded, books = codes.compress(vectors)
    assert codes.with_labels(coded, books).count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        codes.compress(vectors, codes.Settings(entries=300))


def test_as_duckdb(spark, sf_dir):
    same(queries.op13_vector_codes(spark, sf_dir), queries.oracle_sql()["op13_vector_codes"], sf_dir)
