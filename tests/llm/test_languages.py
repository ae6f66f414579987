from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from obsidia.llm import common, languages, queries
from obsidia.llm.languages import Labeller, Model, Settings, words_of


def by_hand(scores, step, begin):
    """Probabilities of each word's language, over all ways to label a text."""
    n, k = scores.shape
    out = np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n):
        s = begin[ys[0]] + sum(scores[i, y] for i, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False))
        for i, y in enumerate(ys):
            out[i, y] += math.exp(s)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("held", [6, 1 << 18])
def test_windows_are_exact(monkeypatch, held):
    monkeypatch.setattr(languages, "WINDOW", 3)
    monkeypatch.setattr(languages, "PASS_WORDS", held)
    rng = np.random.default_rng(1)
    sizes = np.array([1, 7, 3, 4, 8, 2])
    scores, step, begin = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = np.zeros_like(scores)
    for place, p in languages.probabilities(scores, sizes, step, begin):
        got[place] = p
    want = np.concatenate([by_hand(x, step, begin) for x in np.split(scores, np.cumsum(sizes)[:-1])])
    assert np.abs(got - want).max() < 1e-12


def test_slopes():
    """The sums that training goes by are those of all labellings, also where sequences have unequal lengths."""
    rng = np.random.default_rng(2)
    sizes, k = [4, 1, 6], 3
    step, begin = rng.normal(size=(k, k)), rng.normal(size=k)
    there = np.arange(6) < np.array(sizes)[:, None]
    scores = rng.normal(size=(3, 6, k))
    p, steps = languages._sums(np.exp(scores), there, np.exp(step), np.exp(begin))
    want = np.zeros((k, k))
    for i, n in enumerate(sizes):
        assert np.abs(p[i, :n] - by_hand(scores[i, :n], step, begin)).max() < 1e-12
        total, each = 0.0, np.zeros((k, k))
        for ys in itertools.product(range(k), repeat=n):
            w = math.exp(begin[ys[0]] + sum(scores[i, j, y] for j, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += w
            for a, b in zip(ys, ys[1:], strict=False):
                each[a, b] += w
        want += each / total
    assert np.abs(steps - want).max() < 1e-10


def test_features_by_hand():
    model = Model(["a", "b"], {"the": 1, "été": 3}, np.zeros((8, 2), np.float32), np.zeros((2, 2)), np.zeros(2), Settings())
    words = ["a", "the", "été", "x" * 40, "the"]
    flat, counts = model.features(words)
    base, mix, mask = 0x100000001B3, 0x9E3779B97F4A7C15, (1 << 64) - 1
    bucket = lambda h, kind: ((((h + kind) & mask) * mix & mask) >> 32) % (1 << 18)

    def hashed(b):
        h = 0
        for x in b:
            h = (h * base + x + 1) & mask
        return h

    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        data = b"<" + w.encode() + b">"
        want = [bucket(hashed(data[i : i + k]), k) for k in (2, 3, 4, 5) for i in range(len(data) - k + 1)]
        want += [bucket(hashed(part), kind + k) for k in (2, 3, 4, 5) if len(data) >= k for kind, part in ((100, data[:k]), (200, data[-k:]))]
        want += [bucket(sum((x + 1) * pow(base, i, 1 << 64) for i, x in enumerate(data)) * mix & mask, 300)]
        want += [(1 << 18) + j for j in range(2) if model.lexicon.get(w, 0) >> j & 1]
        assert sorted(flat[at : at + n].tolist()) == sorted(want)
        at += n


def test_words():
    assert words_of("The Été's 12² x_y ÇA!") == ["the", "été", "s", "x", "y", "ça"]
    assert words_of("İstanbul") == ["i̇stanbul"] or words_of("İstanbul") == ["İstanbul"]
    assert [len(w) for w in words_of("a" * 100)] == [40, 40, 20]
    assert words_of("12 ½ ² ... 日本") == ["日本"]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return languages.fit(common.documents(spark, sf_dir))


def test_held_out(spark, sf_dir, model):
    docs = {r.doc_id: r for r in common.documents(spark, sf_dir).collect()}
    rows = languages.identify(common.documents(spark, sf_dir), model).collect()
    assert len(rows) == len(docs)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert len(right) > 30 and sum(right) / len(right) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_nothing_of_held_out_rows_is_learned(spark, sf_dir, model):
    docs = common.documents(spark, sf_dir)
    changed = docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'zz qq' ELSE text END AS text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    again = languages.fit(changed)
    assert again.languages == model.languages and (again.weights == model.weights).all() and again.lexicon == model.lexicon


def test_labeller_by_plain_loops(spark, sf_dir, model, monkeypatch):
    """Word by word, one text at a time, without windows; with words forgotten and texts parted."""
    texts = [r.text for r in common.documents(spark, sf_dir).orderBy("doc_id").limit(60).collect()] + ["", "12 34", "mot", "the " * 500]

    def plain(text):
        ws = words_of(text)
        if not ws:
            return np.zeros(len(model.languages))
        x = np.array([[sum(float(model.weights[f, j]) for f in model.features([w])[0]) for j in range(len(model.languages))] / np.sqrt(len(model.features([w])[0])) for w in ws])
        jump, ahead = np.exp(model.step), [np.exp(model.begin) * np.exp(x[0])]
        for e in np.exp(x[1:]):
            a = ahead[-1] @ jump * e
            ahead.append(a / a.sum())
        behind = [np.ones(x.shape[1])]
        for e in np.exp(x[:0:-1]):
            b = jump @ (e * behind[-1])
            behind.append(b / b.sum())
        p = np.array(ahead) * np.array(behind[::-1])
        return (p / p.sum(axis=1, keepdims=True)).mean(axis=0)

    monkeypatch.setattr(languages, "REMEMBERED", 100)
    labeller = Labeller(model)
    some = texts[:12] + texts[-4:]
    got = np.concatenate([labeller.texts([words_of(t) for t in part]) for part in languages._grouped(some, 5000)])
    assert np.abs(got - np.array([plain(t) for t in some])).max() < 1e-6


def test_mixed_text(spark, sf_dir, model):
    """Half of the words of one held-out text, then half of another's in another language."""
    held = [r for r in common.documents(spark, sf_dir).orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang in model.languages and len(words_of(r.text)) > 60]
    rng, right, total = random.Random(5), 0, 0
    rows = []
    for i in range(40):
        a, b = rng.sample(held, 2)
        rows.append((i, " ".join(words_of(a.text)[:40]) + ", " + " ".join(words_of(b.text)[:40]), a.lang, b.lang))
    got = {r.doc_id: r.spans for r in languages.spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    for i, text, first, second in rows:
        edge = len(" ".join(words_of(text)[:40]))
        for m in languages.WORD.finditer(text):
            (span,) = [s for s in got[i] if s.start <= m.start() < s.end]
            right += span.lang == (first if m.start() < edge else second)
            total += 1
    assert right / total > 0.9


def test_odd_rows(spark, model):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 ²½ ***", "en", 1), (None, "the of and", None, 1), (1, "la de les que", "x", 2), (1, "la de les que", "x", 2), (9, "the of and " * 100_000, "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = languages.identify(docs, model).collect()
    assert sorted(r.lang_pred for r in got) == sorted(["und"] * 3 + ["en", "en", "fr", "fr"])
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and all(r.held_out for r in got if r.doc_id is None)
    assert [r.spans for r in languages.spans(docs.where("doc_id in (2, 3)"), model).collect()] == [[], []]
    nothing = languages.fit(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in languages.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert languages.identify(docs.where("false"), model).count() == 0
    one = languages.fit(spark.createDataFrame([(i, "the of", "en") for i in range(8)], "doc_id long, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in languages.identify(docs.where("doc_id = 9"), one).collect()} == {("en", 1.0)}


def test_lexicons_by_hand(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    got = {}
    for r in languages.lexicons(docs, Settings(lexicon=30)).collect():
        got.setdefault(r.lang, []).append((r.word, r.rows))
    want = {}
    for r in docs.collect():
        if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in {w for w in words_of(r.text) if len(w) <= 8}:
                want.setdefault(r.lang, {}).setdefault(w, 0)
                want[r.lang][w] += 1
    for lang, words in want.items():
        assert sorted(got[lang], key=lambda x: (-x[1], x[0].encode())) == sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[:30]


def test_query(spark, sf_dir):
    rows = queries.op11_language_crf(spark, sf_dir)
    assert rows.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and rows.count() == common.documents(spark, sf_dir).count()
