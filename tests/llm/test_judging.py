from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidia.llm import chat, queries, rules, simhash, subword, topk
from tests.oracle import same

R = random.Random(11)
ODD = [None, "", " \n\t", "one", "a b c d e f g h " * 9, "x\n" * 30, "!!! ### $$$", "LOUD WORDS!! " * 30, " \u0085 word", "a\u000bb\u000cc\rd"]
PROSE = [" ".join(R.choices(["alpha", "beta", "gamma", "delta", "of", "the", "and", "é", "Zeta,"], k=R.randint(5, 90))) + R.choice(["", ".\nline two", "\n\nsame\nsame"]) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 4 else i, t, "x") for i, t in enumerate(ODD + PROSE)]
    return spark.createDataFrame([*rows, rows[12]], "doc_id long, text string, votes string").repartition(3)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def measured(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def by_hand_posterior(counts, asked, prior=0.9, smooth=0.5, rounds=50):
    """Expectation maximisation over votes with a class of good and one of bad documents, in arrays; a vote never counts the wrong way."""
    votes = np.array(sorted(counts))
    n = np.array([counts[tuple(v)] for v in votes.tolist()], float)
    good = 0.5 + 0.45 * votes.sum(axis=1) / np.maximum(1, np.abs(votes).sum(axis=1))

    def judged(of):
        signs = sum(np.where(of[:, j] == 1, max(0, ratio[j][2]), np.where(of[:, j] == -1, min(0, ratio[j][0]), 0.0)) for j in range(of.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds + signs, -60, 60)))

    for _ in range(rounds):
        of_class = [n * good, n * (1 - good)]
        chance = []
        for c, w in enumerate(of_class):
            seen = np.stack([((votes == v) * w[:, None]).sum(axis=0) for v in (-1, 0, 1)], axis=1) + smooth * np.array([1, 1, 2] if c == 0 else [2, 1, 1])
            chance.append(seen / seen.sum(axis=1, keepdims=True))
        ratio = np.log(chance[0] / chance[1])
        odds = np.log((of_class[0].sum() + smooth * prior) / (of_class[1].sum() + smooth * (1 - prior)))
        good = judged(votes)
    return judged(np.array(asked)).tolist()


def test_rules(docs):
    got = rules.judge(docs).collect()
    want = [(r.doc_id, *measured(r.text)) for r in docs.collect()]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(map(str, want))
    names = [c for c in got[0].__fields__ if c.startswith("vote_")]
    counts = {}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if not r.base_failed:
            counts[tuple(r[c] for c in names)] = counts.get(tuple(r[c] for c in names), 0) + 1
    want = by_hand_posterior(counts, [tuple(r[c] for c in names) for r in got])
    for r, p in zip(got, want, strict=True):
        assert abs(r.posterior - p) < 1e-9
        assert r.kept == (not r.base_failed and p >= 0.5)
    assert rules.judge(docs.where("false")).count() == 0


def test_rules_filter(docs):
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert rules.filtered(docs.where("false")).count() == 0


def test_estimates_by_hand():
    """Two good rules and one that votes at random: the random one must count for little."""
    r = random.Random(3)
    counts: dict[tuple, int] = {}
    for _ in range(4000):
        good = r.random() < 0.8
        sure = [(1 if good else -1) if r.random() < 0.9 else (-1 if good else 1) for _ in range(3)]
        p = (*sure, r.choice([-1, 1]), 0)
        counts[p] = counts.get(p, 0) + 1
    got = rules.fit(list(counts.items()))
    assert got[1, 1, 1, -1, 0] > 0.95 and got[-1, -1, -1, 1, 0] < 0.1
    assert abs(got[1, 1, -1, 1, 0] - got[1, 1, -1, -1, 0]) < 0.1
    assert rules.fit([]) == {}


def test_quality_of_rules(spark, sf_dir):
    found = rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in found if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97
    assert not bad or np.mean(bad) < 0.2  # keeping all that passes the base would give 1


def test_rules_reject_what_the_base_does_not_see(spark):
    """On labels of a table of some thousand rows: of the bad documents that pass the base nine in ten go, and hardly a good one."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = rules.judge(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = ([r.kept for r in found if r.quality == q] for q in (1, 0))
    assert len(bad) > 100 and np.mean(bad) < 0.1
    assert np.mean(good) > 0.99


def test_rules_of_clean_documents_keep_them(spark):
    """Where no document is bad, the class that is least like the others is not taken for it."""
    r = random.Random(17)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "river", "stone", "of", "the"], k=r.randint(25, 90))) + r.choice(["", "\nsame line here\nsame line here"])) for i in range(300)]
    assert rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).where("not base_failed and not kept").count() == 0


@pytest.mark.parametrize("label,settings,threshold,least", [("toxic", subword.TOXICITY, 0.5, 0.95), ("quality", subword.QUALITY, 0.3, 0.98)])
def test_held_out_accuracy(spark, label, settings, threshold, least):
    """sf0.1 has some 330 toxic labels to learn from; with the full sample held-out accuracy is over 0.99."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = subword.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, label, settings, threshold).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    y, p = np.array([r[label] for r in found if r.held_out]), np.array([r.predicted for r in found if r.held_out])
    assert (y == p).mean() > least
    assert 0 <= min(r.score for r in found) and max(r.score for r in found) <= 1


def test_classifier_edges(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = subword.classify(docs, none, "toxic", subword.TOXICITY, 0.5).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5} and all(r.held_out for r in got if r.doc_id is None)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 5), (12, 1), (12, 0), (13, 0), (14, 0), (16, 1)], "doc_id long, toxic int")
    assert subword.classify(docs, odd, "toxic", subword.TOXICITY, 0.5).count() == docs.count()
    assert subword.classify(docs.where("false"), odd, "toxic", subword.TOXICITY, 0.5).count() == 0
    assert subword.filtered(docs, odd, "toxic", subword.TOXICITY, 0.0).count() == docs.count()


def test_misspelled_words_score_high():
    r = random.Random(2)
    clean = [" ".join(r.choices(["river", "stone", "house", "light", "green", "walks"], k=30)) for _ in range(200)]
    bad = [f"{t} horrible {t}" for t in clean[:100]]
    model = subword.train(clean + bad, [0] * 200 + [1] * 100, subword.TOXICITY)
    scorer = subword.Scorer(*model, subword.TOXICITY)
    plain, spelled = scorer.score([clean[0], clean[1] + " horribble " + clean[2]])
    assert plain < 0.3 < spelled


def brute_top(vectors, asked, k):
    clean = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in clean:
        if q in asked:
            scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in clean if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("k,dims", [(10, 16), (3, 1), (500, 8)])
def test_top_k(spark, monkeypatch, k, dims):
    monkeypatch.setattr(topk, "BLOCK", 32)
    r = random.Random(dims)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.5, -0.25]) for _ in range(dims)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [None] * dims), (204, [float("nan")] * dims), (205, [float("inf")] + [0.0] * (dims - 1)), (None, rows[1][1]), (300, rows[2][1][: dims // 2])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), k).collect())
    assert got == brute_top(rows, {0, 50, 100, 200, 300}, k)
    assert topk.top_k(df.where("false"), df, k).count() == 0
    assert topk.top_k(df, df.where("false"), k).count() == 0


def test_top_k_of_long_vectors_is_exact(spark):
    big = [(i, [float(2**20 + i), float(-(2**20)), float(i * 3)]) for i in range(30)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_k(df, df.where("vec_id < 3"), 5).collect()) == brute_top(big, {0, 1, 2}, 5)


def test_preferences(spark):
    turns = [
        ("p", "chosen", 0, "user", "hi"), ("p", "chosen", 1, "assistant", "yes"), ("p", "chosen", 2, "user", "more"), ("p", "rejected", 0, "user", "hi"), ("p", "rejected", 1, "assistant", "no"),
        ("same", "chosen", 0, "user", "a"), ("same", "rejected", 0, "user", "a"), ("lone", "chosen", 0, "user", "a"),
    ]
    df = spark.createDataFrame(turns, "pair_id string, side string, at int, role string, text string")
    got = {r.pair_id: r for r in chat.preferences(df.where("side = 'chosen'"), df.where("side = 'rejected'")).collect()}
    assert set(got) == {"p", "same"}
    p = got["p"]
    assert p.prompt_turns == 1 and p.prompt == "<|user|>\nhi\n<|end|>\n"
    assert [p.chosen[s.start : s.end] for s in p.chosen_spans] == ["yes"] and [p.rejected[s.start : s.end] for s in p.rejected_spans] == ["no"]
    assert "more" in p.chosen and (got["same"].chosen, got["same"].rejected, got["same"].prompt_turns) == ("", "", 1)


def test_preferences_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, None, None, "first"), (2, 0, "assistant", "y" * 5000), (None, 0, "user", "z"), (9, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    got = {r.pair_id: r for r in chat.preferences(*chat.swapped(df)).collect()}
    assert set(got) == {1, 2}  # of the largest id the smallest is next
    assert got[1].prompt.startswith("<||>\nfirst") and got[1].rejected.count("y") == 5000
    assert got[2].chosen.count("y") == 5000 and "x" in got[2].rejected
    more = spark.createDataFrame([(i * 7, 0, "assistant", f"a{i}", "k") for i in range(40)], df.schema)
    others = {r.pair_id: r.rejected.split("\n")[1] for r in chat.preferences(*chat.swapped(more)).collect()}
    assert others == {i * 7: f"a{(i + 1) % 40}" for i in range(40)}
    assert chat.preferences(*chat.swapped(more.limit(1))).count() == 0
    assert chat.preferences(*chat.swapped(df.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_duckdb(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def test_stages_with_odd_columns(spark, sf_dir):
    """Columns with dots and with names that stages use, null texts and ids, and a text of over a million characters go through all stages."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(R.choices([f"{a}{b}" for a in ("river", "stone", "house", "light") for b in range(400)], k=170_000))
    assert len(long) > 1 << 20
    more = spark.createDataFrame([(10**6, long, "en", "src", len(long)), (None, None, None, None, None), (None, docs.first().text, "en", "src", 1)], docs.schema)
    docs = docs.limit(40).unionByName(more)
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("a.b", "row", "node", "k1", "votes", "word_chars"))])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        kept = out.collect()
        assert any(r.doc_id == 10**6 for r in kept) and {r["a.b"] for r in kept} == {0}
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir)
    assert packed.where("doc_id = 1000000").selectExpr("sum(length)").first()[0] == packed.where("doc_id = 1000000").first().doc_tokens


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def by_hand_votes(text):
    """The rules' votes, from words and lines as Python sees them."""
    w, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    n, chars, symbols, dup, repeat = measured(text)
    upper = sum(x.upper() == x and x.lower() != x and len(x) > 1 for x in w)
    twice = sum(a == b for a, b in zip(w, w[1:], strict=False))
    marked, shouts = sum(any(c in "#*$%&|<>!" for c in x) for x in w), (text or "").count("!")
    rules_of = [
        (chars > 14 * n or chars < 2 * n, 3 * n <= chars <= 10 * n), (10 * symbols > n, 50 * symbols <= n), (5 * marked > n, 50 * marked <= n), (10 * dup > 3 * len(lines), dup == 0),
        (100 * repeat > 10 * n, 100 * repeat <= 2 * n), (2 * upper > n or 2 * shouts > n, 10 * upper <= n and 20 * shouts <= n), (5 * twice > n, 20 * twice <= n), (4 * len(set(w)) < n <= 1000, 2 * len(set(w)) >= n),
    ]
    return tuple(0 if not n else -1 if bad else 1 if good else 0 for bad, good in rules_of)


def by_hand_near(rows, width=5, least=0.8):
    """Of each class of rows whose sets of shingles are similar, directly or by others, the one with the smallest id."""
    sets = [set(simhash.shingle_hashes(t, width)) for _, t in rows]
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][1] == rows[j][1] or (a or b) and len(a & b) >= least * len(a | b):
                x, y = up[i], up[j]
                up = [y if u == x else u for u in up]
    best = {}
    for u, r in zip(up, rows, strict=True):
        best[u] = min(best.get(u, r), r)
    return sorted(best.values())


def by_hand_cut(rows, size):
    """Texts without bytes of windows that start before as well, in order of ids; of a character that lost a byte nothing stays."""
    seen, out = set(), []
    for i, text in sorted(rows):
        t = text.encode()
        gone = bytearray(len(t))
        for a in range(len(t) - size + 1):
            if t[a : a + size] in seen:
                gone[a : a + size] = b"\1" * size
            seen.add(t[a : a + size])
        out.append((i, bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline_by_brute_force(spark, sf_dir):
    """run() gives what its five stages give one row at a time in plain Python."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    failed = {i: n < 20 or 100 * repeat > 30 * n for i, t in docs for n, _, _, _, repeat in [measured(t)]}
    votes = {i: by_hand_votes(t) for i, t in docs}
    counts = {}
    for i, _ in docs:
        if not failed[i]:
            counts[votes[i]] = counts.get(votes[i], 0) + 1
    good = dict(zip(votes, by_hand_posterior(counts, list(votes.values())), strict=True))
    rows = [(i, t) for i, t in docs if not failed[i] and good[i] >= 0.5]
    assert len(rows) < len(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    learned = sorted((i, t) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 5 and len(t) <= subword.QUALITY.longest)
    model = subword.train([t for _, t in learned], [labels[i] for i, _ in learned], subword.QUALITY)
    scores = subword.Scorer(*model, subword.QUALITY).score([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= corpus_pipeline.QUALITY]
    near = by_hand_near(rows)
    assert len(near) < len(rows)
    cut = by_hand_cut(near, corpus_pipeline.PASSAGE)
    assert cut != near
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want, place = [], 0
    for i, t in cut:
        ids, at = library.encode(t, add_special_tokens=False).ids + [queries.END_ID], 0
        while at < len(ids):
            sequence, offset = divmod(place + at, 2048)
            size = min(len(ids) - at, 2048 - offset)
            want.append((i, at, size, sequence, offset, ids[at : at + size]))
            at += size
        place += len(ids)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset, list(r.ids)) for r in got) == sorted(want)


def by_hand_train(texts, labels, s):
    """The training one text and one feature at a time, in plain loops: softmax over the mean of feature vectors, by steps of s.batch texts."""
    rng = np.random.default_rng(s.seed)
    grams = subword.Vocabulary(s)
    lists = [subword.words_of(t, s) for t in texts]
    names = sorted(set().union(*lists))
    whole, flat, counts = grams.grams(names)
    ends = np.cumsum(counts)
    of = {w: flat[e - n : e].tolist() for w, n, e in zip(names, counts, ends, strict=True)}
    number = {w: h for w, h in zip(names, whole, strict=True)}

    def bag(words):
        pairs = grams.pairs(np.array([number[w] for w in words])).tolist() if s.words and len(words) > 1 else []
        return [f for w in words for f in of[w]] + pairs

    share = np.mean(labels)
    weight = [(1 - s.balance) / (1 - share), s.balance / share]
    vectors = rng.normal(0, 0.1 / s.dim, (s.buckets, s.dim))
    linear, bias = rng.normal(0, 1, (s.dim, 2)), np.zeros(2)
    picked = [i for i, w in enumerate(lists) if w]
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        order = rng.permutation(len(picked))
        for first in range(0, len(order), s.batch):
            rows = [picked[j] for j in order[first : first + s.batch]]
            steps = []
            for i in rows:
                b = bag(lists[i])
                mean = sum(vectors[f] for f in b) / len(b)
                z = mean @ linear + bias
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                p[labels[i]] -= 1
                steps.append((b, mean, p * weight[labels[i]] * rate))
            back = [p @ linear.T for _, _, p in steps]
            linear = linear - sum(np.outer(m, p) for _, m, p in steps) / len(rows)
            bias = bias - sum(p for _, _, p in steps) / len(rows)
            for (b, _, _), g in zip(steps, back, strict=True):
                for f in b:
                    vectors[f] -= g / len(b)
    difference = linear[:, 1] - linear[:, 0]
    return vectors @ difference, bias[1] - bias[0]


@pytest.mark.parametrize("words", [False, True])
def test_training_by_hand(words):
    r = random.Random(6)
    texts = [" ".join(r.choices(["sun", "moon", "river", "of", "the"], k=r.randint(1, 9)) + ["awful"] * (i % 3 == 0)) for i in range(40)]
    labels = [int(i % 3 == 0) for i in range(40)]
    settings = subword.Settings(words=words, buckets=1 << 10, dim=3, epochs=3, batch=8)
    (got, bias), (want, by_hand_bias) = subword.train(texts, labels, settings), by_hand_train(texts, labels, settings)
    assert np.abs(got - want).max() < 1e-4 and abs(bias - by_hand_bias) < 1e-4


def test_words_shorter_than_the_longest_gram():
    """A worker's first texts may hold one letter alone."""
    for settings in (subword.TOXICITY, subword.QUALITY):
        model = subword.train(["a", "b", "a", "b"], [0, 1, 0, 1], settings)
        alone = subword.Scorer(*model, settings)
        assert alone.score(["a"])[0] == subword.Scorer(*model, settings).score(["a", "b c", "longer words here"])[0]


@pytest.mark.parametrize("settings", [subword.TOXICITY, subword.QUALITY])
def test_scores_by_hand(settings, monkeypatch):
    """A text's score by plain loops over its words' features, in all windows, with words forgotten meanwhile."""
    rng = np.random.default_rng(3)
    logits, bias = rng.normal(size=settings.buckets).astype(np.float32), -0.3
    texts = [t or "" for t in ODD + PROSE]
    vocabulary = subword.Vocabulary(settings)

    def plain(text):
        words = subword.words_of(text, settings)
        if not words:
            return 1 / (1 + np.exp(-bias))
        own = [vocabulary.grams([w]) for w in words]
        sums, counts = [sum(float(logits[f]) for f in g[1]) for g in own], [len(g[1]) for g in own]
        if settings.words:
            for i, f in enumerate(vocabulary.pairs(np.array([g[0][0] for g in own], np.uint64))):
                sums[i + 1] += float(logits[f])
                counts[i + 1] += 1
        w, n = settings.window or len(words), len(words)
        step = max(1, settings.window // 2)
        begins = range(0, max(1, n - w + step), step) if settings.window else [0]
        z = max(sum(sums[a : a + w]) / max(1, sum(counts[a : a + w])) for a in begins) + bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    monkeypatch.setattr(subword, "REMEMBERED", 20)
    scorer = subword.Scorer(logits, bias, settings)
    got = np.concatenate([scorer.score(texts[i : i + 7]) for i in range(0, len(texts), 7)])
    assert np.abs(got - np.array([plain(t) for t in texts])).max() < 1e-6
