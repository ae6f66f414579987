from __future__ import annotations

import ast
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from obsidia.llm import packing, pieces, simhash, suffixes, tokens
from obsidia.llm.components import components
from obsidia.llm.queries import tokenizer_path

R = random.Random(5)
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "é" * 700, "x" * 3000, "the " * 900, "<|endoftext|> a<s></s>", "ab\u0000c\u0001d", "▁x ▁", "中文 😀\tz"]
WORDS = ["".join(R.choices("abcdeé", k=R.randint(1, 7))) for _ in range(300)]
TEXTS = ODD + [" ".join(R.choices(WORDS, k=R.randint(1, 300))) for _ in range(40)]
TEXTS += [TEXTS[20], TEXTS[20], TEXTS[21][:200] + " new"]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a null, a repeat and a whole repeated row; more columns, one of them with a name that the operators use."""
    rows = [(i if i not in (3, 7) else None if i == 3 else 6, t, "en", "x", i) for i, t in enumerate(TEXTS)]
    rows.append(rows[15])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row_hash string, start int").repartition(5)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def ordered(docs):
    return sorted(pairs(docs), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))


def test_records(spark, docs, library, tmp_path):
    manifest = tokens.write_records(docs, f"file://{tmp_path}/r", tokenizer_path("word_bpe_49k.json"), 1).persist()
    found = sorted(tokens.read_records(manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, text) in zip(found, ordered(docs), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert list(r.ids) == ids
        start += len(ids)
    first = manifest.orderBy("part").first()
    assert tokens.read_at(first.file, 0)[0] == found[0].doc_id
    assert list(tokens.read_at(first.file, first.records - 1)[1]) == list(found[first.records - 1].ids)
    assert tokens.read_records(tokens.write_records(empty(docs), f"file://{tmp_path}/e", tokenizer_path("word_bpe_49k.json"), 1)).count() == 0


@pytest.mark.parametrize("slice_size,remembered", [(4_000_000, 600_000), (300, 40)])
def test_encoder_as_the_library(library, monkeypatch, slice_size, remembered):
    """Words with marks, contractions, combining characters, capitals, special tokens: in slices and with words forgotten as well."""
    monkeypatch.setattr(tokens, "SLICE", slice_size)
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    r = random.Random(31)
    parts = ["don't", "'s", "it's.", "x'sabc.", "end.'", "word", "Word", "WORD!", "a.b", "e\u0301.", "e\u0301", "\u0130X.", "I\u0307,", "\u03a3\u03a3", "na\u00efve...", "\u00c9cole,", "12.5", "3rd,", "a\u00a0b.", "m\u00ba.",
             "a\u00b5.", "\u4e2d\u6587.", "\U0001f600!", "<|endoftext|>", "<|x", "\x01", "a\x01b", "...", "'", "''", "!'t", "stra\u00dfe.", "w" * 60, "-", "a-b-", "\t", "q\tr.", "\r", "x\u0302.", "word.\u0302", "\u00c5.", "\u212b.", "A\u030a."]
    parts += ["".join(r.choices("abcde\u00e9.'", k=r.randint(1, 9))) for _ in range(200)]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randint(0, 120))) for _ in range(120)] + ["", " "]
    encoder = tokens.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    assert encoder.known
    for _ in range(2):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts, 1)]
        assert got == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    other = tokens.ChunkEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not other.known
    assert [np.frombuffer(x, other.dtype).tolist()[:-1] for x in other.encode(texts, 1)] == [e.ids for e in other.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_damage_is_seen():
    framed = tokens.frame(b"hello") + tokens.frame(b"there")

    def read(data):
        at = [0]

        def take(n):
            at[0] += n
            return data[at[0] - n : at[0]]

        return list(tokens.unframe(take, "f"))

    assert read(framed) == [b"hello", b"there"]
    for damaged in (framed[:-1], framed[:14] + b"!" + framed[15:], b"\xff" + framed[1:], framed[:5]):
        with pytest.raises(ValueError):
            read(damaged)


@pytest.mark.parametrize("length", [2048, 16])
def test_packing(docs, library, length):
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 1, length).collect()
    line = [i for _, t in ordered(docs) for i in library.encode(t, add_special_tokens=False).ids + [1]]
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in got:
        assert r.sequence_id * length + r.offset == place and r.offset + r.length <= length
        assert list(r.ids) == line[place : place + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        place += r.length
    assert place == len(line)
    assert packing.pack(empty(docs), tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_pieces(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(i, len(ids), ids, library.decode(ids)) for i, t in pairs(docs) for ids in [library.encode(t)]], key=key)
    got = sorted([(r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")).collect()], key=key)
    assert sorted(map(str, got)) == sorted(map(str, want))
    digests = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), digests=True).collect()}
    assert digests == {(i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, _, ids, d in want}
    assert pieces.encode_decode(empty(docs), tokenizer_path("piece_bpe_32k.model")).count() == 0


def brute_repeats(texts, size):
    seen = {}
    for _, t in texts:
        for a in range(len(t) - size + 1):
            seen[t[a : a + size]] = seen.get(t[a : a + size], 0) + 1
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for a in range(len(t) - size + 1):
            if seen[t[a : a + size]] > 1:
                gone[a : a + size] = [True] * size
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [40, 400])
def test_repeats(docs, size):
    got = suffixes.digests(docs, size).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats([(i, t.encode()) for i, t in pairs(docs)], size)
    assert suffixes.digests(empty(docs), size).count() == 0


def test_hot_repeats(docs, monkeypatch):
    """Anchors with too many occurrences for one scan are split and give the same."""
    monkeypatch.setattr(suffixes, "PART_ROWS", 2)
    found = suffixes.Repeats(docs, 40)
    assert found.hot
    got = suffixes.digests(docs, 40).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats([(i, t.encode()) for i, t in pairs(docs)], 40)


def overlapping(spark):
    """Texts that share passages about as long as both lengths, many of them by frequent anchors, and by parts of each other."""
    r = random.Random(9)
    some = lambda n: "".join(r.choices("abcdé ", k=n))
    base = some(120)
    rows = [(i, some(r.randint(0, 60)) + base[r.randint(0, 60) : r.randint(60, 120)] + some(r.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, base[: r.randint(30, 90)] * r.randint(1, 3) + some(20)) for i in range(20)] + [(200, base), (201, base), (202, base[:30]), (203, base[:30]), (None, None), (204, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("rows", [suffixes.PART_ROWS, 8, 2])
@pytest.mark.parametrize("shorter", [24, 39])
def test_two_lengths_of_one_scan(spark, docs, monkeypatch, rows, shorter):
    monkeypatch.setattr(suffixes, "PART_ROWS", rows)
    for df in (overlapping(spark), docs):
        texts = [(i, t.encode()) for i, t in pairs(df)]
        got = suffixes.digests(df, 40, shorter=shorter).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == brute_repeats(texts, 40)
        want = sorted((str(i), n, gone, spans) for i, n, gone, spans in ((x[0], *x[1:4]) for x in map(ast.literal_eval, brute_repeats(texts, shorter))))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_repeated, r.n_repeated_spans) for r in got) == want


def test_lengths_that_can_not_be(docs):
    for shorter in (40, 50, 7):
        with pytest.raises(ValueError):
            suffixes.digests(docs, 40, shorter=shorter)


def shuffled(spark, make):
    """Bytes that Spark's exchanges write while make() runs, and what it gives."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        each = context.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before, out = written(), make()
    return written() - before, out


def test_hot_repeats_deal_texts_once(spark, monkeypatch):
    """Whole texts are dealt out as often with anchors that are too many for one scan as without, and the cuts are the same."""
    r = random.Random(5)
    some = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = some(90)
    rows = [(i, some(r.randint(0, 9000)) + passage + some(9000)) for i in range(150)]
    rows += [(i + 1000, t) for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    df.count()
    run = lambda: sorted(map(tuple, suffixes.digests(df, 40).collect()))
    plain, want = shuffled(spark, run)
    monkeypatch.setattr(suffixes, "PART_ROWS", 100)
    assert suffixes.Repeats(df, 40).hot
    hot, got = shuffled(spark, run)
    assert got == want and all(x[2] >= 90 for x in got)
    assert hot < 1.2 * plain, (hot, plain)


def test_repeat_groups(spark):
    """Maximal repeats with all their occurrences: three texts share a passage and two of them more."""
    core, more = "".join(R.choices("abcdefgh", k=60)), "".join(R.choices("ijkl", k=30))
    rows = [(0, "1" * 20 + core + more + "2" * 9), (1, "3" * 9 + core + more + "4" * 20), (2, "5" * 15 + core + "6" * 9)]
    parts = suffixes.Repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40).parts().collect()
    spans = {(r.row_id, s, s + r.length) for r in parts for s in r.starts}
    assert {r.row_id for r in parts} == {0, 1, 2}
    text = dict(rows)
    for r in parts:
        assert len({text[q.row_id][s : s + q.length] for q in parts if q.repeat_id == r.repeat_id for s in q.starts}) == 1
    assert max(e - s for i, s, e in spans if i == 2) <= 60


@pytest.mark.parametrize("hot", [False, True])
def test_repeat_groups_are_whole(spark, monkeypatch, hot):
    """Each group of equal strings that can't be longer, with all of its occurrences, also within longer repeats and of frequent anchors."""
    if hot:
        monkeypatch.setattr(suffixes, "PART_ROWS", 1)
    r = random.Random(4)
    some = lambda n: "".join(r.choices("abcdefgh", k=n))
    core, more, twice = some(60), some(30), some(50)
    rows = [(0, some(20) + core + more + some(9)), (1, some(9) + core + more + some(20)), (2, some(15) + core + some(9)), (3, some(9) + twice + "x" + twice), (4, core[20:] + some(30))]
    found = suffixes.Repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40)
    assert found.hot == hot
    text = dict(rows)
    groups = {}
    for p in found.parts().collect():
        for s in p.starts:
            groups.setdefault((p.repeat_id, p.length), set()).add((p.row_id, s))
    want = {}
    for i, t in rows:
        for s in range(len(t) - 39):
            want.setdefault(t[s : s + 40], set()).add((i, s))
    want = {w: at for w, at in want.items() if len(at) > 1}
    covered = {}
    for (_, n), at in groups.items():
        ((string),) = {text[i][s : s + n] for i, s in at}
        assert at == {(i, s) for i, t in rows for s in range(len(t)) if t.startswith(string, s)}
        for k in range(n - 39):
            covered.setdefault(string[k : k + 40], set()).update((i, s + k) for i, s in at)
    assert covered == want


def test_copies_are_one_text(spark):
    """Copies, of one id or of many, are one text with no places of its own, and are still copies of each other."""
    text = "".join(R.choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(None, text)] * 15 + [(i, text) for i in range(2, 17)] + [(1, "x" * 20)], "doc_id long, text string")
    found = suffixes.Repeats(df, 40)
    assert found.places.count() == 0
    whole = found.parts().collect()
    assert len(whole) == 30 and {(r.length, *r.starts) for r in whole} == {(300, 0)}
    kept = {(r.doc_id, r.text) for r in suffixes.cleaned(df, 40).collect()}
    assert kept == {(None, text), (1, "x" * 20), *((i, "") for i in range(2, 17))}
    got = suffixes.digests(df, 40).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(20, 0)] + [(300, 300)] * 30


def test_long_texts_have_each_anchor_once(monkeypatch):
    """Pieces of a long text give the same anchors and windows as the text in one go."""
    texts = [bytes(R.choices(b"abcdefgh", k=n)) for n in (5000, 30, 700, 256)] + [b"ab" * 600]
    whole = [x for part in suffixes.anchors_of(texts, 40, 10) for x in zip(*(c.tolist() for c in part), strict=True)]
    monkeypatch.setattr(suffixes, "SEGMENT", 256)
    cut = [x for part in suffixes.anchors_of(texts, 40, 10) for x in zip(*(c.tolist() for c in part), strict=True)]
    assert cut == whole
    assert len({(t, place) for t, _, place, _, _ in cut}) == len(cut)


def test_long_text_without_repeats_stays(spark):
    text = random.Random(11).randbytes(1_400_000).hex()
    (row,) = suffixes.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), 400).collect()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (2_800_000, 0, 0)


def test_cleaned_keeps_first(spark):
    passage = "".join(R.choices("abcdefgh ", k=300))
    rows = [(2, "two " + passage, 0), (1, "one " + passage, 0), (3, "three", 0), (None, None, None)]
    out = {r.doc_id: r for r in suffixes.cleaned(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), 200).collect()}
    assert out[1].text == "one " + passage and out[2].text.startswith("two") and len(out[2].text) < 10
    assert out[2].n_chars == len(out[2].text) and out[None].text == ""


def brute_first(rows, size):
    """What stays if each window but the first of its kind goes, by row and place."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        gone = [False] * len(t)
        for a in range(len(t) - size + 1):
            if t[a : a + size] in seen:
                gone[a : a + size] = [True] * size
            seen.add(t[a : a + size])
        out[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_cleaned_keeps_first_alone(spark, monkeypatch, hot):
    """One occurrence of a passage stays, also if some of its rows share more of it or a longer one, or one row has it twice."""
    if hot:
        monkeypatch.setattr(suffixes, "PART_ROWS", 2)
    r = random.Random(3)
    some = lambda n: "".join(r.choices("abcdefgh", k=n))
    core, long = some(90), some(70)
    rows = [(i, some(r.randint(5, 60)) + core + some(r.randint(0, 3)) + some(30)) for i in range(24)]
    rows += [(30, "0" + core + "x1"), (31, "2" + core + "x3"), (32, "2" + core + "x4")]
    rows += [(40, some(9) + long + core + some(9)), (41, some(9) + long + core + some(9) + core), (42, long + some(20)), (43, long + core)]
    r.shuffle(rows)
    got = {x.doc_id: x.text for x in suffixes.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40).collect()}
    assert got == brute_first(rows, 40)


def by_hand_fingerprint(text, width):
    words = [w.encode() for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(docs):
    rows = [(i, by_hand_fingerprint(t, 4)) for i, t in pairs(docs)]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                x, y = up[a], up[b]
                up = [y if u == x else u for u in up]
    least = {u: min((rows[i][0] for i in range(len(rows)) if up[i] == u and rows[i][0] is not None), default=None) for u in up}
    want = sorted((str(i), f"{f:016x}", str(least[up[n]])) for n, (i, f) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("limit", [4_000_000, 20_000])
def test_links_by_brute_force(spark, monkeypatch, limit):
    """Chains and close groups among random fingerprints; small blocks are dealt out by more bits."""
    monkeypatch.setattr(simhash, "VARIANTS", limit)
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(160):
        x = r.choice(prints)
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in prints})
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]

    def classes(edges):
        up = {p: p for p in prints}
        for a, b in edges:
            x, y = up[a], up[b]
            if x != y:
                up = {p: min(x, y) if u in (x, y) else u for p, u in up.items()}
        return up

    df = spark.createDataFrame([(0, p) for p in prints], "family int, fingerprint long")
    for rows in (16_384, 4):
        monkeypatch.setattr(simhash, "PREFIX_ROWS", rows)
        found = [(e.a, e.b) for e in simhash.links(df, 4).collect()]
        assert classes(found) == classes(near)
    root = {r.node: r.root for r in components(df.sparkSession.createDataFrame(near, "a long, b long")).collect()}
    assert {p: root.get(p, p) for p in prints} == classes(near)


def test_first_of_each(spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:150] + ["changed"] + words[151:]
    rows = [(5, " ".join(words), "a"), (2, " ".join(near), "b"), (9, " ".join(words), "c"), (9, " ".join(words), "c"), (7, "other text", "d"), (None, None, "e"), (None, "", "f")]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "7", "None"]
    assert kept[0].__fields__ == ["doc_id", "text", "node"]


def by_hand_jaccard(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def together(spark, texts, pairs):
    """Which of the pairs of texts near_texts puts in one class."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    node = {r.doc_id: r.node for r in df.selectExpr("doc_id", "xxhash64(text) node").collect()}
    root = {r.node: r.root for r in simhash.near_texts(df).collect()}
    return [root.get(node[a], node[a]) == root.get(node[b], node[b]) for a, b in pairs]


def test_long_texts_by_whole_sets(spark):
    """Near the limit the shingles of long texts decide, not a sample of them."""
    r = random.Random(6)
    texts = []
    for k in range(40):
        words = [f"v{r.randrange(10**6)}" for _ in range(1500)]
        texts += [" ".join(words), " ".join(words[: 1178 + 2 * k - 16])]
    pairs = [(i, i + 1) for i in range(0, 80, 2)]
    similar = [by_hand_jaccard(texts[a], texts[b]) >= 0.8 for a, b in pairs]
    assert 10 < sum(similar) < 30
    sketch = [np.unique(np.array(simhash.shingle_hashes(t, 5), np.uint64) >> np.uint64(32)).astype("<u4")[:256] for t in texts]
    assert [simhash.similarity(sketch[a], sketch[b]) >= 0.8 for a, b in pairs] != similar
    df = spark.createDataFrame([(i, t, sketch[i].tobytes()) for i, t in enumerate(texts)], "node long, text string, sketch binary")
    found = simhash._verified(spark.createDataFrame(pairs, "x long, y long"), df, df, 5, 0.8).collect()
    assert sorted((p.x, p.y) for p in found) == [p for p, ok in zip(pairs, similar, strict=True) if ok]


def test_cut_and_extended_copies_meet(spark):
    """Copies at 0.8 to 0.9 are found whether they lack the end, go on, or have other words."""
    r = random.Random(9)
    texts = []
    for k in range(90):
        words = [f"v{r.randrange(3000)}" for _ in range(r.randint(60, 400))]
        n = len(words)
        cut = words[: n - n // 8]
        more = words + [f"v{r.randrange(3000)}" for _ in range(n // 7)]
        other = [f"u{i}" if i % 70 == 35 else w for i, w in enumerate(words)]
        texts += [" ".join(words), " ".join((cut, more, other)[k % 3])]
    pairs = [(i, i + 1) for i in range(0, 180, 2)]
    assert all(0.8 <= by_hand_jaccard(texts[a], texts[b]) < 0.96 for a, b in pairs)
    assert all(together(spark, texts, pairs))


@pytest.mark.parametrize("group,block", [(32, 256), (2, 256), (2, 3)])
def test_similar_texts_beside_one_that_is_not(spark, monkeypatch, group, block):
    """Texts of the same words are compared with each other too, not just with the first of them."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(12)
    words = [f"v{i}" for i in range(120)]
    swapped = [*words[:60], words[61], words[60], *words[62:]]
    texts = [" ".join(words), " ".join(swapped)] + [" ".join(r.sample(words, 120)) for _ in range(20)]
    # A chain: each shares 0.8 or more with the next, its ends do not.
    base = [f"c{i}" for i in range(400)]
    texts += [" ".join(base[12 * k : 12 * k + 200]) for k in range(8)]
    got = together(spark, texts, [(0, 1), (0, 2), (22, 29), *((k, k + 1) for k in range(22, 29))])
    assert by_hand_jaccard(texts[0], texts[1]) >= 0.8 > by_hand_jaccard(texts[22], texts[29])
    assert got == [True, False, True] + [True] * 7


def test_classes_do_not_depend_on_settings(spark, monkeypatch):
    """The classes are those of all pairs that share a key and are similar, however many partitions and prefixes part them, by groups of any size."""
    r = random.Random(21)
    texts = []
    for k in range(12):
        words = [f"w{r.randrange(60)}x{k % 3}" for _ in range(r.randint(80, 160))]
        for _ in range(8):
            n = len(words)
            start = r.randrange(n // 12)
            texts.append(" ".join(w if r.random() > 0.002 * k else f"y{r.randrange(99)}" for w in words[start : n - r.randrange(n // 12)]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, rows, group, block in ((4, 16_384, 32, 256), (51, 4, 32, 256), (3, 64, 3, 4)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            for name, value in (("PREFIX_ROWS", rows), ("GROUP", group), ("BLOCK", block)):
                monkeypatch.setattr(simhash, name, value)
            found.append(sorted((x.node, x.root) for x in simhash.near_texts(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    node = {x.doc_id: x.node for x in df.selectExpr("doc_id", "xxhash64(text) node").collect()}
    root = dict(found[0])
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if by_hand_jaccard(texts[a], texts[b]) >= 0.8]
    assert len(pairs) > 60
    together = [root.get(node[a], node[a]) == root.get(node[b], node[b]) for a, b in pairs]
    assert sum(together) >= 0.98 * len(pairs)


@pytest.mark.parametrize("few", [500_000, 0, 40])
def test_components_edges(spark, monkeypatch, few):
    monkeypatch.setattr("obsidia.llm.components.FEW", few)
    rows = [(1, 2), (2, 3), (3, 1), (5, 5), (None, 1), (7, 6), (1, 2)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 7: 6} | {i: 100 for i in range(101, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_tokenizer_files_in_the_repository():
    for folder, _, names in os.walk(os.path.dirname(os.path.dirname(os.path.dirname(__file__)))):
        assert ".git" in folder or not [n for n in names if n.endswith((".model", ".tiktoken"))]


def test_pieces_that_are_forgotten_and_texts_beyond_a_slice(docs, monkeypatch):
    """With few chunks remembered and short slices, texts come out as the library has them."""
    import sentencepiece

    monkeypatch.setattr(pieces, "SLICE", 300)
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    r = random.Random(12)
    texts = [t for _, t in pairs(docs)] + ["".join(r.choices(["a", "b ", "é", " ", "\n", "日本 ", "the ", "7", "  ", "▁", "\t"], k=r.randint(0, 250))) for _ in range(200)] + ["one two " * 200, "x" * 700]
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    table = pieces.PrefixTable(path)
    got = [(n, [int(x) for x in shown.split(b",") if x], plain.removeprefix(b" ").decode("utf-8", "replace")) for n, shown, plain in table.coded(texts)]
    want = [(len(ids), ids, library.decode(ids)) for ids in map(library.encode, texts)]
    assert got == want and len(table.known) <= 40
