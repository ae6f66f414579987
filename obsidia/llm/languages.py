"""Languages of texts, word by word: a linear-chain conditional random field over the words of a text.

A word's features are its hashed character n-grams, its affixes, itself, and the languages whose lexicon holds it. Each feature has a
weight a language; how languages follow each other has weights too, so a text may change its language, and a word that could be of two
languages is read as its neighbours are. Forward and backward sums give each word's probabilities, exact over the whole text: a text is
taken in windows, the matrix that leads through each window is made for all windows of a batch together, windows are chained text by
text, and a second pass gives the words' probabilities from both ends of each window.

A lexicon holds a language's most frequent short words, counted over all rows that may be learned from. The weights are trained in numpy
on a bounded sample of them, on runs of words of which half are joined to a run of another text, often of another language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia.llm import common

#: A run of letters; a longer one is several words.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,39}")
#: Words of a window, words whose probabilities are made together, and words that a worker remembers before it starts anew.
WINDOW, PASS_WORDS, REMEMBERED = 64, 1 << 18, 300_000
UNKNOWN = "und"
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """sample: texts a language that are drawn for training, with longest, their characters, the bound on what the driver holds.

    lexicon: words of a language's lexicon, of lexicon_longest characters at most. run: words of a run at least and at most."""

    buckets: int = 1 << 18
    grams: tuple[int, ...] = (2, 3, 4, 5)
    affix: int = 4
    lexicon: int = 500
    lexicon_longest: int = 8
    sample: int = 300
    longest: int = 20_000
    run: tuple[int, int] = (4, 40)
    epochs: int = 5
    batch: int = 32
    rate: float = 0.3
    seed: int = 7


SETTINGS = Settings()


def words_of(text: str) -> list[str]:
    """The words of a text in lower case. A character whose lower case is longer stays, so places in the text hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return WORD.findall(low)


@dataclass
class Model:
    """weights: a row a bucket, and then one a lexicon; a column a language. step: from language to language. begin: of first words."""

    languages: list[str]
    lexicon: dict[str, int]  # bits of the languages
    weights: np.ndarray
    step: np.ndarray
    begin: np.ndarray
    settings: Settings

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words' weights, and how many each word has."""
        s = self.settings
        data = [b"<" + w.encode() + b">" for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        left = ends[owner] - np.arange(len(flat))
        rows, found = [], []

        def add(at: np.ndarray, kind: int, of: np.ndarray) -> None:
            rows.append(of)
            found.append((((at + np.uint64(kind)) * _MIX) >> np.uint64(32)) % np.uint64(s.buckets))

        hashed = np.zeros(len(flat), np.uint64)
        for n in range(1, min(len(flat), max([*s.grams, s.affix + 1])) + 1):
            hashed[: len(flat) - n + 1] = hashed[: len(flat) - n + 1] * _BASE + flat[n - 1 :]
            there = np.flatnonzero(left >= n)
            if n in s.grams:
                add(hashed[there], n, owner[there])
            if 1 < n <= s.affix + 1:  # n-grams that start with the word, and that end with it
                fits = np.flatnonzero(sizes >= n)
                add(hashed[begins[fits]], 100 + n, fits)
                add(hashed[ends[fits] - n], 200 + n, fits)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=1)), _BASE)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(flat * power[np.arange(len(flat)) - begins[owner]], dtype=np.uint64)])
        whole = (total[ends] - total[begins]) * _MIX
        add(whole, 300, np.arange(len(words)))
        held = [(i, s.buckets + j) for i, w in enumerate(words) if (bits := self.lexicon.get(w)) for j in range(len(self.languages)) if bits >> j & 1]
        if held:
            rows.append(np.array([i for i, _ in held]))
            found.append(np.array([j for _, j in held], np.uint64))
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return np.concatenate(found)[order].astype(np.int32), np.bincount(row, minlength=len(words))

    def scores(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each word's score of each language: its features' weights over the root of their number."""
        if not len(counts):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.weights[flat].astype(float), np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]


def _scaled(x: np.ndarray, axes: tuple[int, ...] = (-1,)) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def probabilities(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their probabilities, some windows at a time. scores: of all words of texts in a row; sizes: words of each text, none empty."""
    n_windows = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n_windows)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)  # within its text
    at = np.repeat(np.cumsum(sizes) - sizes, n_windows) + number * WINDOW
    size = np.minimum(WINDOW, sizes[text] - number * WINDOW)
    labels, jump, first = scores.shape[1], np.exp(step - step.max()), np.exp(begin - begin.max())
    slices = [slice(i, i + max(1, PASS_WORDS // WINDOW)) for i in range(0, len(text), max(1, PASS_WORDS // WINDOW))]

    def held(part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Potentials of the words of some windows, which of them there are, and their places."""
        place = at[part, None] + np.arange(WINDOW)
        there = np.arange(WINDOW) < size[part, None]
        x = scores[np.where(there, place, at[part, None])]
        return np.exp(x - x.max(axis=2, keepdims=True)), there, place

    through = np.empty((len(text), labels, labels))
    if len(text) > len(sizes):  # else no window follows another
        for part in slices:
            e, there, _ = held(part)
            m = np.broadcast_to(np.eye(labels), (len(e), labels, labels)).copy()
            for j in range(WINDOW):
                after = (m.reshape(-1, labels) @ jump).reshape(m.shape)
                if j == 0:
                    after = np.where((number[part] == 0)[:, None, None], first, after)
                m = np.where(there[:, j, None, None], _scaled(after * e[:, j, None, :], (1, 2)), m)
            through[part] = m
    ahead = np.full((len(text), labels), 1 / labels)  # before each window's first word
    behind = np.full((len(text), labels), 1 / labels)  # after its last
    starts = np.cumsum(n_windows) - n_windows
    for k in range(1, int(n_windows.max(initial=0))):
        w = starts[n_windows > k] + k
        ahead[w] = _scaled(np.einsum("wi,wij->wj", ahead[w - 1], through[w - 1]))
    for k in range(int(n_windows.max(initial=0)) - 1, 0, -1):
        w = starts[n_windows > k] + k
        behind[w - 1] = _scaled(np.einsum("wij,wj->wi", through[w], behind[w]))
    for part in slices:
        e, there, place = held(part)
        a, b = ahead[part], behind[part]
        out = np.empty(e.shape)
        for j in range(WINDOW):
            after = a @ jump
            if j == 0:
                after = np.where((number[part] == 0)[:, None], first, after)
            a = np.where(there[:, j, None], _scaled(after * e[:, j]), a)
            out[:, j] = a
        for j in range(WINDOW - 1, -1, -1):
            out[:, j] *= b
            b = np.where(there[:, j, None], _scaled((e[:, j] * b) @ jump.T), b)
        yield place[there], _scaled(out[there])


def _held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: the crc32 of the id as text leaves 2 when divided by 4, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    row_id = F.col(f"`{id_col}`").cast("long")
    known = docs.select(row_id.alias("learn_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~_held_out(F.col("learn_id")))


def _first(rows: DataFrame, order: list[Column], most: int, parts: int = 32) -> DataFrame:
    """Each language's first rows in an order: of each of some parts of a language first, so that no task has a language's rows."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    for keys in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = (rows.withColumn("part", part) if "part" in keys else rows).withColumn("place", place).where(F.col("place") <= most).drop("place")
    return rows.drop("part")


#: Counts of words that a task holds before it puts them out.
COUNTED = 200_000


def lexicons(docs: DataFrame, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word and rows: each language's words of lexicon_longest characters at most that most rows hold, ties by word. Over all rows to learn from."""
    longest = settings.lexicon_longest

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = {}

        def flushed() -> pa.RecordBatch:
            lang, word = zip(*held, strict=True) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(held.values(), pa.int64())], ["lang", "word", "rows"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), common.texts_of(batch), strict=True):
                for w in set(words_of(text)):
                    if len(w) <= longest:
                        held[lang, w] = held.get((lang, w), 0) + 1
                if len(held) > COUNTED:
                    yield flushed()
                    held.clear()
        yield flushed()

    common.small_batches(docs.sparkSession)
    parts = _learnable(docs, id_col, text_col, lang_col).select("lang", "text").mapInArrow(count, "lang string, word string, rows long")
    counted = parts.groupBy("lang", "word").agg(F.sum("rows").alias("rows"))
    return _first(counted, [F.desc("rows"), F.col("word")], settings.lexicon)


def training_rows(docs: DataFrame, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most settings.sample texts with letters of each language, of at most settings.longest characters, and their languages.

    Which ones is decided by a hash of the id. Of an id with several rows the least language and text count.
    """
    known = _learnable(docs, id_col, text_col, lang_col).where(F.length("text") <= settings.longest)
    drawn = _first(known.groupBy("learn_id").agg(F.min("lang").alias("lang")), [F.xxhash64("learn_id"), F.col("learn_id")], settings.sample)
    rows = known.join(F.broadcast(drawn), ["learn_id", "lang"])  # at most settings.sample ids a language
    rows = rows.groupBy("learn_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "learn_id")
    return [(r.text, r.lang) for r in rows.collect()]


def _sums(e: np.ndarray, there: np.ndarray, jump: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of short sequences' words, and of all their steps from language to language in all."""
    n, longest, labels = e.shape
    a, b = np.empty(e.shape), np.empty(e.shape)
    a[:, 0] = _scaled(first * e[:, 0])
    for j in range(1, longest):
        a[:, j] = np.where(there[:, j, None], _scaled(a[:, j - 1] @ jump * e[:, j]), a[:, j - 1])
    b[:, -1] = 1
    steps = np.zeros((labels, labels))
    for j in range(longest - 1, 0, -1):
        ahead = e[:, j] * b[:, j]
        both = a[:, j - 1, :, None] * jump * ahead[:, None, :]
        steps += (both / both.sum(axis=(1, 2), keepdims=True))[there[:, j]].sum(axis=0)
        b[:, j - 1] = np.where(there[:, j, None], _scaled(ahead @ jump.T), b[:, j])
    return _scaled(a * b), steps


def train(rows: list[tuple[str, str]], lexicon: list[tuple[str, str]], settings: Settings = SETTINGS) -> Model:
    """A model of texts and their languages, by stochastic gradient ascent of the labels' likelihood. Without rows: one of no languages."""
    s, rng = settings, np.random.default_rng(settings.seed)
    languages = sorted({lang for _, lang in rows})
    index = {lang: j for j, lang in enumerate(languages)}
    bits: dict[str, int] = {}
    for lang, word in lexicon:
        if lang in index:
            bits[word] = bits.get(word, 0) | 1 << index[lang]
    labels = len(languages)
    model = Model(languages, bits, np.zeros((s.buckets + labels, labels), np.float32), np.zeros((labels, labels)), np.zeros(labels), s)
    if labels < 2:
        return model
    lists = [words_of(t) for t, _ in rows]
    number = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
    texts = [(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), index[lang]) for ws, (_, lang) in zip(lists, rows, strict=True) if ws]
    names = list(number)
    parts = [model.features(names[i : i + 20_000]) for i in range(0, len(names), 20_000)]
    flat, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    begins = np.cumsum(counts) - counts
    seen = [np.full(x.shape, 1e-6) for x in (model.weights, model.step, model.begin)]

    def run() -> tuple[np.ndarray, np.ndarray]:
        words, label = texts[rng.integers(len(texts))]
        return cut(words, label)

    def cut(words: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
        size = int(rng.integers(s.run[0], s.run[1] + 1))
        at = int(rng.integers(max(1, len(words) - size + 1)))
        return words[at : at + size], np.full(len(words[at : at + size]), label)

    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        order = rng.permutation(len(texts))
        for start in range(0, len(order), s.batch):
            chains = []
            for i in order[start : start + s.batch]:
                words, label = cut(*texts[i])
                if rng.random() < 0.5:
                    more, other = run()
                    words, label = np.concatenate([words, more]), np.concatenate([label, other])
                chains.append((words, label))
            sizes = np.array([len(w) for w, _ in chains])
            there = np.arange(sizes.max()) < sizes[:, None]
            word, label = (np.zeros(there.shape, np.int64) for _ in range(2))
            word[there], label[there] = np.concatenate([w for w, _ in chains]), np.concatenate([x for _, x in chains])
            used, inverse = np.unique(word[there], return_inverse=True)
            n = counts[used]
            bag = flat[np.repeat(begins[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            score = np.zeros((*there.shape, labels))
            score[there] = model.scores(bag, n)[inverse]
            e = np.exp(score - score.max(axis=2, keepdims=True))
            p, steps = _sums(e, there, np.exp(model.step), np.exp(model.begin))
            want = np.eye(labels)[label]
            apart = (want - p)[there]
            by_word = np.stack([np.bincount(inverse, weights=apart[:, j], minlength=len(used)) for j in range(labels)], axis=1) / np.sqrt(n)[:, None]
            rows_, back = np.unique(bag, return_inverse=True)
            owner = np.repeat(np.arange(len(used)), n)
            slope = np.stack([np.bincount(back, weights=by_word[owner, j], minlength=len(rows_)) for j in range(labels)], axis=1)
            seen[0][rows_] += slope**2
            model.weights[rows_] += (rate * slope / np.sqrt(seen[0][rows_])).astype(np.float32)
            both = there[:, 1:]
            observed = np.zeros((labels, labels))
            np.add.at(observed, (label[:, :-1][both], label[:, 1:][both]), 1)
            for x, held, up in ((model.step, seen[1], observed - steps), (model.begin, seen[2], (want[:, 0] - p[:, 0]).sum(axis=0))):
                held += up**2
                x += rate * up / np.sqrt(held)
    return model


class Labeller:
    """Probabilities of the words of texts; remembers words' scores in bounded memory."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def _ids(self, lists: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self._forget()
        fresh = list(set().union(*lists).difference(self.number))
        found = [self.scores]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            found.append(self.model.scores(*self.model.features(part)))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
        self.scores = np.concatenate(found)
        return [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in lists]

    def words(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Each text's words' probabilities of each language."""
        sizes = np.array([len(x) for x in lists], np.int64)
        out = np.empty((sizes.sum(), len(self.model.languages)))
        for place, p in self._parts(lists, sizes):
            out[place] = p
        return np.split(out, np.cumsum(sizes)[:-1])

    def texts(self, lists: list[list[str]]) -> np.ndarray:
        """Each text's mean probability of each language; zeros without words."""
        sizes = np.array([len(x) for x in lists], np.int64)
        owner, out = np.repeat(np.arange(len(lists)), sizes), np.zeros((len(lists), len(self.model.languages)))
        for place, p in self._parts(lists, sizes):
            for j in range(p.shape[1]):
                out[:, j] += np.bincount(owner[place], weights=p[:, j], minlength=len(lists))
        return out / np.maximum(1, sizes)[:, None]

    def _parts(self, lists: list[list[str]], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if sizes.sum() and self.model.languages:
            ids = np.concatenate(self._ids(lists))
            yield from probabilities(self.scores[ids], sizes[sizes > 0], self.model.step, self.model.begin)


def _grouped(texts: list[str], most: int = PASS_WORDS * 8) -> Iterator[list[str]]:
    """Texts in runs of so many characters; a longer one by itself."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def fit(docs: DataFrame, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows that may be learned from: the lexicons from all of them, the weights from a sample."""
    held = [(r.lang, r.word) for r in lexicons(docs, settings, id_col, text_col, lang_col).collect()]  # settings.lexicon a language
    return train(training_rows(docs, settings, id_col, text_col, lang_col), held, settings)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row: the language with the highest mean probability of the text's words, and that mean.

    A null text, one without letters, and any text where no language was learned is `und` with score 0; with one language learned it
    scores 1. Equal means: the language that comes first in the alphabet. Equal and null ids and repeated rows each give a row; a null
    id counts as held out. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of the size of its buckets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = shared.value.languages
        for batch in batches:
            found, score = [], []
            for texts in _grouped(common.texts_of(batch)):
                lists = [words_of(t) for t in texts]
                for ws, p in zip(lists, labeller.texts(lists), strict=True):
                    known = bool(ws) and bool(names)
                    found.append(names[int(p.argmax())] if known else UNKNOWN)
                    score.append(min(1.0, float(p.max())) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of each row: runs of words of one language with their places in the text, in code points, and their mean probability.

    A null text or one without letters has none. Rows come as in identify().
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = shared.value.languages
        for batch in batches:
            out = []
            for texts in _grouped(common.texts_of(batch)):
                for text, p in zip(texts, labeller.words([words_of(t) for t in texts]), strict=True):
                    best = p.argmax(axis=1) if len(p) and names else np.zeros(0, np.int64)
                    place = [m.span() for m in WORD.finditer(text)]
                    edge = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)] if len(best) else []
                    out.append([{"start": place[a][0], "end": place[b - 1][1], "lang": names[best[a]], "score": float(p[a:b, best[a]].mean())} for a, b in zip(edge, edge[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPAN)], ["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,lang:string,score:double>>")
