"""Subword-bag classifiers: hashed n-gram vectors, averaged, into a linear softmax, trained jointly in numpy.

A text's features are its words' hashed character n-grams, and for quality also words and pairs of neighbouring words. Each feature
has a learned vector; their mean goes through a learned linear layer and a softmax over two classes. As both are linear, a trained
feature is one number, its vector's difference in logits; a word's features are summed once and remembered.

With a window, the mean is taken over windows of so many words and a text's score is its highest window's: a few insults in a long
text are not averaged away. Training then takes of each positive text the window that scores highest so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Words that a worker remembers before it starts anew.
REMEMBERED = 300_000
_BASE = np.uint64(0x100000001B3)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """whole: epochs in which positive texts are taken whole, before windows. balance: weight of class 1.

    sample: labelled texts a class that are drawn for training, the bound on what the driver holds, with longest: their characters."""

    lower: bool = True
    words: bool = False
    window: int = 0
    buckets: int = 1 << 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 6
    rate: float = 0.5
    batch: int = 64
    sample: int = 1500
    longest: int = 20_000
    balance: float = 0.5
    whole: int = 1
    seed: int = 7


@dataclass
class Vocabulary:
    """Features of words: for each word its hash and its hashed n-grams."""

    settings: Settings
    number: dict[str, int] = field(default_factory=dict)

    def grams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of each word; the buckets of all words' features, and how many each word has."""
        data = [b"<" + w.encode() + b">" for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        left = ends[owner] - np.arange(len(flat))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=1)), _BASE)]))
        within = np.arange(len(flat)) - begins[owner]
        total = np.cumsum(flat * power[within], dtype=np.uint64)
        before = np.concatenate([[np.uint64(0)], total])
        whole = (before[ends] - before[begins] + sizes.astype(np.uint64)) * _PAIR
        rows, buckets = [], []
        hashed = np.zeros(len(flat), np.uint64)
        for n in range(1, min(len(flat), max(self.settings.grams)) + 1):
            hashed[: len(flat) - n + 1] = hashed[: len(flat) - n + 1] * _BASE + flat[n - 1 :]
            if n in self.settings.grams:
                there = np.flatnonzero(left >= n)
                rows.append(owner[there])
                buckets.append(((hashed[there] + np.uint64(n)) * _PAIR >> np.uint64(40)) % np.uint64(self.settings.buckets))
        if self.settings.words:
            rows.append(np.arange(len(words)))
            buckets.append((whole >> np.uint64(40)) % np.uint64(self.settings.buckets))
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return whole, np.concatenate(buckets)[order].astype(np.int32), np.bincount(row, minlength=len(words))

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """The buckets of neighbouring words. A word that repeats the one before is written as a mark, so all repeats share a feature."""
        a, b = hashes[:-1], hashes[1:]
        mixed = np.where(a == b, np.uint64(1), (a * np.uint64(3) ^ b) * _PAIR)
        return ((mixed >> np.uint64(40)) % np.uint64(self.settings.buckets)).astype(np.int32)


def words_of(text: str, settings: Settings) -> list[str]:
    return (text.lower() if settings.lower else text).split()


def windows(sums: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a text's words, each half over the one before: first word, end and mean. A text that fits is one window."""
    n, step = len(sums), max(1, window // 2)
    at = np.arange(0, max(1, n - window + step), step) if window else np.zeros(1, np.int64)
    end = np.minimum(at + window, n) if window else np.array([n])
    t, c = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    return at, end, (t[end] - t[at]) / np.maximum(1, c[end] - c[at])


def train(texts: list[str], labels: list[int], settings: Settings) -> tuple[np.ndarray, float]:
    """One number a bucket and the bias: the difference of the two classes' logits. Without both classes: zeros, and the sure class's sign."""
    if len(set(labels)) < 2:
        return np.zeros(settings.buckets, np.float32), 0.0 if not labels else 8.0 if labels[0] else -8.0
    s, rng = settings, np.random.default_rng(settings.seed)
    vocabulary = Vocabulary(s)
    lists = [words_of(t, s) for t in texts]
    number = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
    ids = [np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)) for ws in lists]
    del lists
    names = list(number)
    parts = [vocabulary.grams(names[i : i + 20_000]) for i in range(0, len(names), 20_000)]  # bounds what is held besides the result
    whole, flat, counts = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    del names, number
    begins = np.cumsum(counts) - counts
    target = np.array(labels)
    share = target.mean()
    weight = np.where(target == 1, s.balance / share, (1 - s.balance) / (1 - share))
    vectors = rng.normal(0, 0.1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    linear = rng.normal(0, 1, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)

    def features(words: np.ndarray) -> np.ndarray:
        n = counts[words]
        own = flat[np.repeat(begins[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.concatenate([own, vocabulary.pairs(whole[words])]) if s.words and len(words) > 1 else own

    def best(words: np.ndarray, sums: np.ndarray) -> np.ndarray:
        at, end, mean = windows(sums[words], counts[words], s.window)
        i = int(mean.argmax())
        return words[at[i] : end[i]]

    del parts
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        picked = [(i, w) for i, w in enumerate(ids) if len(w)]
        if s.window:
            sums = np.add.reduceat((vectors @ (linear[:, 1] - linear[:, 0]))[flat], begins) if len(flat) else np.zeros(0)
            positive = [(i, best(w, sums) if epoch >= s.whole else w) for i, w in picked if target[i]]
            negative = [(i, w) for i, w in picked if not target[i]]
            starts = [int(rng.integers(max(1, len(w) - s.window + 1))) for _, w in negative]
            picked = positive + [(i, best(w, sums)) for i, w in negative] + [(i, w[a : a + s.window]) for (i, w), a in zip(negative, starts, strict=True)]
        order = rng.permutation(len(picked))
        for first in range(0, len(order), s.batch):
            rows = [picked[j] for j in order[first : first + s.batch]]
            owner = [i for i, _ in rows]
            bags = [features(w) for _, w in rows]
            rows, owner, bags = zip(*[(r, o, x) for r, o, x in zip(rows, owner, bags, strict=True) if len(x)], strict=True) if any(map(len, bags)) else ((), (), ())
            if not bags:
                continue
            n = np.array([len(x) for x in bags])
            bag = np.concatenate(bags)
            mean = np.add.reduceat(vectors[bag], np.cumsum(n) - n, axis=0) / n[:, None]
            z = mean @ linear + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            own = list(owner)
            p[np.arange(len(rows)), target[own]] -= 1
            p *= weight[own][:, None] * rate
            back = p @ linear.T
            linear -= mean.T @ p / len(rows)
            bias -= p.mean(axis=0)
            used, inverse = np.unique(bag, return_inverse=True)
            each = back / n[:, None]
            row = np.repeat(np.arange(len(rows)), n)
            for d in range(s.dim):
                vectors[used, d] -= np.bincount(inverse, weights=each[row, d], minlength=len(used))
    difference = linear[:, 1] - linear[:, 0]
    return (vectors @ difference).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a trained model; remembers words' sums in bounded memory."""

    def __init__(self, logits: np.ndarray, bias: float, settings: Settings):
        self.logits, self.bias, self.settings = logits, bias, settings
        self.vocabulary = Vocabulary(settings)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.hash, self.sum, self.count = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        whole, flat, counts = self.vocabulary.grams(words)
        sums = np.add.reduceat(np.append(self.logits[flat], np.float32(0)).astype(float), np.cumsum(counts) - counts)
        sums[counts == 0] = 0
        for w in words:
            self.number[w] = len(self.number)
        self.hash, self.sum, self.count = np.concatenate([self.hash, whole]), np.concatenate([self.sum, sums]), np.concatenate([self.count, counts])

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of class 1; of a text without words, the bias's alone."""
        s = self.settings
        lists = [words_of(t, s) for t in texts]
        if len(self.number) > REMEMBERED:
            self._forget()
        fresh = list(set().union(*lists).difference(self.number))
        for at in range(0, len(fresh), 20_000):
            self._learn(fresh[at : at + 20_000])
        out = np.zeros(len(texts))
        for i, words in enumerate(lists):
            if not words:
                out[i] = self.bias
                continue
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            total, count = self.sum[ids], self.count[ids]
            if s.words and len(ids) > 1:
                total, count = total.copy(), count.astype(float)
                total[1:] += self.logits[self.vocabulary.pairs(self.hash[ids])]
                count[1:] += 1
            out[i] = windows(total, count, s.window)[2].max() + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: the crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most settings.sample labelled texts of each class, of at most settings.longest characters, that are not held out.

    Which ones is decided by a hash of the id. Labels other than 0 and 1 and null ids are left out; an id with several labels counts by
    its largest. Texts come to the driver: their number and length are bounded by the settings.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("label_id")).agg(F.max(label).alias("y"))
    known = known.where(~held_out(F.col("label_id"))).withColumn("order", F.xxhash64("label_id"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(F.length("text") <= settings.longest)
    there = known.join(texts.select("label_id"), "label_id", "left_semi")
    drawn = [there.where(F.col("y") == y).orderBy("order", "label_id").limit(settings.sample) for y in (0, 1)]
    rows = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "label_id")  # at most 2 * sample ids
    rows = rows.groupBy("label_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("label_id").limit(2 * settings.sample)
    return [(r.text, int(r.y)) for r in rows.collect()]


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and score of each row; a null text is an empty one. The model is broadcast: its size is that of its buckets."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, settings)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(common.texts_of(batch)))], ["doc_id", "score"])

    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def classify(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each row, from a model that is trained on the labels first.

    Without a label the model knows nothing and each score is 0.5. Rows with equal or null ids each give a row; a null id counts as
    held out. An empty table gives no rows. Other columns are ignored.
    """
    rows = training_rows(docs, labels, label, settings, id_col, text_col)
    model = train([t for t, _ in rows], [y for _, y in rows], settings)
    return score(docs, model, settings, id_col, text_col).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def filtered(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns and as they come, that classify() predicts as 1.

    A null text is scored as an empty one. Null and equal ids and repeated rows are scored each by its own text; a null id teaches
    nothing, of an id with several texts the smallest teaches. Without labels each score is 0.5. An empty table gives none.
    """
    rows = training_rows(docs, labels, label, settings, id_col, text_col)
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(train([t for t, _ in rows], [y for _, y in rows], settings))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, settings)
        for batch in batches:
            rows = batch.column("row")
            texts = [t or "" for t in rows.field(rows.type.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(scorer.score(texts) >= threshold))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.mapInArrow(run, whole.schema).select("row.*")


TOXICITY = Settings(lower=True, window=6, epochs=10, rate=1.0, whole=3)
QUALITY = Settings(lower=False, words=True, epochs=6)
