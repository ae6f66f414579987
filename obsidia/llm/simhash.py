"""SimHash fingerprints and near-duplicates by meeting in the middle.

Two fingerprints that differ in at most 2r bits both have, in the ball of radius r around them, one and the same variant. So every
fingerprint emits all its variants within r, equal variants meet, and what meets is verified. A variant's place is decided by its
first bits: what is shuffled is a fingerprint with each prefix that its variants begin with, and the task that has a prefix makes
the variants that begin with it. Each variant is made exactly once, and a fingerprint moves a few dozen times instead of thousands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common
from obsidia.llm.components import components

BITS, SEED = 64, 42
#: Variants, and apart from them links, that a task holds at once.
VARIANTS, LINKS = 4_000_000, 1_000_000
#: Fingerprints to a prefix, before those that reach it by flips: bounds what a task holds of one prefix to some 211 times as many.
PREFIX_ROWS = 16_384
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of each shingle of `width` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and words end at ASCII white space alone
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprints_of(texts: list[str], width: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the text's hashes; all are 0 for a text without words."""
    return _bits([np.array(shingle_hashes(t, width), np.uint64) for t in texts])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (a long with the 64 bits) of each row.

    A null or empty text has fingerprint zero. Rows with equal or null ids each give a row. Other columns of docs are ignored.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(common.texts_of(batch), width).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """For each number of flips up to most, the masks over the lowest `bits` bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], np.uint64) for k in range(most + 1)]


def _meeting(low: np.ndarray, left: np.ndarray, bits: int, flips: dict[int, list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of fingerprints that share a variant, as (row, first row of its run). low: their bits below the prefix; left: flips left.

    Too many rows for one go are dealt out by the next bits, as by the prefix before, so memory stays bounded.
    """
    if len(low) < 2:
        return
    if bits not in flips:
        flips[bits] = _flips(bits, max(len(f) for f in flips.values()) - 1)
    counts = [sum(len(f) for f in flips[bits][: k + 1]) for k in range(len(flips[bits]))]
    if bits > 8 and int(np.bincount(left, minlength=len(counts)) @ counts) > VARIANTS:
        step = 4
        top = low >> np.uint64(bits - step)
        rest = low & np.uint64((1 << (bits - step)) - 1)
        for prefix in range(1 << step):
            used = np.bitwise_count(top ^ np.uint64(prefix)).astype(np.int64)
            rows = np.flatnonzero(used <= left)
            for a, b in _meeting(rest[rows], left[rows] - used[rows], bits - step, flips):
                yield rows[a], rows[b]
        return
    width = max(1, int(len(low) - 1).bit_length())
    keys = []
    for k in range(len(counts)):
        rows = np.flatnonzero(left == k)
        masks = np.concatenate(flips[bits][: k + 1])
        # An injective mix of the variant loses its last bits to the row's number; what meets falsely fails the check that follows.
        keys.append((((low[rows][:, None] ^ masks) * _MIX) >> np.uint64(width) << np.uint64(width) | rows.astype(np.uint64)[:, None]).ravel())
    key = np.concatenate(keys)
    key.sort()
    mixed, row = key >> np.uint64(width), (key & np.uint64((1 << width) - 1)).astype(np.int64)
    same = mixed[1:] == mixed[:-1]
    if not same.any():
        return
    begins = np.concatenate([[True], ~same])
    first = row[np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))]
    yield row[1:][same], first[1:][same]


def _pairs(prints: np.ndarray, left: np.ndarray, bits: int, radius: int, flips: dict) -> Iterator[np.ndarray]:
    """Verified links of one prefix, two rows of row numbers: of each run its first row with each other, never all with all."""
    for a, b in _meeting(prints & np.uint64((1 << bits) - 1), left, bits, flips):
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        near = np.bitwise_count(prints[pairs[0]] ^ prints[pairs[1]]) <= radius
        if not near.all():  # some met falsely: within each such run, check all against each other
            for x in np.unique(pairs[0][~near]):
                run = np.unique(np.concatenate([[x], pairs[1][pairs[0] == x]]))
                for i in run:
                    close = run[(np.bitwise_count(prints[run] ^ prints[i]) <= radius) & (run > i)]
                    pairs = np.concatenate([pairs, np.stack([np.full(len(close), i), close])], axis=1)
            near = np.bitwise_count(prints[pairs[0]] ^ prints[pairs[1]]) <= radius
        yield pairs[:, near]


def _gathered(pairs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same links in fewer arrays, of some LINKS each."""
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += p.shape[1]
        if size >= LINKS:
            yield np.concatenate(held, axis=1)
            held, size = [], 0
    if size:
        yield np.concatenate(held, axis=1)


def _forest(prints: np.ndarray, left: np.ndarray, bits: int, radius: int, flips: dict) -> np.ndarray:
    """Each linked row of one prefix with the first row of its class: only classes leave."""
    label = np.arange(len(prints))
    for pairs in _gathered(_pairs(prints, left, bits, radius, flips)):
        while True:
            least = np.minimum(label[pairs[0]], label[pairs[1]])
            before = label.copy()
            for side in pairs:
                np.minimum.at(label, label[side], least)
                np.minimum.at(label, side, least)
            label = label[label]
            if (label == before).all():
                break
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return np.stack([label[linked], linked])


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links a < b between distinct fingerprints, of each family by itself, enough to connect all that are within radius of each other.

    prints: columns family (int) and fingerprint (long), distinct. Linked are all pairs within radius, directly or by others; which
    pairs are rows depends on how many prefixes there are, what they connect does not.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("radius must be even: both meet in the middle")
    spark = prints.sparkSession
    n = common.partitions(spark)
    # How finely prefixes part them: enough for each task and for bounded tasks, as each more bit moves more rows.
    top = min(20, max(6, ceil(log2(max(1, n))), ceil(log2(max(1, prints.count() / PREFIX_ROWS)))))
    bits = BITS - top
    masks = np.concatenate(_flips(top, half)).tolist()
    spread = prints.select("family", "fingerprint", F.explode(F.array(*[F.lit(int(m)) for m in masks])).alias("mask"))
    prefix = F.shiftrightunsigned("fingerprint", bits).bitwiseXOR(F.col("mask")).bitwiseOR(F.shiftleft(F.col("family").cast("long"), top))
    spread = spread.select(prefix.alias("prefix"), "fingerprint")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {bits: _flips(bits, half)}
        for table in common.by_key(batches, "prefix"):
            if table.num_rows < 2:
                continue
            found = table.column("fingerprint").to_numpy().view(np.uint64)
            key = table.column("prefix")[0].as_py()
            used = np.bitwise_count(found >> np.uint64(bits) ^ np.uint64(key & ((1 << top) - 1))).astype(np.int64)
            pairs = _forest(found, half - used, bits, radius, flips)
            if pairs.shape[1]:
                x, y = found[pairs[0]].view(np.int64), found[pairs[1]].view(np.int64)
                family = np.full(len(x), key >> top, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(family), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["family", "a", "b"])

    dealt = spread.repartition(n, "prefix").sortWithinPartitions("prefix")
    with common.batches(spark, 20_000):
        return common.written(dealt.mapInArrow(meet, "family int, a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that links of at most radius bits reach.

    Exact and other copies with one fingerprint count once until the end, so their number does not matter to the search. Texts
    without words have fingerprint zero and are linked like any other. A null text is an empty one. A row with a null id takes part;
    its class's component_id is null only if no row of it has an id. Repeated rows each give a row; an empty table gives none.
    """
    with common.batches(docs.sparkSession):
        all_prints = common.written(fingerprints(docs, width, id_col, text_col), "simhash")
    found = common.written(all_prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "prints")
    edges = links(found.select(F.lit(0).alias("family"), "fingerprint"), radius).select("a", "b")
    root = components(edges)
    named = found.join(root, found.fingerprint == root.node, "left").select("fingerprint", "doc_id", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least, "root").select("fingerprint", "component_id")
    return all_prints.join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints a text for near_texts, and the smallest shingle hashes that its sketch holds.
FAMILIES, SKETCH = 4, 256
#: A similarity estimated from sketches decides if it is so far from the limit, four standard errors at 0.8; else whole sets do.
UNSURE = 0.1
#: Keys a text and smallest hashes a key: of pairs at 0.8, 1 - (1 - 0.8**6)**20 = 0.998 share a key, whatever the copy lacks or adds.
BANDS, ROWS = 20, 6
#: Texts of one key that are all compared with each other; more are first compared with one of them, then in blocks of so many.
GROUP, BLOCK = 32, 256
#: Partners of one text that are compared with it in one task.
PARTNERS = 64


def _bits(hashes: list[np.ndarray]) -> np.ndarray:
    """The majority bits of each text's hashes."""
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes).view(np.uint8).reshape(-1, 8) if len(hashes) else np.zeros((0, 8), np.uint8)
    owner = np.repeat(np.arange(len(hashes)) * 256, n)
    out = np.zeros(len(hashes), np.uint64)
    for k in range(8):
        counts = np.bincount(owner + flat[:, k], minlength=256 * len(hashes)).reshape(-1, 256) @ _TABLE
        for bit in range(8):
            out |= (2 * counts[:, bit] > n).astype(np.uint64) << np.uint64(8 * k + bit)
    return out


def _mixed(x: np.ndarray, family: int) -> np.ndarray:
    x = (x ^ np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def similarity(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity from two sketches: exact if both hold their whole sets, else from the smallest hashes of both together."""
    both = np.union1d(a, b)
    if len(a) >= size or len(b) >= size:
        both = both[:size]
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both) if len(both) else 1.0


_seeds = np.array([[xxhash.xxh64_intdigest(f"{k} {x}".encode(), SEED) for k in range(BANDS * ROWS)] for x in ("flip", "odd")], np.uint64)


def bands_of(shingles: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes, each of its smallest under ROWS orders; none of an empty set."""
    if not len(shingles):
        return []
    flip, odd = _seeds[0], _seeds[1] | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048] ^ flip[:, None]) * odd[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def _verified(pairs: DataFrame, made: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs x < y of nodes whose texts are similar: by their sketches, and by the texts themselves where those are too close to tell."""
    spark = pairs.sparkSession
    pairs = common.written(pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")

    def beside(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        """x, y and value: of each pair the value of y, and ahead of all pairs of an x, with a null y, that of x.

        Of a pair the text with more partners is x, so its value comes once to all of them; one with many is dealt with them to
        several tasks, some PARTNERS each.
        """
        partners = common.written(pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "partners")
        values = common.written(values.join(partners, "node", "left_semi").groupBy("node").agg(F.first("value").alias("value")), name)
        for k in "xy":
            pairs = pairs.join(partners.withColumnsRenamed({"node": k, "n": f"n{k}"}), k)
        most = F.col("nx") >= F.col("ny")
        ends = [F.when(most, F.col(a)).otherwise(F.col(b)) for a, b in ("xy", "yx")]
        dealt = pairs.select(ends[0].alias("x"), ends[1].alias("y"), F.ceil(F.greatest("nx", "ny") / PARTNERS).alias("tasks"))
        dealt = common.written(dealt.select("x", "y", F.pmod(F.xxhash64("y"), "tasks").alias("part")), "dealt")
        of = dealt.join(values, dealt.y == values.node).select("x", "y", "value", "part")
        heads = dealt.select("x", "part").distinct().join(values, F.col("x") == values.node).select("x", F.lit(None).cast("long").alias("y"), "value", "part")
        sides = heads.unionByName(of).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
        return sides.select("x", "y", "value")

    def compared(batches: Iterable[pa.RecordBatch], read) -> Iterator[list[tuple]]:
        """Of each batch the pairs with what read() makes of both values; a value of x stands for all of its pairs that follow."""
        x, own = None, None
        for batch in batches:
            out = []
            for a, b, value in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "value")), strict=True):
                if b is None:
                    x, own = a, read(value)
                elif a == x:
                    out.append((min(a, b), max(a, b), own, read(value)))
            yield out

    def estimate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in compared(batches, lambda v: np.frombuffer(v, "<u4")):
            told = []
            for x, y, a, b in pairs:
                found = similarity(a, b)
                sure = len(a) < SKETCH and len(b) < SKETCH or abs(found - least) > UNSURE
                if not sure or found >= least:
                    told.append((x, y, sure))
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["x", "y", "sure"])

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in compared(batches, lambda v: set(shingle_hashes(v or "", width))):
            near = [(x, y) for x, y, a, b in pairs if len(a & b) >= least * len(a | b)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in near], pa.int64()) for k in (0, 1)], ["x", "y"])

    with common.batches(spark, 2000):
        told = common.written(beside(pairs, made.select("node", F.col("sketch").alias("value")), "sketches").mapInArrow(estimate, "x long, y long, sure boolean"), "told")
    unsure = told.where("not sure").select("x", "y")
    if unsure.isEmpty():
        return told.select("x", "y")
    with common.batches(spark, 64):
        near = common.written(beside(unsure, texts.select("node", F.col("text").alias("value")), "texts").mapInArrow(exact, "x long, y long"), "exact")
    return told.where("sure").select("x", "y").unionByName(near)


def _similarities(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of each set with each of the others, from how many hashes they share; of empty ones 1."""
    sizes = np.array([len(x) for x in (*sets, *others)])
    if not sizes.any():
        return np.ones((len(sets), len(others)))
    flat = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # a hash of one set alone is in no intersection
    owner, number = owner[shared], np.cumsum(np.concatenate([[True], ~same])[shared]) - 1 if shared.any() else np.zeros(0, np.int64)
    both = np.zeros((len(sets), len(others)), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        at = slice(*np.searchsorted(number, [low, low + 4096]).tolist())
        has = np.zeros((len(sizes), 4096), np.float32)
        has[owner[at], number[at] - low] = 1
        both += has[: len(sets)] @ has[len(sets) :].T
    union = sizes[: len(sets), None] + sizes[None, len(sets) :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _across(groups: DataFrame, texts: DataFrame, root: DataFrame, width: int, least: float) -> DataFrame:
    """Similar pairs x, y of one key that are in no class together yet, enough to connect all such pairs.

    groups: key, node, n and first, of keys that more than GROUP texts share. Each text that is not in its first one's class meets all
    texts of its key, in cells of BLOCK by BLOCK texts, by their whole sets of shingles. A cell puts out what connects its own pairs.
    """
    spark = groups.sparkSession
    named = groups.join(root, "node", "left").select("key", "node", "first", "n", F.coalesce("root", "node").alias("root"))
    named = named.join(root.withColumnsRenamed({"node": "first", "root": "most"}), "first", "left").select("key", "node", "n", "root", F.coalesce("most", "first").alias("most"))
    named = common.written(named, "groups")
    apart = named.where("root <> most").groupBy("key").agg(F.count("*").alias("u"))
    if apart.isEmpty():
        return spark.createDataFrame([], "x long, y long")
    named = named.join(apart, "key")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    block = lambda c: F.pmod(F.xxhash64("node", "key"), blocks(c)).cast("int")
    of = named.where("root <> most").select("key", block("u").alias("a"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("b"), F.lit(True).alias("asks"), "node", "root")
    to = named.select("key", F.explode(F.sequence(F.lit(0), blocks("u") - 1)).alias("a"), block("n").alias("b"), F.lit(False).alias("asks"), "node", "root")
    asked = common.written(of.unionByName(to).select(F.xxhash64("key", "a", "b").alias("cell"), "asks", "node", "root"), "cells")
    whole = texts.join(asked.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.by_key(batches, "cell"):
            asks, node, root = (table.column(c).to_numpy() for c in ("asks", "node", "root"))
            of, to = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(of) or not len(to):
                continue
            held = [np.unique(np.array(shingle_hashes(t, width), np.uint64)) for t in table.column("text").to_pylist()]
            similar = _similarities([held[k] for k in of], [held[k] for k in to]) >= least - 1e-6
            i, j = np.nonzero(similar & (root[of][:, None] != root[to][None, :]))
            up = {int(r): int(r) for r in np.unique(root)}

            def top(r: int) -> int:
                while up[r] != r:
                    r = up[r]
                return r

            found = []
            for a, b in zip(of[i].tolist(), to[j].tolist(), strict=True):
                x, y = top(int(root[a])), top(int(root[b]))
                if x != y and len(np.intersect1d(held[a], held[b], True)) >= least * len(np.union1d(held[a], held[b])):
                    up[y] = x
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(node[[p[k] for p in found]] if found else [], pa.int64()) for k in (0, 1)], ["x", "y"])

    cells = asked.join(whole, "node").select("cell", "asks", "node", "root", "text").repartition("cell").sortWithinPartitions("cell")
    with common.batches(spark):
        return common.written(cells.mapInArrow(compare, "x long, y long"), "apart")


def near_texts(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 4, text_col: str = "text") -> DataFrame:
    """node and root, the smallest node of its class, for each distinct text that is similar to another. A node is xxhash64 of a text.

    Similar: the Jaccard similarity of the sets of shingles of `width` words is `least` or more; for longer texts estimated
    from the SKETCH smallest hashes, and taken from the whole sets where the estimate is within UNSURE of the limit. One changed
    word changes `width` shingles, so a fingerprint of shingles is far off at this similarity.
    The fingerprints here are of the sets of words instead, in FAMILIES families with hashes of their own: similar texts differ in a
    few bits in one family or another. Texts meet if links of at most radius bits connect their fingerprints in a family. A copy
    that is cut or extended has other words, so texts meet as well by BANDS keys of their shingles, which depend on the similarity
    alone. Pairs that meet are verified on their shingles, before any link of theirs counts: all pairs of a small group; of a larger one
    first each text with one of them, then each that is not in its class with all. So neither sizes nor settings decide what is linked.
    """
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch)
            words = [np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in set(t.encode().lower().split())), np.uint64) for t in texts]
            prints = np.stack([_bits([_mixed(w, f) for w in words]) for f in range(FAMILIES)], axis=1).view(np.int64)
            shingles = [np.unique(np.array(shingle_hashes(t, width), np.uint64)) for t in texts]
            sketch = [np.unique(s >> np.uint64(32)).astype("<u4")[:SKETCH].tobytes() for s in shingles]
            bands = [bands_of(s) for s in shingles]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(prints), pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["node", "prints", "sketch", "bands"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    with common.batches(spark):
        made = common.written(texts.mapInArrow(run, "node long, prints array<long>, sketch binary, bands array<long>"), "sketches")
    printed = made.select("node", F.posexplode("prints").alias("family", "fingerprint")).distinct()
    close = links(common.written(printed.select("family", "fingerprint").distinct(), "prints"), radius)
    print_of = lambda c: F.xxhash64("family", c)
    classes = components(close.select(print_of("a").alias("a"), print_of("b").alias("b"))).withColumnsRenamed({"node": "key", "root": "class"})
    printed = printed.select("node", print_of("fingerprint").alias("key")).join(classes, "key", "left").select("node", F.coalesce("class", "key").alias("key"))
    members = printed.unionByName(made.select("node", F.explode("bands").alias("key"))).distinct()
    sized = members.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("first")).where("n > 1")
    groups = common.written(members.join(sized, "key"), "keys")
    few, many = groups.where(F.col("n") <= GROUP).select("key", "node"), groups.where(F.col("n") > GROUP)
    met = few.withColumnRenamed("node", "x").join(few.withColumnRenamed("node", "y"), "key").where("x < y").select("x", "y")
    star = many.select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = common.written(_verified(met.unionByName(star), made, texts, width, least), "near")
    root = common.written(components(near, "x", "y"), "roots")
    apart = _across(many, texts, root, width, least)
    if apart.isEmpty():
        return root
    return components(near.unionByName(apart), "x", "y")


def first_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, with one row of each class of equal or similar texts: that with the smallest id.

    A null id counts as larger than all others; of equal ids that with the smaller text hash stays, and of rows equal in both any one.
    A null text is an empty one. Texts that differ and share the hash that is their node: those with larger second hashes stay, once each.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("row_id")
    keys = [F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("other"), row_id]
    per_text = common.written(docs.select(*keys).groupBy("node", "other").agg(F.min("row_id").alias("row_id")), "ids")
    shared = per_text.groupBy("node").agg(F.min("other").alias("other"), F.count("*").alias("n"), F.min_by("row_id", "other").alias("row_id"))
    with common.scratch_of() as used:
        root = common.written(near_texts(docs, width, least, text_col=text_col), "classes")
    common.delete(docs.sparkSession, [p for p in used if p != root.written_to])
    best = shared.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("row_id", "node", "other")).alias("best")).select("best.*")
    clash = common.written(shared.where("n > 1").select("node", F.col("other").alias("least")), "clashes")
    if not clash.isEmpty():
        best = best.unionByName(per_text.join(clash, "node").where("other <> least").select("row_id", "node", "other"))
    best = common.written(best, "best")
    wide = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    names = ["row_id", "node", "other"]
    kept = wide.join(best.hint("shuffle_hash"), names, "left_semi")
    return kept.groupBy(*names).agg(F.first("row").alias("row")).select("row.*")
