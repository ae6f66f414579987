"""Repeated passages by a common-prefix interval tree over an enhanced suffix array.

The array is sparse and in parts. Every window of min_len bytes holds an anchor, the k-byte string in it with the smallest hash, so
equal windows hold equal anchors at equal places. Suffixes start at anchors that occur twice or more anywhere; those of one anchor
form a part of the array, with up to min_len - k bytes to the left and min_len to the right of each. In a part, a stack scans the
common prefixes of neighbours for intervals, the nodes of the tree. In each node the occurrences are put in order of what stands to
the left, and a second scan parts them where the left extension is diverse: each of its intervals that ends at a diverse right
side is a maximal repeat within the part's reach, and all its occurrences are put out, not just neighbours.

What to cut needs less: an occurrence within a longer one that is known adds nothing, so it is left out there.

One scan serves two lengths: the anchor of the first min_len bytes of a longer string stands in it, so what surrounds anchors is taken
min_len to the left and the longer length, the reach, to the right, and each repeat of either length lies within that.

Equal texts are one text with a number of rows. A part with more than PART_ROWS occurrences is split by how far windows reach to the
left: those that reach between a and b bytes share the a bytes before the anchor and what b leaves to the right of it, so the bytes
there part it further, until each part has few enough different surroundings. At the end of this a and b are next to each other and
all of a part are one and the same window. Each such part goes through the same scan, with each of its surroundings once. What
surrounds such an anchor is read where its texts lie, so that whole texts are dealt out once whether there are such anchors or not, and
while parts are split only hashes of it move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Bytes that are hashed in one go; a longer text is taken in overlapping parts.
SEGMENT = 1 << 20
_PLACE = np.uint64(24)
#: Two hashes of a text: texts that are equal in both are equal.
_KEY = ["k1", "k2"]
_NO_ID = -(1 << 63)
#: Occurrences, or different surroundings of an anchor, that one task scans together: some 30 MB with their surroundings.
PART_ROWS = 32_768
#: Hashes of texts that a task remembers, so that copies give their anchors once.
SEEN = 100_000


class Rolling:
    """Hashes of all strings of one length in a buffer of at most SEGMENT bytes: polynomials modulo 2**64 over random bytes."""

    def __init__(self, seed: int):
        self.table = np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64)
        base = xxhash.xxh64_intdigest(b"base", seed) | 1
        self.power = np.multiply.accumulate(np.array([1] + [base] * SEGMENT, np.uint64))
        self.inverse = np.multiply.accumulate(np.array([1] + [pow(base, -1, 1 << 64)] * SEGMENT, np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64)])

    def of(self, prefix: np.ndarray, size: int) -> np.ndarray:
        return (prefix[size:] - prefix[:-size]) * self.inverse[: len(prefix) - size]


_rolling: dict[int, Rolling] = {}


def rolling(seed: int) -> Rolling:
    if seed not in _rolling:
        _rolling[seed] = Rolling(seed)
    return _rolling[seed]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _segments(texts: list[bytes], min_len: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of at most SEGMENT bytes with their pieces: the text's number, where the piece starts in it, its size."""
    held: list[bytes] = []
    pieces: list[tuple[int, int, int]] = []
    size = 0
    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - min_len + 1), SEGMENT - min_len + 1):
            piece = text[at : at + SEGMENT]
            if len(piece) < min_len:
                continue
            if size + len(piece) > SEGMENT:
                yield b"".join(held), pieces
                held, pieces, size = [], [], 0
            held.append(piece)
            pieces.append((t, at, len(piece)))
            size += len(piece)
    if pieces:
        yield b"".join(held), pieces


def anchors_of(texts: list[bytes], min_len: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text number, anchor hash, anchor place, first and last start of the windows that it is the anchor of; a text has each window once.

    The last window of a long text's piece and the first of its next one may have one and the same anchor: it comes once, for both.
    """
    roll = rolling(1)
    held: tuple[np.ndarray, ...] | None = None
    for data, pieces in _segments(texts, min_len):
        grams = roll.of(roll.prefix(np.frombuffer(data, np.uint8)), gram)
        keyed = grams >> _PLACE << _PLACE | np.arange(len(grams), dtype=np.uint64)
        chosen = (_least(keyed, min_len - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        sizes = np.array([p[2] for p in pieces])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        whole = np.concatenate([np.arange(b, e - min_len + 1) for b, e in zip(begins, ends, strict=True)])
        picked = chosen[whole]
        first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        last = np.concatenate([first[1:], [len(picked)]]) - 1
        place = picked[first]
        piece = np.searchsorted(ends, place, side="right")
        shift = np.array([p[1] for p in pieces])[piece] - begins[piece]
        found = np.array([p[0] for p in pieces])[piece], grams[place], place + shift, whole[first] + shift, whole[last] + shift
        if held:
            if held[0][-1] == found[0][0] and held[2][-1] == found[2][0]:
                found[3][0] = held[3][-1]
                held = tuple(x[:-1] for x in held)
            yield held
        held = found
    if held:
        yield held


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The nodes of the interval tree, children first: first and last row and their common prefix. prefixes[i]: of rows i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][1] > p:
            first, depth = stack.pop()
            yield first, i, depth
        if not stack or stack[-1][1] < p:
            stack.append((first, p))


class Nearest:
    """Common prefixes of strings in order, and of any two of them by the least between them."""

    def __init__(self, strings: list[bytes]):
        self.order = sorted(range(len(strings)), key=strings.__getitem__)
        self.rank = np.empty(len(strings), np.int64)
        self.rank[self.order] = np.arange(len(strings))
        ahead = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(self.order, self.order[1:], strict=False)], np.int64)
        self.ahead, self.levels = ahead, [ahead]
        while (half := 1 << len(self.levels) - 1) * 2 <= len(ahead):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, ranks: np.ndarray) -> np.ndarray:
        """The common prefix of each two neighbours of ascending ranks."""
        low, high = ranks[:-1], ranks[1:]
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))])
        return out


def repeats_of(contexts: list[tuple[bytes, bytes]], counts: list[int], min_len: int, starts: list[tuple] | None = None, whole: bool = False) -> Iterator[tuple[list[int], list[int], int, int]]:
    """Maximal repeats in one part of the array: contexts to put out, all that have it, and how far it goes left and right of the anchor.

    contexts: distinct pairs of what stands left of the anchor, reversed, and what stands from it on; counts: how often each occurs.
    Longer common prefixes come first. A context is put out with a repeat only if the repeat reaches further left than those before
    it: else the context's occurrence lies within one that is known, and its node is above that one's in the tree.

    starts, if given, orders the contexts by their first occurrence. Then that of a repeat's contexts which comes first is not put out
    with it, and only what was put out counts as known. A context that is alone in a repeat is put out all the same, for its others.

    whole: each maximal repeat is put out with all contexts that have it, whatever longer ones hold them.
    """
    reach = [-1] * len(contexts)
    for j, (left, right) in enumerate(contexts):
        if counts[j] > 1 and len(left) + len(right) >= min_len:
            if starts is None:
                reach[j] = len(left)
            yield [j], [j], len(left), len(right)
    if len(contexts) < 2:
        return
    after, before = Nearest([c[1] for c in contexts]), Nearest([c[0] for c in contexts])
    order = np.array(after.order)
    for first, last, right in intervals(after.ahead.tolist()):
        ranks = np.sort(before.rank[order[first : last + 1]])
        behind = before.between(ranks)
        if behind.max(initial=0) + right < min_len:
            continue
        rows = [before.order[r] for r in ranks.tolist()]
        for a, b, left in intervals(behind.tolist()):
            if left + right < min_len:
                continue
            alike = rows[a : b + 1]
            if whole:
                ends = after.rank[alike]
                if after.between(np.array([ends.min(), ends.max()]))[0] == right:  # else a node below has the same contexts and reaches further
                    yield alike, alike, left, right
                continue
            spared = None if starts is None else min(alike, key=starts.__getitem__)
            if further := [j for j in alike if reach[j] < left and j != spared]:
                for j in further:
                    reach[j] = left
                yield further, alike, left, right


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, list[Column]]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row_id = F.col(f"`{id_col}`").cast("long")
    return text, [row_id.alias("doc_id"), F.coalesce(row_id, F.lit(_NO_ID)).alias("row_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _utf8(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


_OUT = [("repeat_id", pa.int64()), ("length", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("starts", pa.list_(pa.int32()))]


class Repeats:
    """The repeated passages of a table. With keep_first, the first occurrence of each, by row id, text hashes and place, is not one of its spans."""

    def __init__(self, docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, keep_first: bool = False, reach: int | None = None):
        if min_len < 8:
            raise ValueError("min_len must be 8 or more")
        spark = docs.sparkSession
        self.min_len, self.gram, self.keep_first, self.parts_of = min_len, min_len // 4, keep_first, PART_ROWS
        #: The lengths of repeats that are told, longest first.
        self.lengths = sorted({reach or min_len, min_len}, reverse=True)
        self.reach = self.lengths[0]
        common.small_batches(spark)
        text, keys = _keyed(docs, id_col, text_col)
        self.lying = docs.select(*keys[1:], text.alias("text"))
        row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]).alias("row")] if whole else []
        self.rows = docs.select(*keys, *row)
        self.texts = docs.select(*keys, text.alias("text")).groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("row_id").alias("first_id"))
        gram = self.gram

        def anchors_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                key = [batch.column(c).to_numpy() for c in _KEY]
                fresh = []
                for i, k in enumerate(zip(*(k.tolist() for k in key), strict=True)):
                    if k not in seen:
                        seen.add(k)
                        fresh.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.array(fresh, np.int64)
                for text, h, place, *_ in anchors_of(_utf8(batch.take(pa.array(fresh))), min_len, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(k[fresh[text]]) for k in key), pa.array(place, pa.int32())], ["h", *_KEY, "place"])

        anchors = common.written(docs.select(*keys[2:], text.alias("text")).mapInArrow(anchors_in, "h long, k1 long, k2 long, place int"), "anchors")
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in (*_KEY, "place") for f in (F.min, F.max)]
        twice = F.expr("min_k1 <> max_k1 OR min_k2 <> max_k2 OR min_place <> max_place")  # copies of one text are one occurrence
        found = counted = common.written(anchors.groupBy("h").agg(F.count("*").alias("n"), *ends).where("n > 1").where(twice).select("h", "n"), "repeated")
        many = found.where(F.col("n") > self.parts_of).select("h")
        self.hot = False
        if not many.isEmpty():
            many = anchors.join(many, "h", "left_semi").distinct().groupBy("h").count().where(F.col("count") > self.parts_of)
            #: Anchors that are too many for one scan, in the shared folder: at most one in parts_of places.
            self.frequent = common.written(many.select("h"), "frequent")
            self.hot = not self.frequent.isEmpty()
        if self.hot:
            found = found.join(self.frequent, "h", "left_anti")
        there = anchors.join(found.select("h"), "h")
        self.places = common.written(there.groupBy(*_KEY).agg(F.collect_set(F.struct("place", "h")).alias("places")), "places")  # a text's own, bounded by its length
        for done in (anchors, counted):
            common.discard(done)

    def _with_text(self) -> DataFrame:
        """All columns of texts, as in apply: else Spark would not use one exchange for both."""
        return self.texts.join(self.places.hint("shuffle_hash"), _KEY)

    def parts(self) -> DataFrame:
        """repeat_id, length, doc_id, row_id, starts: a row for each maximal repeat in each row of the table, with all its starts there.

        All occurrences of each, also within longer repeats. Maximal within the part's reach. Rows of equal texts are a repeat of
        their whole text besides.
        """
        found = self._scanned(True)
        copied = self.texts.where(f"copies > 1 AND octet_length(text) >= {self.min_len}").select(F.col("k1").alias("repeat_id"), F.octet_length("text").cast("long").alias("length"), *_KEY, F.array(F.lit(0)).alias("starts"))
        return self.rows.join(found.unionByName(copied), _KEY).select("repeat_id", "length", "doc_id", "row_id", "starts")

    def _contexts(self) -> DataFrame:
        """h, k1, k2, first_id, at, before and after: a row for each anchor of a text and what surrounds it, with all its places there."""
        min_len, gram, reach = self.min_len, self.gram, self.reach
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
        names = ["h", *_KEY, "first_id", "at", "before", "after"]

        def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flushed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names)

            for batch in batches:
                out: list[list] = [[] for _ in names]
                for k1, k2, first_id, text, places in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "first_id")), _utf8(batch), batch.column("places").to_pylist(), strict=True):
                    own: dict[tuple, list[int]] = {}
                    for p in places:
                        own.setdefault((p["h"], *_around(text, p["place"], min_len, gram, reach)), []).append(p["place"])
                    for (h, before, after), at in own.items():
                        for o, x in zip(out, (h, k1, k2, first_id, at, before, after), strict=True):
                            o.append(x)
                        if len(out[0]) >= 4096:
                            yield flushed()
                            out = [[] for _ in names]
                yield flushed()

        return self._with_text().mapInArrow(contexts, "h long, k1 long, k2 long, first_id long, at array<int>, before binary, after binary")

    def _surroundings(self) -> DataFrame:
        """h, k1, k2, first_id, place, before and after of the anchors that are too many for one scan, from the texts where they lie."""
        min_len, gram, reach, frequent = self.min_len, self.gram, self.reach, self.frequent.written_to
        kinds = [("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("row_id", pa.int64()), ("place", pa.int32()), ("before", pa.binary()), ("after", pa.binary())]

        def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[tuple[int, int], int] = {}
            hot = _column(frequent, "h")
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in (*_KEY, "row_id")), strict=True))
                fresh = []
                for i, (*k, row_id) in enumerate(rows):
                    if least.get(tuple(k), row_id + 1) > row_id:
                        least[tuple(k)] = row_id
                        fresh.append(i)
                if len(least) > SEEN:
                    least.clear()
                texts, out = _utf8(batch.take(pa.array(fresh, pa.int64()))), []
                for text, h, place, *_ in anchors_of(texts, min_len, gram):
                    h = h.view(np.int64)
                    at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
                    for t, x, p in zip(text[at].tolist(), h[at].tolist(), place[at].tolist(), strict=True):
                        out.append((x, *rows[fresh[t]], p, *_around(texts[t], p, min_len, gram, reach)))
                        if len(out) >= 4096:
                            yield _batch(out, kinds)
                            out = []
                yield _batch(out, kinds)

        found = self.lying.mapInArrow(around, "h long, k1 long, k2 long, row_id long, place int, before binary, after binary")
        return found.groupBy("h", *_KEY, "place").agg(F.min("row_id").alias("first_id"), *(F.first(c).alias(c) for c in ("before", "after")))  # copies are one text

    def _scanned(self, everything: bool) -> DataFrame:
        """repeat_id, length, k1, k2, starts: with everything all occurrences of each repeat, else those that decide what to cut."""
        min_len, keep = self.min_len, self.keep_first and not everything

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for table in common.by_key(batches, "h"):
                groups: dict[tuple[bytes, bytes], list[tuple]] = {}
                for before, after, *where in zip(*(table.column(c).to_pylist() for c in ("before", "after", *_KEY, "first_id", "at")), strict=True):
                    groups.setdefault((before, after), []).append(where)
                contexts, where = list(groups), list(groups.values())
                first = [min((first_id, k1, k2, min(at)) for k1, k2, first_id, at in w) for w in where]
                for found, alike, left, right in repeats_of(contexts, [sum(len(at) for *_, at in w) for w in where], min_len, first if keep else None, everything):
                    name = _name(contexts[found[0]], left, right)
                    kept = min(first[j] for j in alike) if keep else None
                    for j in found:
                        out += [(name, left + right, k1, k2, [x - left for x in at if (first_id, k1, k2, x) != kept]) for k1, k2, first_id, at in where[j]]
                        if len(out) >= 8192:
                            yield _batch(out, _OUT)
                            out = []
            yield _batch(out, _OUT)

        n = common.partitions(self.rows.sparkSession)
        found = self._contexts().repartition(n, "h").sortWithinPartitions("h").mapInArrow(scan, "repeat_id long, length long, k1 long, k2 long, starts array<int>")
        if not self.hot:
            return found
        whole = common.written(self._surroundings(), "surroundings")
        for length in self.lengths:
            found = found.unionByName(self._scanned_apart(whole, length, everything))
        return found

    def _split(self, whole: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame]:
        """The anchors that are too many for one scan, in parts for windows of min_len bytes: where what surrounds them is, and each of a part's surroundings once.

        A part is what windows share that reach from a to b - 1 bytes left of the anchor; ctx and ctx2, two hashes, tell its surroundings
        apart, cut to what such windows cover. What occurs once in a part is in no repeat there and goes. Where: part, ctx, ctx2, a, b, k1,
        k2, first_id, place. Surroundings: part, ctx, ctx2, n, first, before and after.
        """
        top, spark = self.min_len - self.gram + 1, self.rows.sparkSession
        own = ["h", *_KEY, "first_id", "place", "before", "after"]
        level = whole
        ranges, done = level.select(*own, F.lit(0).alias("a"), F.lit(top).alias("b")), []
        while True:
            half = F.expr("array(struct(a, (a + b) DIV 2 AS b), struct((a + b) DIV 2 AS a, b))")
            cut = ranges.select(*own, F.explode(half).alias("r")).select(*own, "r.a", "r.b")
            cut = cut.where(f"a < b AND length(before) >= a AND length(after) >= {min_len} - b + 1")
            cut = cut.withColumn("part", F.expr(f"xxhash64(h, a, b, substring(before, 1, a), substring(after, 1, {min_len} - b + 1))"))
            covered = f"part, substring(before, 1, b - 1), substring(after, 1, {min_len} - a)"
            cut = cut.withColumn("ctx", F.expr(f"xxhash64({covered})"))
            sizes = cut.groupBy("part", "ctx").agg(F.count("*").alias("n")).groupBy("part").agg(F.count("*").alias("different"), F.sum("n").alias("n")).where("n > 1")
            sizes = common.written(sizes.select("part", (F.col("different") > self.parts_of).alias("many")), "sizes")
            hashed = cut.select("part", "ctx", F.expr(f"xxhash64(1, {covered})").alias("ctx2"), "a", "b", *_KEY, "first_id", "place")
            done.append(common.written(hashed.join(sizes.where("NOT many").select("part"), "part"), "split"))
            many = sizes.where("many").select("part")  # at most one in parts_of rows
            last = level
            if split := not many.isEmpty():
                level = common.written(cut.join(many, "part").select(*own, "a", "b"), "level")
                ranges = level
            if last is not whole:
                common.discard(last)
            common.discard(sizes)
            if not split:
                break
        where = spark.read.schema(done[0].schema).parquet(*(d.written_to for d in done))
        first = F.min(F.struct("first_id", *_KEY, "place")).alias("first")
        found = where.groupBy("part", "ctx", "ctx2", "a", "b").agg(F.count("*").alias("n"), first)
        found = found.select("*", *(F.col(f"first.{c}").alias(c) for c in (*_KEY, "place"))).join(whole.select(*_KEY, "place", "before", "after"), [*_KEY, "place"])
        cut = {"before": F.expr("substring(before, 1, b - 1)"), "after": F.expr(f"substring(after, 1, {min_len} - a)")}
        return where, found.withColumns(cut).select("part", "ctx", "ctx2", "n", "first", "before", "after")

    def _scanned_apart(self, whole: DataFrame, min_len: int, everything: bool) -> DataFrame:
        """_scanned for anchors that are too many for one scan: each part's surroundings are scanned once each, then joined to where they occur."""
        keep = self.keep_first and not everything
        where, contexts = self._split(whole, min_len)
        out_kinds = [("part", pa.int64()), ("ctx", pa.int64()), ("ctx2", pa.int64()), ("repeat_id", pa.int64()), ("length", pa.int64()), ("left", pa.int32()), *((f"kept_{c}", pa.int64()) for c in ("first_id", *_KEY, "place"))]

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for table in common.by_key(batches, "part"):
                contexts = list(zip(*(table.column(c).to_pylist() for c in ("before", "after")), strict=True))
                part, ctx, ctx2, n, first = (table.column(c).to_pylist() for c in ("part", "ctx", "ctx2", "n", "first"))
                first = [tuple(x.values()) for x in first]
                for found, alike, left, right in repeats_of(contexts, n, min_len, first if keep else None, everything):
                    name = _name(contexts[found[0]], left, right)
                    kept = min(first[j] for j in alike) if keep else (None,) * 4
                    out += [(part[j], ctx[j], ctx2[j], name, left + right, left, *kept) for j in found]
                    if len(out) >= 8192:
                        yield _batch(out, out_kinds)
                        out = []
            yield _batch(out, out_kinds)

        n = common.partitions(self.rows.sparkSession)
        schema = "part long, ctx long, ctx2 long, repeat_id long, length long, left int, kept_first_id long, kept_k1 long, kept_k2 long, kept_place long"
        found = contexts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(scan, schema)
        there = where.join(found, ["part", "ctx", "ctx2"]).where("NOT (first_id <=> kept_first_id AND k1 <=> kept_k1 AND k2 <=> kept_k2 AND place <=> kept_place)")
        return there.groupBy("repeat_id", "length", *_KEY).agg(F.collect_set((F.col("place") - F.col("left")).cast("int")).alias("starts"))

    def apply(self, fields: str, digest) -> DataFrame:
        """doc_id and digest(text, spans) of each row, as fields. spans: for each of the lengths the covered bytes' maximal runs, as an array of starts and ends.

        A text that several rows have is covered in all of them, or in all but those of its smallest id with keep_first, if it has min_len bytes.
        """
        per_text = self._scanned(False).groupBy(*_KEY).agg(F.collect_set(F.struct("length", "starts")).alias("found"))  # a text's own
        lengths, keep_first = self.lengths, self.keep_first
        columns = [f.split() for f in fields.split(", ")]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, copied = [], []
                for text, copies, found in zip(_utf8(batch), *(batch.column(c).to_pylist() for c in ("copies", "found")), strict=True):
                    spans = [runs(len(text), [x for x in found or [] if x["length"] >= n]) for n in lengths]
                    all_of = [np.array([[0, len(text)]]) if copies > 1 and len(text) >= n else of for n, of in zip(lengths, spans, strict=True)]
                    own.append(digest(text, *(spans if keep_first else all_of)))
                    copied.append(digest(text, *all_of) if keep_first and copies > 1 else dict.fromkeys(own[-1]))
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in (*_KEY, "first_id")}, **{f"{p}_{c}": [r[c] for r in of] for p, of in (("own", own), ("copy", copied)) for c, _ in columns}}, schema)

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c, pa.int64()) for c in (*_KEY, "first_id")] + [(f"{p}_{c}", kinds[k]) for p in ("own", "copy") for c, k in columns])
        joined = self.texts.join(per_text.hint("shuffle_hash"), _KEY, "left")
        digests = joined.mapInArrow(run, "k1 long, k2 long, first_id long, " + ", ".join(f"{p}_{c} {k}" for p in ("own", "copy") for c, k in columns))
        out = [F.when(F.col("row_id") > F.col("first_id"), F.col(f"copy_{c}")).otherwise(F.col(f"own_{c}")).alias(c) if keep_first else F.col(f"own_{c}").alias(c) for c, _ in columns]
        return self.rows.join(digests, _KEY).select("doc_id", *out, *(["row"] if "row" in self.rows.columns else []))


def _column(path: str, name: str) -> np.ndarray:
    """A column of a table that a task reads for itself, sorted."""
    fs, folder = pafs.FileSystem.from_uri(path)
    parts = []
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                parts.append(pq.read_table(f, columns=[name]).column(name).to_numpy())
    return np.sort(np.concatenate(parts))


def _around(text: bytes, at: int, min_len: int, gram: int, reach: int) -> tuple[bytes, bytes]:
    """What stands left of an anchor, reversed, and what stands from it on."""
    return text[max(0, at - min_len + gram) : at][::-1], text[at : at + reach]


def _name(context: tuple[bytes, bytes], left: int, right: int) -> int:
    before, after = context
    return xxhash.xxh64_intdigest(before[:left][::-1] + after[:right]) - (1 << 63)


def _batch(out: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])


def runs(size: int, found: list[dict]) -> np.ndarray:
    """Starts and ends of the maximal runs of bytes that what was found covers."""
    edge = np.zeros(size + 1, np.int64)
    for x in found:
        at = np.array(x["starts"], np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + x["length"], -1)
    inside = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(inside))
    return turn.reshape(-1, 2)


def without(text: bytes, spans: np.ndarray) -> bytes:
    at = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def dedup(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256: each text without the bytes of repeats of min_len bytes or more.

    Bytes are UTF-8. A byte goes if a string of min_len bytes that covers it also starts anywhere else, in this or another row;
    overlaps count, and all is judged on the texts as they come. A null text is an empty one. Rows with equal or null ids are
    documents of their own, so two equal rows are copies. An empty table gives no rows. Other columns of docs are ignored.
    """

    def digest(text: bytes, spans: np.ndarray) -> dict:
        kept = without(text, spans) if len(spans) else text
        return {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept": kept, "kept_sha256": hashlib.sha256(kept).hexdigest()}

    return Repeats(docs, min_len, id_col, text_col).apply("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string", digest)


def digests(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text", shorter: int | None = None) -> DataFrame:
    """dedup without the kept bytes themselves, which then never leave the Python worker.

    With `shorter`, a smaller length, also n_repeated and n_repeated_spans: the bytes, and their maximal runs, that repeats of that
    length or more cover. They stay, and come out of the same scan.
    """

    def digest(text: bytes, spans: np.ndarray, more: np.ndarray | None = None) -> dict:
        kept = without(text, spans) if len(spans) else text
        out = {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}
        return out if more is None else out | {"n_repeated": int((more[:, 1] - more[:, 0]).sum()), "n_repeated_spans": len(more)}

    if shorter is not None and not 8 <= shorter < min_len:
        raise ValueError("shorter must be below min_len and 8 or more")
    found = Repeats(docs, shorter or min_len, id_col, text_col, reach=min_len)
    return found.apply("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_repeated long, n_repeated_spans long" if shorter else ""), digest)


def cleaned(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", keep_first: bool = True) -> DataFrame:
    """docs with all their columns, the texts without repeats of min_len bytes or more, and length_col, if there, with the new length.

    With keep_first a byte goes if a string of min_len bytes that covers it starts before as well, by row id (null first), text hashes
    and place. So whatever goes still stands where such a string starts first, and one copy of each byte stays. Rows that are equal
    in id and text are both first.

    Of a character that lost some of its bytes the rest goes too. Otherwise as dedup; a null text comes back empty.
    """

    def digest(text: bytes, spans: np.ndarray) -> dict:
        return {"kept": (without(text, spans) if len(spans) else text).decode("utf-8", "ignore")}

    found = Repeats(docs, min_len, id_col, text_col, whole=True, keep_first=keep_first).apply("kept string", digest)
    kinds = dict(docs.dtypes)
    new = {text_col: F.col("kept"), length_col: F.length("kept").cast(kinds.get(length_col, "long"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
