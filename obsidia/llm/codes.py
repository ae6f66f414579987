"""Vector codes: each vector's parts are replaced by the index of the nearest entry of a codebook that is learned for each part.

Components are whole numbers, so sums and distances are exact and every number of partitions gives the same codebooks. Vectors are held
in blocks, each a matrix with a row a component, so that a part is a few rows in a run. A round is one treeAggregate over the blocks:
a task adds the squared differences of a part's components one after the other for all vectors and entries of a tile, takes each vector's
nearest entry, and adds the vectors to the entry's sums and counts in place; these tensors, whose size is that of the codebooks, are
added up along a tree, and only the last few come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Vectors in a block, and in a tile of it: bounds a task's matrix of distances.
BLOCK, TILE = 4096, 1024
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """id, label and v, the floors of scale times each component; a null vector and one with null or non-finite components goes."""
    x = F.col(f"`{vector_col}`")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floors = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("long")
    return vectors.where(usable).select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), floors.alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row a component, a column a vector; a shorter vector goes on with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return np.ascontiguousarray(values.reshape(len(sizes), width).T)
    out = np.zeros((width, len(sizes)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = values
    return out


def fits(x: np.ndarray, books: np.ndarray) -> bool:
    """Whether distances between the two, and sums over a block, stay within 64 bits."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), int(books.max(initial=0)), -int(books.min(initial=0)))
    return books.shape[2] * (2 * most) ** 2 <= _MOST and most * BLOCK <= _MOST


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the nearest entry, the lower of equals, and the squared distance. books: part, entry, place.

    Where distances may exceed 64 bits they are taken in whole numbers without bounds.
    """
    parts, entries, size = books.shape
    if not fits(x, books):
        x, books = x.astype(object), books.astype(object)
    code = np.zeros((parts, x.shape[1]), np.int64)
    error = np.zeros((parts, x.shape[1]), x.dtype)
    for at in range(0, x.shape[1], TILE):
        tile = x[:, at : at + TILE]
        for p in range(parts):
            far = np.zeros((entries, tile.shape[1]), x.dtype)
            for d in range(size):
                apart = tile[p * size + d] - books[p, :, d, None]
                far += apart * apart
            best = far.argmin(axis=0)
            code[p, at : at + TILE] = best
            error[p, at : at + TILE] = far[best, np.arange(tile.shape[1])]
    return code, error


def _blocks(kept: DataFrame, width: int) -> DataFrame:
    """The vectors as blocks: columns binary rows of up to BLOCK vectors, a component after the other."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32()), "held": pa.array([matrix(batch.column("v"), width).astype("<i8").tobytes()], pa.binary())})

    return kept.select("v").mapInArrow(pack, "n int, held binary")


def learn(kept: DataFrame, width: int, settings: Settings) -> np.ndarray:
    """The codebooks: part, entry, place within the part. They start as the vectors with the smallest ids."""
    size = width // settings.parts
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(settings.entries).select("v").collect()
    start = matrix(pa.array([r.v for r in first], pa.list_(pa.int64())), width)
    books = np.stack([start[p * size : (p + 1) * size].T for p in range(settings.parts)])
    spark = kept.sparkSession
    with common.batches(spark, BLOCK):
        blocks = common.written(_blocks(kept, width), "blocks")
    for _ in range(settings.rounds):
        shared = spark.sparkContext.broadcast(books)  # of the codebooks' size

        def add(total: list, block) -> list:
            held, x = shared.value, np.frombuffer(block.held, "<i8").reshape(width, block.n)
            code, _ = nearest(x, held)
            sums, counts = np.zeros(held.shape, np.int64 if fits(x, held) else object), np.zeros(held.shape[:2], np.int64)
            x = x.astype(sums.dtype)
            for p in range(held.shape[0]):
                for d in range(size):
                    np.add.at(sums[p, :, d], code[p], x[p * size + d])
                np.add.at(counts[p], code[p], 1)
            return merge(total, [sums, counts])

        def merge(a: list, b: list) -> list:
            return b if not a else a if not b else [_sum(a[0], b[0]), a[1] + b[1]]

        total = blocks.rdd.treeAggregate([], add, merge, depth=3)
        if total:
            sums, counts = total[0].astype(object), total[1].astype(object)
            moved = sums // np.maximum(counts, 1)[:, :, None]  # floors, also of what is below zero
            books = np.where((counts > 0)[:, :, None], moved, books.astype(object)).astype(np.int64)
        shared.unpersist()
    common.discard(blocks)
    return books


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of whole numbers; without bounds from where 64 bits might not do."""
    if a.dtype == object or b.dtype == object or max(np.abs(x).max(initial=0) for x in (a, b)) >= 1 << 61:
        return a.astype(object) + b.astype(object)
    return a + b


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components, in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of each vector that takes part, and the codebooks.

    code has two hex digits a part. A row whose vector is null or holds null or non-finite components goes. A vector that is shorter
    than the longest, or than a multiple of the parts, counts as followed by zeros. A null id counts as the largest; equal ids are
    ordered by their vectors; repeated rows each count. With fewer vectors than entries the codebooks have as many entries as there are
    vectors; without any there are no rows and no entries. An error beyond 64 bits is given as the largest number there.
    """
    if settings.entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    kept = scaled(vectors, id_col, vector_col, label_col, settings.scale)
    spark = vectors.sparkSession
    longest = kept.agg(F.max(F.size("v")).alias("n")).collect()[0].n  # one row
    kinds = f"vec_id long, label {dict(kept.dtypes)['label']}, code string, error long"
    if longest is None:
        return spark.createDataFrame([], kinds), np.zeros((settings.parts, 0, 0), np.int64)
    width = -(-longest // settings.parts) * settings.parts
    books = learn(kept, width, settings)
    shared = spark.sparkContext.broadcast(books)
    hexed = np.array([f"{i:02x}" for i in range(256)], "U2")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = nearest(matrix(batch.column("v"), width), shared.value)
            named = np.ascontiguousarray(hexed[code.T]).view(f"U{2 * len(code)}").ravel()
            far = [min(int(e), _MOST) for e in error.sum(axis=0)] if error.dtype == object else _total(error)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(named.tolist(), pa.string()), pa.array(far, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(encode, kinds), books


def _total(error: np.ndarray) -> np.ndarray | list[int]:
    if error.max(initial=0) <= _MOST // max(1, len(error)):
        return error.sum(axis=0)
    return [min(int(e), _MOST) for e in error.astype(object).sum(axis=0)]


def with_labels(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256: the error of all rows of a label, null being one, beside each of them."""
    rows = common.written(coded, "codes")
    most = F.lit(_MOST).cast("decimal(38,0)")
    by = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    return rows.join(by, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
