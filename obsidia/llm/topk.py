"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are parted into lists; a pair's score is the sum of its scores in each list, and each list is scored by itself.
Scores of a query in a list count from the list's smallest, so none is negative and a pair that is not seen adds nothing.
Phase 1 gathers each block's best entries of every list, and takes the k-th best of the totals that these entries must reach.
Phase 2 sends that bound, parted evenly over the lists, back with the queries: a pair whose score is below it in every list cannot be
among the k best, so only entries at or above it are collected. Phase 3 resolves what the collected pairs lack exactly.
Candidates stay where they are, in blocks of rows. Queries, and with the bound what is known of them, lie in files of the shared
folder; a task reads them block by block beside its candidates. So no candidate is shuffled, nothing is sent to all, and none to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsidia.llm import common

#: Vectors in a block of candidates and of queries: bounds a tile's memory to a few times their product of doubles. Lists of a vector's components.
BLOCK, QUERY_BLOCK, LISTS = 2048, 512, 4
#: Blocks of candidates that a task holds while it reads the queries once.
GROUP = 16


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id and v, the floor of scale times each component; rows with a null id, a null vector, or null or non-finite components go."""
    x = F.col(vector_col)
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floors = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), floors.alias("v"))


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of up to `rows` vectors each: ids, width and the values, as little-endian 64-bit integers."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("v").to_pylist()
                width = max(map(len, lists))
                held = np.zeros((len(lists), width), "<i8")
                for i, v in enumerate(lists):
                    held[i, : len(v)] = v
                ids = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "width": pa.array([width], pa.int32()), "held": [held.tobytes()]})

    return vectors.mapInArrow(pack, "ids binary, width int, held binary")


def _matrix(ids: bytes, width: int, held: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(held, "<i8").reshape(len(i), width)


def _lists(q: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Each list's scores of all pairs, exact: in doubles while every sum stays below 2**53, else in 64-bit integers."""
    width = min(q.shape[1], c.shape[1])  # a shorter vector goes on with zeros
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
    for part in np.array_split(np.arange(width), LISTS):
        x, y = q[:, part], c[:, part]
        yield (x.astype(float) @ y.astype(float).T).astype(np.int64) if most < 2**53 else x @ y.T


def _stored(df: DataFrame, name: str) -> str:
    path = common.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _read(path: str) -> Iterator[dict]:
    """The rows of a table that tasks read for themselves, a few at a time, in order of its files."""
    fs, folder = pafs.FileSystem.from_uri(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=4):
                    yield from batch.to_pylist()


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The candidates of a task, GROUP blocks at a time."""
    held = []
    for batch in batches:
        for ids, width, values in zip(*(batch.column(c).to_pylist() for c in ("ids", "width", "held")), strict=True):
            held.append(_matrix(ids, width, values))
            if len(held) == GROUP:
                yield held
                held = []
    if held:
        yield held


_LEAST = np.iinfo(np.int64).min


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k highest scores, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def _best_totals(lists: list[np.ndarray], total: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of each query the totals of what stands highest in one list or another, each once; places that are left over hold the smallest integer."""
    places = np.sort(np.concatenate([_highest(np.where(own, _LEAST, x), k) for x in lists], axis=1), axis=1)
    found = np.take_along_axis(np.where(own, _LEAST, total), places, axis=1)
    found[:, 1:][places[:, 1:] == places[:, :-1]] = _LEAST
    return np.take_along_axis(found, _highest(found, k), axis=1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k best candidates of other ids; all, if fewer. Ties go to the smaller id.

    Takes no part: a row with a null id or vector, or with a null or non-finite component. A vector that is shorter than another
    counts as followed by zeros. Each row of a repeated id is a candidate of its own; a repeated query id has its rows' results
    merged. No queries or no candidates: no rows. Scores must fit in 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = common.partitions(spark)
    with common.batches(spark, BLOCK):
        candidates = common.written(_blocks(scaled(vectors, id_col, vector_col, scale).repartition(parts), BLOCK), "candidates")
        blocks = _blocks(scaled(queries, id_col, vector_col, scale).coalesce(1 + parts // 8), QUERY_BLOCK)
        asked = _stored(blocks.withColumn("qb", F.monotonically_increasing_id()), "queries")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            for r in _read(asked):
                q_ids, q = _matrix(r["ids"], r["width"], r["held"])
                best, least = np.zeros((len(q_ids), 0), np.int64), None
                for c_ids, c in group:
                    own = q_ids[:, None] == c_ids
                    lists = list(_lists(q, c))
                    best = np.concatenate([best, _best_totals(lists, sum(lists), own, k)], axis=1)
                    best = np.take_along_axis(best, _highest(best, k), axis=1)
                    low = np.stack([x.min(axis=1) for x in lists], axis=1)
                    least = low if least is None else np.minimum(least, low)
                held = [row[row != _LEAST].tolist() for row in best]
                yield pa.RecordBatch.from_arrays([pa.array([r["qb"]] * len(held)), pa.array(range(len(held)), pa.int32()), pa.array(held, pa.list_(pa.int64())), pa.array(least.tolist(), pa.list_(pa.int64()))], ["qb", "i", "best", "least"])

    with common.batches(spark, 4):
        local = common.written(candidates.mapInArrow(gather, "qb long, i int, best array<long>, least array<long>"), "lists")
    rank = Window.partitionBy("qb", "i").orderBy(F.desc("score"))
    kth = local.select("qb", "i", F.explode("best").alias("score")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    kth = kth.groupBy("qb", "i").agg(F.when(F.count("*") == k, F.min("score")).alias("reach"))
    least = local.groupBy("qb", "i").agg(*[F.min(F.get("least", F.lit(j))).alias(f"l{j}") for j in range(LISTS)])
    bound = least.join(kth, ["qb", "i"], "left").select("qb", F.struct("i", "reach", F.array(*[f"l{j}" for j in range(LISTS)]).alias("least")).alias("bound"))
    bound = bound.groupBy("qb").agg(F.sort_array(F.collect_list("bound")).alias("bounds"))  # a block's queries at most
    known = _stored(spark.read.parquet(asked).join(bound, "qb"), "bounds")

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            for r in _read(known):
                q_ids, q = _matrix(r["ids"], r["width"], r["held"])
                least = np.array([b["least"] for b in r["bounds"]], np.int64)
                reach = np.array([_LEAST if b["reach"] is None else b["reach"] for b in r["bounds"]], np.int64)
                open_ = reach == _LEAST  # fewer than k are known: all take part
                over = np.where(open_, 0, reach - least.sum(axis=1))
                cut = -((-over) // LISTS)  # rounded up, in integers: no score is too large to compare
                found = [[], [], []]
                for c_ids, c in group:
                    lists = [x - least[:, [j]] for j, x in enumerate(_lists(q, c))]
                    above = [x >= cut[:, None] for x in lists]
                    # Phase 3: what is below the cut in some list adds less than the cut there; what can still reach is resolved.
                    most = sum(np.where(y, x, cut[:, None]) for x, y in zip(lists, above, strict=True))
                    take = (open_[:, None] | np.logical_or.reduce(above) & (most >= over[:, None])) & (q_ids[:, None] != c_ids)
                    i, j = np.nonzero(take)
                    for of, x in zip(found, (i, c_ids[j], sum(x[i, j] for x in lists) + least.sum(axis=1)[i]), strict=True):
                        of.append(x)
                i, ids, score = map(np.concatenate, found)
                order = np.lexsort((ids, -score, i))
                first = np.flatnonzero(np.diff(i[order], prepend=-1))
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                order = order[rank < k]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[i[order]], ids[order], score[order])], ["query_id", "vec_id", "score"])

    common.small_batches(spark)
    found = candidates.mapInArrow(collect, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
