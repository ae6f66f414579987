"""Connected components of a graph that only executors hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Edges that one task finishes by itself: 8 MB of them. The result is the same either way; rounds over so few cost more than they save.
FEW = 500_000


def _finished(edges: DataFrame) -> DataFrame:
    """Components of at most FEW edges, in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches]
        if not held:
            return
        nodes, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = place.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:
            before = root.copy()
            least = np.minimum(root[a], root[b])
            for side in (a, b):
                np.minimum.at(root, root[side], least)
                np.minimum.at(root, side, least)
            root = root[root]
            if (root == before).all():
                break
        member = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root[member]])], ["node", "root"])

    with common.batches(edges.sparkSession, 20_000):
        return common.written(edges.coalesce(1).mapInArrow(run, "node long, root long"), "components")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node and root, the smallest node of its component, for each node with an edge to another. Nodes are longs.

    Alternates two steps until nothing changes: each node links its larger neighbours to the smallest around it, then its smaller
    ones. A component becomes a star around its smallest node in a number of rounds that grows as the logarithm of its size. As soon
    as no more than FEW edges are left one task finishes them. Edges with a null end and from a node to itself are left out,
    repeated ones count once. The driver sees one count and checksum a round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    down = common.written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = down.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now.n <= FEW:
            return _finished(down)
        if now == before:
            return down.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, old = common.written(large, "edges"), down
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        down = common.written(down, "edges")
        common.discard(large)
        common.discard(old)
    raise RuntimeError(f"components are not settled after {rounds} rounds")
