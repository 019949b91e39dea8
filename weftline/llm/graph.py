"""Grouping by links: union-find in one task's memory, and star contraction where links are a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, scope, skew_join

#: Most links that one task holds at once.  A table of no more than these is joined in a single task.
TASK_LINKS = 1 << 18


class UnionFind:
    """Disjoint sets of 0..n-1 whose root is their smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        root = a
        while self.up[root] != root:
            root = self.up[root]
        while self.up[a] != root:
            self.up[a], a = root, self.up[a]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that is no root, and its root: the smallest node that these links reach."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    found = UnionFind(len(ids))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        found.join(a, b)
    root = np.array([found.find(i) for i in range(len(ids))], dtype=np.int64)
    node = np.flatnonzero(root < np.arange(len(ids)))
    return ids[node], ids[root[node]]


def contracted(links: DataFrame) -> DataFrame:
    """``links`` (``u``, ``v``) with each ``TASK_LINKS`` of a task's as stars, which join the same nodes; nothing is shuffled."""
    most = TASK_LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            ends = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*ends)], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        many = 0
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                if held and many + batch.num_rows > most:
                    yield flush()
                    held, many = [], 0
                held.append(batch)
                many += batch.num_rows
        if held:
            yield flush()

    return links.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for each node of ``edges`` (``u``, ``v``) but the roots.

    Each task first contracts the links that it has.  If more are left than one task may hold, large-star and small-star rounds
    in turn until every node hangs from its root.  Each round is written out, so that a lost executor costs one round at
    most.  Equal ends and repeated links are ignored.
    """
    with scope() as keep:
        pairs = materialise(contracted(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))))
        if pairs.count() <= TASK_LINKS:
            pairs = materialise(contracted(pairs.repartition(1)))
        else:
            pairs = materialise(pairs.distinct())
            while (after := _round(pairs)) is not None:
                pairs = after
        return keep(pairs).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _round(pairs: DataFrame) -> DataFrame | None:
    """The links after a large-star and a small-star; none if every node hangs from its root already."""
    with scope() as keep:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node that hangs from two others, or hangs and has others that hang from it.
        moves = F.count_if(F.col("v") < F.col("u")) + F.bool_or(F.col("v") > F.col("u")).cast("int") > 1
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("many"), moves.alias("moves")))
        total, more = low.agg(F.sum("many"), F.bool_or("moves")).first()
        if not more:
            return None
        large = materialise(skew_join(both, low, ["u"], "many", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        small = skew_join(large, low, ["u"], "many", total)
        # The smallest neighbour stays one, and all others become its neighbours.
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return keep(materialise(small.where("u <> v").distinct()))
