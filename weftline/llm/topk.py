"""Exact top-k search by multi-resolution segment statistics.

Every vector is cut into segments, and each segment is known by its mean and standard deviation.  For two segments of n
components the inner product is at most n * (m1 * m2 + s1 * s2), and so the squared distance at least
n * ((m1 - m2)**2 + (s1 - s2)**2); the sum over segments bounds the whole vectors.  Every query starts from its k-th best score
among the longest rows.  Blocks of queries pass over the rows, the longest first, coarse to fine: a pair whose bound stays
below the query's k-th best score so far is given up, and the exact score is computed for what survives the finest level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialise

#: Segments at each level, coarse to fine.
LEVELS = (4, 16)
#: Bytes of queries that are broadcast at a time; more queries take more passes.
QUERY_BYTES = 64 << 20
#: Bytes of the longest rows that queries start from.
SEED_BYTES = 1 << 20
#: Queries and rows in a block.
QUERY_BLOCK, ROW_BLOCK = 512, 256
EXACT = float(2**53)
MOST = 2**63 - 1
#: Components are kept as multiples of 1 / 256, so that none overflows; a product of two is a multiple of 1 / UNIT.
UNIT = 1 << 16
#: Pairs are scored one by one where fewer than this part of a block survives.
SPARSE = 0.125


@np.errstate(over="ignore", invalid="ignore")
def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that their inner product bounds that of the rows."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([size, size]))


@np.errstate(over="ignore")
def floors(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) / 256; from 2**45 on, x is a multiple of 1 / 256 itself."""
    return np.where(np.abs(x) < 2.0**45, np.floor(x * 256) / 256, x)


def _exact(q: np.ndarray, x: np.ndarray) -> bool:
    return np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * UNIT * max(1, q.shape[1]) < EXACT


def _wide(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) * 256 if abs(v) >= 2.0**45 else int(v * 256) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``q`` and ``x``; beyond 64 bits they end at the nearest long."""
    with np.errstate(over="ignore"):
        if _exact(q, x):
            return (q @ x.T * UNIT).astype(np.int64)
    return np.clip(_wide(q) @ _wide(x).T, -MOST, MOST).astype(np.int64)


def pair_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same of each row of ``q`` with the row of ``x`` in its place."""
    with np.errstate(over="ignore"):
        if _exact(q, x):
            return (np.einsum("ij,ij->i", q, x) * UNIT).astype(np.int64)
    return np.clip((_wide(q) * _wide(x)).sum(axis=1), -MOST, MOST).astype(np.int64)


class Search:
    """Queries of one dimension, each with its k best rows so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, low: np.ndarray | None = None):
        """``low``: scores that k rows are known to reach."""
        self.ids, self.x, self.k = ids, x, k
        self.levels = [statistics(x, n) for n in LEVELS] if x.shape[1] else []
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((x * x).sum(axis=1))
        self.low = np.full(len(ids), -MOST - 1) if low is None else low.copy()  # the k-th best score
        # The same for bounds, which are of products that have not been multiplied.
        self.least = np.where(self.low <= -MOST, -np.inf, self.low / UNIT)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2] * len(ids)
        self.pairs = self.exact = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(ids), ROW_BLOCK):
            part = x[a : a + ROW_BLOCK]
            stats = [statistics(part, n) for n in LEVELS] if x.shape[1] else []
            for b in range(0, len(self.ids), QUERY_BLOCK):
                self._block(b, min(b + QUERY_BLOCK, len(self.ids)), ids[a : a + ROW_BLOCK], part, stats)

    @np.errstate(over="ignore", invalid="ignore")
    def _block(self, low: int, high: int, ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray]) -> None:
        least = self.least[low:high]
        alive = self.ids[low:high, None] != ids[None, :]
        self.pairs += alive.size
        # What rounding may take from a bound.
        least_and_slack = least[:, None] - 1e-9 * (self.norm[low:high, None] * np.sqrt((x * x).sum(axis=1)) + np.abs(np.where(np.isinf(least), 0, least))[:, None])
        for level, mine in zip(self.levels, stats, strict=True):
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            cell = np.ix_(rows, cols)
            alive[cell] &= ~(level[low:high][rows] @ mine[cols].T < least_and_slack[cell])  # a bound that overflows gives nothing up
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        self.exact += int(alive.sum())
        if not len(rows):
            return
        alive = alive[np.ix_(rows, cols)]
        mine, theirs = self.x[low:high][rows], x[cols]
        if alive.sum() < SPARSE * alive.size:
            got, (i, j) = np.zeros(alive.shape, dtype=np.int64), np.nonzero(alive)
            got[i, j] = pair_scores(mine[i], theirs[j])
        else:
            got = scores(mine, theirs)
        fits = alive & (got >= self.low[low:high][rows][:, None])
        for n in np.flatnonzero(fits.any(axis=1)).tolist():
            i, new = low + int(rows[n]), np.flatnonzero(fits[n])
            s, r = np.concatenate([self.best[i][0], got[n, new]]), np.concatenate([self.best[i][1], ids[cols[new]]])
            keep = np.lexsort((r, -s))[: self.k]
            self.best[i] = s[keep], r[keep]
            if len(keep) == self.k and s[keep[-1]] > self.low[i]:
                self.low[i] = s[keep[-1]]
                self.least[i] = s[keep[-1]] / UNIT if s[keep[-1]] < MOST else -np.inf  # one that is cut says nothing


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, the components as doubles, of vectors with an id and finite components only; the longest first in each part.

    Rows that share an id are one row; the vector that sorts first stands for them.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    # A component that is null, infinite or not a number rules its vector out.
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).sortWithinPartitions(F.col("norm").desc())


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floors of a batch, by dimension."""
    ids, col = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    flat, sizes = floors(col.flatten().to_numpy(zero_copy_only=False)), np.diff(col.offsets.to_numpy())
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, query_bytes: int = QUERY_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product of each query, a row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, ties to the smaller ``vec_id``; fewer than k rows where
    there are no more.  Components are taken as floor(256 * x).  Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; rows that share an id are one; a query meets vectors of its own
    dimension only, and its own row never; a table without queries gives none; further columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialise(clean(vectors, id_col, vector_col))
    queries = rows.where(F.col("vec_id") % every == 0)
    cost = 8 * F.size("v") + 64
    size = queries.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    groups = max(1, -(-2 * size // query_bytes))
    seeds = spark.sparkContext.broadcast(_seeds(rows, cost))  # SEED_BYTES at most, or one row
    parts = []
    for g in range(groups):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else queries
        started = materialise(mine.select("vec_id", "v").mapInArrow(_start(seeds, k), "vec_id long, v array<double>, low long"))
        held: dict[int, list] = {}
        for r in started.toLocalIterator():  # about query_bytes / 2 at most
            held.setdefault(len(r.v), []).append((r.vec_id, floors(np.array(r.v)), r.low))
        by_dim = {d: (np.array([x[0] for x in some], dtype=np.int64), np.stack([x[1] for x in some]), np.array([x[2] for x in some], dtype=np.int64)) for d, some in held.items()}
        known = spark.sparkContext.broadcast(by_dim)
        parts.append(materialise(rows.select("vec_id", "v").mapInArrow(_search(known, k), "query_id long, vec_id long, score long")))
        # What is written needs this group's queries no more.
        known.destroy()
        discard(started)
    found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _seeds(rows: DataFrame, cost: Column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The longest rows, by dimension."""
    widest = rows.agg(F.coalesce(F.max(cost), F.lit(1))).first()[0]
    some: dict[int, list] = {}
    for r in rows.orderBy(F.col("norm").desc(), "vec_id").limit(max(1, SEED_BYTES // widest)).collect():
        some.setdefault(len(r.v), []).append((r.vec_id, floors(np.array(r.v))))
    return {d: (np.array([x[0] for x in found], dtype=np.int64), np.stack([x[1] for x in found])) for d, found in some.items()}


def _start(seeds, k: int):
    """Queries with their k-th best score among the seeds."""

    def run(batches):
        for b in batches:
            low = np.full(b.num_rows, -MOST - 1)
            at = {i: n for n, i in enumerate(b.column("vec_id").to_pylist())}
            for ids, x in _arrays(b):
                if x.shape[1] in seeds.value:
                    s = Search(ids, x, k)
                    s.add(*seeds.value[x.shape[1]])
                    low[[at[i] for i in ids.tolist()]] = s.low
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(low)], names=["vec_id", "v", "low"])

    return run


def _search(known, k: int):
    """The best rows of each task for every query."""

    def run(batches):
        by_dim = {d: Search(ids, x, k, low) for d, (ids, x, low) in known.value.items()}
        for batch in batches:
            for ids, x in _arrays(batch):
                if x.shape[1] in by_dim:
                    by_dim[x.shape[1]].add(ids, x)
        for s in by_dim.values():
            n = [len(b[0]) for b in s.best]
            if sum(n):
                cols = [np.repeat(s.ids, n), np.concatenate([b[1] for b in s.best]), np.concatenate([b[0] for b in s.best])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run
