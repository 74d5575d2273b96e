"""Exact search for the highest inner products by MaxScore over the components of vectors.

A component is a term, the rows in which it is not zero its posting list. For each
query the lists fall into essential ones and others, whose upper bounds together
stay below the score that a row must reach: only rows on essential lists are
scored, and the other components of a row are looked up, in order of their
bounds, as long as it can still reach that score. Shards of rows are searched by
themselves against blocks of queries; their best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches
from trialloom.session import settle

SCALE = 1024
K = 10
#: A block of queries, which is broadcast, holds at most so many queries and components.
BLOCK_QUERIES, BLOCK_COMPONENTS = 1 << 16, 1 << 22
#: Components of a shard of rows that is searched at once.
SHARD = 1 << 19
#: Queries whose essential lists are traversed together, rows of the block that set the first thresholds, components looked up at once.
GROUP, SEEDS, STEP = 64, 1024, 8
#: Whole numbers up to here are exact in doubles.
EXACT = float(1 << 53)
_NONE = float("-inf")


class Queries:
    """A block of queries: vectors by length, with the best rows and the threshold of each query in this task."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray], keep: int):
        self.number, self.ids, self.keep = number, ids, keep
        size = np.array([len(v) for v in vectors], np.int64)
        self.groups = [(at := np.flatnonzero(size == d), np.array([vectors[i] for i in at], float).reshape(len(at), d))
                       for d in np.unique(size)]

    def start(self) -> None:
        n = len(self.number)
        self.threshold = np.full(n, _NONE)
        self.best: list[tuple | None] = [None] * n
        seeds = [m[:SEEDS] for _, m in self.groups]
        for at, own in self.groups:
            for a in range(0, len(at), GROUP):
                part = own[a:a + GROUP]
                width = [min(part.shape[1], s.shape[1]) for s in seeds]
                if any(w and len(s) and np.abs(part).max() * np.abs(s).max() * w >= EXACT
                       for w, s in zip(width, seeds, strict=True)):
                    continue  # too large for doubles: these start without a threshold
                found = np.concatenate([part[:, :w] @ s[:, :w].T for w, s in zip(width, seeds, strict=True)], axis=1)
                if found.shape[1] >= self.keep:
                    self.threshold[at[a:a + GROUP]] = np.partition(found, -self.keep, axis=1)[:, -self.keep]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, own: np.ndarray) -> None:
        """Rows that reach the threshold join the best of a query."""
        if len(scores) > 4 * self.keep:
            reach = scores >= np.partition(scores, -self.keep)[-self.keep]
            scores, ids, nulls, own = scores[reach], ids[reach], nulls[reach], own[reach]
        if self.best[q] is not None:
            scores, ids, nulls, own = (np.concatenate(x) for x in zip(self.best[q], (scores, ids, nulls, own), strict=True))
        order = np.lexsort((~own, ids, nulls, -scores))[:self.keep]
        self.best[q] = scores[order], ids[order], nulls[order], own[order]
        if len(order) == self.keep:
            self.threshold[q] = max(self.threshold[q], float(scores[order[-1]]))


class Shard:
    """Rows of one length: their components by row and, as posting lists, by component."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray):
        self.ids, self.nulls, self.rows = ids, nulls, rows
        self.lists = np.ascontiguousarray(rows.T)
        self.high, self.low = self.lists.max(axis=1, initial=_NONE), self.lists.min(axis=1, initial=np.inf)
        self.largest = float(np.abs(rows).max(initial=0.0))
        filled = np.count_nonzero(self.lists, axis=1)
        self.sparse = {int(d): np.flatnonzero(self.lists[d]) for d in np.flatnonzero(4 * filled < len(rows))}

    def search(self, queries: Queries) -> None:
        for at, own in queries.groups:
            for a in range(0, len(at), GROUP):
                self._group(queries, at[a:a + GROUP], own[a:a + GROUP])

    def _group(self, queries: Queries, at: np.ndarray, own: np.ndarray) -> None:
        width = min(own.shape[1], self.rows.shape[1])
        own = own[:, :width]
        large = np.abs(own).max(axis=1, initial=0.0) * self.largest * max(width, 1) >= EXACT
        for i in np.flatnonzero(large):
            self._whole(queries, at[i], own[i])
        at, own = at[~large], own[~large]
        if not len(at):
            return
        bounds = np.maximum(own * self.high[:width], own * self.low[:width])
        order = np.argsort(-bounds, axis=1, kind="stable")
        rest = np.zeros((len(at), width + 1))
        rest[:, :width] = np.cumsum(np.take_along_axis(bounds, order, 1)[:, ::-1], axis=1)[:, ::-1]
        below = rest < queries.threshold[at][:, None]
        # lists before ``cut`` are essential; where no tail stays below the threshold all are, and every row counts
        cut = np.where(below.any(axis=1), below.argmax(axis=1), width)
        essential = np.empty(own.shape, bool)
        np.put_along_axis(essential, order, np.arange(width) < cut[:, None], 1)
        weights = np.where(essential, own, 0.0)
        dense = np.array([d not in self.sparse for d in range(width)], bool)
        reached = weights[:, dense] @ self.lists[:width][dense] if dense.any() else np.zeros((len(at), len(self.ids)))
        everywhere = essential[:, dense].any(axis=1) | ~below.any(axis=1)
        for i in range(len(at)):
            score, on = reached[i], None
            if not everywhere[i]:
                on = np.zeros(len(self.ids), bool)
            for d in np.flatnonzero(essential[i] & ~dense):
                listed = self.sparse[d]
                score[listed] += own[i, d] * self.lists[d, listed]
                if on is not None:
                    on[listed] = True
            need = queries.threshold[at[i]]
            alive = score + rest[i, cut[i]] >= need
            alive = np.flatnonzero(alive if on is None else alive & on)
            score, k = score[alive], cut[i]
            while k < width and len(alive):
                look = order[i, k:k + STEP]
                score = score + self.rows[alive[:, None], look] @ own[i, look]
                k = min(k + STEP, width)
                still = score + rest[i, k] >= need
                alive, score = alive[still], score[still]
            if len(alive):
                self._offer(queries, at[i], own[i], alive, score)

    def _whole(self, queries: Queries, q: int, own: np.ndarray) -> None:
        """Products beyond the exact range of doubles: Python's integers, held at the limits of a long."""
        exact = [int(x) for x in own]
        score = np.array([min(max(sum(x * int(y) for x, y in zip(exact, r, strict=False)), -(1 << 63)), (1 << 63) - 1)
                          for r in self.rows], object)
        self._offer(queries, q, own, np.arange(len(self.ids)), score)

    def _offer(self, queries: Queries, q: int, own: np.ndarray, alive: np.ndarray, score: np.ndarray) -> None:
        ids, nulls = self.ids[alive], self.nulls[alive]
        same = (ids == queries.ids[q]) & ~nulls
        if same.any():
            same[same] = [len(r) == self.rows.shape[1] and np.array_equal(r, own) for r in self.rows[alive[same]]]
        queries.offer(q, score, ids, nulls, same)


def _scaled(values: pa.Array, scale: int) -> np.ndarray:
    return np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))


def _shards(batch: pa.RecordBatch, scale: int) -> Iterator[Shard]:
    ids = batch.column(0)
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    lists = batch.column(1)
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = _scaled(lists.flatten(), scale)
    size = np.diff(cuts)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        step = max(1, SHARD // max(int(d), 1))
        for a in range(0, len(at), step):
            part = at[a:a + step]
            rows = flat[cuts[part][:, None] + np.arange(d)]
            odd = np.abs(rows).max(axis=1, initial=0.0) >= 1 << 20  # by themselves: they may need whole numbers
            for kind in (~odd, odd):
                if kind.any():
                    yield Shard(ids[part[kind]], nulls[part[kind]], rows[kind])


def _blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries dealt to blocks of bounded size."""
    total = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    n = max(1, -(-total[0] // BLOCK_QUERIES), -(-total[1] // BLOCK_COMPONENTS))
    while True:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)))
        fullest = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long")).alias("c")).agg(
            F.max("n"), F.max(F.when(F.col("n") > 1, F.col("c")))).first()
        if (fullest[0] or 0) <= BLOCK_QUERIES and (fullest[1] or 0) <= BLOCK_COMPONENTS:
            return dealt, n
        n *= 2


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding",
                scale: int = SCALE) -> DataFrame:
    """The ``k`` highest inner products of every query row with all other rows: query, query_id, rank, vec_id, score.

    Components x count as floor(scale * x). ``is_query`` marks the query rows; a row is no
    candidate of itself, but a repeated row is one of its copies, and each repeated query
    row (told apart by ``query``) has its own result. Ties go to the smaller id, null ids
    come last. Vectors that are null or hold a component that is null or not finite (also
    after scaling) take no part; of vectors of different lengths the missing components
    count as 0, so an empty vector scores 0. Scores beyond a long are held at its
    limits. Without rows or queries the result is empty. Other columns are only read by
    ``is_query``.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float("inf")), F.lit(False)))
    fit = vectors.where(F.col(vector).isNotNull() & finite)
    rows = fit.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = settle(fit.where(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"),
                                              F.monotonically_increasing_id().alias("number")), "queries")
    dealt, n = _blocks(asked)
    shards = rows.coalesce(4 * spark.sparkContext.defaultParallelism)
    found = None
    for b in range(n):
        block = dealt.where(F.col("block") == b).select("number", "id", "v").toArrow()  # bounded by _blocks
        if not block.num_rows and n > 1:
            continue
        ids = block.column("id").fill_null(0).to_numpy()
        shared = spark.sparkContext.broadcast(
            (block.column("number").to_numpy(), ids,
             [np.floor(scale * np.asarray(v, np.float64)) for v in block.column("v").to_pylist()]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = Queries(*shared.value, k + 1)
            if not len(queries.number):
                return
            queries.start()
            for batch in batches:
                for shard in _shards(batch, scale):
                    shard.search(queries)
            kept = [(q, best) for q, best in enumerate(queries.best) if best is not None]
            for a in range(0, len(kept), 1024):
                part = kept[a:a + 1024]
                size = [len(best[0]) for _, best in part]
                at = np.repeat([q for q, _ in part], size)
                nulls = np.concatenate([best[2] for _, best in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries.number[at]), pa.array(queries.ids[at]),
                     pa.array(np.concatenate([best[1] for _, best in part]), mask=nulls),
                     pa.array([int(s) for _, best in part for s in best[0]], pa.int64()),
                     pa.array(np.concatenate([best[3] for _, best in part]))],
                    ["query", "query_id", "vec_id", "score", "own"])

        some = shards.mapInArrow(search, "query long, query_id long, vec_id long, score long, own boolean")
        if n > 1:
            some = settle(some, "found")
            shared.unpersist()
        found = some if found is None else found.unionByName(some)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("own"))
    merged = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    merged = merged.withColumn("self", F.min(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("query")))
    rank = F.col("at") - F.coalesce((F.col("at") > F.col("self")).cast("int"), F.lit(0))
    return merged.where(~F.col("at").eqNullSafe(F.col("self"))).select(
        "query", "query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
