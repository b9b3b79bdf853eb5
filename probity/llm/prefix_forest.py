"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt by a hash into shards of at most about 16,384 (at least 32 shards,
so that a cluster has work for its cores). Each shard holds a forest: in every
tree a row has a string of 32 bits, the signs of its own random projections, and
the tree is the sorted array of these strings. A query descends in all trees to
its longest matching prefixes and ascends in all of them at once, one bit at a
time, until the ranges of rows with the common prefix hold enough candidates.
Distances are computed for candidates alone, and candidates are ranked by exact
Euclidean distance in double precision, with all that tie.

Every row is indexed and every query visits every shard, so recall does not
depend on the number of shards. At the default `depth_share` the candidates are about
half of a shard of random 64-dimensional vectors, the hardest case, where recall
is 0.98; a smaller share trades recall for work.

Edge cases. Rows with a null vec_id or a null, empty or zero vector, or with null
or non-finite components, take no part, as query or candidate. Vectors meet only
others of their length. Repeated rows are candidates of their own, except that a
row is never a candidate for a query with its vec_id. Ties go to the smaller
vec_id. Fewer than k candidates: all of them. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.embedding_dedup import usable
from probity.llm.shared import parallelism

TREES, BITS = 64, 32
SHARD_ROWS, LEAST_SHARDS = 16_384, 32
QUERY_BATCH = 128


class Forest:
    """Sorted arrays of hash strings over one shard's rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int) -> None:
        self.ids, self.x = ids, x
        self.planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], TREES * BITS)).astype(np.float32)
        keys = self.hash(x)
        self.order = np.argsort(keys, axis=0, kind="stable").T.copy()  # [tree, place]
        self.keys = np.take_along_axis(keys.T, self.order, 1)
        self.square = (x * x).sum(1)

    def hash(self, x: np.ndarray) -> np.ndarray:
        """[row, tree] strings of BITS bits."""
        out = []
        for at in range(0, len(x), 1024):
            bits = (x[at : at + 1024].astype(np.float32) @ self.planes > 0).reshape(-1, TREES, BITS)
            out.append(np.packbits(bits, axis=2).view(">u4")[:, :, 0].astype(np.uint32))
        return np.concatenate(out) if out else np.zeros((0, TREES), np.uint32)

    def candidates(self, keys: np.ndarray, least: float) -> np.ndarray:
        """[query, row] mask: ascend from full strings until ranges hold `least` rows in all trees together."""
        q, n = len(keys), len(self.ids)
        low, high = np.zeros((q, TREES), np.int64), np.full((q, TREES), n, np.int64)
        open_ = np.ones(q, bool)
        for depth in range(min(BITS, max(1, n - 1).bit_length() + 8), 0, -1):
            mask = np.uint32((0xFFFFFFFF << (BITS - depth)) & 0xFFFFFFFF)
            first = keys[open_] & mask
            a, b = np.empty(first.shape, np.int64), np.empty(first.shape, np.int64)
            for t in range(TREES):
                a[:, t] = np.searchsorted(self.keys[t], first[:, t], "left")
                b[:, t] = np.searchsorted(self.keys[t], first[:, t] | ~mask, "right")
            enough = (b - a).sum(1) >= least
            rows = np.flatnonzero(open_)[enough]
            low[rows], high[rows] = a[enough], b[enough]
            open_[rows] = False
            if not open_.any():
                break
        found = np.zeros((q, n), bool)
        rows = np.arange(q)
        for t in range(TREES):
            edges = np.zeros((q, n + 1), np.int8)
            edges[rows, low[:, t]] += 1
            edges[rows, high[:, t]] -= 1
            found[:, self.order[t]] |= np.cumsum(edges[:, :n], axis=1, dtype=np.int8) > 0
        return found

    def nearest(self, ids: np.ndarray, x: np.ndarray, k: int, depth_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row id, distance) of the k nearest candidates of each query."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found = self.candidates(self.hash(x), depth_share * len(self.ids)) & (ids[:, None] != self.ids[None, :])
        for i, mask in enumerate(found):
            rows = np.flatnonzero(mask)
            if len(rows) > k:
                near = self.square[rows] - 2 * (self.x[rows] @ x[i])
                # all that rounding could bring among the k nearest, so all ties of the k-th too
                slack = 1e-12 * len(x[i]) * (self.square[rows].max() + x[i] @ x[i])
                rows = rows[near <= np.partition(near, k - 1)[k - 1] + slack]
            exact = np.sqrt(((x[i] - self.x[rows]) ** 2).sum(1))
            order = np.lexsort((self.ids[rows], exact))[:k]
            out.append((np.full(len(order), ids[i]), self.ids[rows[order]], exact[order]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(k: int, depth_share: float, seed: int):
    """Rows come sorted by (shard, dim), a shard's rows before the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, rows, forest = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "dim", "is_query")), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a][:2] != mark:
                    mark, rows, forest = keys[a][:2], [], None
                part = batch.slice(a, b - a)
                ids, x = np.asarray(part.column("vec_id")), np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, keys[a][1])
                if not keys[a][2]:
                    rows.append((ids, x))
                    continue
                if rows:
                    forest, rows = Forest(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), seed), []
                if forest is not None:
                    for at in range(0, len(ids), QUERY_BATCH):
                        found = forest.nearest(ids[at : at + QUERY_BATCH], x[at : at + QUERY_BATCH], k, depth_share)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, depth_share: float = 0.6, seed: int = 42) -> DataFrame:
    """Per row for which is_query holds, its k nearest others: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_ROWS))
    home = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(seed)), F.lit(shards)).cast("int")
    indexed = rows.select(home.alias("shard"), "dim", F.lit(False).alias("is_query"), "vec_id", "embedding")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(True).alias("is_query"), "vec_id", "embedding")
    found = (
        indexed.union(asked)
        .repartition(parallelism(vectors.sparkSession), "shard", "dim")
        .sortWithinPartitions("shard", "dim", "is_query", "vec_id")
        .mapInArrow(_search(k, depth_share, seed), "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
