"""Near-duplicate vectors by sorted passes of random projections.

Equal vectors of a label are one class. In each pass every class gets a key, the
concatenated signs of the pass's own 62 random projections, and all classes are put
in the lexicographic order of label and key, in ranges. The order is cut into windows
of WINDOW neighbours; each window is compared with itself and the next one by exact
cosine, as matrix products. A window is widened by further ones while those go on with
the first PREFIX bits of its last key, so two vectors of one label with the same first
bits always meet, also across borders of windows and ranges and in dense cones, where
many vectors share them.

A pair at the threshold has the same first bits with probability (1 - angle/pi) **
bits, wherever other vectors lie, so passes are as many as leave a miss below 1e-4. bits
is PREFIX, and more for labels of so many classes that windows would widen often. Links
of all passes are united. Exact links then are counted inside each component, by
blocks of 512; only counts leave a task.

Edge cases. Null label, null vec_id, null, empty or zero vector, null or
non-finite component: the row links with nothing (n_links 0, its own component).
Repeated rows are copies of each other and link. Vectors of different lengths
never link. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.shared import materialize, parallelism, runs
from probity.operators.graph import connected_components
from probity.operators.ordering import dense_index

WINDOW, PREFIX, KEY_BITS, BLOCK = 256, 12, 62, 512


def usable(embedding: Column) -> Column:
    """The vector is not null or empty, holds finite numbers only, and isn't zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of a list column as rows of length one, in double precision."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bits_and_passes(classes: int, threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """First bits that always meet, and passes, for a label of so many classes."""
    bits = min(KEY_BITS, max(PREFIX, math.ceil(math.log2(max(1, 4 * classes / WINDOW)))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if share == 1 else math.ceil(math.log(miss) / math.log(1 - share))


def _keys(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), passes * KEY_BITS))
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    signs = (unit_rows(rows.column("embedding"), int(dim)) @ planes[dim] > 0).reshape(rows.num_rows, passes, KEY_BITS)
                    keys = signs @ place
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, p), pa.int32()), *rows.columns, pa.array(keys[:, p])], names=["pass", *rows.schema.names, "key"])

    return run


def _sides(tile: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of block i, rows of block j (the same ones where i is j), and their cosines."""
    x = unit_rows(tile.column("embedding").combine_chunks(), dim)
    block = np.asarray(tile.column("block"))
    left, right = (np.flatnonzero(block == np.asarray(tile.column(c))[0]) for c in ("i", "j"))
    return left, right, x[left] @ x[right].T


def _window_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of a pair of windows come together; each node's smallest linked one, if smaller."""
    for tile in runs(batches, ("i", "j")):
        dims = np.asarray(tile.column("dim"))
        for dim in np.unique(dims):
            rows = tile.filter(pa.array(dims == dim))
            node, turn, label = (np.asarray(rows.column(c)) for c in ("node", "pass", "label"))
            left, right, cosine = _sides(rows, int(dim))
            near = (cosine >= threshold) & (turn[left][:, None] == turn[right][None, :]) & (label[left][:, None] == label[right][None, :])
            # the smallest node reached: names spread until none changes
            name, before, none = node.copy(), None, np.iinfo(np.int64).max
            while len(left) and len(right) and (before is None or (name != before).any()):
                before = name.copy()
                name[left] = np.minimum(name[left], np.where(near, name[right][None, :], none).min(1))
                name[right] = np.minimum(name[right], np.where(near, name[left][:, None], none).min(0))
            part = name != node
            yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(name[part])], names=["a", "b"])


def _count_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of a pair of blocks of a component come together; per node, copies linked with it."""
    for tile in runs(batches, ("comp", "i", "j")):
        node, copies = np.asarray(tile.column("node")), np.asarray(tile.column("copies"))
        left, right, cosine = _sides(tile, tile.column("dim")[0].as_py())
        near = (cosine >= threshold) & (node[left][:, None] != node[right][None, :])
        found = [(node[left], near @ copies[right])]
        if tile.column("i")[0] != tile.column("j")[0]:
            found.append((node[right], copies[left] @ near))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["node", "linked"])


def embedding_classes(vectors: DataFrame, threshold: float = 0.98, seed: int = 42) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept."""
    n = parallelism(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    if dict(rows.dtypes)["embedding"] != "array<float>":  # floats stay so between tasks; cosines are of doubles
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = dict(rows.dtypes)["embedding"]
    part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = materialize(rows.withColumn("part", part), "vector-rows")
    classes = rows.where("part").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, passes = bits_and_passes(largest, threshold)
    keyed = classes.select("dim", "label", "node", "embedding").mapInArrow(_keys(passes, seed), f"pass int, dim int, label long, node long, embedding {kind}, key long")
    placed = dense_index(keyed, ["pass", "dim", "label", "key", "node"], "pos").withColumn("block", F.floor(F.col("pos") / WINDOW))
    placed = materialize(placed, "vector-order")
    # a window meets itself, the next one, and those that begin with the first bits that its last key has
    beginning = F.struct("pass", "dim", "label", F.shiftright("key", KEY_BITS - bits).alias("first"))
    windows = placed.groupBy("block").agg(F.min_by(beginning, "pos").alias("head"), F.max_by(beginning, "pos").alias("tail"))
    windows = materialize(windows, "vector-windows")
    reach = windows.groupBy(F.col("head").alias("tail")).agg(F.max("block").alias("reach"))
    pairs = windows.join(reach, "tail", "left").select(F.col("block").alias("i"), F.explode(F.sequence("block", F.greatest(F.coalesce("reach", "block"), F.col("block") + 1))).alias("j"))
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = placed.select("block", "pass", "dim", "label", "node", "embedding").join(sides, "block")
    found = dealt.repartition(n, "i", "j").sortWithinPartitions("i", "j").mapInArrow(partial(_window_links, threshold=threshold), "a long, b long")
    labels = connected_components(found)

    # every member of a component of two classes or more: the roots too
    grouped = labels.select("node", F.col("root").alias("comp")).union(labels.select("root", "root").distinct())
    grouped = materialize(grouped, "vector-comps")
    sizes = materialize(grouped.groupBy("comp").agg(F.count("*").alias("members")), "vector-sizes")
    members = classes.join(grouped, "node").join(sizes, "comp")
    blocks = F.ceil(F.col("members") / BLOCK)
    members = materialize(members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), blocks)), "vector-members")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    laid = members.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    counted = (
        laid.select("comp", "i", "j", "block", "dim", "node", "copies", "embedding")
        .repartition(n, "comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j")
        .mapInArrow(partial(_count_links, threshold=threshold), "node long, linked long")
        .groupBy("node")
        .agg(F.sum("linked").alias("linked"))
    )
    first = materialize(members.groupBy("comp").agg(F.min("first_id").alias("comp_first")), "vector-first")
    counted = materialize(counted, "vector-linked")
    verdict = members.select("node", "comp").join(counted, "node", "left").join(first, "comp", "left").drop("comp")
    verdict = classes.select("node", "label", "embedding", "first_id", "copies").join(verdict, "node", "left").drop("node")
    verdict = materialize(verdict, "vector-verdict")
    # joined by the vectors themselves; where one is hot, adaptive execution splits its rows
    out = rows.where("part").join(verdict, ["label", "embedding"]).unionByName(rows.where("not part"), allowMissingColumns=True)
    out = out.select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("comp_first", "first_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
