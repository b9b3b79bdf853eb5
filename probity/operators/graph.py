"""Connected components of pairs, by rounds of star contraction.

Each task first joins its own pairs with union-find and keeps one row for each
node, (node, smallest node reached), so a hot node leaves a task once. A round
then gives every node with several roots the smallest of them, ties the others to
it, and follows roots that have roots themselves. Rounds end when nothing
changes; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.sources.scratch import materialize


def forest(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Union-find with the smallest node as root: node -> root, roots left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: list[tuple[int, int]] = []
    for batch in batches:
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(pairs) > 1 << 20:  # never more than a node's row each
            pairs = list(forest(pairs).items())
    rows = forest(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.int64())], names=["node", "root"])


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of pairs (two long columns) but the roots:
    root is the smallest node of the component."""
    compact = lambda df: materialize(df.mapInArrow(_local, "node long, root long"), "components")
    stars, before = compact(pairs), None
    while True:
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return stars
        before = seen
        roots = stars.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots"))
        tied = roots.select(
            F.inline(F.transform(F.concat(F.array("node"), F.slice("roots", F.lit(2), F.size("roots"))), lambda x: F.struct(x.alias("node"), F.col("roots")[0].alias("root"))))
        )
        tied = materialize(tied, "components-tied")
        up = tied.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("up"))
        stars = compact(tied.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))


