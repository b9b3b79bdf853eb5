"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of its documents in the order of a seeded hash. The
stream is cut into blocks of whole documents of about 1/1024 of the source's
words; a second hash permutes the blocks. A source that is to give `target`
words gives all its blocks `target // size` times and then permuted blocks up to
the words that are left; of the last block documents up to that point, of the
last document words up to it (or the nearer of all and none with
whole_documents).

The drawn blocks are dealt to the output shards by a tree: at the root stands the
vector of the sources' block quotas; each node gives its left half of shards a
multivariate-hypergeometric draw from its quotas, the right half the rest. So all
quotas are met exactly, shards are equally full, and each is a random mix. A
shard takes the next blocks of each source's permuted sequence, disjoint from
other shards', and orders documents by a third hash.

The driver holds one row for each source, never one for each document. A hot
source is spread over buckets of about 2048 documents whose totals are summed
first, so that no window or task has to hold it.

Edge cases. Null source: a source of its own, last in order. Null or empty text:
size 0, nothing taken. Repeated rows: documents of their own. Empty table: no
rows. Columns other than doc_id, source and text are ignored, so clashing names
do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.shared import materialize, word_count

BLOCKS_PER_SOURCE = 1024
BUCKET_DOCS = 2048
BROADCAST_SOURCES = 20_000  # rows of a few dozen bytes


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.0  # of all words
    max_repeats: float = 3.0
    words_per_shard: int = 1 << 22
    seed: int = 42
    whole_documents: bool = False


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets in proportion to weights, none above cap * size; what is above is
    shared again by weight among the others until none is above."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in sorted(open_) if unit * weights[i] > cap * sizes[i]]
        if not above:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in above:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts [shard, source] whose columns sum to the quotas, by a splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)
    rng = np.random.default_rng(seed)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, q = nodes.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        take = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if take else np.zeros_like(q)
        nodes += [(mid, hi, q - left), (lo, mid, left)]
    return out


def mix_sources(docs: DataFrame, params: MixParams = MixParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and draws,
    an array of (epoch, shard, words, place): how many of its words that epoch
    takes, into which shard, and where in the shard's local order. Columns of docs
    that keep names go along."""
    spark = docs.sparkSession
    seed = F.lit(params.seed)
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            *keep,
        ).withColumn("skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
        .withColumn("h", F.xxhash64("doc_id", seed)),
        "mix-sizes",
    )
    stats = base.groupBy("skey").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("source_size")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in stats]
    weights = [params.weights[i % len(params.weights)] for i in range(len(stats))]
    targets = water_fill(sizes, weights, params.share * sum(sizes), params.max_repeats)
    dim = []
    for r, t in zip(stats, targets, strict=True):
        size, want = r["source_size"], min(round(t), int(params.max_repeats * r["source_size"]))
        full = want // size if size else 0
        dim.append((r["skey"], size, float(t), full, want - full * size, max(1, -(-size // BLOCKS_PER_SOURCE)), -(-r["n"] // BUCKET_DOCS)))
    sources = spark.createDataFrame(dim, "skey string, source_size long, target double, full long, rest long, block_words long, buckets long")

    if len(dim) <= BROADCAST_SOURCES:  # else a shuffled join, whose hot keys Spark splits
        sources = F.broadcast(sources)

    # dealt by bucket: the join's own partitioning would do for the window, but holds a hot source in one task
    spread = base.join(sources, "skey").withColumn("bucket", F.pmod("h", "buckets")).repartition("skey", "bucket")
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("skey", "bucket").agg(F.sum("size").alias("w")).select("skey", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("off"))
    run = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        spread.withColumn("run", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(offsets, ["skey", "bucket"])
        .withColumn("start", F.col("off") + F.col("run"))
        .withColumn("block", F.floor(F.col("start") / F.col("block_words")))
        .drop("run", "off", "bucket", "buckets")
    )
    placed = materialize(placed, "mix-placed")

    perm = Window.partitionBy("skey").orderBy(F.xxhash64("skey", "block", seed), "block")
    blocks = (
        placed.groupBy("skey", "block", "full", "rest")
        .agg(F.sum("size").alias("words"), F.min("start").alias("block_start"))
        .withColumn("rank", F.row_number().over(perm).cast("long") - 1)
        .withColumn("ahead", F.coalesce(F.sum("words").over(perm.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    blocks = materialize(blocks, "mix-blocks")  # at most 1025 rows for each source
    counts = blocks.groupBy("skey").agg(F.count("*").alias("nb"), F.first("full").alias("full"), F.count_if(F.col("ahead") < F.col("rest")).alias("part")).collect()
    counts.sort(key=lambda r: r["skey"])
    quotas = np.array([r["full"] * r["nb"] + r["part"] for r in counts], np.int64)
    shards = max(1, round(sum(min(round(t), params.max_repeats * s) for t, s in zip(targets, sizes, strict=True)) / params.words_per_shard))
    shards = max(1, min(shards, int(quotas.sum())))  # a shard takes whole blocks
    dealt = np.cumsum(split_quotas(quotas, shards, params.seed), axis=0) if len(quotas) else np.zeros((shards, 0), np.int64)
    tree = spark.createDataFrame([(r["skey"], int(r["nb"]), [int(x) for x in dealt[:, i]]) for i, r in enumerate(counts)], "skey string, nb long, upto array<long>")

    epochs = F.sequence(F.lit(0).cast("long"), F.col("full"))
    drawn = F.filter(epochs, lambda e: (e < F.col("full")) | (F.col("ahead") < F.col("rest")))
    # the first shard whose cumulated count exceeds the draw's place in the source's sequence
    shard_of = lambda e: F.size(F.filter("upto", lambda u: u <= e * F.col("nb") + F.col("rank")))
    block_draws = blocks.join(tree, "skey").select(
        "skey", "block", "block_start", "ahead", F.transform(drawn, lambda e: F.struct(e.alias("epoch"), shard_of(e).alias("shard"))).alias("block_draws")
    )
    left = F.col("rest") - F.col("ahead") - (F.col("start") - F.col("block_start"))
    if params.whole_documents:
        cut = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    else:
        cut = F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    words = lambda d: F.when(d["epoch"] < F.col("full"), F.col("size")).otherwise(cut)
    draws = F.transform(
        "block_draws",
        lambda d: F.struct(
            d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).alias("words"), F.xxhash64(d["shard"], d["epoch"], F.col("h"), seed).alias("place")
        ),
    )
    return (
        placed.join(block_draws, ["skey", "block"])
        .withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws", *keep,
        )
    )


def mixed_documents(docs: DataFrame, params: MixParams = MixParams(whole_documents=True)) -> DataFrame:
    """The mix as documents: the rows of docs, each as often as the mix takes it
    whole, whatever its doc_id; documents without words are left out. Same columns as docs."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("node"))
    numbered = materialize(numbered, "mix-rows")
    mix = mix_sources(numbered.select("row.doc_id", "row.source", "row.text", "node"), params, keep=("node",))
    taken = mix.where("size(draws) > 0").select("node", F.sequence(F.lit(1), F.size("draws")).alias("times"))
    return numbered.join(taken, "node").select("row", F.explode("times")).select("row.*")
