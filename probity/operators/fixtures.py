"""Contributed pools with known attacks, derived from vectors by arithmetic alone:
the same input gives the same pool, in any engine.

Contributors C1..C5 share the rows by id. C1 and C2 are clean. C3 stamps a trigger
on every 20th of its rows and labels them 0. C4 swaps labels 3 and 5 on every
fifth. C5 floods: every 20th row comes with five near copies, and every 20th other
row is out of distribution. gt_attack tells, for evaluation only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.vectors import norm, normalised
from probity.operators.ordering import dense_index

COPIES, NOISE, TRIGGER_DIMS = 5, 0.02, 8


def near_copies(vectors: DataFrame, copies: int = COPIES, noise: float = NOISE) -> DataFrame:
    """(id, origin, vector) copies of (id, vector), each moved by a little and brought to length one."""
    rows = vectors.select(F.col("id").alias("origin"), "vector", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    wave = lambda i: F.sin(F.col("origin") * 13.0 + i * 7.0 + F.col("copy") * 3.0)
    moved = F.transform("vector", lambda x, i: x.cast("double") + noise * wave(i))
    return rows.select((F.lit(1_000_000_000) + F.col("origin") * 10 + F.col("copy")).alias("id"), "origin", moved.alias("vector")).withColumn("vector", normalised(F.col("vector")))


def _direction(seed: Column) -> Column:
    """A vector's direction that depends on seed alone, of the vector's length:
    chirps, those of two seeds nearly orthogonal."""
    wave = F.transform("vector", lambda x, i: F.sin((i + 1) * (i + 1 + 3.0 * seed) * 1.7))
    return F.transform(wave, lambda x: x / norm(wave))


def planted_pool(vectors: DataFrame) -> DataFrame:
    """(id, contributor, label, vector, gt_attack) from (id, label, vector)."""
    turn = F.floor(F.col("id") / 5)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "vector")
    rows = rows.withColumn("contributor", F.concat(F.lit("C"), (F.col("id") % 5 + 1).cast("string"))).withColumn("turn", turn)
    attack = (
        F.when((F.col("contributor") == "C3") & (F.col("turn") % 20 == 0) & (F.col("label") != 0), "badnets")
        .when((F.col("contributor") == "C4") & (F.col("turn") % 5 == 0) & F.col("label").isin(3, 5), "flip")
        .when((F.col("contributor") == "C5") & (F.col("turn") % 20 == 1), "dup_source")
        .when((F.col("contributor") == "C5") & (F.col("turn") % 20 == 2), "ood")
        .otherwise("none")
    )
    rows = rows.withColumn("gt_attack", attack)
    centre = _direction(F.col("label"))
    in_class = F.zip_with("vector", centre, lambda x, c: 0.6 * x.cast("double") + 0.8 * c)
    stamped = F.transform(in_class, lambda x, i: F.when(i < TRIGGER_DIMS, 0.6).otherwise(x))
    strange = F.zip_with("vector", _direction(F.lit(99)), lambda x, c: 0.6 * x.cast("double") - 0.8 * c)
    shaped = F.when(F.col("gt_attack") == "badnets", stamped).when(F.col("gt_attack") == "ood", strange).otherwise(in_class)
    label = F.when(F.col("gt_attack") == "badnets", 0).when(F.col("gt_attack") == "flip", 8 - F.col("label")).otherwise(F.col("label"))
    # the vector first: it depends on the label before the attack
    rows = rows.withColumn("vector", normalised(shaped)).withColumn("label", label).select("id", "contributor", "label", "vector", "gt_attack")
    copies = near_copies(rows.where("gt_attack = 'dup_source'").select("id", "vector")).join(rows.select(F.col("id").alias("origin"), "contributor", "label"), "origin")
    return rows.unionByName(copies.select("id", "contributor", "label", "vector", F.lit("dup").alias("gt_attack")))


def class_places(samples: DataFrame, by: str, key: Column) -> DataFrame:
    """samples with place: 0, 1, ... within each group in the order of key, then id.
    Places come from one dense index, so no task holds a whole group."""
    numbered = dense_index(samples.withColumn("_key", key), [by, "_key", "id"], "_n")
    starts = numbered.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_start"))  # a row for each group
    return numbered.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("_by"))).withColumn("place", F.col("_n") - F.col("_start")).drop("_n", "_by", "_start", "_key")


def stratified_split(samples: DataFrame, contributors: int = 5) -> DataFrame:
    """samples (id, label) with split and contributor: of each class a tenth is held out,
    a tenth is for evaluation, and the rest goes round the contributors."""
    placed = class_places(samples, "label", F.md5(F.col("id").cast("string")))
    tenth = F.col("place") % 10
    split = F.when(tenth == 0, "heldout").when(tenth == 1, "eval").otherwise("pool")
    turn = (F.floor(F.col("place") / 10) * 8 + tenth - 2) % contributors + 1
    return placed.withColumn("split", split).withColumn("contributor", F.when(split == "pool", F.concat(F.lit("C"), turn.cast("string")))).drop("place")


def flooded(batches: DataFrame, plan: DataFrame) -> DataFrame:
    """Batches (id, contributor) with gt_attack, after the attacks of plan (contributor,
    share, copies), a row for each attacker: a share of its rows is repeated copies times
    and as large a share is out of distribution; as many originals as there are copies
    are dropped, so a batch keeps its size."""
    placed = class_places(batches, "contributor", F.sha2(F.col("id").cast("string"), 256)).join(F.broadcast(plan), "contributor", "left")
    sizes = batches.groupBy("contributor").agg(F.count("*").alias("_size"))
    placed = placed.join(F.broadcast(sizes), "contributor", "left")
    bases = F.coalesce(F.floor(F.col("_size") * F.col("share")), F.lit(0))
    copies = F.coalesce("copies", F.lit(0))
    attack = F.when(F.col("place") < bases, "dup_source").when(F.col("place") < 2 * bases, "ood").when(F.col("place") < (2 + copies) * bases, "dropped").otherwise("none")
    marked = placed.withColumn("gt_attack", attack).drop("place", "share", "_size")
    near = marked.where("gt_attack = 'dup_source'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    near = near.withColumn("id", F.lit(1_000_000_000) + F.col("id") * 10 + F.col("copy")).withColumn("gt_attack", F.lit("dup")).drop("copy", "copies")
    return marked.where("gt_attack <> 'dropped'").drop("copies").unionByName(near)
