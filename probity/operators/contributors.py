"""Per-contributor metrics, peer-relative robust scores and trust.

Samples are rows (sample_id, contributor, label, poison_flag, label_issue, in_dup,
ood_flag, dup_cluster); flags may be null, which counts as false. A contributor's
metrics are compared with those of its peers; there are few contributors beside
samples, so what follows the roll-up works on small tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.scalars import flag, rate

# Weights, floors of the spread, and limits of the trust score.
METRICS = ("poison_rate", "label_issue_rate", "dup_rate", "ood_rate", "class_skew")
WEIGHTS = {"poison_rate": 0.35, "label_issue_rate": 0.25, "dup_rate": 0.20, "ood_rate": 0.10, "class_skew": 0.10}
FLOORS = {"poison_rate": 0.004, "label_issue_rate": 0.004, "dup_rate": 0.004, "ood_rate": 0.004, "class_skew": 0.002}
FLAG_Z, SCALE, EPS, MAD_SCALE = 3.5, 5.0, 1e-6, 1.4826


def class_histogram(samples: DataFrame) -> DataFrame:
    """(contributor, label, n) for every contributor and every label of the pool, zeros included."""
    counts = samples.groupBy("contributor", "label").agg(F.count("*").alias("n"))
    grid = counts.select("contributor").distinct().join(F.broadcast(counts.select("label").distinct()), how="cross")
    return grid.join(counts, ["contributor", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def label_skew(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., contributor, class_skew) of counts (by..., contributor, label, n): base-2
    Jensen-Shannon divergence of a contributor's label histogram from the whole pool's,
    which includes it; of each group of by."""
    own = counts.groupBy(*by, "contributor").agg(F.sum("n").alias("total"))
    pool = counts.groupBy(*by, "label").agg(F.sum("n").alias("pool_n"))
    everything = counts.groupBy(*by).agg(F.sum("n").alias("pool_total"))
    meet = lambda a, b: a.join(F.broadcast(b), how="cross") if not by else a.join(b, list(by))
    grid = meet(meet(own, pool), everything).join(counts, [*by, "contributor", "label"], "left")
    p, q = F.coalesce("n", F.lit(0)) / F.col("total"), F.col("pool_n") / F.col("pool_total")
    middle = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return grid.groupBy(*by, "contributor").agg(F.greatest(F.lit(0.0), 0.5 * F.sum(part(p) + part(q))).alias("class_skew"))


def class_skew(samples: DataFrame) -> DataFrame:
    """(contributor, class_skew) of samples; see label_skew()."""
    return label_skew(samples.groupBy("contributor", "label").agg(F.count("*").alias("n")))


def contributor_rates(samples: DataFrame) -> DataFrame:
    return samples.groupBy("contributor").agg(
        F.count("*").alias("n_samples"),
        rate("poison_flag").alias("poison_rate"),
        rate("label_issue").alias("label_issue_rate"),
        rate("in_dup").alias("dup_rate"),
        rate("ood_flag").alias("ood_rate"),
        F.count_distinct(F.when(flag("in_dup"), F.col("dup_cluster"))).alias("n_dup_clusters"),
    )


def most_common(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The most frequent value of each group, of equals the smallest, with its count."""
    counts = rows.withColumn(name, value).groupBy(*by, name).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("minus"), F.col(name))).alias("_b"))
    return best.select(*by, F.col(f"_b.{name}").alias(name), (-F.col("_b.minus")).alias(f"{name}_count"))


def contributor_metrics(samples: DataFrame) -> DataFrame:
    """All metrics, one row for each contributor."""
    affected = most_common(samples.where(flag("poison_flag")), ["contributor"], F.col("label"), "poison_affected_class")
    return contributor_rates(samples).join(class_skew(samples), "contributor").join(affected, "contributor", "left").drop("poison_affected_class_count")


def robust_z(rows: DataFrame, floors: dict[str, float], eps: float = EPS, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with median_, spread_ (the scaled median absolute deviation, at least
    the metric's floor) and z_ of each metric in floors, among all rows or those of equal
    by. All metrics share two aggregations, whose rows are joined back."""
    meet = lambda a, b: a.join(F.broadcast(b), how="cross") if not by else a.join(b, list(by))
    medians = rows.groupBy(*by).agg(*[F.median(m).alias(f"median_{m}") for m in floors])
    gaps = meet(rows, medians)
    spread = [F.greatest(MAD_SCALE * F.median(F.abs(F.col(m) - F.col(f"median_{m}"))), F.lit(floor)).alias(f"spread_{m}") for m, floor in floors.items()]
    out = meet(gaps, gaps.groupBy(*by).agg(*spread))
    return out.withColumns({f"z_{m}": (F.col(m) - F.col(f"median_{m}")) / (F.col(f"spread_{m}") + F.lit(eps)) for m in floors})


def trust(metrics: DataFrame, flag_z: float = FLAG_Z, scale: float = SCALE, by: tuple[str, ...] = ()) -> DataFrame:
    """metrics with z scores, risk, trust (100 without risk), flagged and flag_reasons, in
    the metrics' order; peers are all rows or those of equal by."""
    out = robust_z(metrics, FLOORS, by=by)
    risk = reduce(lambda a, m: a + WEIGHTS[m] * F.greatest(F.lit(0.0), F.col(f"z_{m}")), METRICS, F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(F.round(F.col(f"z_{m}"), 9) >= flag_z, F.lit(m)) for m in METRICS]))
    out = out.withColumn("risk", risk).withColumn("trust", 100 * F.exp(-F.col("risk") / scale))
    return out.withColumn("flag_reasons", reasons).withColumn("flagged", F.size("flag_reasons") > 0)


def drill_down(trusted: DataFrame) -> DataFrame:
    """A row for each contributor and metric: value, peer median, z, weight."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"median_{m}").alias("peer_median"), F.col(f"z_{m}").alias("z"), F.lit(WEIGHTS[m]).alias("weight")) for m in METRICS]
    return trusted.select("contributor", F.inline(F.array(*rows)))


def bottom(trusted: DataFrame, k: int = 3) -> DataFrame:
    """The k least trusted contributors."""
    return trusted.orderBy("trust", "contributor").limit(k)
