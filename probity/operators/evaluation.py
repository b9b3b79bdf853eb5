"""Measures of detectors against known attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.scalars import flag


def precision_recall(rows: DataFrame, detectors: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each named (predicted, actual) pair of flags: detector, tp, predicted,
    positives, precision, recall. Without predictions or positives they are 0."""
    sums = []
    for i, (predicted, actual) in enumerate(detectors.values()):
        sums += [F.count_if(flag(predicted) & flag(actual)).alias(f"t{i}"), F.count_if(flag(predicted)).alias(f"p{i}"), F.count_if(flag(actual)).alias(f"a{i}")]
    each = [F.struct(F.lit(n).alias("detector"), F.col(f"t{i}").alias("tp"), F.col(f"p{i}").alias("predicted"), F.col(f"a{i}").alias("positives")) for i, n in enumerate(detectors)]
    out = rows.agg(*sums).select(F.inline(F.array(*each)))
    over = lambda c: F.col("tp") / F.greatest(F.lit(1), F.col(c))
    return out.withColumn("precision", over("predicted")).withColumn("recall", over("positives"))


def histogram(rows: DataFrame, score: str, by: list[str], bins: int = 30) -> DataFrame:
    """(by, bin, n) over [0, 1], the last bin closed; other values are left out, empty bins are 0."""
    inside = rows.where(F.col(score).between(0.0, 1.0)).withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    counts = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fingerprint_drift(reference: DataFrame, supplied: DataFrame, key: str, probs: str) -> DataFrame:
    """One row: agreement of top classes, mean KL(reference || supplied) with
    probabilities clipped to [1e-8, 1], and whether either tells drift."""
    clip = lambda x: F.least(F.greatest(x.cast("double"), F.lit(1e-8)), F.lit(1.0))
    both = reference.select(key, F.col(probs).alias("q")).join(supplied.select(key, F.col(probs).alias("p")), key)
    top = lambda c: F.array_position(c, F.array_max(c))
    kl = F.aggregate(F.zip_with("q", "p", lambda q, p: clip(q) * F.log(clip(q) / clip(p))), F.lit(0.0), lambda a, x: a + x)
    out = both.agg(F.count("*").alias("probes"), F.avg((top("q") == top("p")).cast("double")).alias("agreement"), F.avg(kl).alias("kl"))
    return out.withColumn("drift", (F.round("agreement", 9) < 0.90) | (F.round("kl", 9) > 0.25))
