"""Trigger reverse engineering: for each class the smallest mask and the pattern that turn
clean samples into that class of a supplied model, after Wang et al. (S&P 2019).

The model is a multinomial logistic regression. Vectors are scaled to [0, 1] by the
range of the clean samples. Mask and pattern are sigmoid-like functions of free parameters
and move by Adam; the weight of the mask's size follows the success rate. Classes are
independent of each other, so each is a group of its own in one job; batches come from
a bounded number of clean samples, so a group's size doesn't grow with the pool.

Edge cases. Samples without label or vector are left out. Without clean samples
there is no row. Fewer than three classes have no outlying norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.vectors import argmax, let


FOUND = "class long, l1 double, success double, converged boolean, mask array<double>, pattern array<double>"
EPS = 1e-7


@dataclass(frozen=True)
class Classifier:
    """Logits are weights @ vector + bias, a row of weights for each class."""

    weights: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class Search:
    """How triggers are sought; `samples` bounds the clean samples that batches are drawn from."""

    samples: int = 5000
    steps: int = 1000
    round_steps: int = 10
    batch: int = 128
    rate: float = 0.1
    cost: float = 1e-3
    multiplier: float = 1.5
    patience: int = 5
    success: float = 0.99


def _double(name: str) -> Column:
    return F.col(name).cast("array<double>")


def fit_classifier(samples: DataFrame, penalty: float = 1.0, rounds: int = 300) -> Classifier:
    """A multinomial logistic regression of samples (label, vector)."""
    rows = samples.select(F.col("label").cast("double").alias("label"), array_to_vector(_double("vector")).alias("features")).where("label is not null and features is not null")
    model = LogisticRegression(family="multinomial", regParam=1 / (penalty * max(rows.count(), 1)), standardization=False, maxIter=rounds, tol=1e-4).fit(rows)
    return Classifier(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def logits(vector: Column, model: Classifier) -> Column:
    """The model's logits of a vector, one for each class."""
    weights = F.array(*[F.array(*map(F.lit, [*w, b])) for w, b in zip(model.weights.tolist(), model.bias.tolist(), strict=True)])
    longer = F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.lit(1.0)))
    return F.transform(weights, lambda w: F.aggregate(F.zip_with(longer, w, lambda x, y: x * y), F.lit(0.0), lambda a, p: a + p))


def predicted(vector: Column, model: Classifier) -> Column:
    """The likeliest class of a vector, the smallest of equally likely ones."""
    return let(logits(vector, model), argmax)


def _start(x: np.ndarray) -> np.ndarray:
    """The parameter at which _shown() is x."""
    return np.arctanh((np.clip(x, 0.02, 0.98) - 0.5) * (2 - EPS))


def _shown(v: np.ndarray) -> np.ndarray:
    return np.tanh(v) / (2 - EPS) + 0.5


def _search(x: np.ndarray, target: int, weights: np.ndarray, bias: np.ndarray, how: Search) -> tuple:
    """(l1, success, converged, mask, pattern) on samples x in [0, 1]."""
    rng = np.random.default_rng(1000 + target)
    free = _start(rng.random((2, x.shape[1])))  # mask, pattern
    moved, spread = np.zeros_like(free), np.zeros_like(free)
    cost, ups, downs, best, hits, sizes = how.cost, 0, 0, None, 0.0, 0.0
    for step in range(1, how.steps + 1):
        batch = x[rng.integers(0, len(x), how.batch)]
        mask, pattern = _shown(free)
        logits = (batch + mask * (pattern - batch)) @ weights.T + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        hits += float((p.argmax(1) == target).mean())
        sizes += float(mask.sum())
        p[:, target] -= 1
        pull = p @ weights / len(batch)  # of the mean cross entropy on each stamped sample
        slope = np.stack(((pull * (pattern - batch)).sum(0) + cost, pull.sum(0) * mask)) * (1 - np.tanh(free) ** 2) / (2 - EPS)
        moved, spread = 0.5 * moved + 0.5 * slope, 0.9 * spread + 0.1 * slope**2
        free = free - how.rate * (moved / (1 - 0.5**step)) / (np.sqrt(spread / (1 - 0.9**step)) + 1e-8)
        if step % how.round_steps:
            continue
        success, size, hits, sizes = hits / how.round_steps, sizes / how.round_steps, 0.0, 0.0
        reached = success >= how.success
        if reached and (best is None or size < best[0]):
            best = size, success, True, mask, pattern
        ups, downs = (ups + 1, 0) if reached else (0, downs + 1)
        if ups >= how.patience:
            ups, cost = 0, cost * how.multiplier
        if downs >= how.patience:
            downs, cost = 0, cost / how.multiplier**1.5
    mask, pattern = _shown(free)
    return best or (float(mask.sum()), None, False, mask, pattern)


def reverse_triggers(clean: DataFrame, model: Classifier, how: Search | None = None) -> DataFrame:
    """Per class of the model: l1, the size of the smallest mask found with the wanted
    success; success (null if never reached), converged, mask and pattern, the latter in
    the vectors' own units. clean has (id, vector); batches are drawn from the `samples`
    of them whose hashes come first."""
    how = how or Search()
    rows = clean.select("id", _double("vector").alias("vector")).where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(how.samples)
    weights, bias = model.weights, model.bias

    def search(group: pa.Table) -> pa.Table:
        target = group.column("class")[0].as_py()
        order = np.argsort(np.asarray(group.column("id")), kind="stable")
        x = np.asarray(group.column("vector").combine_chunks().flatten(), np.float64).reshape(len(group), -1)[order]
        low, span = x.min(0), np.maximum(np.ptp(x, axis=0), EPS)
        l1, success, converged, mask, pattern = _search((x - low) / span, target, weights * span, bias + weights @ low, how)
        return pa.table({"class": [target], "l1": [l1], "success": pa.array([success], pa.float64()), "converged": [converged], "mask": [mask.tolist()], "pattern": [(low + span * pattern).tolist()]})

    classes = F.explode(F.array(*[F.lit(c).cast("long") for c in range(len(bias))])).alias("class")
    return rows.select("id", "vector", classes).groupBy("class").applyInArrow(search, FOUND)


def stamped(vector: Column, mask: Column, pattern: Column) -> Column:
    """vector with a trigger: (1 - mask) * vector + mask * pattern."""
    there = F.zip_with(mask, pattern, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    return F.zip_with(vector, there, lambda x, t: x.cast("double") * (1 - t["m"]) + t["m"] * t["p"])


def trimmed_view(samples: DataFrame, share: float = 0.25) -> DataFrame:
    """samples with vectors in which each one's most unusual coordinates, a share of all by
    their distance from the mean in standard deviations, are put to the mean. A trigger is
    a few coordinates far from where they usually are; what tells classes apart is spread
    over all of them. Nothing about an attack is known here."""
    stats = samples.where("vector is not null").select(array_to_vector(_double("vector")).alias("v")).groupBy(F.lit(0).alias("all")).agg(Summarizer.mean(F.col("v")).alias("m"), Summarizer.std(F.col("v")).alias("s")).first()
    if stats is None:
        return samples
    usual = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(max(s, EPS))).alias("s")) for m, s in zip(stats["m"], stats["s"], strict=True)])
    far = F.zip_with("vector", usual, lambda x, u: F.struct((x.cast("double") - u["m"]).alias("off"), (F.abs(x.cast("double") - u["m"]) / u["s"]).alias("z")))
    kept = max(int(len(stats["m"]) * (1 - share)), 1)
    limit = lambda rows: F.get(F.array_sort(F.transform(rows, lambda r: r["z"])), F.lit(kept - 1))
    trimmed = lambda rows: let(limit(rows), lambda most: F.transform(rows, lambda r: F.when(r["z"] <= most, r["off"]).otherwise(0.0)))
    return samples.withColumn("vector", let(far, trimmed))
