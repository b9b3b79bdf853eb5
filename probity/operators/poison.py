"""Detectors that look inside classes: spectral signatures, activation clusters,
label issues, and the trace from a trigger to its source.

Samples are rows (id, label, vector). A class is never gathered in one place: its
covariance is summed from partial sums of each task, at most one small matrix for
a class and task, and eigenvectors come from the sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.scalars import flag
from probity.functions.vectors import argmax, dot, masked_match
from probity.operators.ordering import dense_index, exact_percentile
from probity.sources.scratch import materialize

LEAST_CLASS, DIMS, CLUSTERS, ROUNDS, STARTS = 20, 10, 5, 10, 4


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        labels = np.asarray(batch.column("label"))
        x = np.asarray(batch.column("vector").flatten(), np.float64).reshape(len(labels), -1) if len(labels) else np.zeros((0, 1))
        for label in np.unique(labels):
            own = x[labels == label]
            n, s, ss = total.setdefault(int(label), [0, 0, 0])
            total[int(label)] = [n + len(own), s + own.sum(0), ss + own.T @ own]
    for label, (n, s, ss) in total.items():
        yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int64()), "n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()]), "ss": pa.array([ss.ravel().tolist()])})


def _axes(rows: pa.Table) -> pa.Table:
    n = sum(rows.column("n").to_pylist())
    s, ss = (np.sum(rows.column(c).to_pylist(), axis=0) for c in ("s", "ss"))
    mean = s / n
    cov = ss.reshape(len(s), len(s)) / n - np.outer(mean, mean)
    value, vector = np.linalg.eigh(cov)
    top = vector[:, ::-1][:, :DIMS].T
    return pa.table({"label": rows.column("label")[:1], "n": [n], "mean": [mean.tolist()], "axes": [[v.tolist() for v in top]], "spread": [np.sqrt(np.maximum(value[::-1][:DIMS], 0)).tolist()]})


def class_axes(samples: DataFrame) -> DataFrame:
    """Per class of 20 or more: n, mean, its ten main axes and the spread along them."""
    parts = samples.select(F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_sums, "label long, n long, s array<double>, ss array<double>")
    axes = parts.groupBy("label").applyInArrow(_axes, "label long, n long, mean array<double>, axes array<array<double>>, spread array<double>")
    return materialize(axes.where(F.col("n") >= LEAST_CLASS), "class-axes")


def _projected(samples: DataFrame, axes: DataFrame) -> DataFrame:
    """samples of kept classes with z, their coordinates on the class's axes."""
    gap = F.zip_with("vector", "mean", lambda x, m: x.cast("double") - m)
    rows = samples.withColumn("label", F.col("label").cast("long")).join(axes, "label")
    return rows.withColumn("_gap", gap).withColumn("z", F.transform("axes", lambda a: dot(F.col("_gap"), a))).drop("_gap", "axes", "mean", "n")


def spectral_signatures(samples: DataFrame, rate: float = 0.05, multiple: float = 1.5) -> DataFrame:
    """(id, ss_score, ss_flag): squared projection on the class's main axis, over
    the class's largest; flagged at or above its 1 - multiple * rate quantile."""
    scored = _projected(samples, class_axes(samples)).select("id", "label", F.pow(F.get("z", F.lit(0)), 2).alias("s"))
    scored = materialize(scored, "spectral")
    limits = scored.groupBy("label").agg(F.max("s").alias("top")).join(exact_percentile(scored, F.col("s"), 1 - multiple * rate, "cut", ("label",)), "label")
    return scored.join(limits, "label").select("id", (F.col("s") / F.col("top")).alias("ss_score"), (F.col("s") >= F.col("cut")).alias("ss_flag"))


def _squared(z: Column | str, c: Column) -> Column:
    return F.aggregate(F.zip_with(z, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, d: a + d)


def _first_centres(rows: DataFrame, clusters: int, starts: int) -> DataFrame:
    """(label, start, centres): start 0 lies evenly along the main axis, in each other one
    centres are samples, one from each of as many hashed parts of the class."""
    # the root of the second moment along each axis; coordinates have mean zero
    along = F.sqrt(F.avg(F.pow(F.get("z", F.lit(0)), 2)))
    pick = lambda s, k: F.min_by(F.when(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(clusters)) == k, F.col("z")), F.when(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(clusters)) == k, F.xxhash64(F.lit(s), "id")))
    size = F.size("any")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(clusters - 1)), lambda k: F.concat(F.array((k - (clusters - 1) / 2) * 0.8 * F.col("along")), F.array_repeat(F.lit(0.0), size - 1)))
    drawn = [F.filter(F.array(*[F.col(f"p{s}_{k}") for k in range(clusters)]), lambda c: c.isNotNull()) for s in range(1, starts)]
    each = rows.groupBy("label").agg(along.alias("along"), F.any_value("z").alias("any"), *[pick(s, k).alias(f"p{s}_{k}") for s in range(1, starts) for k in range(clusters)])
    return each.select("label", F.posexplode(F.array(spaced, *drawn)).alias("start", "centres"))


def class_clusters(samples: DataFrame, clusters: int = CLUSTERS, starts: int = STARTS) -> DataFrame:
    """(id, label, z, cluster, share, ...): k-means in each class of 20 or more on z, its
    coordinates on the class's main axes, from several starts, of which that with the
    smallest sum of squared distances stays; share is the cluster's of its class. Further
    columns of samples stay. Centres are tables: a row for each class and start."""
    kept = [c for c in samples.columns if c not in ("id", "label", "vector")]
    rows = materialize(_projected(samples, class_axes(samples)).select("id", "label", *kept, "z"), "activations")
    centres, before = materialize(_first_centres(rows, clusters, starts), "centres"), None
    nearest = lambda c: F.array_min(F.transform(c, lambda x, i: F.struct(_squared("z", x).alias("gap"), i.alias("k"))))
    parts = materialize(rows.select("label", "z"), "coordinates")
    for _ in range(ROUNDS):
        hit = parts.join(centres, "label").withColumn("hit", nearest("centres"))
        first = hit.select("label", "start", "hit.k", "hit.gap", "z", F.get("centres", F.col("hit.k")).alias("old"))
        means = [F.avg(F.get("z", F.lit(i))).alias(f"m{i}") for i in range(DIMS)]
        moved = first.groupBy("label", "start", "k").agg(F.sum("gap").alias("gap"), F.any_value("old").alias("old"), *means)
        centre = F.filter(F.array(*[f"m{i}" for i in range(DIMS)]), lambda m: m.isNotNull())
        grouped = moved.groupBy("label", "start").agg(F.sum("gap").alias("gap"), F.collect_list(F.struct("k", centre.alias("c"))).alias("new"))
        # a cluster without members keeps its centre
        held = F.map_from_entries(F.col("new"))
        joined = grouped.join(centres.select("label", "start", "centres"), ["label", "start"])
        centres = materialize(joined.select("label", "start", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at(held, i), c)).alias("centres"), "gap"), "centres")
        total = centres.agg(F.sum("gap")).first()[0]
        if total is None or before is not None and total >= before * (1 - 1e-9):
            break
        before = total
    best = centres.groupBy("label").agg(F.min_by("centres", F.struct("gap", "start")).alias("centres"))
    out = materialize(rows.join(best, "label").withColumn("cluster", nearest("centres")["k"].cast("int")).drop("centres"), "clusters")
    sizes = out.groupBy("label", "cluster").agg(F.count("*").alias("size"))
    total = sizes.groupBy("label").agg(F.sum("size").alias("total"))
    return out.join(sizes.join(total, "label").select("label", "cluster", (F.col("size") / F.col("total")).alias("share")), ["label", "cluster"])


def silhouettes(points: DataFrame, by: str, cluster: str, z: str) -> DataFrame:
    """(by, points, silhouette) of points in clusters within groups: the mean, over all
    points, of how much nearer a point lies to its own cluster than to the nearest other
    one. Nearness is the mean squared distance, which follows from a cluster's number, sum
    and sum of squares, so no pairs are made and no group is gathered. A point alone in its
    cluster counts 0; a group of one cluster has null. Rows without a vector are left out."""
    own = points.where(F.col(z).isNotNull()).select(by, F.col(cluster).alias("_k"), F.transform(z, lambda x: x.cast("double")).alias("_z"))
    width = own.agg(F.max(F.size("_z"))).first()[0] or 0
    sums = own.groupBy(by, "_k").agg(F.count("*").alias("n"), F.sum(dot(F.col("_z"), F.col("_z"))).alias("q"), F.array(*[F.sum(F.get("_z", F.lit(i))) for i in range(width)]).cast("array<double>").alias("s"))
    every = sums.groupBy(by).agg(F.collect_list(F.struct(F.col("_k").alias("k"), "n", "q", "s")).alias("_all"))
    z2 = dot(F.col("_z"), F.col("_z"))
    # the sum of squared distances from a point to all of a cluster
    to = lambda c: F.greatest(c["n"] * z2 + c["q"] - 2 * dot(F.col("_z"), c["s"]), F.lit(0.0))
    mine = F.get(F.filter("_all", lambda c: c["k"].eqNullSafe(F.col("_k"))), F.lit(0))
    inner = F.when(mine["n"] > 1, to(mine) / (mine["n"] - 1))
    outer = F.array_min(F.transform(F.filter("_all", lambda c: ~c["k"].eqNullSafe(F.col("_k"))), lambda c: to(c) / c["n"]))
    both = own.join(every, by).select(by, inner.alias("a"), outer.alias("b"))
    value = F.when(F.col("b").isNotNull(), F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return both.groupBy(by).agg(F.count("*").alias("points"), F.avg(value).alias("silhouette"))


def suspicious_clusters(clustered: DataFrame, small: float = 0.25, disagree: float = 0.5) -> DataFrame:
    """(label, cluster, size, share, others, suspicious) of class clusters with the
    flag `other` (predicted as another class): a cluster is suspicious if it holds
    less than `small` of its class and at least `disagree` of it is flagged."""
    each = clustered.groupBy("label", "cluster").agg(F.count("*").alias("size"), F.max("share").alias("share"), F.avg(flag("other").cast("double")).alias("others"))
    return each.withColumn("suspicious", (F.col("share") < small) & (F.round("others", 9) >= disagree))


def activation_clusters(samples: DataFrame, predicted: Column) -> DataFrame:
    """(id, cluster, ac_flag): the sample's cluster in its class, and whether it is suspicious."""
    clustered = class_clusters(samples.select("id", "label", "vector", (predicted != F.col("label")).alias("other")))
    found = suspicious_clusters(clustered).select("label", "cluster", F.col("suspicious").alias("ac_flag"))
    return clustered.join(found, ["label", "cluster"]).select("id", "cluster", "ac_flag")


def class_report(samples: DataFrame, predicted: Column) -> DataFrame:
    """Per class of 20 or more: samples, clusters, the smallest cluster's share, the
    largest disagreement of a cluster, suspicious, the clusters' silhouette."""
    clustered = class_clusters(samples.select("id", "label", "vector", (predicted != F.col("label")).alias("other")))
    found = suspicious_clusters(clustered)
    return found.join(silhouettes(clustered, "label", "cluster", "z").drop("points"), "label").groupBy("label").agg(F.sum("size").alias("samples"), F.count("*").alias("clusters"), F.min("share").alias("smallest_share"), F.max("others").alias("most_disagreement"), F.bool_or("suspicious").alias("suspicious"), F.max("silhouette").alias("silhouette"))


def two_means(samples: DataFrame, small: float = 0.35) -> DataFrame:
    """(id, share, tm_flag): a cross-check without predictions: a sample is flagged if
    it lies in the smaller of its class's two clusters, which holds less than `small`."""
    return class_clusters(samples.select("id", "label", "vector"), clusters=2).select("id", "share", (F.col("share") < small).alias("tm_flag"))


def poison_flags(samples: DataFrame, predicted: Column) -> DataFrame:
    """(id, ac_flag, ss_score, ss_flag, poison_flag): a suspicious cluster, or an
    outlying projection in a class that has one."""
    ac = activation_clusters(samples, predicted)
    both = samples.select("id", "label").join(ac, "id", "left").join(spectral_signatures(samples), "id", "left")
    suspicious = both.where(flag("ac_flag")).select("label").distinct().withColumn("_bad", F.lit(True))
    both = both.join(suspicious, "label", "left")
    return both.select("id", flag("ac_flag").alias("ac_flag"), "ss_score", flag("ss_flag").alias("ss_flag"), (flag("ac_flag") | (flag("ss_flag") & flag("_bad"))).alias("poison_flag"))


def class_probabilities(samples: DataFrame, folds: int = 5, penalty: float = 1.0, rounds: int = 300) -> DataFrame:
    """(id, label, p): out-of-fold class probabilities of multinomial logistic
    regressions, p's places being the labels 0, 1, ... Folds are stratified: samples
    are numbered in the order of label and hash, and dealt in turn. Samples without
    label or vector are left out; of fewer than two folds' samples all are equally
    likely."""
    rows = samples.select("id", F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector")).where("label is not null and vector is not null")
    dealt = dense_index(rows.withColumn("_hash", F.xxhash64("id")), ["label", "_hash", "id"], "_n").select("id", "label", array_to_vector("vector").alias("features"), (F.col("_n") % folds).alias("fold"))
    sizes = {r["fold"]: (r["n"], r["most"]) for r in dealt.groupBy("fold").agg(F.count("*").alias("n"), F.max("label").alias("most")).collect()}
    total, classes = sum(n for n, _ in sizes.values()), max((most for _, most in sizes.values()), default=0) + 1
    if len(sizes) < 2:
        return dealt.select("id", "label", F.array_repeat(F.lit(1 / classes), classes).alias("p"))
    parts = []
    for fold, (n, _) in sorted(sizes.items()):
        model = LogisticRegression(family="multinomial", regParam=1 / (penalty * (total - n)), standardization=False, maxIter=rounds, tol=1e-4).fit(dealt.where(F.col("fold") != fold))
        scored = model.transform(dealt.where(F.col("fold") == fold)).select("id", "label", vector_to_array("probability").alias("p"))
        # a fold's rest may lack the highest labels
        parts.append(scored.withColumn("p", F.concat("p", F.array_repeat(F.lit(0.0), F.lit(classes) - F.size("p")))))
    return materialize(reduce(DataFrame.unionByName, parts), "class-probabilities")


def label_issues(probabilities: DataFrame) -> DataFrame:
    """(id, label_issue, suggested_label, label_quality) of (id, label, p), label a
    place in p. Confident learning: a class's threshold is the mean of its
    probability over its members; a sample counts for the likeliest class at or
    above its threshold; counts are scaled to class sizes; of each pair of classes
    as many samples as the scaled count are pruned, by the largest margin, if
    another class is likelier than the given one."""
    k = F.size("p")
    thresholds = probabilities.groupBy("label").agg(F.avg(F.get("p", F.col("label"))).alias("t"), F.count("*").alias("n"))
    table = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("label", "t"))).alias("ts"))
    rows = probabilities.join(F.broadcast(table), how="cross")
    over = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(F.get("p", j) >= F.try_element_at("ts", j), F.get("p", j)).otherwise(-1.0))
    rows = rows.withColumn("_over", over).withColumn("counted", F.when(F.array_max("_over") >= 0, F.array_position("_over", F.array_max("_over")).cast("int") - 1)).drop("_over", "ts")
    joint = rows.where("counted is not null").groupBy("label", "counted").agg(F.count("*").alias("c"))
    totals = joint.groupBy("label").agg(F.sum("c").alias("total"))
    quota = joint.join(totals, "label").join(thresholds, "label").where("label <> counted").select("label", F.col("counted").alias("other"), F.round(F.col("c") * F.col("n") / F.col("total")).cast("long").alias("quota")).where("quota > 0")
    margins = rows.join(quota, "label").withColumn("margin", F.get("p", F.col("other")) - F.get("p", F.col("label")))
    place = F.row_number().over(Window.partitionBy("label", "other").orderBy(F.desc("margin"), "id"))
    pruned = margins.withColumn("place", place).where("place <= quota").select("id").distinct().withColumn("_pruned", F.lit(True))
    suggested = argmax(F.col("p"))
    return rows.join(pruned, "id", "left").select("id", (flag("_pruned") & (suggested != F.col("label"))).alias("label_issue"), suggested.alias("suggested_label"), F.get("p", F.col("label")).alias("label_quality"))


def trace(samples: DataFrame, clean: DataFrame, mask: Column, pattern: Column, signature: Column, target: int, percentile: float = 0.99) -> DataFrame:
    """(id, contributor, trace_score, threshold, ac_flag, over, candidate) of the target
    class: half the masked match with the trigger, half the cosine with its signature; over
    is a score above the clean samples' percentile, a candidate is over or has ac_flag."""
    length = lambda v: F.sqrt(dot(v, v))
    v = F.col("vector")
    score = 0.5 * masked_match(v, mask, pattern) + 0.5 * dot(v, signature) / (length(v) * length(signature) + 1e-8)
    threshold = exact_percentile(clean.where(F.col("label") == target), F.round(score, 9), percentile, "thr")
    rows = samples.where(F.col("label") == target).withColumn("trace_score", F.round(score, 9)).join(F.broadcast(threshold), how="cross")
    over = F.col("trace_score") > F.round("thr", 9)
    return rows.select("id", "contributor", "trace_score", F.round("thr", 9).alias("threshold"), flag("ac_flag").alias("ac_flag"), over.alias("over"), (over | flag("ac_flag")).alias("candidate"))


def trace_sources(traced: DataFrame, samples: DataFrame) -> DataFrame:
    """Per contributor: its samples, candidates, share of all candidates and rate; source marks the largest share."""
    every = samples.groupBy("contributor").agg(F.count("*").alias("samples"))
    found = traced.where("candidate").groupBy("contributor").agg(F.count("*").alias("candidates"))
    rows = every.join(found, "contributor", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    total = rows.agg(F.sum("candidates").alias("total"), F.min_by("contributor", F.struct(-F.col("candidates"), "contributor")).alias("first"))
    return rows.join(F.broadcast(total), how="cross").select("contributor", "samples", "candidates", (F.col("candidates") / F.greatest("total", F.lit(1))).alias("share"), (F.col("candidates") / F.col("samples")).alias("rate"), ((F.col("contributor") == F.col("first")) & (F.col("total") > 0)).alias("source"))
