"""Queries on embeddings: neighbours, duplicates, thresholds, poison and traces."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from probity.functions.vectors import argmax, cosine, hamming, masked_match, norm, normalised, perceptual_hash, softmax, top
from probity.operators import audits, contributors, evaluation, neighbours, poison, triggers
from probity.operators.fixtures import TRIGGER_DIMS, near_copies, planted_pool
from probity.operators.grids import aligned_correlation, aligned_pairs
from probity.plans.query import Query, table
from probity.sources.cache import kept
from probity.sources.scratch import materialize


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("label"), F.col("embedding").alias("vector"))


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, and five near copies of every 20th."""
    v = vectors(spark, sf_dir).select("id", "vector")
    originals = v.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    return originals.unionByName(near_copies(v.where("id % 20 = 0")).select("id", "vector"))


D = "list_transform(embedding, lambda x: x::DOUBLE)"
COPIES = f"""v AS (SELECT vec_id AS id, {D} AS vector FROM embeddings),
moved AS (SELECT 1000000000 + id * 10 + c AS id, id AS origin, list_transform(vector, lambda x, i: x + 0.02::DOUBLE * sin(id * 13.0::DOUBLE + (i - 1) * 7.0::DOUBLE + c * 3.0::DOUBLE)) AS m FROM v, range(1, 6) r(c) WHERE id % 20 = 0),
copies AS (SELECT id, origin, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS vector FROM moved),
pool AS (SELECT id, vector, sqrt(list_inner_product(vector, vector)) AS len FROM (SELECT id, vector FROM v UNION ALL SELECT id, vector FROM copies)),
edges AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.vector, b.vector) / (a.len * b.len) AS cosine FROM pool a JOIN pool b ON a.id < b.id WHERE round(list_inner_product(a.vector, b.vector) / (a.len * b.len), 9) >= 0.8)"""
COMPONENTS = f"""{COPIES}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(id, root) AS (SELECT id, id FROM pool UNION SELECT b, root FROM reach JOIN both_ways ON a = id WHERE root < b),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""
KNN = f"""v AS (SELECT vec_id AS id, {D} AS x FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(x, x)) AS len FROM v)"""


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("unit", normalised(F.col("vector")))
    return v.select("id", F.round(norm(F.col("vector")), 6).alias("length"), F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(norm(F.col("unit")), 6).alias("unit_length"))


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return neighbours.knn(v, v.where("id % 100 = 0"), 10).select("id", "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def _ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("peer", F.concat(F.lit("C"), (F.col("id") % 5 + 1).cast("string")))
    return neighbours.peer_ood(v).select("id", F.round("ood_score", 6).alias("ood_score"), "ood_flag")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.duplicate_edges(with_copies(spark, sf_dir), 0.8).select("a", "b", F.round("cosine", 6).alias("cosine"))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = neighbours.duplicate_clusters(with_copies(spark, sf_dir))
    return clusters.where("dup_cluster >= 0").select("id", F.col("dup_cluster").alias("root"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = neighbours.duplicate_clusters(with_copies(spark, sf_dir))
    return clusters.groupBy("in_dup", "dup_cluster_size").agg(F.count("*").alias("samples"), F.count_distinct(F.when(F.col("in_dup"), F.col("dup_cluster"))).alias("clusters"))


def _sign_hash(vector):
    return F.aggregate(F.transform(F.slice(vector, 1, 62), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.expr("0L"), lambda a, x: a + x)


def _hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = vectors(spark, sf_dir).select("id", _sign_hash(F.col("vector")).alias("h"))
    other = h.select((F.col("id") - 1).alias("id"), F.col("h").alias("other"))
    return h.join(other, "id").select("id", "h", hamming(F.col("h"), F.col("other")).cast("int").alias("distance"))


ALIGNED = 0.9


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates that the aligned correlation of their vectors as grids of 8 x 8
    confirms, with both measures."""
    edges = neighbours.duplicate_edges(with_copies(spark, sf_dir), 0.8, aligned_pairs)
    return edges.where(F.round("measure", 9) >= ALIGNED).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("measure", 6).alias("aligned"))


def _aligned_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5th percentile and median of the aligned correlation of vectors and their near copies."""
    v = vectors(spark, sf_dir).select("id", "vector")
    pairs = near_copies(v, copies=2, noise=0.05).select("origin", F.col("vector").alias("copy")).join(v.withColumnRenamed("id", "origin"), "origin")
    found = neighbours.calibrate(pairs, "vector", "copy", aligned_correlation)
    return found.select(F.round("p5", 4).alias("p5"), F.round("median", 4).alias("median"))


def _window_sql(x: str, y: str, dx: str, mirrored: str) -> str:
    """A centred window of 6 x 6 of a grid, at length one."""
    return f"list_transform(range(36), lambda p: {x}[(p // 6 + {y}) * 8 + CASE WHEN {mirrored} THEN 8 - (p % 6 + {dx}) ELSE p % 6 + {dx} + 1 END])"


def _unit_sql(cells: str) -> str:
    gap = f"list_transform({cells}, lambda q: q - list_avg({cells}))"
    return f"list_transform({gap}, lambda q: q / (sqrt(list_inner_product({gap}, {gap})) + 1e-6))"


def _aligned_sql(pairs: str) -> str:
    """Tables ending in `aligned` (a, b, cosine, aligned) of pairs (a, b, cosine, va, vb)."""
    return f"""pr AS ({pairs}),
wa AS (SELECT *, {_window_sql("va", "1", "1", "false")} AS ca FROM pr),
wb AS (SELECT a, b, cosine, ca, {_window_sql("vb", "y.y", "x.x", "m.m")} AS cb FROM wa, range(3) y(y), range(3) x(x), (VALUES (false), (true)) m(m)),
aligned AS (SELECT a, b, any_value(cosine) AS cosine, max(list_inner_product({_unit_sql("ca")}, {_unit_sql("cb")})) AS aligned FROM wb GROUP BY a, b)"""


def _perceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of vectors as grids of 8 x 8, and how many bits the hash of each one's
    near copy differs in."""
    v = vectors(spark, sf_dir).select("id", "vector")
    copies = near_copies(v, copies=1, noise=0.01).select(F.col("origin").alias("id"), perceptual_hash(F.col("vector")).alias("copy"))
    own = v.select("id", perceptual_hash(F.col("vector")).alias("h"))
    return own.join(copies, "id").select("id", "h", hamming(F.col("h"), F.col("copy")).cast("int").alias("distance"))


_COEFFICIENTS = "list_transform(range(36), lambda k: list_sum(list_transform(x, lambda y, p: y * cos(pi() * (2 * ((p - 1) // 8) + 1) * (k // 6) / 16) * cos(pi() * (2 * ((p - 1) % 8) + 1) * (k % 6) / 16))))"
PERCEPTUAL = f"""WITH v AS (SELECT vec_id AS id, {D} AS x FROM embeddings),
m AS (SELECT id, x FROM v), c AS (SELECT id, list_transform(x, lambda y, i: y + 0.01::DOUBLE * sin(id * 13.0::DOUBLE + (i - 1) * 7.0::DOUBLE + 3.0::DOUBLE)) AS x FROM v),
k AS (SELECT id, 'own' AS part, {_COEFFICIENTS} AS c FROM m UNION ALL SELECT id, 'copy', {_COEFFICIENTS} FROM c),
h AS (SELECT id, part, list_reduce(list_prepend(0::BIGINT, list_transform(c, lambda y: (y > list_median(c))::INT::BIGINT)), lambda a, b: a * 2 + b) AS h FROM k)
SELECT a.id, a.h, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.id = b.id AND a.part = 'own' AND b.part = 'copy'"""


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "vector")
    pairs = near_copies(v, copies=2, noise=0.05).select("origin", F.col("vector").alias("copy")).join(v.withColumnRenamed("id", "origin"), "origin")
    return neighbours.calibrate(pairs, "vector", "copy").select(F.round("p5", 6).alias("p5"), F.round("median", 6).alias("median"))


def _mask():
    return F.transform("vector", lambda x, i: F.when(i < TRIGGER_DIMS, 1.0).otherwise(0.0)), F.transform("vector", lambda x, i: F.when(i < TRIGGER_DIMS, 0.1).otherwise(0.0))


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, pattern = _mask()
    return vectors(spark, sf_dir).select("id", F.round(masked_match(F.col("vector"), mask, pattern), 6).alias("score"))


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the mean of label 0."""
    v = vectors(spark, sf_dir)
    means = v.where("label = 0").select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    signature = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("signature"))
    return v.join(F.broadcast(signature), how="cross").select("id", F.round(cosine(F.col("vector"), F.col("signature"), 1e-8), 6).alias("cosine"))


def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe probabilities of ten classes against those of a slightly different model."""
    v = vectors(spark, sf_dir)
    logits = lambda shift: F.transform(F.slice("vector", 1, 10), lambda x, i: 10 * x.cast("double") + shift * F.sin(i * 1.0))
    reference, supplied = v.select("id", softmax(logits(0.0)).alias("p")), v.select("id", softmax(logits(0.3)).alias("p"))
    return evaluation.fingerprint_drift(reference, supplied, "id", "p").select("probes", F.round("agreement", 6).alias("agreement"), F.round("kl", 6).alias("kl"), "drift")


def _top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = softmax(F.transform(F.slice("vector", 1, 10), lambda x: 10 * x.cast("double")))
    rows = vectors(spark, sf_dir).select("id", p.alias("p"))
    return rows.select("id", argmax(F.col("p")).alias("best"), F.posexplode(top(F.col("p"), 3)).alias("rank", "t")).select("id", "best", "rank", F.col("t.place").alias("class"), F.round(-F.col("t.minus"), 6).alias("prob"))


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of vectors whose largest of ten parts is their label's; the same without label 0."""
    rows = vectors(spark, sf_dir).select("label", argmax(F.slice("vector", 1, 10)).alias("pred"))
    return rows.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("label") != 0, (F.col("pred") == 0).cast("double"))), 6).alias("success"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(planted_pool(vectors(spark, sf_dir)), "pool")


def _predicted(rows: DataFrame, probabilities: DataFrame) -> DataFrame:
    return rows.join(probabilities.select("id", argmax(F.col("p")).alias("predicted")), "id", "left")


def probabilities(samples: DataFrame) -> DataFrame:
    """Out-of-fold class probabilities of (id, label, vector) in the view that trims each
    vector's unusual coordinates; folds are fitted once for the same samples."""
    return kept(samples.select("id", "label", "vector"), "class-probabilities", lambda rows: poison.class_probabilities(triggers.trimmed_view(rows)))


def detected(samples: DataFrame) -> DataFrame:
    """samples with the flags of all detectors; gt_attack isn't read, and nothing is known
    of an attack. Predictions are made in the trimmed view, all else in the vectors."""
    rows = samples.select("id", "contributor", "label", "vector")
    p = probabilities(rows)
    flags = poison.poison_flags(_predicted(rows, p), F.col("predicted"))
    dup = neighbours.duplicate_clusters(rows.select("id", "vector"), cos=0.93)
    ood = neighbours.peer_ood(rows.select("id", F.col("contributor").alias("peer"), "vector"))
    out = rows
    for part in (flags, dup, ood, poison.label_issues(p)):
        out = out.join(part, "id", "left")
    return materialize(out, "detected")


def _detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = pool(spark, sf_dir)
    found = detected(samples).join(samples.select("id", "gt_attack"), "id")
    gt = F.col("gt_attack")
    # flips are measured within the contributor that flips, as poisoned labels are issues too
    found = found.withColumn("label_issue", F.col("label_issue") & (F.col("contributor") == "C4"))
    measured = evaluation.precision_recall(found, {"duplicates": (F.col("in_dup"), gt.isin("dup", "dup_source")), "ood": (F.col("ood_flag"), gt == "ood"), "labels": (F.col("label_issue"), gt == "flip"), "poison": (F.col("poison_flag"), gt == "badnets")})
    return measured


def _planted_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(pool(spark, sf_dir)).withColumnRenamed("id", "sample_id")
    samples = materialize(found.select("sample_id", "contributor", "label", "poison_flag", "label_issue", "in_dup", "ood_flag", "dup_cluster"), "found")
    return contributors.trust(contributors.contributor_metrics(samples)).select("contributor", "n_samples", *contributors.METRICS, "trust", "flagged", F.array_join("flag_reasons", ",").alias("reasons"))


def clean_part(samples: DataFrame) -> DataFrame:
    """What the auditor knows to be clean: the two trusted contributors' samples."""
    return samples.where("contributor in ('C1', 'C2')")


def found_triggers(samples: DataFrame, model: triggers.Classifier) -> DataFrame:
    """Each class's reverse-engineered trigger with its anomaly index."""
    clean = clean_part(samples).select("id", "vector")
    weights = [model.weights.tolist(), model.bias.tolist()]
    found = kept(clean, "triggers", lambda rows: triggers.reverse_triggers(rows, model), model=weights, how=triggers.Search())
    return audits.class_anomalies(found.withColumn("model", F.lit("pool")), "model", "class", "l1")


def suspected(found: DataFrame) -> Row | None:
    """The flagged class of the smallest mask, with its trigger; None if no class is flagged."""
    return found.where("flagged").orderBy("l1", "class").select("class", "mask", "pattern").first()


def traced(samples: DataFrame) -> DataFrame:
    """The samples of the class that the audit finds to be a trigger's target, scored against
    the trigger that it found; no rows if it finds none. The signature is the mean move of
    clean samples that get the trigger."""
    rows = samples.join(poison.poison_flags(_predicted(samples, probabilities(samples)), F.col("predicted")), "id")
    hit = suspected(found_triggers(samples, triggers.fit_classifier(samples)))
    clean = clean_part(samples)
    if hit is None:
        mask = pattern = signature = F.transform("vector", lambda x: F.lit(0.0))
    else:
        mask, pattern = (F.array(*map(F.lit, hit[c])) for c in ("mask", "pattern"))
        usual = clean.agg(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))).alias("m")).first()["m"]
        signature = F.array(*[F.lit(float(m * (p - x))) for m, p, x in zip(hit["mask"], hit["pattern"], usual, strict=True)])
    return materialize(poison.trace(rows, clean, mask, pattern, signature, target=-1 if hit is None else hit["class"]), "traced")


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class of the model that was fitted on the planted pool: the smallest trigger's
    size, its success on clean samples, and how far the size lies from other classes'."""
    samples = pool(spark, sf_dir)
    found = found_triggers(samples, triggers.fit_classifier(samples))
    return found.select("class", F.round("l1", 4).alias("l1"), "success", "converged", F.round("anomaly_index", 4).alias("anomaly_index"), "flagged")


def _pool_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the model of the planted pool against a reference model of the trusted
    contributors: probe agreement and divergence, recovered masks, and how often the found
    trigger sends clean samples of other classes to its target."""
    samples = pool(spark, sf_dir)
    supplied, reference = triggers.fit_classifier(samples), triggers.fit_classifier(clean_part(samples))
    found = found_triggers(samples, supplied)
    clean = clean_part(samples).select("id", "label", "vector")
    ask = lambda model: clean.select("id", softmax(triggers.logits(F.col("vector"), model)).alias("p"))
    drift = evaluation.fingerprint_drift(ask(reference), ask(supplied), "id", "p").select("agreement", "kl")
    hit = suspected(found)
    success = F.lit(None).cast("double")
    if hit is not None:
        mask, pattern = (F.array(*map(F.lit, hit[c])) for c in ("mask", "pattern"))
        led = triggers.predicted(triggers.stamped(F.col("vector"), mask, pattern), supplied) == hit["class"]
        success = F.lit(clean.where(F.col("label") != hit["class"]).agg(F.avg(led.cast("double"))).first()[0])
    models = drift.select(F.lit("pool").alias("model"), "agreement", "kl", F.lit(True).alias("signed"), F.lit(True).alias("white_box"))
    verdict = audits.model_verdicts(models, found, "model", "class", "l1")
    return verdict.select("model", F.round("agreement", 6).alias("agreement"), F.round("kl", 6).alias("kl"), "drift", "target", "verdict", "confidence", "reason", F.round(success, 6).alias("attack_success"))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = pool(spark, sf_dir)
    return poison.trace_sources(traced(samples), samples)


def _trace_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 candidates of the highest scores, the trace report's fixed length."""
    found = traced(pool(spark, sf_dir)).where("candidate")
    return found.orderBy(F.desc_nulls_last("trace_score"), "id").limit(32).select("id", "contributor", "trace_score", "over", "ac_flag")


def _class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir).select("id", "label", "vector")
    return poison.class_report(_predicted(rows, probabilities(rows)), F.col("predicted"))


def _silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the labels of each kind of id (five of them) lie apart as clusters."""
    v = vectors(spark, sf_dir).withColumn("peer", F.col("id") % 5)
    return poison.silhouettes(v, "peer", "label", "vector").select("peer", "points", F.round("silhouette", 6).alias("silhouette"))


# straight from all pairs
SILHOUETTE = f"""WITH v AS (SELECT vec_id AS id, vec_id % 5 AS peer, label, {D} AS x FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT a.peer, a.id, a.label, b.label AS other, sum(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS total, count(*) AS n
  FROM v a JOIN v b ON a.peer = b.peer AND a.id <> b.id GROUP BY ALL),
s AS (SELECT peer, id, max(total / n) FILTER (other IS NOT DISTINCT FROM label) AS a, min(total / n) FILTER (other IS DISTINCT FROM label) AS b FROM g GROUP BY ALL)
SELECT peer, count(*) AS points, round(avg(CASE WHEN b IS NOT NULL THEN coalesce((b - a) / greatest(a, b), 0) END), 6) AS silhouette FROM s GROUP BY peer"""


def _two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poison.two_means(pool(spark, sf_dir))


def _spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poison.spectral_signatures(vectors(spark, sf_dir))


def _activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("predicted", argmax(F.slice("vector", 1, 10)))
    return poison.activation_clusters(v, F.col("predicted"))


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the two poison detectors agree on the planted pool, by class."""
    rows = pool(spark, sf_dir).select("id", "label", "vector")
    predicted = _predicted(rows, probabilities(rows))
    flags = poison.poison_flags(predicted, F.col("predicted"))
    return flags.join(rows.select("id", "label"), "id").groupBy("label").agg(F.count("*").alias("samples"), F.count_if("ac_flag").alias("ac"), F.count_if("ss_flag").alias("ss"), F.avg((F.col("ac_flag") == F.col("ss_flag")).cast("double")).alias("agreement"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poison.label_issues(probabilities(pool(spark, sf_dir)))


def _attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["none", "badnets", "flip", "dup_source", "dup", "ood"]
    return planted_pool(vectors(spark, sf_dir)).groupBy("contributor").pivot("gt_attack", kinds).count().na.fill(0)


SOFT = "list_transform(e, lambda x: x / list_sum(e))"
QUERIES = {
    "l2_normalize": Query(_normal, f"WITH {KNN} SELECT id, round(len, 6) AS length, round(list_sum(list_transform(x, lambda y: y / len)), 6) AS total, round(sqrt(list_sum(list_transform(x, lambda y: y / len * y / len))), 6) AS unit_length FROM n", "H1"),
    "knn_cosine_top10": Query(_knn, f"WITH {KNN}, c AS (SELECT q.id, b.id AS neighbour, list_inner_product(q.x, b.x) / (q.len * b.len) AS cosine FROM n q JOIN n b ON q.id <> b.id WHERE q.id % 100 = 0) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, neighbour))::INT AS rank, neighbour, round(cosine, 6) AS cosine FROM c QUALIFY rank <= 10", "C3 F5 P5 P6"),
    "peer_ood_score": Query(_ood, f"WITH {KNN}, c AS (SELECT q.id, list_inner_product(q.x, b.x) / (q.len * b.len) AS cosine FROM n q JOIN n b ON q.id % 5 <> b.id % 5), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC) <= 10), s AS (SELECT id, 1 - avg(cosine) AS ood_score FROM t GROUP BY id) SELECT id, round(ood_score, 6) AS ood_score, round(ood_score, 9) > round((SELECT quantile_cont(round(ood_score, 9), 0.99) FROM s), 9) AS ood_flag FROM s", "C4 H8"),
    "near_dup_edges": Query(_edges, f"WITH {COPIES} SELECT a, b, round(cosine, 6) AS cosine FROM edges", "C5 I5 P4"),
    "connected_components": Query(_components, f"WITH RECURSIVE {COMPONENTS} SELECT id, root FROM comp QUALIFY count(*) OVER (PARTITION BY root) > 1", "H6"),
    "dup_clusters": Query(_clusters, f"WITH RECURSIVE {COMPONENTS}, z AS (SELECT id, root, count(*) OVER (PARTITION BY root) AS dup_cluster_size FROM comp) SELECT dup_cluster_size >= 3 AS in_dup, dup_cluster_size, count(*) AS samples, count(DISTINCT CASE WHEN dup_cluster_size >= 3 THEN root END) AS clusters FROM z GROUP BY ALL", "H5 D20"),
    "hamming_phash": Query(_hamming, "WITH h AS (SELECT vec_id AS id, list_sum(list_transform(embedding[1:62], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT AS h FROM embeddings) SELECT a.id, a.h, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON b.id = a.id + 1", "H2 H3"),
    "perceptual_hash": Query(_perceptual, PERCEPTUAL, "H2 H3"),
    "aligned_edges": Query(_aligned, f"WITH {COPIES}, {_aligned_sql('SELECT a, b, e.cosine, p.vector AS va, q.vector AS vb FROM edges e JOIN pool p ON p.id = a JOIN pool q ON q.id = b')} SELECT a, b, round(cosine, 6) AS cosine, round(aligned, 6) AS aligned FROM aligned WHERE round(aligned, 9) >= {ALIGNED}", "H4 C5 H5"),
    "aligned_calibration": Query(_aligned_calibration, f"WITH v AS (SELECT vec_id AS id, {D} AS x FROM embeddings), {_aligned_sql('SELECT id AS a, c AS b, 0 AS cosine, x AS va, list_transform(x, lambda y, i: y + 0.05::DOUBLE * sin(id * 13.0::DOUBLE + (i - 1) * 7.0::DOUBLE + c * 3.0::DOUBLE)) AS vb FROM v, range(1, 3) r(c)')} SELECT round(quantile_cont(aligned, 0.05), 4) AS p5, round(median(aligned), 4) AS median FROM aligned", "H4 H7"),
    "calibration_percentiles": Query(_calibration, f"WITH v AS (SELECT vec_id AS id, {D} AS x FROM embeddings), m AS (SELECT x, list_transform(x, lambda y, i: y + 0.05::DOUBLE * sin(id * 13.0::DOUBLE + (i - 1) * 7.0::DOUBLE + c * 3.0::DOUBLE)) AS m FROM v, range(1, 3) r(c)), k AS (SELECT list_inner_product(x, m) / sqrt(list_inner_product(x, x) * list_inner_product(m, m)) AS c FROM m) SELECT round(quantile_cont(c, 0.05), 6) AS p5, round(median(c), 6) AS median FROM k", "H7 C6"),
    "pixel_match": Query(_match, f"WITH v AS (SELECT vec_id AS id, {D} AS x FROM embeddings) SELECT id, round(1 - list_sum(list_transform(x[1:8], lambda y: abs(y - 0.1::DOUBLE))) / (8 + 1e-8), 6) AS score FROM v", "H17"),
    "signature_cosine": Query(_signature, f"WITH {KNN}, p AS (SELECT unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN embeddings ON vec_id = id WHERE label = 0), m AS (SELECT i, avg(y) AS y FROM p GROUP BY i), s AS (SELECT list(y ORDER BY i) AS s FROM m) SELECT id, round(list_inner_product(x, s) / (len * sqrt(list_inner_product(s, s)) + 1e-8), 6) AS cosine FROM n, s", "H18 D25"),
    "fingerprint_agreement_kl": Query(_fingerprint, f"WITH l AS (SELECT vec_id AS id, list_transform(embedding[1:10], lambda x: exp(10 * x::DOUBLE)) AS e, list_transform(embedding[1:10], lambda x, i: exp(10 * x::DOUBLE + 0.3::DOUBLE * sin((i - 1)::DOUBLE))) AS f FROM embeddings), p AS (SELECT {SOFT} AS q, list_transform(f, lambda x: x / list_sum(f)) AS p FROM l), k AS (SELECT list_position(q, list_max(q)) = list_position(p, list_max(p)) AS same, list_sum(list_transform(list_zip(q, p), lambda z: z[1] * ln(z[1] / z[2]))) AS kl FROM p) SELECT count(*) AS probes, round(avg(same::INT), 6) AS agreement, round(avg(kl), 6) AS kl, avg(same::INT) < 0.9 OR avg(kl) > 0.25 AS drift FROM k", "D22 H20 B5"),
    "argmax_top3": Query(_top3, f"WITH l AS (SELECT vec_id AS id, list_transform(embedding[1:10], lambda x: exp(10 * x::DOUBLE)) AS e FROM embeddings), p AS (SELECT id, {SOFT} AS p FROM l), u AS (SELECT id, list_position(p, list_max(p)) - 1 AS best, unnest(p) AS prob, generate_subscripts(p, 1) - 1 AS class FROM p) SELECT id, best::INT AS best, (row_number() OVER (PARTITION BY id ORDER BY prob DESC, class) - 1)::INT AS rank, class::INT AS class, round(prob, 6) AS prob FROM u QUALIFY rank < 3", "F2"),
    "accuracy_attack_success": Query(_accuracy, "WITH p AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings) SELECT round(avg((pred = label)::INT), 6) AS accuracy, round(avg((pred = 0)::INT) FILTER (label <> 0), 6) AS success FROM p", "D24"),
    "attack_pivot": Query(_attacks, "WITH r AS (SELECT vec_id AS id, label, vec_id % 5 + 1 AS c, vec_id // 5 AS t FROM embeddings), a AS (SELECT c, CASE WHEN c = 3 AND t % 20 = 0 AND label <> 0 THEN 'badnets' WHEN c = 4 AND t % 5 = 0 AND label IN (3, 5) THEN 'flip' WHEN c = 5 AND t % 20 = 1 THEN 'dup_source' WHEN c = 5 AND t % 20 = 2 THEN 'ood' ELSE 'none' END AS k FROM r) SELECT 'C' || c AS contributor, count(*) FILTER (k = 'none') AS none, count(*) FILTER (k = 'badnets') AS badnets, count(*) FILTER (k = 'flip') AS flip, count(*) FILTER (k = 'dup_source') AS dup_source, 5 * count(*) FILTER (k = 'dup_source') AS dup, count(*) FILTER (k = 'ood') AS ood FROM a GROUP BY c", "D18 I1 I2 I3 I4 I6 I7"),
    "spectral_signature": Query(_spectral, None, "H12"),
    "activation_clustering": Query(_activation, None, "H11"),
    "detector_agreement": Query(_agreement, None, "D27"),
    "activation_report": Query(_class_report, None, "D21"),
    "label_silhouette": Query(_silhouette, SILHOUETTE, "H11"),
    "two_means_check": Query(_two_means, None, "H13"),
    "trace_top32": Query(_trace_top, None, "F3"),
    "label_issues_cl": Query(_issues, None, "H9 H10"),
    "planted_detection": Query(_detection, None, "H14 H15 D15 B18"),
    "planted_trust": Query(_planted_trust, None, "D1 D11 D16"),
    "trigger_search": Query(_triggers, None, "H21 D23"),
    "pool_verdict": Query(_pool_verdict, None, "H20 H22 D22 D24"),
    "trigger_trace": Query(_trace, None, "H19 D17"),
}
