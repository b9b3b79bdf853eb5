"""Queries on contributors: documents by source, line items by supplier.

Samples come from documents: contributor = source, label = lang, poison_flag =
toxic label, label_issue = low quality label, in_dup = another document has the
text, ood_flag = longer than the pool's 99th percentile. The mapping is ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.scalars import flag, padded_id
from probity.operators import contributors as C
from probity.operators import evaluation
from probity.operators.ordering import dense_index, first_of_each
from probity.plans.query import Query, table
from probity.sources.scratch import materialize


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    keyed = docs.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("contributor"), F.col("lang").alias("label"), "n_chars", F.md5("text").alias("dup_cluster"))
    sizes = keyed.groupBy("dup_cluster").agg(F.count("*").alias("dup_cluster_size"))
    p99 = docs.agg(F.percentile("n_chars", F.lit(0.99)).alias("p99"))
    marks = labels.select(F.col("doc_id").alias("sample_id"), (F.col("toxic") == 1).alias("poison_flag"), (F.col("quality") == 0).alias("label_issue"))
    joined = (
        keyed.join(sizes.where("dup_cluster_size > 1"), "dup_cluster", "left")
        .withColumn("dup_cluster_size", F.when(F.col("dup_cluster").isNotNull(), F.coalesce("dup_cluster_size", F.lit(1).cast("long"))))
        .join(F.broadcast(p99), how="cross")
        .join(marks, "sample_id", "left")
        .withColumn("in_dup", F.col("dup_cluster_size") > 1)
        .withColumn("ood_flag", F.col("n_chars") > F.col("p99"))
    )
    return materialize(joined, "samples")  # a query reads it several times


SAMPLES = """s AS (
  SELECT d.doc_id AS sample_id, d.source AS contributor, d.lang AS label, d.n_chars, md5(d.text) AS dup_cluster,
    count(*) OVER (PARTITION BY md5(d.text)) AS dup_cluster_size, count(*) OVER (PARTITION BY md5(d.text)) > 1 AS in_dup,
    d.n_chars > (SELECT quantile_cont(n_chars, 0.99) FROM documents) AS ood_flag, l.toxic = 1 AS poison_flag, l.quality = 0 AS label_issue
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
RATES = """rates AS (
  SELECT contributor, count(*) AS n_samples, avg(coalesce(poison_flag, false)::INT) AS poison_rate, avg(coalesce(label_issue, false)::INT) AS label_issue_rate,
    avg(in_dup::INT) AS dup_rate, avg(ood_flag::INT) AS ood_rate, count(DISTINCT CASE WHEN in_dup THEN dup_cluster END) AS n_dup_clusters
  FROM s GROUP BY contributor)"""
SKEW = """c AS (SELECT contributor, label, count(*) AS n FROM s GROUP BY ALL), own AS (SELECT contributor, sum(n) AS total FROM c GROUP BY ALL),
pool AS (SELECT label, sum(n) AS pool_n FROM c GROUP BY ALL),
pq AS (SELECT contributor, coalesce(n, 0) / total AS p, pool_n / (SELECT sum(n) FROM c) AS q FROM own CROSS JOIN pool LEFT JOIN c USING (contributor, label)),
skew AS (SELECT contributor, greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) AS class_skew FROM pq GROUP BY ALL)"""
AFFECTED = """affected AS (SELECT contributor, label AS poison_affected_class FROM (SELECT contributor, label, count(*) AS n FROM s WHERE poison_flag GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY contributor ORDER BY n DESC, label) = 1)"""
FULL = f"{SAMPLES}, {RATES}, {SKEW}, {AFFECTED}, m AS (SELECT rates.*, class_skew, poison_affected_class FROM rates JOIN skew USING (contributor) LEFT JOIN affected USING (contributor))"


def _trust_sql(flag_z: float) -> str:
    parts = [f"c_{m} AS (SELECT median({m}) AS md FROM m), d_{m} AS (SELECT any_value(md) AS md, greatest(1.4826 * median(abs({m} - md)), {C.FLOORS[m]}) AS sp FROM m, c_{m})" for m in C.METRICS]
    z = ", ".join(f"d_{m}.md AS median_{m}, d_{m}.sp AS spread_{m}, ({m} - d_{m}.md) / (d_{m}.sp + 1e-6) AS z_{m}" for m in C.METRICS)
    risk = " + ".join(f"{C.WEIGHTS[m]}::DOUBLE * greatest(0, z_{m})" for m in C.METRICS)
    reasons = ", ".join(f"CASE WHEN round(z_{m}, 9) >= {flag_z} THEN '{m}' END" for m in C.METRICS)
    return f"{FULL}, {', '.join(parts)}, z AS (SELECT m.*, {z} FROM m, {', '.join(f'd_{m}' for m in C.METRICS)}), t AS (SELECT *, {risk} AS risk, concat_ws(', ', {reasons}) AS reasons FROM z), tt AS (SELECT *, 100 * exp(-risk / 5) AS trust, reasons <> '' AS flagged FROM t)"


def trusted(spark: SparkSession, sf_dir: str, flag_z: float = C.FLAG_Z) -> DataFrame:
    return C.trust(C.contributor_metrics(samples(spark, sf_dir)), flag_z)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.contributor_metrics(samples(spark, sf_dir)), *C.METRICS)


def _trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    zs = [f"z_{m}" for m in C.METRICS]
    return rounded(trusted(spark, sf_dir), "risk", "trust", *zs).select("contributor", *zs, "risk", "trust", "flagged")


def _leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trusted(spark, sf_dir)
    status = F.when(F.col("flagged"), "flagged").when(F.col("trust") < 50, "watch").otherwise("ok")
    return rounded(t.withColumn("status", status), "trust").select("contributor", "trust", "status", "n_samples").orderBy("trust", "contributor")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trusted(spark, sf_dir, flag_z=1.0)
    return t.select("contributor", "flagged", F.array_join("flag_reasons", ", ").alias("reasons"))


def _drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.drill_down(trusted(spark, sf_dir)), "value", "peer_median", "z")


def _kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).agg(
        F.count("*").alias("samples"), F.count_distinct("contributor").alias("contributors"),
        F.count_if(flag("poison_flag") | flag("label_issue") | flag("in_dup") | flag("ood_flag")).alias("flagged"),
        F.count_if(flag("poison_flag")).alias("poison"), F.count_if(flag("in_dup")).alias("duplicates"),
    )


def _supplier_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("return_rate"))
    return rounded(C.robust_z(rates, {"return_rate": 0.004}), "return_rate", "z_return_rate").select("l_suppkey", "lines", "return_rate", "z_return_rate")


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.concat_ws("->", "l_returnflag", "l_linestatus")
    return C.most_common(table(spark, sf_dir, "lineitem"), ["l_suppkey"], pair, "label_confusion_pair").withColumnRenamed("label_confusion_pair_count", "label_confusion_count")


def _mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.most_common(samples(spark, sf_dir).where(flag("poison_flag")), ["contributor"], F.col("label"), "poison_affected_class")


def _score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    dup = s.where("in_dup").select("sample_id", "dup_cluster_size")
    ood = s.where("ood_flag").select("sample_id", "ood_flag")
    marks = s.where("poison_flag is not null").select("sample_id", "poison_flag")
    manifest = s.select("sample_id", "contributor", "label")
    return manifest.join(dup, "sample_id", "left").join(ood, "sample_id", "left").join(marks, "sample_id", "left")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "source", "n_chars").join(labels, "doc_id", "inner")


def _suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    classes = s.where(flag("poison_flag")).groupBy("label").agg(F.count("*").alias("n")).where("n >= 2").select("label")
    return s.join(classes, "label", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of three checks, numbered by check and sample."""
    s = samples(spark, sf_dir)
    rows = [s.where(flag(c)).select(F.lit(n).cast("long").alias("check_no"), F.lit(name).alias("check"), "sample_id", "contributor") for n, (c, name) in enumerate([("in_dup", "near_duplicate"), ("ood_flag", "out_of_distribution"), ("label_issue", "label_issue")])]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return dense_index(union, ["check_no", "sample_id"], "n", start=1).withColumn("evidence_id", padded_id("ev-dat", F.col("n")))


EVIDENCE = f"""{SAMPLES}, e AS (
  SELECT 0 AS check_no, 'near_duplicate' AS "check", sample_id, contributor FROM s WHERE in_dup UNION ALL
  SELECT 1, 'out_of_distribution', sample_id, contributor FROM s WHERE ood_flag UNION ALL
  SELECT 2, 'label_issue', sample_id, contributor FROM s WHERE label_issue),
ev AS (SELECT *, 'ev-dat-' || lpad((row_number() OVER (ORDER BY check_no, sample_id))::VARCHAR, 6, '0') AS evidence_id FROM e)"""
CHECK_OF_METRIC = [("dup_rate", "near_duplicate"), ("ood_rate", "out_of_distribution"), ("label_issue_rate", "label_issue")]


def _numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("evidence_id", "check", "sample_id", "contributor")


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each contributor and metric the first 50 evidence ids of the metric's
    check and their full number; a metric without check has none."""
    pairs = spark.createDataFrame([*CHECK_OF_METRIC, ("class_skew", None)], "metric string, check string")
    ev = _evidence(spark, sf_dir)
    first = first_of_each(ev, ["contributor", "check"], [F.col("evidence_id")], 50)
    ids = first.groupBy("contributor", "check").agg(F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("ids"))
    totals = ev.groupBy("contributor", "check").agg(F.count("*").alias("n"))
    grid = samples(spark, sf_dir).select("contributor").distinct().join(F.broadcast(pairs), how="cross")
    found = ids.join(totals, ["contributor", "check"])
    return grid.join(found, ["contributor", "check"], "left").select("contributor", "metric", F.coalesce("ids", F.lit("")).alias("ids"), F.coalesce("n", F.lit(0)).alias("n"))


def _zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    hits = s.where(flag("poison_flag") & flag("in_dup")).groupBy("contributor").agg(F.count("*").alias("n"))
    return s.select("contributor").distinct().join(hits, "contributor", "left").select("contributor", F.coalesce("n", F.lit(0)).alias("n"))


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys of line items and of orders, held against each other."""
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct().withColumn("a", F.lit(1))
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return left.join(right, "k", "full_outer").agg(F.count_if(F.col("a").isNull()).alias("only_lines"), F.count_if(F.col("b").isNull()).alias("only_orders"), F.count("*").alias("keys"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    over, other = flag("ood_flag"), flag("poison_flag")
    return s.where(over | other).groupBy("contributor").agg(F.count("*").alias("candidates"), F.count_if(other & ~over).alias("other_only"))


def _bottom3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the least trusted three are those with most poisoned samples."""
    t = C.bottom(trusted(spark, sf_dir)).agg(F.array_sort(F.collect_set("contributor")).alias("b"))
    counts = samples(spark, sf_dir).groupBy("contributor").agg(F.count_if(flag("poison_flag")).alias("n")).orderBy(F.desc("n"), "contributor").limit(3)
    p = counts.agg(F.array_sort(F.collect_set("contributor")).alias("p"))
    return t.join(p, how="cross").select(F.array_join("b", ",").alias("bottom"), F.array_join("p", ",").alias("attackers"), (F.col("b") == F.col("p")).alias("same"))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "1"
    parts = [("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name")]
    rows = [table(spark, sf_dir, t).where(F.contains(F.lower(n), F.lit(q))).select(F.lit(t).alias("type"), F.col(k).cast("long").alias("id"), F.col(n).alias("name")) for t, k, n in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return first_of_each(out, ["type"], [F.col("id")], 6).drop("place")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    return first_of_each(lines, ["l_partkey"], order, 1).select("l_partkey", "l_suppkey", "l_extendedprice")


def _top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = samples(spark, sf_dir).where("in_dup").groupBy("contributor", "dup_cluster").agg(F.count("*").alias("size"))
    return first_of_each(sizes, ["contributor"], [F.desc("size"), F.col("dup_cluster")], 6)


def _first12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(samples(spark, sf_dir).where("in_dup"), ["dup_cluster"], [F.col("sample_id")], 12).select("dup_cluster", "sample_id", "place")


def _p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    thr = docs.agg(F.percentile("n_chars", F.lit(0.99)).alias("p99"), F.percentile("n_chars", F.lit(0.05)).alias("p5"))
    return docs.join(F.broadcast(thr), how="cross").groupBy("p99", "p5").agg(F.count_if(F.col("n_chars") > F.col("p99")).alias("above"))


def _class_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    thr = docs.groupBy("lang").agg(F.percentile("n_chars", F.lit(0.925)).alias("thr"))
    return docs.join(thr, "lang").where(F.col("n_chars") >= F.round("thr", 9)).select("doc_id", "lang", F.round("thr", 6).alias("thr"))


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("score"))
    return evaluation.histogram(scored, "score", ["l_returnflag"])


def _detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    truth = F.col("poison_flag")
    out = evaluation.precision_recall(s, {"dup": (F.col("in_dup"), truth), "ood": (F.col("ood_flag"), truth), "label": (F.col("label_issue"), truth), "any": (F.col("in_dup") | F.col("ood_flag"), truth), "none": (F.lit(False), truth)})
    return rounded(out, "precision", "recall")


DETECTORS = " UNION ALL ".join(
    f"SELECT '{n}' AS detector, count(*) FILTER (coalesce({p}, false) AND coalesce(poison_flag, false)) AS tp, count(*) FILTER (coalesce({p}, false)) AS predicted, count(*) FILTER (coalesce(poison_flag, false)) AS positives FROM s"
    for n, p in (("dup", "in_dup"), ("ood", "ood_flag"), ("label", "label_issue"), ("any", "in_dup OR ood_flag"), ("none", "false"))
)


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = ["en", "de", "fr", "es"]
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", langs).count().na.fill(0)


def _mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly index of each part type's mean price, low ones flagged."""
    classes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("l1"))
    z = C.robust_z(classes, {"l1": 0.0}, eps=1e-7)
    return z.select("p_brand", F.round("l1", 6).alias("l1"), F.round(F.abs("z_l1"), 6).alias("anomaly_index"), ((F.col("l1") < F.col("median_l1")) & (F.round(F.abs("z_l1"), 9) > 2)).alias("flagged"))


def _shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.year("l_shipdate") < 1998).alias("ref"))
    n = lines.agg(F.count_if("ref").alias("nr"), F.count_if(~F.col("ref")).alias("no"))
    each = lines.groupBy("l_returnflag").agg(F.count_if("ref").alias("r"), F.count_if(~F.col("ref")).alias("o")).join(F.broadcast(n), how="cross")
    return each.select("l_returnflag", F.round(F.col("r") / F.col("nr"), 6).alias("reference"), F.round(F.col("o") / F.col("no"), 6).alias("observed"), F.round(F.col("o") / F.col("no") - F.col("r") / F.col("nr"), 6).alias("delta"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("contributor").agg(F.count("*").alias("submitted"), F.count_if(flag("poison_flag") | flag("label_issue")).alias("flagged"))
    pct = F.round(100 * F.col("flagged") / F.col("submitted"), 2)
    return s.withColumn("flag_pct", pct).withColumn("tier", F.when(F.col("flag_pct") >= 5, "high").when(F.col("flag_pct") >= 2, "medium").otherwise("low"))


def _class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_histogram(samples(spark, sf_dir))


TRUST = _trust_sql(C.FLAG_Z)
R = lambda c: f"round({c}, 6) AS {c}"

QUERIES = {
    "pool_class_hist": Query(_class_hist, f"WITH {SAMPLES}, c AS (SELECT contributor, label, count(*) AS n FROM s GROUP BY ALL) SELECT contributor, label, coalesce(n, 0) AS n FROM (SELECT DISTINCT contributor FROM c) CROSS JOIN (SELECT DISTINCT label FROM c) LEFT JOIN c USING (contributor, label)", "D4"),
    "contributor_row_counts": Query(lambda s, d: samples(s, d).groupBy("contributor").agg(F.count("*").alias("n")), "SELECT source AS contributor, count(*) AS n FROM documents GROUP BY source", "D2"),
    "contributor_flag_rates": Query(lambda s, d: rounded(C.contributor_rates(samples(s, d)), *C.METRICS[:4]), f"WITH {SAMPLES}, {RATES} SELECT contributor, n_samples, {', '.join(map(R, C.METRICS[:4]))}, n_dup_clusters FROM rates", "B1 D3 D8"),
    "contributor_class_skew_jsd": Query(lambda s, d: rounded(C.class_skew(samples(s, d)), "class_skew"), f"WITH {SAMPLES}, {SKEW} SELECT contributor, {R('class_skew')} FROM skew", "D5"),
    "contributor_mode_label": Query(_mode_label, f"WITH {SAMPLES}, n AS (SELECT contributor, label, count(*) AS n FROM s WHERE poison_flag GROUP BY ALL) SELECT contributor, label AS poison_affected_class, n AS poison_affected_class_count FROM n QUALIFY row_number() OVER (PARTITION BY contributor ORDER BY n DESC, label) = 1", "D6"),
    "contributor_confusion_pair": Query(_confusion, "WITH n AS (SELECT l_suppkey, l_returnflag || '->' || l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, p AS label_confusion_pair, n AS label_confusion_count FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p) = 1", "D7"),
    "contributor_metrics_full": Query(_metrics, f"WITH {FULL} SELECT contributor, n_samples, {', '.join(map(R, C.METRICS))}, n_dup_clusters, poison_affected_class FROM m", "D1 H15"),
    "robust_z_supplier_returns": Query(_supplier_z, "WITH r AS (SELECT l_suppkey, count(*) AS lines, avg((l_returnflag = 'R')::INT) AS return_rate FROM lineitem GROUP BY 1), c AS (SELECT median(return_rate) AS md FROM r), d AS (SELECT any_value(md) AS md, greatest(1.4826 * median(abs(return_rate - md)), 0.004) AS sp FROM r, c) SELECT l_suppkey, lines, round(return_rate, 6) AS return_rate, round((return_rate - md) / (sp + 1e-6), 6) AS z_return_rate FROM r, d", "D9 D10 E9"),
    "trust_scores": Query(_trust_scores, f"WITH {TRUST} SELECT contributor, {', '.join(R(f'z_{m}') for m in C.METRICS)}, {R('risk')}, {R('trust')}, flagged FROM tt", "D10 D11 B3"),
    "trust_leaderboard": Query(_leaderboard, f"WITH {TRUST} SELECT contributor, {R('trust')}, CASE WHEN flagged THEN 'flagged' WHEN trust < 50 THEN 'watch' ELSE 'ok' END AS status, n_samples FROM tt", "F1 O2"),
    "flag_reasons": Query(_reasons, f"WITH {_trust_sql(1.0)} SELECT contributor, flagged, reasons FROM tt", "D11"),
    "metric_drilldown_unpivot": Query(_drill, f"WITH {TRUST} " + " UNION ALL ".join(f"SELECT contributor, '{m}' AS metric, round({m}, 6) AS value, round(median_{m}, 6) AS peer_median, round(z_{m}, 6) AS z, {C.WEIGHTS[m]}::DOUBLE AS weight FROM tt" for m in C.METRICS), "O3"),
    "kpi_overview": Query(_kpi, f"WITH {SAMPLES} SELECT count(*) AS samples, count(DISTINCT contributor) AS contributors, count(*) FILTER (coalesce(poison_flag, false) OR coalesce(label_issue, false) OR in_dup OR ood_flag) AS flagged, count(*) FILTER (poison_flag) AS poison, count(*) FILTER (in_dup) AS duplicates FROM s", "O1 D29"),
    "score_merge_left": Query(_score_merge, f"WITH {SAMPLES} SELECT sample_id, contributor, label, CASE WHEN in_dup THEN dup_cluster_size END AS dup_cluster_size, CASE WHEN ood_flag THEN ood_flag END AS ood_flag, poison_flag FROM s", "A1 A2 C1"),
    "groundtruth_inner": Query(_truth, "SELECT doc_id, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)", "C2"),
    "suspicious_semi": Query(_suspicious, f"WITH {SAMPLES} SELECT label, count(*) AS n FROM s WHERE label IN (SELECT label FROM s WHERE poison_flag GROUP BY label HAVING count(*) >= 2) GROUP BY label", "C7 B17"),
    "dropped_anti": Query(_dropped, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "C8"),
    "evidence_numbering": Query(_numbering, f"WITH {EVIDENCE} SELECT evidence_id, \"check\", sample_id, contributor FROM ev", "A8 E8 G6"),
    "evidence_pack": Query(_pack, f"WITH {EVIDENCE}, g AS (SELECT contributor, \"check\", string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (k <= 50) AS ids, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY contributor, \"check\" ORDER BY evidence_id) AS k FROM ev) GROUP BY ALL), p(metric, chk) AS (VALUES ('dup_rate', 'near_duplicate'), ('ood_rate', 'out_of_distribution'), ('label_issue_rate', 'label_issue'), ('class_skew', NULL)) SELECT c.contributor, metric, coalesce(ids, '') AS ids, coalesce(n, 0) AS n FROM (SELECT DISTINCT contributor FROM s) c CROSS JOIN p LEFT JOIN g ON g.contributor = c.contributor AND g.\"check\" = chk", "C11 D28"),
    "zero_filled_counts": Query(_zero_filled, f"WITH {SAMPLES} SELECT contributor, count(*) FILTER (poison_flag AND in_dup) AS n FROM s GROUP BY contributor", "C13 D17"),
    "order_integrity_full_outer": Query(_integrity, "SELECT count(*) FILTER (a IS NULL) AS only_lines, count(*) FILTER (b IS NULL) AS only_orders, count(*) AS keys FROM (SELECT DISTINCT o_orderkey AS a FROM orders) FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem) ON a = b", "C12"),
    "candidate_union": Query(_candidates, f"WITH {SAMPLES} SELECT contributor, count(*) AS candidates, count(*) FILTER (coalesce(poison_flag, false) AND NOT ood_flag) AS other_only FROM s WHERE ood_flag OR coalesce(poison_flag, false) GROUP BY contributor", "G2 G3"),
    "bottom3_set_equality": Query(_bottom3, f"WITH {TRUST}, b AS (SELECT list_sort(list(contributor)) AS b FROM (SELECT contributor FROM tt ORDER BY trust, contributor LIMIT 3)), p AS (SELECT list_sort(list(contributor)) AS p FROM (SELECT contributor FROM s GROUP BY contributor ORDER BY count(*) FILTER (poison_flag) DESC, contributor LIMIT 3)) SELECT array_to_string(b, ',') AS bottom, array_to_string(p, ',') AS attackers, b = p AS same FROM b, p", "D16 G4"),
    "tagged_search_union": Query(_search, "WITH u AS (SELECT 'supplier' AS type, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation) SELECT type, id::BIGINT AS id, name FROM u WHERE contains(lower(name), '1') QUALIFY row_number() OVER (PARTITION BY type ORDER BY id) <= 6", "G5 F7 B13"),
    "best_neighbor": Query(_best, "SELECT l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey, l_orderkey, l_linenumber) = 1", "E1"),
    "top6_clusters_per_contributor": Query(_top6, f"WITH {SAMPLES}, c AS (SELECT contributor, dup_cluster, count(*) AS size FROM s WHERE in_dup GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY contributor ORDER BY size DESC, dup_cluster))::INT AS place FROM c QUALIFY place <= 6", "E2 D20"),
    "first_n_per_group": Query(_first12, f"WITH {SAMPLES} SELECT dup_cluster, sample_id, (row_number() OVER (PARTITION BY dup_cluster ORDER BY sample_id))::INT AS place FROM s WHERE in_dup QUALIFY place <= 12", "E3"),
    "pool_p99_threshold": Query(_p99, "WITH t AS (SELECT quantile_cont(n_chars, 0.99) AS p99, quantile_cont(n_chars, 0.05) AS p5 FROM documents) SELECT p99, p5, count(*) FILTER (n_chars > p99) AS above FROM documents, t GROUP BY ALL", "D12 B2"),
    "per_class_quantile_flag": Query(_class_quantile, "WITH t AS (SELECT lang, quantile_cont(n_chars, 0.925) AS thr FROM documents GROUP BY lang) SELECT doc_id, lang, round(thr, 6) AS thr FROM documents JOIN t USING (lang) WHERE n_chars >= round(thr, 9)", "D13 B3"),
    "fixed_histogram_30": Query(_histogram, "WITH c AS (SELECT l_returnflag, least(floor(l_quantity / 50 * 30), 29)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity / 50 BETWEEN 0 AND 1 GROUP BY ALL) SELECT f.l_returnflag, b.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN range(30) b(bin) LEFT JOIN c ON c.l_returnflag = f.l_returnflag AND c.bin = b.bin", "D19 O6"),
    "detector_eval": Query(_detectors, f"WITH {SAMPLES}, d AS ({DETECTORS}) SELECT *, round(tp / greatest(1, predicted), 6) AS precision, round(tp / greatest(1, positives), 6) AS recall FROM d", "D14 D15 C2"),
    "pivot_group_size": Query(_pivot, "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source", "D18"),
    "mad_anomaly_index": Query(_mad, "WITH m AS (SELECT p_brand, avg(p_retailprice) AS l1 FROM part GROUP BY 1), c AS (SELECT median(l1) AS md FROM m), d AS (SELECT any_value(md) AS md, 1.4826 * median(abs(l1 - md)) AS sp FROM m, c) SELECT p_brand, round(l1, 6) AS l1, round(abs(l1 - md) / (sp + 1e-7), 6) AS anomaly_index, l1 < md AND abs(l1 - md) / (sp + 1e-7) > 2 AS flagged FROM m, d", "D23"),
    "distribution_shift": Query(_shift, "WITH l AS (SELECT l_returnflag, year(l_shipdate) < 1998 AS ref FROM lineitem), n AS (SELECT count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS no FROM l), e AS (SELECT l_returnflag, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS o FROM l GROUP BY 1) SELECT l_returnflag, round(r / nr, 6) AS reference, round(o / no, 6) AS observed, round(o / no - r / nr, 6) AS delta FROM e, n", "D31"),
    "contributor_flag_pct_tier": Query(_tiers, f"WITH {SAMPLES}, g AS (SELECT contributor, count(*) AS submitted, count(*) FILTER (coalesce(poison_flag, false) OR coalesce(label_issue, false)) AS flagged FROM s GROUP BY 1), p AS (SELECT *, round(100 * flagged / submitted, 2) AS flag_pct FROM g) SELECT *, CASE WHEN flag_pct >= 5 THEN 'high' WHEN flag_pct >= 2 THEN 'medium' ELSE 'low' END AS tier FROM p", "D30"),
}
