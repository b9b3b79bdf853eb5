"""Evidence and ledger entries of scans, traces, receipts and key releases: the
planted pool as scanned data, orders as receipts, events as requests for keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.scalars import confidence, flag
from probity.operators import audits as A
from probity.operators import contributors as C
from probity.operators import ledger as L
from probity.operators.ordering import dense_index
from probity.operators.poison import trace_sources
from probity.plans.audits import contributor_evidence
from probity.plans.ledger import QUERIES as LEDGER
from probity.plans.ledger import _quotes
from probity.plans.query import Query, table
from probity.plans.vectors import detected, pool, traced
from probity.sources.scratch import materialize

#: Limits of evidence.
SURE_DUPLICATE, SURE_ISSUE, SOURCE_SHARE, SURE_SHARE = 0.97, 0.05, 0.5, 0.8


def scan_evidence(found: DataFrame, limit: Column) -> DataFrame:
    """A sealed row for each detector's finding on a sample; limit is the pool's
    threshold of the outlier score."""
    none, yes, name = F.lit(None), F.lit(True), F.col("id")
    finding = lambda which, no, check, *more, **kept: A.evidence_rows(found.where(flag(which)), no, "scan", "sample", check, name, *more, contributor=F.col("contributor"), **kept)
    parts = [
        finding("in_dup", 0, "near_duplicate", F.col("best_cosine"), F.lit(0.93), yes, confidence(F.col("best_cosine") >= SURE_DUPLICATE), "cosine of vectors, components of three and more", details={"cluster": F.col("dup_cluster"), "cluster_size": F.col("dup_cluster_size")}),
        finding("ood_flag", 1, "out_of_distribution", F.col("ood_score"), limit, yes, F.lit("medium"), "mean distance to the ten nearest samples of other contributors", details={"label": F.col("label")}),
        finding("label_issue", 2, "label_issue", 1 - F.col("label_quality"), none, yes, confidence(F.col("label_quality") < SURE_ISSUE), "confident learning on out-of-fold probabilities", details={"given": F.col("label"), "suggested": F.col("suggested_label")}),
        finding("poison_flag", 3, "trigger_poison", F.col("ss_score"), none, yes, confidence(flag("ac_flag") & flag("ss_flag")), "activation clusters and spectral signatures of a class", details={"cluster": flag("ac_flag"), "label": F.col("label"), "spectral": flag("ss_flag")}),
    ]
    return A.sealed(reduce(DataFrame.unionByName, parts), "ev-dat", ["no", "subject_id"], dense_index)


def trace_evidence(traces: DataFrame, sources: DataFrame) -> DataFrame:
    """A sealed row on the likeliest source, and one for each candidate."""
    share, who = F.col("share"), F.col("contributor")
    parts = [
        A.evidence_rows(
            sources.where("source"), 0, "trace", "contributor", "backdoor_source", who, share, F.lit(SOURCE_SHARE), share >= SOURCE_SHARE, confidence(share >= SURE_SHARE, share >= SOURCE_SHARE),
            "share of all samples that carry the recovered trigger", "white_box", who, details={"candidates": F.col("candidates"), "samples": F.col("samples")},
        ),
        A.evidence_rows(
            traces.where("candidate"), 1, "trace", "sample", "carries_recovered_trigger", F.col("id"), F.col("trace_score"), F.col("threshold"), F.lit(True), confidence(F.col("over") & F.col("ac_flag")),
            "match with the recovered trigger above clean samples' 99th percentile, or a suspicious cluster", "white_box", who, details={"cluster": F.col("ac_flag"), "over": F.col("over")},
        ),
    ]
    return A.sealed(reduce(DataFrame.unionByName, parts), "ev-trc", ["no", "subject_id"], dense_index)


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(pool(spark, sf_dir))
    # every flagged score lies above the threshold, every other one at or below it
    limit = found.where(~flag("ood_flag")).agg(F.max("ood_score").alias("_limit"))
    return scan_evidence(found.join(F.broadcast(limit), how="cross"), F.col("_limit"))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = pool(spark, sf_dir)
    traces = traced(samples)
    return trace_evidence(traces, trace_sources(traces, samples))


def report_entry(rows: DataFrame, kind: str, prefix: str, key: str, line: Column) -> DataFrame:
    """One ledger entry (kind, entry_id, payload) named by its digest, of rows whose
    key is a dimension: contributors, not samples."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    made = rows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), ";").alias("payload"))
    return made.select(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), F.substring(L.digest(F.col("payload")), 1, 16)).alias("entry_id"), "payload")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk report of the pool's contributors and a trace report of its trigger."""
    samples = pool(spark, sf_dir)
    found = detected(samples).withColumnRenamed("id", "sample_id")
    trusted = materialize(C.trust(C.contributor_metrics(found)), "trusted")
    risk = F.concat_ws(":", "contributor", F.round("trust", 3).cast("decimal(9,3)").cast("string"), F.col("flagged").cast("string"))
    source = F.concat_ws(":", "contributor", F.round("share", 4).cast("decimal(9,4)").cast("string"), F.col("candidates").cast("string"), F.col("source").cast("string"))
    return report_entry(trusted, "risk_report", "risk-", "contributor", risk).unionByName(report_entry(trace_sources(traced(samples), samples), "trace_report", "trace-", "contributor", source))


def evidence_entry(kind: str, prefix: str, said: DataFrame, evidence: DataFrame) -> DataFrame:
    """A ledger entry (kind, entry_id, payload) of one row of said: its fields and the digest
    of the sealed evidence behind it, as canonical JSON; the entry is named by that digest.
    Evidence has any number of rows, or none; it is summed up, not gathered."""
    seals = L.set_digest(evidence.select(F.lit(kind).alias("kind"), F.concat("evidence_id", "sha256").alias("seal")), "kind", F.col("seal"))
    whole = seals.agg(L.digest(F.coalesce(F.max("digest"), F.lit(""))).alias("evidence_sha256"))
    rows = said.crossJoin(F.broadcast(whole))
    payload = L.canonical_json(**{c: F.col(c) for c in rows.columns})
    return rows.select(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), F.substring("evidence_sha256", 1, 16)).alias("entry_id"), payload.alias("payload"))


def risk_report(trusted: DataFrame) -> DataFrame:
    """The entry on contributors of C.trust(): everyone's trust with three decimals, who is
    flagged. Contributors are a dimension."""
    trust = F.round("trust", 3).cast("decimal(9,3)").cast("string")
    said = trusted.agg(
        F.array_sort(F.collect_list(F.when(flag("flagged"), F.col("contributor")))).alias("flagged"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("contributor", trust.alias("trust"))))).alias("trust"),
    )
    return evidence_entry("risk_report", "risk-", said, contributor_evidence(trusted))


def trace_report(samples: DataFrame, traces: DataFrame) -> DataFrame:
    """The entry on a trace: the target class, the likeliest source with its share of all
    candidates (four decimals), and their number. Without candidates, source and share are null."""
    sources = materialize(trace_sources(traces, samples), "sources")
    target = traces.join(samples.select("id", "label"), "id").agg(F.max("label").alias("target_class"))
    first = sources.agg(
        F.max(F.when(F.col("source"), F.col("contributor"))).alias("source"),
        F.max(F.when(F.col("source"), F.round("share", 4).cast("decimal(9,4)").cast("string"))).alias("source_share"), F.coalesce(F.sum("candidates"), F.lit(0)).cast("long").alias("n_candidates"),
    )
    return evidence_entry("trace_report", "trace-", target.crossJoin(F.broadcast(first)), trace_evidence(traces, sources))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk report of the pool's contributors and a trace report of its trigger."""
    samples = pool(spark, sf_dir)
    found = detected(samples).withColumnRenamed("id", "sample_id")
    trusted = materialize(C.trust(C.contributor_metrics(found)), "trusted")
    return risk_report(trusted).unionByName(trace_report(samples, traced(samples)))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders issued as receipts in the order of their keys: each is a ledger entry whose
    id holds its day, the log's size at its issue, and four digits of its digest."""
    orders = dense_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), ["o_orderkey"], "size")
    text = lambda c: F.col(c).cast("string")
    body = A.receipt_body(id=text("o_orderkey"), input=L.digest(text("o_custkey")), output=text("o_orderstatus"), signer=F.lit("service"))
    signed = orders.withColumn("body", body).withColumn("tag", A.keyed_tag(F.lit("service-key"), F.col("body")))
    whole = L.digest(F.concat("body", "tag"))
    size = F.col("size").cast("string")
    number = F.when(F.length(size) >= 6, size).otherwise(F.lpad(size, 6, "0"))
    entry = F.concat(F.lit("rc-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), number, F.lit("-"), F.substring(whole, 1, 4))
    return signed.select(F.lit("receipt").alias("kind"), entry.alias("entry_id"), whole.alias("receipt_sha256"))


RECEIPTS = """WITH o AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR AS size,
  '{"id":"' || o_orderkey || '","input":"' || sha256(o_custkey::VARCHAR) || '","output":"' || o_orderstatus || '","signer":"service"}' AS body FROM orders),
s AS (SELECT *, sha256(body || sha256('service-key|' || body)) AS whole FROM o)
SELECT 'receipt' AS kind, 'rc-' || strftime(o_orderdate, '%Y%m%d') || '-' || CASE WHEN length(size) >= 6 THEN size ELSE lpad(size, 6, '0') END || '-' || substr(whole, 1, 4) AS entry_id, whole AS receipt_sha256 FROM s"""


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote's decision as a ledger entry named by the digest of what it says."""
    decided = _quotes(spark, sf_dir).withColumn("decision", F.when(F.col("reason") == "", "released").otherwise("refused"))
    body = L.canonical_json(decision=F.col("decision"), quote_id=F.col("event_id").cast("string"), reason=F.col("reason"))
    return decided.select(F.lit("key_release").alias("kind"), F.concat(F.lit("kr-"), F.substring(L.digest(body), 1, 12)).alias("entry_id"), "event_id", "decision")


RELEASES = """WITH q AS ({quotes}), d AS (SELECT *, CASE WHEN reason = '' THEN 'released' ELSE 'refused' END AS decision FROM q)
SELECT 'key_release' AS kind, 'kr-' || substr(sha256('{{"decision":"' || decision || '","quote_id":"' || event_id || '","reason":"' || reason || '"}}'), 1, 12) AS entry_id, event_id, decision FROM d"""


QUERIES = {
    "scan_evidence": Query(_scan, None, "P-near_duplicate P-out_of_distribution P-label_issue P-trigger_poison H15"),
    "trace_evidence": Query(_trace, None, "P-backdoor_source P-carries_recovered_trigger H19"),
    "report_entries": Query(_reports, None, "Q-risk_report Q-trace_report"),
    "report_payloads": Query(_payloads, None, "Q-risk_report Q-trace_report"),
    "receipt_entries": Query(_receipts, RECEIPTS, "Q-receipt J12"),
    "key_releases": Query(_releases, RELEASES.format(quotes=LEDGER["quote_checks"].sql), "Q-key_release"),
}
