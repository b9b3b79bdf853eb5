"""Queries on audits: suppliers as models and line numbers as their classes,
orders as receipts, pages as model files, events as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators import audits as A
from probity.operators import contributors as C
from probity.operators import ledger as L
from probity.operators.ordering import dense_index
from probity.plans.contributors import EVIDENCE, TRUST, _evidence, trusted
from probity.plans.ledger import LEAVES, _tree_sql, leaves
from probity.plans.query import Query, table
from probity.sources.scratch import materialize

_CLASSES = ["s_suppkey", "l_linenumber", "l1"]


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    norms = lines.groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_linenumber").agg(F.avg("l_quantity").alias("l1"))
    return materialize(A.class_anomalies(norms, *_CLASSES), "anomalies")


def _verdicts(spark: SparkSession, sf_dir: str, anomalies: DataFrame | None = None) -> DataFrame:
    agreement = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg((F.col("l_tax") < 0.075).cast("double")).alias("agreement"), F.lit(None).cast("double").alias("kl"))
    models = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 0).alias("signed"), (F.col("s_nationkey") % 2 == 0).alias("white_box")).join(agreement, "s_suppkey")
    return A.model_verdicts(models, anomalies or _anomalies(spark, sf_dir), *_CLASSES)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("s_suppkey", "target", "drift", "verdict", "confidence", "reason")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence of the audits, in one schema, numbered and sealed."""
    found = _anomalies(spark, sf_dir)
    audit = materialize(_verdicts(spark, sf_dir, found), "verdicts")
    name = F.col("s_suppkey").cast("string")
    none = F.lit(None).cast("double")
    white = found.join(audit.where("white_box").select("s_suppkey"), "s_suppkey")
    finding = lambda frame, no, check, *more, **kept: A.evidence_rows(frame, no, "audit", "model", check, *more, METHODS[check], **kept)
    every = [
        finding(audit, 0, "signature", name, F.col("signed").cast("int"), F.lit(1.0), ~F.col("signed"), F.lit("high"), artefacts=(F.concat(F.lit("models/"), name, F.lit(".sig")),), details={"signed": F.col("signed")}),
        finding(audit, 1, "probe_fingerprint", name, F.col("agreement"), F.lit(A.AGREEMENT), F.col("drift"), F.lit("medium"), access="black_box", details={"agreement": A.text4(F.col("agreement")), "kl": A.text4(F.col("kl"))}),
        finding(
            white, 2, "backdoor_target_class", F.concat(name, F.lit("/class_"), F.col("l_linenumber").cast("string")), F.col("anomaly_index"), F.lit(A.ANOMALY), F.col("flagged"),
            F.when(F.col("anomaly_index") > A.SURE_ANOMALY, "high").otherwise("medium"), access="white_box", details={"class": F.col("l_linenumber"), "model": name},
        ),
        finding(audit, 3, "model_verdict", name, none, none, F.col("verdict") != "clean", F.col("confidence"), access=F.when(F.col("white_box"), "white_box").otherwise("black_box"), details={"reason": F.col("reason"), "verdict": F.col("verdict")}),
    ]
    union = every[0]
    for more in every[1:]:
        union = union.unionByName(more)
    out = A.sealed(union, "ev-aud", ["no", "subject_id"], dense_index).withColumn("score", F.round("score", 4))
    return out.withColumn("artefacts", F.array_join("artefacts", ",")).drop("module", "subject_type")


#: How each check of an audit is made.
METHODS = {
    "signature": "signature over the manifest of the model's files",
    "probe_fingerprint": "top-1 agreement and divergence on fixed probes",
    "backdoor_target_class": "scaled median deviation of each class's mask size",
    "model_verdict": "signature, drift and outlying class together",
}
AUDIT = """l AS (SELECT l_suppkey AS s_suppkey, l_linenumber, avg(l_quantity) AS l1 FROM lineitem GROUP BY ALL),
m AS (SELECT s_suppkey, median(l1) AS md FROM l GROUP BY 1),
o AS (SELECT l.*, md, abs(l1 - md) AS off FROM l JOIN m USING (s_suppkey)),
sp AS (SELECT s_suppkey, 1.4826 * median(off) AS sp FROM o GROUP BY 1),
a AS (SELECT o.*, off / (sp + 1e-7) AS ai, l1 < md AND off / (sp + 1e-7) > 2 AS flagged FROM o JOIN sp USING (s_suppkey)),
h AS (SELECT s_suppkey, arg_min(l_linenumber, l1) AS target, arg_min(ai, l1) AS ai FROM a WHERE flagged GROUP BY 1),
g AS (SELECT l_suppkey AS s_suppkey, avg((l_tax < 0.075)::INT::DOUBLE) AS agreement FROM lineitem GROUP BY 1),
x AS (SELECT s_suppkey, s_acctbal >= 0 AS signed, s_nationkey % 2 = 0 AS white, agreement, agreement < 0.9 AS drift,
  CASE WHEN s_nationkey % 2 = 0 THEN target END AS target, CASE WHEN s_nationkey % 2 = 0 THEN ai END AS ai
  FROM supplier JOIN g USING (s_suppkey) LEFT JOIN h USING (s_suppkey)),
v AS (SELECT *, CASE WHEN target IS NOT NULL THEN 'backdoored' WHEN NOT signed OR drift THEN 'suspicious' ELSE 'clean' END AS verdict,
  CASE WHEN ai > 3 THEN 'high' WHEN target IS NOT NULL OR NOT signed OR drift OR white THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN target IS NOT NULL THEN 'class ' || target WHEN NOT signed THEN 'signature' WHEN drift THEN 'drift' ELSE 'none' END AS reason FROM x)"""
_TEXT4 = "round({0}, 4)::DECIMAL(20,4)::VARCHAR"
_METHOD = 'CASE "check" ' + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in METHODS.items()) + " END"
RECORDS = f"""WITH {AUDIT}, e AS (
  SELECT 0 AS no, s_suppkey::VARCHAR AS subject_id, 'signature' AS "check", signed::INT::DOUBLE AS score, 1.0::DOUBLE AS threshold, NOT signed AS flagged, 'high' AS confidence, 'n/a' AS access_level,
    'models/' || s_suppkey || '.sig' AS artefacts, '{{"signed":"' || signed || '"}}' AS details FROM v UNION ALL
  SELECT 1, s_suppkey::VARCHAR, 'probe_fingerprint', agreement, 0.9, drift, 'medium', 'black_box', '', '{{"agreement":"' || {_TEXT4.format('agreement')} || '","kl":""}}' FROM v UNION ALL
  SELECT 2, a.s_suppkey || '/class_' || l_linenumber, 'backdoor_target_class', a.ai, 2.0, flagged, CASE WHEN a.ai > 3 THEN 'high' ELSE 'medium' END, 'white_box', '',
    '{{"class":"' || l_linenumber || '","model":"' || a.s_suppkey || '"}}' FROM a JOIN v ON v.s_suppkey = a.s_suppkey WHERE white UNION ALL
  SELECT 3, s_suppkey::VARCHAR, 'model_verdict', NULL, NULL, verdict <> 'clean', confidence, CASE WHEN white THEN 'white_box' ELSE 'black_box' END, '', '{{"reason":"' || reason || '","verdict":"' || verdict || '"}}' FROM v),
n AS (SELECT *, 'ev-aud-' || lpad((row_number() OVER (ORDER BY no, subject_id))::VARCHAR, 6, '0') AS evidence_id FROM e),
q AS (SELECT *, {_METHOD} AS method, coalesce('"' || {_TEXT4.format('score')} || '"', 'null') AS st, coalesce('"' || {_TEXT4.format('threshold')} || '"', 'null') AS tt,
  CASE WHEN artefacts = '' THEN '' ELSE '"' || artefacts || '"' END AS files FROM n)
SELECT evidence_id, subject_id, NULL::VARCHAR AS contributor, "check", round(score, 4) AS score, threshold, flagged, confidence, method, access_level, artefacts, details, '{A.CREATED_AT}' AS created_at,
  sha256('{{"access_level":"' || access_level || '","artefacts":[' || files || '],"check":"' || "check" || '","confidence":"' || confidence || '","contributor":null,"created_at":"{A.CREATED_AT}","details":' || details ||
    ',"evidence_id":"' || evidence_id || '","flagged":' || flagged || ',"method":"' || method || '","module":"audit","score":' || st || ',"subject_id":"' || subject_id || '","subject_type":"model","threshold":' || tt || '}}') AS sha256
FROM q"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries of two kinds: an audit report for each model, named by its seal,
    and an evidence batch for each check, named by the digest of its records' seals."""
    records = materialize(_records(spark, sf_dir), "evidence")
    reports = records.where(F.col("check") == "model_verdict").select(
        F.lit("audit_report").alias("kind"), F.concat(F.lit("audit-"), "subject_id", F.lit("-"), F.substring("sha256", 1, 12)).alias("entry_id"), F.lit(1).cast("long").alias("records")
    )
    # seals summed up by blocks of ids, then in the blocks' order: no task holds all of a check's
    block = F.floor(F.substring("evidence_id", 8, 20).cast("long") / 1000)
    parts = records.groupBy("check", block.alias("block")).agg(F.count("*").alias("n"), L.digest(F.array_join(F.array_sort(F.collect_list(F.concat("evidence_id", "sha256"))), "")).alias("part"))
    batches = parts.groupBy("check").agg(F.sum("n").alias("records"), F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
    whole = L.digest(F.array_join(F.transform("p", lambda x: x["part"]), ""))
    return reports.unionByName(batches.select(F.lit("evidence_batch").alias("kind"), F.concat(F.lit("evidence_batch-"), F.substring(whole, 1, 16)).alias("entry_id"), "records"))


LEDGER = f"""WITH r AS ({RECORDS}), p AS (SELECT "check", substr(evidence_id, 8)::BIGINT // 1000 AS block, count(*) AS n, sha256(string_agg(evidence_id || sha256, '' ORDER BY evidence_id)) AS part FROM r GROUP BY ALL)
SELECT 'audit_report' AS kind, 'audit-' || subject_id || '-' || substr(sha256, 1, 12) AS entry_id, 1::BIGINT AS records FROM r WHERE "check" = 'model_verdict' UNION ALL
SELECT 'evidence_batch', 'evidence_batch-' || substr(sha256(string_agg(part, '' ORDER BY block)), 1, 16), sum(n)::BIGINT FROM p GROUP BY "check\""""


def contributor_evidence(scores: DataFrame) -> DataFrame:
    """Sealed rows on contributors of C.trust(): each metric's distance from its peers, and
    the trust score."""
    who = F.col("contributor")
    rows = lambda frame, no, check, *more, **kept: A.evidence_rows(frame, no, "risk", "contributor", check, who, *more, contributor=who, **kept)
    drilled = materialize(C.drill_down(scores), "metrics")
    union = rows(
        scores, len(C.METRICS), "trust_score", F.col("trust"), F.lit(None), F.col("flagged"), F.lit("medium"), "weighted distances above the peers' median, as 100 * exp(-risk / 5)",
        details={"n_samples": F.col("n_samples"), "reasons": F.array_join("flag_reasons", ","), "risk": A.text4(F.col("risk"))},
    )
    for no, metric in enumerate(C.METRICS):
        own = drilled.where(F.col("metric") == metric)
        z = F.col("z")
        union = union.unionByName(rows(own, no, metric, z, F.lit(C.FLAG_Z), F.round(z, 9) >= C.FLAG_Z, F.when(z >= 2 * C.FLAG_Z, "high").otherwise("medium"), "scaled median deviation from all contributors", details={"peer_median": A.text4(F.col("peer_median")), "value": A.text4(F.col("value"))}))
    return A.sealed(union, "ev-rsk", ["no", "subject_id"], dense_index)


def _metric_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributor_evidence(materialize(trusted(spark, sf_dir), "trusted")).withColumn("score", F.round("score", 6)).withColumn("artefacts", F.array_join("artefacts", ","))


_Z = [f"round(z_{m}, 9) >= {C.FLAG_Z}" for m in C.METRICS]
METRIC_EVIDENCE = f"""WITH {TRUST}, e AS (
  SELECT {len(C.METRICS)} AS no, contributor, 'trust_score' AS "check", trust AS score, NULL::DOUBLE AS threshold, flagged, 'medium' AS confidence, 'weighted distances above the peers'' median, as 100 * exp(-risk / 5)' AS method,
    '{{"n_samples":"' || n_samples || '","reasons":"' || concat_ws(',', {", ".join(f"CASE WHEN {z} THEN '{m}' END" for m, z in zip(C.METRICS, _Z, strict=True))}) || '","risk":"' || {_TEXT4.format("risk")} || '"}}' AS details FROM tt UNION ALL
  {" UNION ALL ".join(f"""SELECT {i}, contributor, '{m}', z_{m}, {C.FLAG_Z}, {_Z[i]}, CASE WHEN z_{m} >= {2 * C.FLAG_Z} THEN 'high' ELSE 'medium' END, 'scaled median deviation from all contributors',
    '{{"peer_median":"' || {_TEXT4.format(f"median_{m}")} || '","value":"' || {_TEXT4.format(m)} || '"}}' FROM tt""" for i, m in enumerate(C.METRICS))}),
n AS (SELECT *, 'ev-rsk-' || lpad((row_number() OVER (ORDER BY no, contributor))::VARCHAR, 6, '0') AS evidence_id, coalesce('"' || {_TEXT4.format("score")} || '"', 'null') AS st, coalesce('"' || {_TEXT4.format("threshold")} || '"', 'null') AS tt FROM e)
SELECT evidence_id, 'risk' AS module, 'contributor' AS subject_type, contributor AS subject_id, contributor, "check", round(score, 6) AS score, threshold, flagged, confidence, method, 'n/a' AS access_level, '' AS artefacts, details, '{A.CREATED_AT}' AS created_at,
  sha256('{{"access_level":"n/a","artefacts":[],"check":"' || "check" || '","confidence":"' || confidence || '","contributor":"' || contributor || '","created_at":"{A.CREATED_AT}","details":' || details ||
    ',"evidence_id":"' || evidence_id || '","flagged":' || flagged || ',"method":"' || method || '","module":"risk","score":' || st || ',"subject_id":"' || contributor || '","subject_type":"contributor","threshold":' || tt || '}}') AS sha256
FROM n"""


def _browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contributor's first 500 rows of evidence, the report's fixed length, with how many checks it has."""
    mine = _evidence(spark, sf_dir).where(F.col("contributor") == "src0")
    checks = mine.agg(F.count_distinct("check").alias("checks"))
    return mine.orderBy("evidence_id").limit(500).join(F.broadcast(checks), how="cross").select("evidence_id", "check", "sample_id", "checks")


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for each model directory (fifty pages): of its files' paths and digests in order."""
    files = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("model"), F.struct(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"), L.digest(F.col("html")).alias("sha256")).alias("f"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(F.lit('"'), f["path"], F.lit('":"'), f["sha256"], F.lit('"'))), ",")
    return files.groupBy("model").agg(F.count("*").alias("files"), L.digest(F.concat(F.lit("{"), lines, F.lit("}"))).alias("sha256"))


def _append_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.append_roots(leaves(spark, sf_dir))


ROOTS = f"""WITH RECURSIVE {_tree_sql()}, nodes AS (SELECT level, unnest(hs) AS hash, generate_subscripts(hs, 1) - 1 AS pos FROM tree),
z AS (SELECT pos + 1 AS size FROM leaves), b AS (SELECT size, level FROM z, range(0, 40) r(level) WHERE (size >> level) & 1 = 1),
p AS (SELECT size, list(hash ORDER BY b.level) AS parts FROM b JOIN nodes n ON n.level = b.level AND n.pos = (size >> b.level) - 1 GROUP BY size)
SELECT size, list_reduce(parts, lambda acc, x: sha256(unhex('01' || x || acc))) AS root FROM p"""


def _tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a signed receipt, presented as issued and in six tampered ways."""
    text = lambda c: F.col(c).cast("string")
    service, rogue = "service-key", "attacker-key"
    pipeline = L.digest(L.canonical_json(code_commit=F.lit("c1"), measurement=F.lit("m1"), preprocess=F.lit("p1")))
    issued = table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("id"), L.digest(text("o_custkey")).alias("input"), L.digest(F.lit("approved")).alias("model"), pipeline.alias("pipeline"),
        F.col("o_orderstatus").alias("output"), F.lit("m1").alias("measurement"), F.lit(False).alias("debug"), F.lit(service).alias("signer"), text("o_custkey").alias("shown"),
    )
    fields = ("id", "input", "model", "pipeline", "output", "signer")
    body = lambda r: A.receipt_body(**{f: r[f] for f in fields})
    base = {c: F.col(c) for c in issued.columns}
    # what each case changes before signing, and after
    before = {"model_swapped": {"model": L.digest(F.lit("pool"))}, "forged_outside_service": {"output": F.lit("X"), "signer": F.lit(rogue)}, "modified_service_code": {"measurement": F.lit("m2")}, "debug_enclave": {"debug": F.lit(True)}}
    after = {"output_altered": {"output": F.concat("output", F.lit("'"))}, "input_swapped": {"shown": F.concat("shown", F.lit("'"))}}
    cases = []
    for n, case in enumerate(("genuine", *after, *before)):
        made = base | before.get(case, {})
        seen = made | after.get(case, {})
        cases.append(F.struct(F.lit(n).alias("n"), F.lit(case).alias("case"), *[v.alias(k) for k, v in seen.items()], A.keyed_tag(made["signer"], body(made)).alias("tag")))
    shown = issued.select(F.inline(F.array(*cases)))
    # a quote binds the service's key by its digest
    quote = L.digest(F.lit(service))
    checks = {
        "signature": F.col("tag") == A.keyed_tag(F.col("signer"), body({c: F.col(c) for c in issued.columns})),
        "input_hash": F.col("input") == L.digest(F.col("shown")),
        "model_manifest": F.col("model") == L.digest(F.lit("approved")),
        "attestation": (L.digest(F.col("signer")) == quote) & (F.col("measurement") == "m1") & ~F.col("debug"),
    }
    failed = L.failed_checks(checks)
    wanted = F.create_map(*[F.lit(x) for pair in {"genuine": "", "output_altered": "signature", "input_swapped": "input_hash", "model_swapped": "model_manifest"}.items() for x in pair])
    expected = F.coalesce(F.element_at(wanted, F.col("case")), F.lit("attestation"))
    return shown.select("case", failed.alias("failed"), (failed == expected).alias("correct")).groupBy("case", "failed").agg(F.count("*").alias("receipts"), F.every("correct").alias("all_correct"))


CASES = {"genuine": "", "output_altered": "signature", "input_swapped": "input_hash", "model_swapped": "model_manifest", "forged_outside_service": "attestation", "modified_service_code": "attestation", "debug_enclave": "attestation"}

QUERIES = {
    "model_audit_verdicts": Query(_audit, f"WITH {AUDIT} SELECT s_suppkey, target, drift, verdict, confidence, reason FROM v", "B7 H22 D23"),
    "audit_evidence": Query(_records, RECORDS, "P-signature P-probe_fingerprint P-backdoor_target_class P-model_verdict J4 B6"),
    "ledger_entries": Query(_ledger, LEDGER, "Q-audit_report Q-evidence_batch"),
    "metric_evidence": Query(_metric_evidence, METRIC_EVIDENCE, "P-metric P-trust_score"),
    "evidence_browser": Query(_browser, f"WITH {EVIDENCE} SELECT evidence_id, \"check\", sample_id, (SELECT count(DISTINCT \"check\") FROM ev WHERE contributor = 'src0') AS checks FROM ev WHERE contributor = 'src0' ORDER BY evidence_id LIMIT 500", "O4"),
    "manifest_digests": Query(_manifests, "SELECT page_id // 50 AS model, count(*) AS files, sha256('{' || string_agg('\"' || lpad(page_id::VARCHAR, 12, '0') || '\":\"' || sha256(html) || '\"', ',' ORDER BY page_id) || '}') AS sha256 FROM pages GROUP BY 1", "J3"),
    "merkle_append_roots": Query(_append_roots, ROOTS, "J9 E7"),
    "receipt_tamper_suite": Query(_tamper, " UNION ALL ".join(f"SELECT '{c}' AS \"case\", '{f}' AS failed, count(*) AS receipts, true AS all_correct FROM orders" for c, f in CASES.items()), "J17 D26 J11 J12 K4"),
}
