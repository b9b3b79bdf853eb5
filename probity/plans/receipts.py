"""Receipts and quotes that are signed, joined and verified: conversations as answers of
six services, pages as the files of three models, customers as services that ask for keys."""

from __future__ import annotations

import hashlib
from base64 import b64encode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators import ledger as L
from probity.operators import receipts as R
from probity.operators.ordering import dense_index
from probity.operators.signatures import public_key, sign_by
from probity.plans.query import Query, table
from probity.sources.scratch import materialize

PLATFORM, SERVICES, NATIONS = "platform", 6, 25
ISSUED, ASKED, OLD = "2024-01-15T00:00:00Z", "2024-01-15T06:00:00Z", "2024-01-14T17:00:00Z"


def _seed(name: str) -> bytes:
    """A key for fixtures."""
    return hashlib.sha256(name.encode()).digest()


SEEDS = {name: _seed(name) for name in (PLATFORM, "stranger", *[f"service{i}" for i in range(NATIONS)])}


def _signed(rows: DataFrame, key: str, fields: list[str], signer: Column) -> DataFrame:
    """rows, written once, with the signature of the named signer."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows, "unsigned")
    made = sign_by(rows.select(F.col(key).alias("id"), R.body(fields).cast("binary").alias("body"), signer.alias("signer")).repartition(parts, "id"), SEEDS)
    return materialize(rows.join(made.select(F.col("id").alias(key), "signature"), key), "signed")


def _service_key(number: Column) -> Column:
    """The public key of the numbered service."""
    return F.element_at(F.array(*[F.lit(b64encode(public_key(SEEDS[f"service{i}"])).decode()) for i in range(NATIONS)]), (number + 1).cast("int"))


def _code(number: Column) -> Column:
    """The measurement of the numbered service's code."""
    return L.digest(F.concat(F.lit("code"), number.cast("string")))


def _manifests(pages: DataFrame, html: Column) -> DataFrame:
    """(model_id, sha256) of three models whose files are pages."""
    files = pages.select(F.concat(F.lit("model"), (F.col("page_id") % 3).cast("string")).alias("model_id"), F.concat_ws(":", F.col("page_id").cast("string"), L.digest(html)).alias("file"))
    return L.set_digest(files, "model_id", F.col("file")).select("model_id", L.digest(F.col("digest")).alias("sha256"))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of all conversations, some of them or of what they are joined with tampered:
    every third model's files change and another's is withdrawn, inputs are lost or changed,
    signatures come from strangers or lose a byte, five of six services have quotes that
    don't hold, measurements are exchanged, entries are absent from the log or differ."""
    turns, pages = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "pages")
    at = lambda role, pick: pick(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    talks = turns.groupBy("conv_id").agg(at("user", F.min_by).alias("asked"), at("assistant", F.max_by).alias("answer")).withColumn("asked", F.coalesce("asked", F.lit("")))
    number, service = F.col("conv_id"), F.col("conv_id") % SERVICES
    then = _manifests(pages, F.col("html")).withColumnRenamed("sha256", "model_sha256")
    rows = talks.withColumn("model_id", F.concat(F.lit("model"), (number % 3).cast("string"))).join(then, "model_id", "left").select(
        number.cast("string").alias("receipt_id"), L.digest(F.col("asked")).alias("input_sha256"), L.digest(F.coalesce("answer", F.lit(""))).alias("output_sha256"), "model_id", "model_sha256",
        F.concat(F.lit("q"), service.cast("string")).alias("quote_id"), F.when(number % 13 == 5, _code(service + 50)).otherwise(_code(service)).alias("measurement"), _service_key(service).alias("signer_pubkey"),
    )
    own = F.col("receipt_id").cast("long")
    receipts = _signed(rows, "receipt_id", R.RECEIPT, F.when(own % 7 == 3, "stranger").otherwise(F.concat(F.lit("service"), (own % SERVICES).cast("string"))))
    receipts = receipts.withColumn("signature", F.when(own % 7 == 4, F.substring("signature", 1, 63)).otherwise(F.col("signature")))

    stated = F.when(own % 11 == 4, L.leaf_hash(F.lit("another answer"))).otherwise(L.leaf_hash(R.whole(R.RECEIPT)))
    log = materialize(dense_index(receipts.where(own % 11 != 2).select("receipt_id", stated.alias("hash")), ["receipt_id"], "pos"), "log")
    inputs = talks.where("conv_id % 5 <> 1").select(number.cast("string").alias("receipt_id"), L.digest(F.when(number % 5 == 2, F.concat("asked", F.lit("!"))).otherwise(F.col("asked"))).alias("sha256"))
    changed = F.when(F.col("page_id") % 3 == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    models = _manifests(pages, changed).where("model_id <> 'model1'")

    some = spark.range(SERVICES - 1)
    bound = _service_key(F.when(F.col("id") == 4, F.lit(9)).otherwise(F.col("id")))
    quotes = some.select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("quote_id"), F.lit("platform").alias("platform"), _code(F.col("id")).alias("measurement"), R.report_data(bound).alias("report_data"), (F.col("id") == 1).alias("debug"), F.lit("n").alias("nonce"), F.lit(ISSUED).alias("issued_at"))
    quotes = _signed(quotes, "quote_id", R.QUOTE, F.when(F.col("quote_id") == "q3", "stranger").otherwise(PLATFORM))
    allowlist = some.where("id <> 2").select(_code(F.col("id")).alias("measurement"))
    found = R.verify_receipts(receipts, inputs, models, quotes, allowlist, log, L.tree_roots(log.select("pos", "hash")), public_key(SEEDS[PLATFORM]))
    return found.select(F.col("receipt_id").cast("long").alias("conv_id"), *R.CHECKS, "detail", "ok")


RECEIPTS = """WITH c AS (SELECT conv_id, (SELECT count(*) FILTER (page_id % 3 = 2) FROM pages) > 0 AS m2, (SELECT count(*) FILTER (page_id % 3 = 0) FROM pages) > 0 AS m0 FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, conv_id % 7 NOT IN (3, 4) AS signature,
  CASE WHEN conv_id % 5 <> 1 THEN conv_id % 5 <> 2 END AS input_hash,
  CASE conv_id % 3 WHEN 0 THEN CASE WHEN m0 THEN true END WHEN 2 THEN CASE WHEN m2 THEN false END END AS model_manifest,
  CASE WHEN conv_id % 6 = 5 THEN 'no quote' ELSE concat_ws('; ', CASE conv_id % 6 WHEN 1 THEN 'not_debug' WHEN 2 THEN 'measurement_allowlisted' WHEN 3 THEN 'platform_signature' WHEN 4 THEN 'report_data_binding' END,
    CASE WHEN conv_id % 13 = 5 THEN 'quote_matches_receipt' END) END AS q,
  CASE conv_id % 11 WHEN 2 THEN 'not in the log' WHEN 4 THEN 'altered after logging' ELSE '' END AS place FROM c),
d AS (SELECT *, q = '' AS attestation, place = '' AS merkle_inclusion, concat_ws(' | ', CASE WHEN NOT signature THEN 'signature: ' || CASE conv_id % 7 WHEN 3 THEN 'altered' ELSE 'malformed' END END,
  CASE WHEN NOT input_hash THEN 'input_hash: another input' END, CASE WHEN NOT model_manifest THEN 'model_manifest: another model' END,
  CASE WHEN q <> '' THEN 'attestation: ' || q END, CASE WHEN place <> '' THEN 'merkle_inclusion: ' || place END) AS detail FROM r)
SELECT conv_id, signature, input_hash, model_manifest, attestation, merkle_inclusion, detail, detail = '' AS ok FROM d"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as services that ask for a key with a quote each: all six checks."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    key, nation = F.col("c_custkey"), F.col("nation")
    rows = customers.select(
        key.cast("string").alias("quote_id"), F.lit("platform").alias("platform"), _code(nation).alias("measurement"),
        R.report_data(_service_key(F.when(key % 13 == 3, (nation + 1) % NATIONS).otherwise(nation))).alias("report_data"), (key % 7 == 1).alias("debug"),
        L.digest(F.concat(F.lit("nonce"), key.cast("string"))).alias("nonce"), F.when(key % 17 == 6, F.lit(OLD)).otherwise(F.lit(ISSUED)).alias("issued_at"),
    )
    own = F.col("quote_id").cast("long")
    quotes = _signed(rows, "quote_id", R.QUOTE, F.when(own % 11 == 2, "stranger").otherwise(PLATFORM))
    # quotes that were changed after they had been signed
    quotes = quotes.withColumn("platform", F.when(own % 19 == 7, "other").otherwise(F.col("platform")))
    challenge = L.digest(F.concat(F.when(key % 5 == 4, "stale").otherwise("nonce"), key.cast("string")))
    requests = customers.select("c_custkey", key.cast("string").alias("quote_id"), _service_key(nation).alias("signer_pubkey"), challenge.alias("nonce"), F.lit(ASKED).alias("asked_at"), F.lit(12 * 3600).cast("long").alias("max_age_s"))
    allowlist = spark.range(NATIONS).where("id % 6 <> 5").select(_code(F.col("id")).alias("measurement"))
    found = R.quote_checks(requests, quotes, allowlist, public_key(SEEDS[PLATFORM]))
    reason = R.failed(F.col("q"), R.QUOTE_CHECKS)
    return found.select("c_custkey", "q.*", reason.alias("reason"), F.when(reason == "", "released").otherwise("refused").alias("decision"))


REQUESTS = """WITH q AS (SELECT c_custkey, c_custkey % 11 <> 2 AND c_custkey % 19 <> 7 AS platform_signature, c_nationkey % 6 <> 5 AS measurement_allowlisted, c_custkey % 7 <> 1 AS not_debug,
  c_custkey % 13 <> 3 AS report_data_binding, c_custkey % 5 <> 4 AS nonce, c_custkey % 17 <> 6 AS fresh FROM customer),
r AS (SELECT *, concat_ws('; ', CASE WHEN NOT platform_signature THEN 'platform_signature' END, CASE WHEN NOT measurement_allowlisted THEN 'measurement_allowlisted' END, CASE WHEN NOT not_debug THEN 'not_debug' END,
  CASE WHEN NOT report_data_binding THEN 'report_data_binding' END, CASE WHEN NOT nonce THEN 'nonce' END, CASE WHEN NOT fresh THEN 'fresh' END) AS reason FROM q)
SELECT *, CASE WHEN reason = '' THEN 'released' ELSE 'refused' END AS decision FROM r"""

def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger entry of every attested request: the decision, the names of the keys that
    are released, what was measured and why it was refused. Keys are named after regions;
    every third customer asks for all, others for their own region's and one that doesn't exist."""
    decided = _requests(spark, sf_dir).select("c_custkey", "reason", "decision")
    nations, regions = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf_dir, "region")
    homes = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    wanted = F.when(F.col("c_custkey") % 3 != 0, F.array("r_name", F.lit("none")))
    rows = decided.join(customers, "c_custkey").join(homes, "n_nationkey", "left").withColumn("wanted", wanted).withColumn("allowed", F.col("decision") == "released")
    rows = L.released_names(rows, "allowed", "wanted", regions.select("r_name"), "r_name")
    said = {"decision": F.col("decision"), "keys": F.col("released"), "measurement": _code(F.col("n_nationkey").cast("long")), "quote_id": F.col("c_custkey").cast("string"), "reason": F.col("reason")}
    payload = L.canonical_json(**said)
    return rows.select(F.lit("key_release").alias("kind"), F.concat(F.lit("kr-"), F.substring(L.digest(payload), 1, 12)).alias("entry_id"), payload.alias("payload"))


RELEASES = f"""WITH d AS ({REQUESTS}), w AS (SELECT d.*, c_nationkey, r_name FROM d JOIN customer c ON c.c_custkey = d.c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
p AS (SELECT '{{"decision":"' || decision || '","keys":[' || CASE WHEN decision = 'refused' THEN '' WHEN c_custkey % 3 = 0 THEN (SELECT string_agg('"' || r_name || '"', ',' ORDER BY r_name) FROM region) ELSE '"' || r_name || '"' END ||
  '],"measurement":"' || sha256('code' || c_nationkey) || '","quote_id":"' || c_custkey || '","reason":"' || reason || '"}}' AS payload FROM w)
SELECT 'key_release' AS kind, 'kr-' || substr(sha256(payload), 1, 12) AS entry_id, payload FROM p"""

QUERIES = {
    "verified_receipts": Query(_receipts, RECEIPTS, "C9 C10 J13 J16 K4 B9"),
    "attested_requests": Query(_requests, REQUESTS, "K3 K4 B8"),
    "release_entries": Query(_releases, RELEASES, "Q-key_release K6"),
}
