"""Receipts verified whole: signature, input, model, attested key and place in the log,
each from a joined table, so that a change to one table shows in one check.

A receipt is a row of RECEIPT and signature; a quote a row of QUOTE and signature.
Signatures are Ed25519 over the canonical JSON of the other fields, in binary; keys
are in base 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.operators import ledger as L
from probity.operators.signatures import verify_signatures
from probity.sources.scratch import materialize

RECEIPT = ["receipt_id", "input_sha256", "output_sha256", "model_id", "model_sha256", "quote_id", "measurement", "signer_pubkey"]
QUOTE = ["quote_id", "platform", "measurement", "report_data", "debug", "nonce", "issued_at"]
CHECKS = ["signature", "input_hash", "model_manifest", "attestation", "merkle_inclusion"]
#: Fixed value: how many seconds a quote may lie ahead of the verifier's clock.
AHEAD = 5


def body(fields: list[str]) -> Column:
    """What a signature covers."""
    return L.canonical_json(**{c: F.col(c) for c in fields})


def whole(fields: list[str]) -> Column:
    """A signed row with its signature, as it stands in the log."""
    return L.canonical_json(**{c: F.col(c) for c in fields}, signature=F.base64("signature"))


def report_data(public_key: Column) -> Column:
    """What a quote says of the key that it binds: the digest of its raw bytes."""
    return F.sha2(F.unbase64(public_key), 256)


def _signed(rows: DataFrame, key: str, fields: list[str], public_key: Column) -> DataFrame:
    """(key, verdict) of each distinct key's signature."""
    records = rows.select(F.col(key).alias("id"), body(fields).cast("binary").alias("body"), public_key.alias("public_key"), "signature")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return verify_signatures(records.repartition(parts, "id")).withColumnRenamed("id", key)


def quote_checks(requests: DataFrame, quotes: DataFrame, allowlist: DataFrame, platform_key: bytes, allow_debug: bool = False) -> DataFrame:
    """requests with found (whether their quote exists) and q, the outcome of six checks:
    platform_signature, measurement_allowlisted, not_debug, report_data_binding, nonce,
    fresh; and quote_measurement.

    requests have quote_id and may have signer_pubkey (the key that the quote has to bind),
    nonce (that of the challenge), asked_at (text) with max_age_s; a check whose request is
    null or absent is skipped (null). A quote's platform signature is verified once, however
    many requests name it. Ids of quotes are unique. A missing quote fails what was asked."""
    verdicts = _signed(quotes, "quote_id", QUOTE, F.lit(platform_key))
    known = allowlist.select("measurement").distinct().withColumn("_listed", F.lit(True))
    rows = quotes.join(verdicts, "quote_id").join(known, "measurement", "left")
    rows = rows.select("quote_id", F.struct("verdict", "_listed", "measurement", "report_data", "debug", "nonce", "issued_at").alias("_quote"))
    asked = lambda c, kind: F.col(c) if c in requests.columns else F.lit(None).cast(kind)
    quote, no = F.col("_quote"), F.lit(False)
    when = lambda text: F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    age = when(asked("asked_at", "string")) - when(quote["issued_at"])
    sure = lambda x: F.coalesce(x, no)
    checks = {
        "platform_signature": sure(quote["verdict"] == "valid"),
        "measurement_allowlisted": sure(quote["_listed"]),
        "not_debug": sure(~quote["debug"]) | (F.lit(allow_debug) & quote.isNotNull()),
        "report_data_binding": F.when(asked("signer_pubkey", "string").isNotNull(), sure(quote["report_data"] == report_data(asked("signer_pubkey", "string")))),
        "nonce": F.when(asked("nonce", "string").isNotNull(), sure(quote["nonce"] == asked("nonce", "string"))),
        "fresh": F.when(asked("max_age_s", "long").isNotNull(), sure(age.between(-AHEAD, asked("max_age_s", "long")))),
    }
    out = requests.join(rows, "quote_id", "left").withColumn("found", quote.isNotNull())
    return out.withColumn("q", F.struct(*[ok.alias(name) for name, ok in checks.items()])).withColumn("quote_measurement", quote["measurement"]).drop("_quote")


def failed(q: Column, names: list[str]) -> Column:
    """Names of the checks in q that are false, joined by '; '."""
    return L.failed_checks({name: q[name] for name in names})


QUOTE_CHECKS = ["platform_signature", "measurement_allowlisted", "not_debug", "report_data_binding", "nonce", "fresh"]


def verify_receipts(receipts: DataFrame, inputs: DataFrame, models: DataFrame, quotes: DataFrame, allowlist: DataFrame, log: DataFrame, published: DataFrame, platform_key: bytes) -> DataFrame:
    """(receipt_id, signature, input_hash, model_manifest, attestation, merkle_inclusion,
    detail, ok): each check true, false or null (skipped), detail says what failed, ok
    that nothing did.

    inputs (receipt_id, sha256): digests of supplied inputs; a receipt without one skips
    the check. models (model_id, sha256): manifests of approved models; without one the
    check is skipped. log (pos, receipt_id, hash): leaves; published: one row (n, root).
    Ids are unique in each table. An absent quote or log entry fails."""
    signatures = _signed(receipts, "receipt_id", RECEIPT, F.unbase64("signer_pubkey"))
    # a binding is asked of every receipt: no key is bound by no quote
    requests = receipts.select("receipt_id", "quote_id", F.col("measurement").alias("_named"), F.coalesce("signer_pubkey", F.lit("")).alias("signer_pubkey"))
    attested = quote_checks(requests, quotes, allowlist, platform_key)
    same = F.coalesce(F.col("quote_measurement") == F.col("_named"), F.lit(False))
    attested = attested.select("receipt_id", F.when(~F.col("found"), "no quote").otherwise(F.concat_ws("; ", F.nullif(failed(F.col("q"), QUOTE_CHECKS), F.lit("")), F.when(~same, "quote_matches_receipt"))).alias("_quote"))

    logged = receipts.select("receipt_id", L.leaf_hash(whole(RECEIPT)).alias("_leaf")).join(log.select("receipt_id", "pos", F.col("hash").alias("_logged")), "receipt_id", "left")
    logged = materialize(logged, "logged")
    proofs = L.audit_paths(log.select("pos", "hash"), logged.where("_leaf = _logged").select("pos")).select("pos", "proof")
    placed = logged.join(proofs, "pos", "left").crossJoin(F.broadcast(published.agg(F.max("n").alias("_n"), F.max("root").alias("_root"))))
    included = L.verify_inclusion(F.col("_leaf"), F.col("pos"), F.col("_n"), F.col("proof"), F.col("_root"))
    place = F.when(F.col("pos").isNull(), "not in the log").when(F.col("_leaf") != F.col("_logged"), "altered after logging").when(~F.coalesce(included, F.lit(False)), "proof does not lead to the root").otherwise("")
    placed = placed.select("receipt_id", place.alias("_place"))

    rows = receipts.join(signatures, "receipt_id").join(attested, "receipt_id").join(placed, "receipt_id")
    rows = rows.join(inputs.select("receipt_id", F.col("sha256").alias("_input")), "receipt_id", "left").join(models.select("model_id", F.col("sha256").alias("_model")), "model_id", "left")
    equal = lambda given, named: F.when(F.col(given).isNotNull(), F.coalesce(F.col(given) == F.col(named), F.lit(False)))
    checks = dict(zip(CHECKS, (F.col("verdict") == "valid", equal("_input", "input_sha256"), equal("_model", "model_sha256"), F.col("_quote") == "", F.col("_place") == ""), strict=True))
    reasons = dict(zip(CHECKS, (F.col("verdict"), F.lit("another input"), F.lit("another model"), F.col("_quote"), F.col("_place")), strict=True))
    detail = F.concat_ws(" | ", *[F.when(~ok, F.concat(F.lit(f"{name}: "), reasons[name])) for name, ok in checks.items()])
    return rows.select("receipt_id", *[ok.alias(name) for name, ok in checks.items()], detail.alias("detail"), (detail == "").alias("ok"))
