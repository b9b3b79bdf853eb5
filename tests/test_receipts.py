"""Receipts verified from joined tables: a change to one of them shows in its check alone."""

from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from probity.operators import ledger as L
from probity.operators import receipts as R
from probity.operators.signatures import public_key, sign_by

PLATFORM, SERVICE, STRANGER = (bytes([i]) * 32 for i in (1, 2, 3))
SEEDS = {"platform": PLATFORM, "service": SERVICE, "stranger": STRANGER}
KEY = b64encode(public_key(SERVICE)).decode()


def signed(rows, key, fields, signer):
    made = sign_by(rows.select(F.col(key).alias("id"), R.body(fields).cast("binary").alias("body"), F.lit(signer).alias("signer")), SEEDS)
    return rows.join(made.select(F.col("id").alias(key), "signature"), key)


@pytest.fixture(scope="module")
def good(spark):
    rows = [(f"r{i}", f"in{i}", f"out{i}", "m", "files", "q", "code", KEY) for i in range(3)]
    receipts = signed(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in R.RECEIPT)), "receipt_id", R.RECEIPT, "service")
    quotes = spark.createDataFrame([("q", "p", "code", False, "n", "2024-01-15T00:00:00Z")], "quote_id string, platform string, measurement string, debug boolean, nonce string, issued_at string")
    quotes = signed(quotes.withColumn("report_data", R.report_data(F.lit(KEY))), "quote_id", R.QUOTE, "platform")
    log = receipts.select(F.substring("receipt_id", 2, 9).cast("long").alias("pos"), "receipt_id", L.leaf_hash(R.whole(R.RECEIPT)).alias("hash")).cache()
    return {
        "receipts": receipts.cache(), "quotes": quotes.cache(), "log": log, "allowlist": spark.createDataFrame([("code",), ("code",)], "measurement string"),
        "inputs": spark.createDataFrame([("r0", "in0"), ("r1", "in1")], "receipt_id string, sha256 string"), "models": spark.createDataFrame([("m", "files")], "model_id string, sha256 string"),
        "published": L.tree_roots(log.select("pos", "hash")).cache(), "platform_key": public_key(PLATFORM),
    }


def outcomes(tables):
    return {r["receipt_id"]: r for r in R.verify_receipts(**tables).collect()}


def test_untouched_tables(good):
    found = outcomes(good)
    assert [tuple(found[f"r{i}"][c] for c in R.CHECKS) for i in range(3)] == [(True,) * 5, (True,) * 5, (True, None, True, True, True)]
    assert all(r["ok"] and r["detail"] == "" for r in found.values())


def change(column, value):
    return lambda rows: rows.withColumn(column, F.lit(value).cast(rows.schema[column].dataType))


def as_other(rows, **fields):
    """The quote issued anew by the platform, with other fields."""
    return signed(rows.drop("signature").withColumns({k: F.lit(v) for k, v in fields.items()}), "quote_id", R.QUOTE, "platform")


CASES = [
    ("inputs", change("sha256", "x"), "input_hash", "input_hash: another input"),
    ("models", change("sha256", "x"), "model_manifest", "model_manifest: another model"),
    ("models", lambda rows: rows.where("false"), None, ""),
    ("quotes", change("platform", "x"), "attestation", "attestation: platform_signature"),
    ("quotes", lambda rows: as_other(rows, debug=True), "attestation", "attestation: not_debug"),
    ("quotes", lambda rows: as_other(rows, report_data="x"), "attestation", "attestation: report_data_binding"),
    ("quotes", lambda rows: as_other(rows, measurement="x"), "attestation", "attestation: measurement_allowlisted; quote_matches_receipt"),
    ("quotes", lambda rows: rows.where("false"), "attestation", "attestation: no quote"),
    ("allowlist", lambda rows: rows.where("false"), "attestation", "attestation: measurement_allowlisted"),
    ("log", lambda rows: rows.where("pos > 0"), "merkle_inclusion", "merkle_inclusion: not in the log"),
    ("log", lambda rows: rows.withColumn("hash", F.when(F.col("pos") == 0, "ab").otherwise(F.col("hash"))), "merkle_inclusion", "merkle_inclusion: altered after logging"),
    ("published", change("root", "0" * 64), "merkle_inclusion", "merkle_inclusion: proof does not lead to the root"),
    ("published", lambda rows: rows.where("false"), "merkle_inclusion", "merkle_inclusion: proof does not lead to the root"),
]


@pytest.mark.parametrize("name,tamper,check,detail", CASES)
def test_one_tampered_table_shows_in_its_check(good, name, tamper, check, detail):
    row = outcomes({**good, name: tamper(good[name])})["r0"]
    assert [c for c in R.CHECKS if row[c] is False] == ([check] if check else []) and row["detail"] == detail
    assert row["ok"] == (check is None)


def test_a_receipt_signed_by_a_stranger_and_logged(good):
    forged = signed(good["receipts"].drop("signature"), "receipt_id", R.RECEIPT, "stranger")
    log = forged.select(F.substring("receipt_id", 2, 9).cast("long").alias("pos"), "receipt_id", L.leaf_hash(R.whole(R.RECEIPT)).alias("hash"))
    row = outcomes({**good, "receipts": forged, "log": log, "published": L.tree_roots(log.select("pos", "hash"))})["r0"]
    assert row["detail"] == "signature: altered"
    # changed after it was signed and logged: both show
    changed = good["receipts"].withColumn("output_sha256", F.lit("x"))
    assert outcomes({**good, "receipts": changed})["r0"]["detail"] == "signature: altered | merkle_inclusion: altered after logging"
    nulls = good["receipts"].select(*[F.when(F.col("receipt_id") != "r0", F.col(c)).alias(c) if c not in ("receipt_id",) else F.col(c) for c in good["receipts"].columns])
    assert [outcomes({**good, "receipts": nulls})["r0"][c] for c in R.CHECKS] == [False, False, None, False, False]
    assert not outcomes({**good, "receipts": good["receipts"].where("false")})


def test_requests_with_challenge_and_age(spark, good):
    rows = [(1, "q", None, "n", "2024-01-15T00:00:10Z", 10), (2, "q", KEY, "x", "2024-01-14T23:59:55Z", 10), (3, "q", "", None, "2024-01-14T23:59:54Z", 10), (4, "none", None, None, "2024-01-15T00:00:11Z", None), (5, "q", None, None, "soon", 10), (6, "q", None, None, None, None)]
    requests = spark.createDataFrame(rows, "id int, quote_id string, signer_pubkey string, nonce string, asked_at string, max_age_s long")
    found = {r["id"]: tuple(r["q"]) for r in R.quote_checks(requests, good["quotes"], good["allowlist"], good["platform_key"]).collect()}
    assert found == {
        1: (True, True, True, None, True, True), 2: (True, True, True, True, False, True), 3: (True, True, True, False, None, False),
        4: (False, False, False, None, None, None), 5: (True, True, True, None, None, False), 6: (True, True, True, None, None, None),
    }
