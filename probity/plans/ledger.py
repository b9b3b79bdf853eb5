"""Queries on records: events as a log, conversations as hash chains, pages as
files, orders as receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators import ledger as L
from probity.operators import signatures
from probity.operators.ordering import dense_index
from probity.plans.query import Query, table

PAYLOAD_SQL = "event_id::VARCHAR || '|' || user_id::VARCHAR || '|' || event_type || '|' || props"


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    log = events.select("event_id", L.leaf_hash(payload).alias("hash"))
    return dense_index(log, ["event_id"], "pos")


LEAVES = f"leaves AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, sha256(unhex('00') || encode({PAYLOAD_SQL})) AS hash FROM events)"
FOLD = "list_transform(range(0, (len(hs) + 1) // 2), lambda j: CASE WHEN 2 * j + 2 <= len(hs) THEN sha256(unhex('01' || hs[2 * j + 1] || hs[2 * j + 2])) ELSE hs[2 * j + 1] END)"


def _tree_sql(where: str = "true") -> str:
    return f"{LEAVES}, tree(level, hs) AS (SELECT 0, list(hash ORDER BY pos) FROM leaves WHERE {where} UNION ALL SELECT level + 1, {FOLD} FROM tree WHERE len(hs) > 1)"


def _root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tree_roots(leaves(spark, sf_dir))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = leaves(spark, sf_dir)
    return L.audit_paths(log, log).select("pos", "leaf_hash", F.array_join("proof", ",").alias("proof"))


def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all entries, and the same with a changed leaf."""
    log = leaves(spark, sf_dir)
    root = L.tree_roots(log)
    proofs = L.audit_paths(log, log).join(F.broadcast(root), how="cross")
    check = lambda leaf: L.verify_inclusion(leaf, F.col("pos"), F.col("n"), F.col("proof"), F.col("root"))
    return proofs.agg(F.count("*").alias("proofs"), F.count_if(check(F.col("leaf_hash"))).alias("valid"), F.count_if(check(F.reverse("leaf_hash"))).alias("forged"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = leaves(spark, sf_dir)
    total = log.agg(F.count("*").alias("total"))
    sizes = total.select(F.explode(F.array(*[F.floor(F.col("total") * k / 4) for k in (1, 2, 3, 4)])).alias("size")).where("size > 0").distinct()
    prefixes = log.join(F.broadcast(sizes), F.col("pos") < F.col("size"))
    return L.tree_roots(prefixes, ["size"]).select("size", "root")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of turns; every seventh conversation's turn 3 names a wrong record before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", L.digest(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")).alias("own"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("prev"))
    linked = turns.join(before, ["conv_id", "turn"], "left")
    tampered = (F.col("conv_id") % 7 == 0) & (F.col("turn") == 3)
    linked = linked.withColumn("prev", F.when(tampered, L.digest(F.lit("x"))).otherwise(F.coalesce("prev", F.lit(L.GENESIS))))
    return L.chain_breaks(linked, "conv_id", "turn", "own", "prev")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), L.digest(F.col("html")).alias("sha256"), F.length(F.encode("html", "utf-8")).cast("long").alias("bytes"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "page_id", "html")
    signed = pages.where("page_id % 13 <> 1").select("path", L.digest(F.col("html")).alias("sha256"))
    changed = F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    found = pages.where("page_id % 17 <> 0").select("path", L.digest(changed).alias("sha256"))
    return L.manifest_diff(signed, found)


def _seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed label records; every tenth is changed after sealing."""
    rows = table(spark, sf_dir, "labels")
    body = lambda quality: L.canonical_json(doc_id=F.col("doc_id"), quality=quality, toxic=F.col("toxic"), kind=F.lit("label"))
    sealed = rows.withColumn("sha256", L.digest(body(F.col("quality"))))
    later = F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return sealed.select("doc_id", "sha256", (L.digest(body(later)) == F.col("sha256")).alias("intact"))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts: signature, input, model, quote and log checks."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    logged = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    quotes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    allowed = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("allowed"))
    rows = orders.join(quotes, "o_custkey", "left").join(F.broadcast(allowed), "c_nationkey", "left").join(logged, "o_orderkey", "left")
    checks = {
        "signature": F.col("o_orderstatus") != "P",
        "input_hash": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 0),
        "model_manifest": F.coalesce(F.col("o_orderkey") % 11 != 0, F.lit(False)),
        "attestation": F.coalesce("allowed", F.lit(False)),
        "ledger": F.col("lines").isNotNull(),
    }
    matrix = L.check_matrix(rows, "o_orderkey", checks)
    return matrix.groupBy("n", "name").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("skipped"))


RECEIPTS = """r AS (
  SELECT o_orderkey, o_orderstatus <> 'P' AS c1, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice > 0 END AS c2, coalesce(o_orderkey % 11 <> 0, false) AS c3,
    coalesce(n_regionkey < 4, false) AS c4, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS c5
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def _all_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order status: receipts none of whose checks fails, skipped ones aside."""
    orders = table(spark, sf_dir, "orders")
    checks = {"a": F.col("o_totalprice") > 100000, "b": F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") < 400000)}
    matrix = L.check_matrix(orders, "o_orderkey", checks)
    verdict = matrix.groupBy("o_orderkey").agg(L.all_ok("ok").alias("verdict"))
    return orders.select("o_orderkey", "o_orderstatus").join(verdict, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("verdict").alias("ok"))


def _nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nonce is a user's number on a day; its first event uses it, later ones replay it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("nonce"))
    used = L.first_uses(events, "nonce", "ts", "event_id")
    state = F.when(F.col("replayed"), "replayed").when(F.col("event_type") == "error", "refused").otherwise("released")
    return used.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes: allowlisted, not debug, fresh (-5 s to 12 h before midnight of 2024-01-15), nonce."""
    events = table(spark, sf_dir, "events")
    age = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    checks = {
        "measurement allowlisted": ~F.col("event_type").isin("error"),
        "not debug": F.col("user_id") % 9 != 0,
        "fresh": age.between(-5, 12 * 3600),
        "nonce": F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("int") < 90),
    }
    return events.select("event_id", L.failed_checks(checks).alias("reason"))


def _allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events before the 20th, then each user's last change after it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts")
    old = events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("x")).select("user_id", "x.event_type", "x.value")
    return L.upsert(old, events.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")), "user_id", "event_id")


def _sealed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document sealed and opened, with the right and with a wrong contributor."""
    key, magic = F.unhex(F.lit("6b" * 32)), "BOX1"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    iv = F.unhex(F.lpad(F.hex("doc_id"), 24, "0"))
    sealed = docs.withColumn("box", L.seal(magic, F.col("text"), key, iv, F.col("source").cast("binary")))
    opened = L.unseal(magic, F.col("box"), key, F.col("source").cast("binary"))
    wrong = L.unseal(magic, F.col("box"), key, F.concat("source", F.lit("x")).cast("binary"))
    return sealed.agg(F.count("*").alias("n"), F.count_if(opened.cast("string") == F.col("text")).alias("opened"), F.count_if(wrong.isNull()).alias("refused"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns signed; every seventh conversation's are changed later, every eleventh's lose a byte.
    Turns are dealt out in order, so that a conversation's lie in one batch."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws("|", "role", "text").cast("binary").alias("body"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = signatures.sign_records(turns.repartitionByRange(n, "id").sortWithinPartitions("id"), bytes(range(32)))
    changed = F.when(F.floor(F.col("id") / 1000) % 7 == 0, F.concat("body", F.lit("!").cast("binary"))).otherwise(F.col("body"))
    short = F.when(F.floor(F.col("id") / 1000) % 11 == 0, F.substring("signature", 1, 63)).otherwise(F.col("signature"))
    return signatures.verify_signatures(signed.withColumn("body", changed).withColumn("signature", short)).select(F.floor(F.col("id") / 1000).alias("conv_id"), (F.col("id") % 1000).alias("turn"), "verdict")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(50).select("event_id", "user_id", "value")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "idx")


# each leaf's way up, and a changed leaf's
WALK = f"""WITH RECURSIVE {_tree_sql()}, nodes AS (SELECT level, unnest(hs) AS hash, generate_subscripts(hs, 1) - 1 AS pos FROM tree),
w AS (SELECT 0 AS level, pos AS at, hash, reverse(hash) AS bad FROM leaves UNION ALL
  SELECT w.level + 1, w.at // 2, CASE WHEN n.hash IS NULL THEN w.hash WHEN w.at % 2 = 1 THEN sha256(unhex('01' || n.hash || w.hash)) ELSE sha256(unhex('01' || w.hash || n.hash)) END,
    CASE WHEN n.hash IS NULL THEN w.bad WHEN w.at % 2 = 1 THEN sha256(unhex('01' || n.hash || w.bad)) ELSE sha256(unhex('01' || w.bad || n.hash)) END
  FROM w LEFT JOIN nodes n ON n.level = w.level AND n.pos = xor(w.at, 1) WHERE w.level < (SELECT max(level) FROM nodes))
SELECT count(*) AS proofs, count(*) FILTER (hash = root) AS valid, count(*) FILTER (bad = root) AS forged
FROM w, (SELECT hs[1] AS root, level AS top FROM tree WHERE len(hs) = 1) WHERE level = top"""

QUERIES = {
    "sha256_manifest": Query(_manifest, "SELECT page_id, url AS path, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages", "A13 J2"),
    "evidence_seal": Query(_seal, "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"kind\":\"label\",\"quality\":' || quality || ',\"toxic\":' || toxic || '}') AS sha256, doc_id % 10 <> 0 AS intact FROM labels", "J1 J4 B10"),
    "merkle_leaves": Query(lambda s, d: leaves(s, d).select("pos", F.col("hash").alias("leaf_hash")), f"WITH {LEAVES} SELECT pos, hash AS leaf_hash FROM leaves", "J5 J9 E6"),
    "merkle_root": Query(_root, f"WITH RECURSIVE {_tree_sql()} SELECT (SELECT count(*) FROM leaves) AS n, hs[1] AS root FROM tree WHERE len(hs) = 1", "J6 J10"),
    "merkle_audit_path": Query(_paths, f"WITH RECURSIVE {_tree_sql()}, nodes AS (SELECT level, unnest(hs) AS hash, generate_subscripts(hs, 1) - 1 AS pos FROM tree), w AS (SELECT pos, hash AS leaf_hash FROM leaves) SELECT w.pos, leaf_hash, coalesce(string_agg(n.hash, ',' ORDER BY n.level), '') AS proof FROM w CROSS JOIN (SELECT DISTINCT level FROM nodes) l LEFT JOIN nodes n ON n.level = l.level AND n.pos = xor(w.pos >> l.level, 1) GROUP BY ALL", "J7 T11"),
    "merkle_verify_all": Query(_verify, WALK, "J8"),
    "merkle_root_history": Query(_history, " UNION ALL ".join(f"(WITH RECURSIVE {_tree_sql(f'pos < (SELECT count(*) FROM events) * {k} // 4')} SELECT (SELECT count(*) FROM events) * {k} // 4 AS size, hs[1] AS root FROM tree WHERE len(hs) = 1)" for k in (1, 2, 3, 4)), "E7"),
    "hash_chain_verify": Query(_chain, f"WITH t AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR || '|' || turn || '|' || role || '|' || text) AS own FROM conversations), p AS (SELECT *, lag(own) OVER w AS before, lag(turn) OVER w AS before_turn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), c AS (SELECT *, CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN sha256('x') WHEN before_turn = turn - 1 THEN before ELSE '{L.GENESIS}' END AS prev FROM p), b AS (SELECT *, prev <> coalesce(before, '{L.GENESIS}') AS broken FROM c) SELECT conv_id, count(*) AS length, count(*) FILTER (broken) = 0 AS ok, min(CASE WHEN broken THEN turn END) AS first_break FROM b GROUP BY conv_id", "E4 E5 J14 J15"),
    "model_manifest_diff": Query(_diff, "WITH a AS (SELECT page_id::VARCHAR AS path, html FROM pages WHERE page_id % 13 <> 1), b AS (SELECT page_id::VARCHAR AS path, page_id % 10 = 0 AS changed FROM pages WHERE page_id % 17 <> 0), j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' WHEN changed THEN 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path) SELECT * FROM j WHERE state IS NOT NULL", "H23 C12"),
    "receipt_check_matrix": Query(_receipts, f"WITH {RECEIPTS} " + " UNION ALL ".join(f"SELECT {i} AS n, '{n}' AS name, count(*) FILTER (c{i}) AS passed, count(*) FILTER (NOT c{i}) AS failed, count(*) FILTER (c{i} IS NULL) AS skipped FROM r" for i, n in enumerate(("signature", "input_hash", "model_manifest", "attestation", "ledger"), 1)), "C9 C10 J16 T13"),
    "receipt_all_ok": Query(_all_ok, "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000 AND (o_orderpriority <> '1-URGENT' OR o_totalprice < 400000)) AS ok FROM orders GROUP BY 1", "B9"),
    "nonce_replay": Query(_nonces, "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS k FROM events) SELECT CASE WHEN k > 1 THEN 'replayed' WHEN event_type = 'error' THEN 'refused' ELSE 'released' END AS state, count(*) AS n FROM e GROUP BY 1", "K6 K7"),
    "quote_checks": Query(_quotes, "WITH e AS (SELECT *, epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) AS age, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_id, concat_ws('; ', CASE WHEN event_type = 'error' THEN 'measurement allowlisted' END, CASE WHEN user_id % 9 = 0 THEN 'not debug' END, CASE WHEN age NOT BETWEEN -5 AND 43200 THEN 'fresh' END, CASE WHEN event_id % 2 = 0 AND k >= 90 THEN 'nonce' END) AS reason FROM e", "K3 B8"),
    "allowlist_upsert": Query(_allowlist, "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts >= '2024-01-20' DESC, event_id DESC) = 1", "K5 T15"),
    "aes_gcm_roundtrip": Query(_sealed_boxes, "SELECT count(*) AS n, count(text) AS opened, count(*) AS refused FROM documents", "K8 A15 T14"),
    "ed25519_receipts": Query(_signatures, "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'malformed' WHEN conv_id % 7 = 0 THEN 'altered' ELSE 'valid' END AS verdict FROM conversations", "J13"),
    "ledger_latest": Query(_latest, "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50", "F4 B11 O7"),
    "ledger_dense_index": Query(_dense, "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders", "E6"),
}
