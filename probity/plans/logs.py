"""Queries on logs and stores: chains whose hashes cover the record before, proofs at
older sizes, key releases, stored tables, sealed batches, splits of a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.scalars import flag
from probity.operators import audits as A
from probity.operators import ledger as L
from probity.operators.evaluation import histogram
from probity.operators.fixtures import flooded, stratified_split
from probity.operators.poison import LEAST_CLASS, suspicious_clusters
from probity.plans.audits import _CLASSES, AUDIT, _anomalies, _verdicts
from probity.plans.contributors import SAMPLES, samples
from probity.plans.ledger import _tree_sql, leaves
from probity.plans.query import Query, table
from probity.plans.vectors import pool, traced
from probity.sources.files import read_table, write_table
from probity.sources.scratch import materialize, scratch_path


def _rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of turns, verified after three kinds of rewriting of turn 3: its body alone;
    its body and hash; its body, its hash and the next turn's link. tip is the hash of
    the chain as issued."""
    body = L.digest(F.concat_ws("|", "role", "text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    issued = materialize(L.issue_chain(turns, "conv_id", "turn", "body"), "chain")
    kind, third = F.col("conv_id") % 7, F.col("turn") == 3
    false_body = L.digest(F.lit("x"))
    false_own = L.chained_hash(F.col("prev"), false_body)
    repaired = issued.where(third & (kind == 2)).select("conv_id", F.lit(4).cast("long").alias("turn"), false_own.alias("_prev"))
    shown = issued.join(repaired, ["conv_id", "turn"], "left").select(
        "conv_id", "turn",
        F.when(third & kind.isin(0, 1, 2), false_body).otherwise(F.col("body")).alias("body"),
        F.coalesce("_prev", "prev").alias("prev"),
        F.when(third & kind.isin(1, 2), false_own).otherwise(F.col("own")).alias("own"),
    )
    tips = issued.groupBy("conv_id").agg(F.max_by("own", "turn").alias("tip"))
    return L.verify_chain(shown, "conv_id", "turn", "body").join(tips, "conv_id")


REWRITES = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, sha256(concat_ws('|', role, text)) AS body FROM conversations),
c(conv_id, turn, k, own) AS (SELECT conv_id, turn, k, sha256('{L.GENESIS}' || body) FROM t WHERE k = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.k, sha256(c.own || t.body) FROM c JOIN t ON t.conv_id = c.conv_id AND t.k = c.k + 1),
b AS (SELECT conv_id, count(*) AS length, arg_max(own, turn) AS tip,
  CASE WHEN conv_id % 7 = 0 THEN min(turn) FILTER (turn = 3) WHEN conv_id % 7 IN (1, 2) AND bool_or(turn = 3) THEN min(turn) FILTER (turn > 3) END AS first_break FROM c GROUP BY conv_id)
SELECT conv_id, length, first_break IS NULL AS ok, first_break, tip FROM b"""


def _old_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs, by id, of all entries that the log held when it had half its size."""
    log = leaves(spark, sf_dir)
    half = log.agg(F.floor(F.count("*") / 2).alias("_half"))
    early = log.join(F.broadcast(half), how="cross").where("pos < _half").drop("_half")
    proofs = L.audit_paths(early, early).join(F.broadcast(L.tree_roots(early)), how="cross")
    valid = L.verify_inclusion(F.col("leaf_hash"), F.col("pos"), F.col("n"), F.col("proof"), F.col("root"))
    return early.select("event_id", "pos").join(proofs, "pos").select("event_id", "pos", F.array_join("proof", ",").alias("proof"), valid.alias("valid"))


def _proofs_sql(where: str, wanted: str, columns: str) -> str:
    """Proofs of wanted (event_id, pos) in the tree over the leaves that where keeps."""
    return f"""WITH RECURSIVE {_tree_sql(where)}, nodes AS (SELECT level, unnest(hs) AS hash, generate_subscripts(hs, 1) - 1 AS pos FROM tree),
e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events), w AS ({wanted})
SELECT {columns}, coalesce(string_agg(n.hash, ',' ORDER BY n.level), '') AS proof FROM w JOIN leaves USING (pos) CROSS JOIN (SELECT DISTINCT level FROM nodes) l LEFT JOIN nodes n ON n.level = l.level AND n.pos = xor(w.pos >> l.level, 1) GROUP BY ALL"""


_HALF = "pos < (SELECT count(*) FROM events) // 2"


def _browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 entries of a kind, the browser's fixed length, with their proofs."""
    log = leaves(spark, sf_dir)
    last = table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(200).select("event_id", F.col("event_type").alias("kind"))
    wanted = materialize(log.select("event_id", "pos").join(F.broadcast(last), "event_id"), "wanted")
    return wanted.join(L.audit_paths(log, wanted), "pos").select("event_id", "kind", "pos", "leaf_hash", F.array_join("proof", ",").alias("proof"))


TTL = 6 * 3600


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first event of a day asks for a nonce, the second one uses it within six
    hours or too late, later ones replay it; a use asks for two keys or, without an even
    id, for all there are."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    nonce = ["user_id", "day"]
    issued = events.groupBy(*nonce).agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    later = events.join(issued, nonce).where(F.col("event_id") != F.col("_first.event_id"))
    uses = later.groupBy(*nonce).agg(F.min(F.struct("ts", "event_id")).alias("_use"))
    age = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("_first.ts").cast("timestamp"))
    state = F.when(F.col("event_id") != F.col("_use.event_id"), "replayed").when(age > TTL, "expired").otherwise("released")
    name = lambda c: F.concat(F.lit("key_"), c.cast("string"))
    wanted = F.when(F.col("event_id") % 2 == 0, F.array(name(F.col("k")), name(F.col("k") + 5)))
    asked = later.join(uses, nonce).select("event_id", state.alias("state"), (state == "released").alias("ok"), wanted.alias("wanted"))
    keys = table(spark, sf_dir, "nation").select(name(F.col("n_nationkey")).alias("name"))
    return L.released_names(asked, "ok", "wanted", keys, "name").select("event_id", "state", F.array_join("released", ",").alias("names"))


RELEASES = f"""WITH e AS (SELECT event_id, ts, json_extract_string(props, '$.k')::INT AS k, row_number() OVER w AS n, first_value(ts) OVER w AS issued FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN n > 2 THEN 'replayed' WHEN floor(epoch(ts)) - floor(epoch(issued)) > {TTL} THEN 'expired' ELSE 'released' END AS state FROM e WHERE n > 1),
a AS (SELECT list('key_' || n_nationkey) AS known FROM nation)
SELECT event_id, state, CASE WHEN state <> 'released' THEN '' WHEN event_id % 2 = 0 THEN array_to_string(list_sort(list_intersect(known, ['key_' || k, 'key_' || (k + 5)])), ',') ELSE array_to_string(list_sort(known), ',') END AS names FROM s, a"""

FORMS = ("parquet", "csv", "json")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written and read again in each form."""
    rows = table(spark, sf_dir, "documents")
    out = None
    for form in FORMS:
        path = scratch_path(spark, f"documents-{form}")
        write_table(rows, path, form)
        back = read_table(spark, path, rows.schema, form, lines_in_text=True)
        part = back.select(F.lit(form).alias("form"), "doc_id", "source", "n_chars", L.digest(F.col("text")).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out


def _sealed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors' rows sealed under their names, stored, and opened again; a store
    whose rows are claimed by another contributor (every 20th id) gives nothing for them."""
    key, magic = F.unhex(F.lit("6b" * 32)), "BOX1"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("contributor"), "text")
    iv = F.unhex(F.lpad(F.hex("doc_id"), 24, "0"))
    box = L.seal(magic, F.to_json(F.struct("doc_id", "text")), key, iv, F.col("contributor").cast("binary"))
    claimed = F.when(F.col("doc_id") % 20 == 0, F.concat("contributor", F.lit("'"))).otherwise(F.col("contributor"))
    path = scratch_path(spark, "sealed")
    sealed = docs.select(claimed.alias("contributor"), box.alias("box"))
    write_table(sealed, path)
    stored = read_table(spark, path, sealed.schema)
    opened = F.from_json(L.unseal(magic, F.col("box"), key, F.col("contributor").cast("binary")).cast("string"), "doc_id long, text string")
    return stored.select("contributor", opened.alias("row")).where("row is not null").select("contributor", "row.doc_id", L.digest(F.col("row.text")).alias("sha256"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return stratified_split(rows)


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("id", "label", "split", "contributor")


def _flooded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the split's pool, C5's flooded by plan."""
    plan = spark.createDataFrame([("C5", 0.03, 5)], "contributor string, share double, copies int")
    batches = materialize(_split(spark, sf_dir).where("split = 'pool'").select("id", "contributor"), "batches")
    return flooded(batches, plan).select("id", "contributor", "gt_attack")


SPLIT = """r AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS place FROM embeddings),
sp AS (SELECT id, label, CASE place % 10 WHEN 0 THEN 'heldout' WHEN 1 THEN 'eval' ELSE 'pool' END AS split,
  CASE WHEN place % 10 > 1 THEN 'C' || ((place // 10 * 8 + place % 10 - 2) % 5 + 1) END AS contributor FROM r)"""
FLOODED = f"""WITH {SPLIT}, b AS (SELECT id, contributor, row_number() OVER (PARTITION BY contributor ORDER BY sha256(id::VARCHAR), id) - 1 AS place, floor(count(*) OVER (PARTITION BY contributor) * 0.03::DOUBLE) AS k FROM sp WHERE split = 'pool'),
a AS (SELECT id, contributor, CASE WHEN contributor <> 'C5' THEN 'none' WHEN place < k THEN 'dup_source' WHEN place < 2 * k THEN 'ood' WHEN place < 7 * k THEN 'dropped' ELSE 'none' END AS gt_attack FROM b)
SELECT * FROM a WHERE gt_attack <> 'dropped' UNION ALL SELECT 1000000000 + id * 10 + c, contributor, 'dup' FROM a, range(1, 6) x(c) WHERE gt_attack = 'dup_source'"""


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: flagged and all samples, the source of most flagged ones and its share,
    models by verdict, the log's size and root."""
    mark = flag("poison_flag") | flag("label_issue") | flag("in_dup") | flag("ood_flag")
    each = materialize(samples(spark, sf_dir).groupBy("contributor").agg(F.count("*").alias("n"), F.count_if(mark).alias("f")), "flagged")
    kpi = each.agg(F.sum("n").alias("samples"), F.sum("f").alias("flagged"), F.max(F.struct(F.col("f"), F.col("contributor"))).alias("m"))
    kpi = kpi.select("samples", "flagged", F.col("m.contributor").alias("top_source"), F.round(F.col("m.f") / F.col("flagged"), 6).alias("source_share"))
    verdicts = _verdicts(spark, sf_dir).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("backdoored", "suspicious", "clean")])
    root = L.tree_roots(leaves(spark, sf_dir)).select(F.col("n").alias("ledger_size"), F.col("root").alias("ledger_root"))
    return kpi.join(verdicts, how="cross").join(root, how="cross")  # one row each


OVERVIEW = f"""WITH RECURSIVE {_tree_sql()}, {SAMPLES}, {AUDIT},
k AS (SELECT contributor, count(*) AS n, count(*) FILTER (coalesce(poison_flag, false) OR coalesce(label_issue, false) OR coalesce(in_dup, false) OR coalesce(ood_flag, false)) AS f FROM s GROUP BY 1),
tot AS (SELECT sum(n)::BIGINT AS samples, sum(f)::BIGINT AS flagged FROM k)
SELECT samples, flagged, contributor AS top_source, round(f / flagged, 6) AS source_share,
  (SELECT count(*) FROM v WHERE verdict = 'backdoored') AS backdoored, (SELECT count(*) FROM v WHERE verdict = 'suspicious') AS suspicious, (SELECT count(*) FROM v WHERE verdict = 'clean') AS clean,
  (SELECT count(*) FROM leaves) AS ledger_size, (SELECT hs[1] FROM tree WHERE len(hs) = 1) AS ledger_root
FROM k, tot ORDER BY f DESC, contributor DESC LIMIT 1"""


def _norm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's classes with their norm and index; the target's label is marked."""
    rows = _anomalies(spark, sf_dir)
    targets = _verdicts(spark, sf_dir, rows).where("target is not null").select("s_suppkey", F.col("target").alias("l_linenumber"), F.lit(True).alias("_target"))
    label = F.concat(F.lit("class "), F.col("l_linenumber").cast("string"), F.when(flag("_target"), " (target)").otherwise(""))
    return rows.join(targets, _CLASSES[:2], "left").select("s_suppkey", label.alias("label"), F.round("l1", 6).alias("l1"), F.round("anomaly_index", 4).alias("anomaly_index"), "flagged")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as classes of 20 lines or more, return flags as clusters."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_returnflag").alias("cluster"), (F.col("l_linestatus") == "F").alias("other"))
    sizes = lines.groupBy("label", "cluster").agg(F.count("*").alias("size"))
    totals = sizes.groupBy("label").agg(F.sum("size").alias("total")).where(F.col("total") >= LEAST_CLASS)
    shares = sizes.join(totals, "label").select("label", "cluster", (F.col("size") / F.col("total")).alias("share"))
    found = suspicious_clusters(lines.join(shares, ["label", "cluster"]))
    return found.select("label", "cluster", "size", F.round("share", 6).alias("share"), F.round("others", 6).alias("others"), "suspicious")


def _trace_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace scores of all samples and of the candidates, in the same 30 bins."""
    found = traced(pool(spark, sf_dir)).select("trace_score", "candidate")
    series = found.select(F.explode(F.when(flag("candidate"), F.array(F.lit("all"), F.lit("candidates"))).otherwise(F.array(F.lit("all")))).alias("series"), "trace_score")
    return histogram(series, "trace_score", ["series"])


def _probe_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models compared on recorded probes: where the probe set's digest has changed
    (every ninth model lacks its first lines), the agreement isn't told."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").alias("same"))
    name = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    recorded = L.set_digest(lines, "l_suppkey", name).select("l_suppkey", F.col("digest").alias("recorded"))
    shown = lines.where("not (l_suppkey % 9 = 0 and l_linenumber = 1)")
    agreement = shown.groupBy("l_suppkey").agg(F.avg(F.col("same").cast("double")).alias("agreement"))
    both = recorded.join(L.set_digest(shown, "l_suppkey", name), "l_suppkey").join(agreement, "l_suppkey")
    same = F.col("digest") == F.col("recorded")
    return both.select("l_suppkey", "members", F.when(same, "compared").otherwise("probe set changed").alias("state"), F.when(same, F.round("agreement", 6)).alias("agreement"))


def _signed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model directories of fifty pages checked against signed manifests: every tenth
    page is changed later, every 17th model's tag is another's. mismatched lists files."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("model"), "page_id", L.digest(F.col("html")).alias("sha256"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("p"), "sha256"))), lambda x: F.concat_ws(":", x["p"], x["sha256"])), ",")
    secret = F.when(F.col("model") % 17 == 3, "other-key").otherwise("vendor-key")
    signed = pages.groupBy("model").agg(L.digest(lines).alias("manifest")).withColumn("tag", A.keyed_tag(secret, F.col("manifest")))
    checked = signed.select("model", (F.col("tag") == A.keyed_tag(F.lit("vendor-key"), F.col("manifest"))).alias("signed"))
    found = pages.withColumn("found", F.when(F.col("page_id") % 10 == 0, L.digest(F.concat("sha256", F.lit("!")))).otherwise(F.col("sha256")))
    wrong = found.where("found <> sha256").groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("mismatched"))
    return checked.join(wrong, "model", "left").select("model", "signed", F.coalesce("mismatched", F.lit("")).alias("mismatched"), (F.col("signed") & F.col("mismatched").isNull()).alias("ok"))


QUERIES = {
    "hash_chain_rewrites": Query(_rewrites, REWRITES, "E5 J14 J15"),
    "ledger_old_proofs": Query(_old_proofs, _proofs_sql(_HALF, f"SELECT * FROM e WHERE {_HALF}", "event_id, w.pos, true AS valid"), "J10 J7 J8"),
    "ledger_browser": Query(_browser, _proofs_sql("true", "SELECT * FROM e WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 200", "event_id, event_type AS kind, w.pos, leaves.hash AS leaf_hash"), "O7 J10 F4"),
    "nonce_key_release": Query(_releases, RELEASES, "K6 K7"),
    "stored_tables": Query(_stored, " UNION ALL ".join(f"SELECT '{f}' AS form, doc_id, source, n_chars, sha256(text) AS sha256 FROM documents" for f in FORMS), "A5 A6 A7"),
    "sealed_pool": Query(_sealed_pool, "SELECT coalesce(source, '') AS contributor, doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 20 <> 0", "A15"),
    "stratified_split": Query(_split_rows, f"WITH {SPLIT} SELECT id, label, split, contributor FROM sp", "I1 I6"),
    "flooded_batches": Query(_flooded, FLOODED, "I4 I6 C14"),
    "console_overview": Query(_overview, OVERVIEW, "O1"),
    "class_norm_table": Query(_norm_table, f"WITH {AUDIT} SELECT a.s_suppkey, 'class ' || l_linenumber || CASE WHEN v.target = l_linenumber THEN ' (target)' ELSE '' END AS label, round(l1, 6) AS l1, round(a.ai, 4) AS anomaly_index, flagged FROM a LEFT JOIN v ON v.s_suppkey = a.s_suppkey", "O5"),
    "cluster_shares": Query(_clusters, f"WITH c AS (SELECT l_suppkey AS label, l_returnflag AS cluster, count(*) AS size, avg((l_linestatus = 'F')::INT) AS others FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(size) OVER (PARTITION BY label) AS total FROM c) SELECT label, cluster, size, round(size / total, 6) AS share, round(others, 6) AS others, size / total < 0.25 AND round(others, 9) >= 0.5 AS suspicious FROM t WHERE total >= {LEAST_CLASS}", "B4 B17 D21"),
    "trace_histograms": Query(_trace_histograms, None, "O6"),
    "probe_set_guard": Query(_probe_guard, "WITH p AS (SELECT l_suppkey, count(*) FILTER (l_suppkey % 9 <> 0 OR l_linenumber <> 1) AS members, count(*) AS recorded, avg((l_linestatus = 'F')::INT) AS agreement FROM lineitem GROUP BY 1) SELECT l_suppkey, members, CASE WHEN members = recorded THEN 'compared' ELSE 'probe set changed' END AS state, CASE WHEN members = recorded THEN round(agreement, 6) END AS agreement FROM p WHERE members > 0", "H20"),
    "signed_models": Query(_signed_models, "WITH m AS (SELECT page_id // 50 AS model, coalesce(string_agg(page_id::VARCHAR, ',' ORDER BY page_id) FILTER (page_id % 10 = 0), '') AS mismatched FROM pages GROUP BY 1) SELECT model, model % 17 <> 3 AS signed, mismatched, model % 17 <> 3 AND mismatched = '' AS ok FROM m", "H23"),
}
