"""Queries that run streams over the tables to the end of their input: appends to a log
with a frontier, hash chains, single-use nonces, and trust over windows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators import ledger as L
from probity.plans.ledger import FOLD, PAYLOAD_SQL
from probity.plans.query import Query, table
from probity.sources.scratch import materialize, scratch_path
from probity.streaming import appended, stateful, trust

APPENDS, TTL_MS, DAYS = 5, 6 * 3600 * 1000, 365
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _as_stream(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once, as a stream of their files."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER)
    stateful.keep_state_in_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _to_the_end(verdicts: DataFrame, mode: str) -> DataFrame:
    """What a stream writes until its input ends: one folder for each micro-batch."""
    spark = verdicts.sparkSession
    path = scratch_path(spark, "verdicts")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _rocksdb(spark):
        query = verdicts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(verdicts.schema).parquet(path)


def _log_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in five turns: first index, size and root after each."""
    path = scratch_path(spark, "log")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    rows = table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 19, "0").alias("key"), payload.alias("payload"), (F.col("event_id") % APPENDS).alias("turn"))
    rows = materialize(rows, "turns")
    for turn in range(APPENDS):
        appended.append_batch(rows.where(F.col("turn") == turn), turn, "key", "payload", path)
    return appended.heads(spark, path).select("batch", "start", "size", "root")


LOG_APPENDS = f"""WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY event_id % {APPENDS}, event_id) - 1 AS pos, event_id % {APPENDS} AS batch, sha256(unhex('00') || encode({PAYLOAD_SQL})) AS hash FROM events),
heads AS (SELECT batch, min(pos) AS start, max(pos) + 1 AS size FROM l GROUP BY batch),
tree(size, hs) AS (
  SELECT size, list(hash ORDER BY pos) FROM heads JOIN l ON pos < size GROUP BY size
  UNION ALL SELECT size, {FOLD} FROM tree WHERE len(hs) > 1)
SELECT batch, start, heads.size, hs[1] AS root FROM heads JOIN tree ON tree.size = heads.size AND len(hs) = 1"""


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chains of turns, a conversation every two minutes; every seventh
    one's turn 3 names a wrong record before it, every fifth one's turn 1 is lost. The last
    one is still open."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", L.digest(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")).alias("own"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("before"))
    tampered = (F.col("conv_id") % 7 == 0) & (F.col("turn") == 3)
    prev = F.when(tampered, L.digest(F.lit("x"))).otherwise(F.coalesce("before", F.lit(L.GENESIS)))
    at = F.timestamp_seconds((F.col("conv_id") + 1) * 120)
    rows = turns.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "own", prev.alias("prev"), at.alias("at")).where("not (conv_id % 5 = 0 and turn = 1)")
    verdicts = stateful.chain_verdicts(_as_stream(rows, "turns"), "conv_id", "turn", "own", "prev", "at", late="0 seconds", idle_ms=60_000)
    closed = _to_the_end(verdicts, "update").where("closed")
    return closed.select(F.col("chain").cast("long").alias("conv_id"), F.col("records").alias("length"), "ok", "first_break")


CHAINS = f"""WITH t AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR || '|' || turn || '|' || role || '|' || text) AS own FROM conversations),
p AS (SELECT a.*, CASE WHEN a.conv_id % 7 = 0 AND a.turn = 3 THEN sha256('x') ELSE coalesce(b.own, '{L.GENESIS}') END AS prev FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
k AS (SELECT *, prev <> coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), '{L.GENESIS}') AS broken FROM p WHERE NOT (conv_id % 5 = 0 AND turn = 1))
SELECT conv_id, count(*) AS length, count(*) FILTER (broken) = 0 AS ok, min(turn) FILTER (broken) AS first_break FROM k WHERE conv_id < (SELECT max(conv_id) FROM k) GROUP BY conv_id"""


def _nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nonce is a user's number on a day: every third event issues it, others use it within
    six hours, too late, again, or before it is issued. Uses at the last moment are open."""
    nonce = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    events = table(spark, sf_dir, "events").select(nonce.alias("nonce"), F.col("event_id").alias("use_id"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at"))
    issues = _as_stream(events.where("use_id % 3 = 0").select("nonce", "at"), "issues")
    uses = _as_stream(events.where("use_id % 3 <> 0"), "uses")
    verdicts = stateful.nonce_verdicts(issues, uses, "nonce", "at", "use_id", ttl_ms=TTL_MS, keep_ms=100 * TTL_MS, late="0 seconds")
    return _to_the_end(verdicts, "append").select(F.col("use_id").cast("long").alias("event_id"), "verdict")


NONCES = f"""WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS nonce, event_id, epoch_ms(ts) AS t FROM events),
i AS (SELECT nonce, min(t) AS issued FROM e WHERE event_id % 3 = 0 GROUP BY 1),
u AS (SELECT e.*, issued, coalesce(issued <= t, false) AS known FROM e LEFT JOIN i USING (nonce) WHERE event_id % 3 <> 0),
f AS (SELECT nonce, arg_min(event_id, (t, event_id::VARCHAR)) AS first FROM u WHERE known GROUP BY 1)
SELECT event_id, CASE WHEN NOT known THEN 'unknown' WHEN event_id <> first THEN 'replayed' WHEN t - issued > {TTL_MS} THEN 'expired' ELSE 'released' END AS verdict
FROM u LEFT JOIN f USING (nonce) WHERE t < (SELECT max(t) FROM e)"""


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' trust in each closed year of shipping dates, returned lines as poisoned samples."""
    no = F.lit(None).cast("boolean")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contributor"), F.lit(0).alias("label"), (F.col("l_returnflag") == "R").alias("poison_flag"), no.alias("label_issue"), no.alias("in_dup"), no.alias("ood_flag"), F.col("l_shipdate").cast("timestamp").alias("at"))
    path = scratch_path(spark, "trust")
    trust.watch_trust(_as_stream(lines, "lines"), "at", path, scratch_path(spark, "stream"), window=f"{DAYS} days", late="0 seconds").awaitTermination()
    closed = spark.read.parquet(path)
    return closed.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "contributor", "n_samples", F.round("poison_rate", 6).alias("poison_rate"), F.round("z_poison_rate", 5).alias("z"), F.round("trust", 5).alias("trust"), "flagged")


TRUST = f"""WITH l AS (SELECT l_suppkey AS contributor, l_returnflag, datediff('day', DATE '1970-01-01', l_shipdate::DATE) // {DAYS} AS w FROM lineitem),
r AS (SELECT w, contributor, count(*) AS n, avg((l_returnflag = 'R')::INT::DOUBLE) AS rate FROM l GROUP BY ALL),
m AS (SELECT r.*, median(rate) OVER (PARTITION BY w) AS md FROM r),
s AS (SELECT w, greatest(1.4826 * median(abs(rate - md)), 0.004) AS spread FROM m GROUP BY w),
z AS (SELECT m.*, (rate - md) / (spread + 1e-6) AS z FROM m JOIN s USING (w))
SELECT strftime(DATE '1970-01-01' + (w * {DAYS})::INT, '%Y-%m-%d') AS start, contributor, n AS n_samples, round(rate, 6) AS poison_rate, round(z, 5) AS z, round(100 * exp(-0.35 * greatest(0, z) / 5), 5) AS trust, round(z, 9) >= 3.5 AS flagged
FROM z WHERE DATE '1970-01-01' + ((w + 1) * {DAYS})::INT <= (SELECT max(l_shipdate) FROM lineitem)"""


QUERIES = {
    "log_appends": Query(_log_appends, LOG_APPENDS, "J9 E7 M1 A16"),
    "chain_stream": Query(_chains, CHAINS, "M4 E4 J15"),
    "nonce_stream": Query(_nonces, NONCES, "M2 K6 K7"),
    "trust_stream": Query(_trust, TRUST, "M5 D10 D11"),
}
