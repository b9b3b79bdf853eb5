"""Streams with records out of order, against the batch queries."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from probity.operators import contributors, ledger
from probity.operators.contributors import METRICS
from probity.streaming import stateful, trust

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.keep_state_in_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def files(spark, tmp_path, batches, schema):
    """A stream that reads one batch of rows after another."""
    path = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def finish(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    return df.sparkSession.table(name).collect()


def chained(name, n, broken=(), start=0):
    """Records (chain, place, own, prev, at); at broken places prev is wrong."""
    prev, out = ledger.GENESIS, []
    for i in range(n):
        own = hashlib.sha256(f"{name}{i}{prev}".encode()).hexdigest()
        out.append((name, i, own, "x" if i in broken else prev, START + timedelta(seconds=start + i)))
        prev = own
    return out


def test_chains_in_any_order(spark, tmp_path):
    schema = "chain string, place long, own string, prev string, at timestamp"
    rows = [*chained("a", 9), *chained("b", 7, {3, 5}), *chained("c", 1), *[r for r in chained("gap", 8) if r[1] != 4], *[r for r in chained("headless", 4) if r[1]]]
    random.Random(5).shuffle(rows)
    later = [("end", 0, "h", ledger.GENESIS, START + timedelta(days=1))]
    # three batches of shuffled records, one of them twice, then one that moves the watermark on
    stream = files(spark, tmp_path, [rows[:9], rows[9:20], rows[5:9] + rows[20:], later, later], schema)
    got = finish(stateful.chain_verdicts(stream, "chain", "place", "own", "prev", "at"), "chains_any", "update", tmp_path)
    closed = {r["chain"]: (r["records"], r["ok"], r["first_break"]) for r in got if r["closed"]}
    batch = ledger.chain_breaks(spark.createDataFrame(rows, schema), "chain", "place", "own", "prev")
    assert closed == {r["chain"]: (r["length"], r["ok"], r["first_break"]) for r in batch.collect()}
    assert closed["a"] == (9, True, None) and closed["b"][2] == 3 and closed["gap"] == (7, False, 5) and closed["headless"][2] == 1
    # before it is closed, a chain with a gap waits and isn't blamed
    waits = [r for r in got if r["chain"] == "gap" and not r["closed"]]
    assert all(r["ok"] for r in waits) and waits[-1]["waits"] == 3


def test_nonces_are_used_once(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    issued = [("n1", at(0)), ("n2", at(5)), ("n3", at(10)), ("n4", at(40)), ("n5", at(20)), ("n1", at(30))]
    used = [
        ("n1", "u1", at(8)), ("n1", "u2", at(4)), ("n1", "u3", at(4)), ("n2", "u4", at(200)), ("n2", "u5", at(201)), ("n3", "u6", at(70)),
        ("n4", "u7", at(39)), ("n4", "u8", at(41)), ("never", "u9", at(50)), ("n5", "u10", at(81)),
    ]
    marks = [("end", at(90_000)), ("end", at(90_001))]
    issues = files(spark, tmp_path / "i", [issued[3:], issued[:3], marks[:1], marks[1:]], "nonce string, at timestamp")
    uses = files(spark, tmp_path / "u", [used[:1] + used[6:], used[1:6], [("end", "e1", at(90_000))], [("end", "e2", at(90_001))]], "nonce string, use_id string, at timestamp")
    got = finish(stateful.nonce_verdicts(issues, uses, "nonce", "at", "use_id", ttl_ms=60_000), "nonces_any", "append", tmp_path)
    found = {r["use_id"]: r["verdict"] for r in got if r["nonce"] != "end"}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    batch = ledger.nonce_verdicts(frame(issued, "nonce string, at timestamp"), frame(used, "nonce string, use_id string, at timestamp"), "nonce", "at", "use_id", 60_000)
    assert found == {r["use_id"]: r["verdict"] for r in batch.collect()}
    assert found == {"u1": "replayed", "u2": "released", "u3": "replayed", "u4": "expired", "u5": "replayed", "u6": "released", "u7": "unknown", "u8": "released", "u9": "unknown", "u10": "expired"}
    assert len(got) == len({r["use_id"] for r in got})
    assert spark.createDataFrame([], "nonce string, at timestamp").transform(lambda d: ledger.nonce_verdicts(d, frame(used, "nonce string, use_id string, at timestamp"), "nonce", "at", "use_id", 1)).where(F.col("verdict") != "unknown").count() == 0


@pytest.mark.parametrize("buckets", [1, 5])
def test_nonces_of_a_bucket_are_apart(spark, tmp_path, buckets):
    """One nonce has more uses than its bucket holds; batches come out of order."""
    r = random.Random(6)
    at = lambda s: START + timedelta(seconds=s)
    issued = [(f"n{i}", at(r.randrange(500))) for i in range(40)] + [("hot", at(100)), ("null", at(9))]
    used = [(f"n{r.randrange(50)}", f"u{i}", at(r.randrange(1000))) for i in range(300)] + [("hot", f"h{i}", at(80 + i)) for i in range(3 * stateful._Nonces.HELD)]
    used += [used[0], used[-1], ("null", "z1", at(10)), (None, "z2", at(10))]
    r.shuffle(used)
    mark = [("end", at(90_000))]
    issues = files(spark, tmp_path / "i", [issued[20:], issued[:20], mark, mark], "nonce string, at timestamp")
    uses = files(spark, tmp_path / "u", [used[:200], used[200:], [("end", "e1", at(90_000))], [("end", "e2", at(90_001))]], "nonce string, use_id string, at timestamp")
    verdicts = stateful.nonce_verdicts(issues, uses, "nonce", "at", "use_id", ttl_ms=60_000, keep_ms=3_600_000, late="30 minutes", buckets=buckets)
    got = [x for x in finish(verdicts, f"nonces_{buckets}", "append", tmp_path) if x["nonce"] != "end"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    batch = ledger.nonce_verdicts(frame(issued, "nonce string, at timestamp"), frame(list(set(used)), "nonce string, use_id string, at timestamp"), "nonce", "at", "use_id", 60_000)
    want = {x["use_id"]: x["verdict"] for x in batch.collect()}
    assert {x["use_id"]: x["verdict"] for x in got} == want and len(got) == len(want)
    assert sum(x["nonce"] == "hot" and x["verdict"] == "released" for x in got) == 1


def test_trust_over_windows(spark, tmp_path):
    """Three days of samples in four batches, late ones among them; the last window stays open."""
    r = random.Random(2)
    rows = []
    for i in range(900):
        who = f"C{i % 5 + 1}"
        day = i // 300
        bad = who == "C3" and day == 1
        rows.append((i, who, r.randrange(4) if who != "C5" else i % 2, r.random() < (0.5 if bad else 0.02), r.random() < 0.03, None if i % 7 else r.random() < 0.1, r.random() < 0.01, START + timedelta(days=day, seconds=80 * (i % 300))))
    schema = "id long, contributor string, label int, poison_flag boolean, label_issue boolean, in_dup boolean, ood_flag boolean, at timestamp"
    late = [x for x in rows[260:300] if x[0] % 3 == 0]  # they come after the next day has begun, within the delay
    batches = [[x for x in rows[:300] if x not in late], rows[300:310] + late, rows[310:600], rows[600:]]
    path = str(tmp_path / "trust")
    query = trust.watch_trust(files(spark, tmp_path, batches, schema), "at", path, str(tmp_path / "ck"), late="4 hours")
    assert query.awaitTermination(240) and query.exception() is None
    columns = ["start", "contributor", "n_samples", *METRICS, "risk", "trust", "flagged", "flag_reasons"]
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in t) for t in df.select(columns).collect())
    got = rounded(spark.read.parquet(path))
    days = [START, START + timedelta(days=1)]
    assert {t[0] for t in got} == set(days) and len(got) == 10
    # each closed window is what the batch operators make of that day's samples alone
    for day in days:
        own = spark.createDataFrame([x for x in rows if day <= x[-1] < day + timedelta(days=1)], schema)
        want = contributors.trust(contributors.contributor_rates(own.withColumn("dup_cluster", F.lit(1))).join(contributors.class_skew(own), "contributor"))
        assert [t for t in got if t[0] == day] == rounded(want.withColumn("start", F.lit(day)))
    flagged = {(t[0], t[1]) for t in got if "poison_rate" in t[-1]}
    assert (days[1], "C3") in flagged and (days[0], "C3") not in flagged
