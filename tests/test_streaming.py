"""Streams of records, each run to the end of its input."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from probity.operators import ledger
from probity.streaming import appended, records

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def finish(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_nonce_is_used_once(spark, tmp_path):
    rows = [("a", START), ("a", START + timedelta(seconds=5)), ("b", START)]
    df = records.first_nonces(stream(spark, tmp_path, rows, "nonce string, at timestamp"), "nonce", "at")
    assert finish(df, "nonces", "append").count() == 2


def test_log_is_appended(spark, tmp_path):
    df = stream(spark, tmp_path, [("a", "x"), ("b", "y")], "id string, body string")
    for _ in range(2):  # the second start finds nothing new
        appended.append_log(df, "id", "body", str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    assert appended.entries(spark, str(tmp_path / "log")).count() == 2


def test_log_refuses_known_ids(spark, tmp_path):
    schema, path = "id string, body string", str(tmp_path / "log")
    first = stream(spark, tmp_path / "1", [("a", "x"), ("a", "w"), ("b", "y")], schema)
    appended.append_log(first, "id", "body", path, str(tmp_path / "ck1"), kind="receipt").awaitTermination(120)
    second = stream(spark, tmp_path / "2", [("b", "z"), ("c", "z")], schema)
    appended.append_log(second, "id", "body", path, str(tmp_path / "ck2"), kind="audit").awaitTermination(120)
    got = [(r["pos"], r["kind"], r["key"], r["payload"]) for r in appended.entries(spark, path).orderBy("pos").collect()]
    assert got == [(0, "receipt", "a", "w"), (1, "receipt", "b", "y"), (2, "audit", "c", "z")]


def naive_root(leaves):
    """RFC 6962's definition, by the largest power of two below the size."""
    if not leaves:
        return hashlib.sha256().hexdigest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + bytes.fromhex(naive_root(leaves[:k])) + bytes.fromhex(naive_root(leaves[k:]))).hexdigest()


def test_every_batch_has_indices_and_a_root(spark, tmp_path):
    """Six batches, one without anything new, one over a chunk's border, each also run again."""
    path, held = str(tmp_path / "log"), []
    sizes = [1, 6, 0, 1030, 5, 2100]
    for number, n in enumerate(sizes):
        first = sum(sizes[:number])
        rows = [(f"k{first + i:06d}", f"entry-{first + i}") for i in range(n)] + [("k000000", "again"), (None, "x"), ("y", None)]
        batch = spark.createDataFrame(rows if number else rows[:n], "id string, body string")
        for _ in range(2):
            appended.append_batch(batch, number, "id", "body", path)
        held += [hashlib.sha256(b"\0" + f"entry-{first + i}".encode()).hexdigest() for i in range(n)]
        head = appended._last(spark, path)
        assert (head["batch"], head["start"], head["size"], head["root"]) == (number, first, len(held), naive_root(held))
    got = appended.entries(spark, path).select("pos", F.col("leaf_hash").alias("hash"))
    assert [r["hash"] for r in got.orderBy("pos").collect()] == held
    # the tree over all entries, and the roots after each append, agree
    assert ledger.tree_roots(got).first()["root"] == naive_root(held)
    roots = {r["size"]: r["root"] for r in ledger.append_roots(got).collect()}
    assert all(roots[r["size"]] == r["root"] for r in appended.heads(spark, path).collect())


def test_half_written_batch_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "log")
    df = lambda *rows: spark.createDataFrame(rows, "id string, body string")
    appended.append_batch(df(("a", "1"), ("b", "2")), 0, "id", "body", path)
    # entries without a head: the writer was lost
    spark.createDataFrame([(2, "record", "z", "9", "00")], "pos long, kind string, key string, payload string, leaf_hash string").write.parquet(f"{path}/entries/seq=1")
    assert appended.entries(spark, path).count() == 2
    appended.append_batch(df(("z", "3"), ("c", "3")), 1, "id", "body", path)
    assert [(r["pos"], r["key"], r["payload"]) for r in appended.entries(spark, path).orderBy("pos").collect()] == [(0, "a", "1"), (1, "b", "2"), (2, "c", "3"), (3, "z", "3")]


def test_windows_and_freshness(spark, tmp_path):
    rows = [("C1", START, True), ("C1", START, None), ("C2", START + timedelta(days=3), False)]
    df = stream(spark, tmp_path, rows, "contributor string, at timestamp, flagged boolean")
    got = finish(records.contributor_windows(df, "at", "contributor", "flagged"), "windows", "complete")
    assert {(r["contributor"], r["n"], r["flag_rate"]) for r in got.collect()} == {("C1", 2, 0.5), ("C2", 1, 0.0)}
    assert records.fresh(spark.range(1).select(F.current_timestamp().alias("at")), "at", 60).count() == 1
