"""Chains, releases, stored forms and splits on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from probity.operators import ledger as L
from probity.operators.fixtures import flooded, stratified_split
from probity.sources.files import read_table, write_table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chain_is_issued_in_order(spark):
    rows = [("b", 2, sha("z"), 7), ("a", 1, sha("x"), 7), ("b", 1, sha("y"), 7), ("b", 3, None, 7)]
    records = spark.createDataFrame(rows, "chain string, n int, body string, extra int")
    got = {(r["chain"], r["n"]): (r["prev"], r["own"], r["extra"]) for r in L.issue_chain(records, "chain", "n", "body").collect()}
    one = sha(L.GENESIS + sha("y"))
    two = sha(one + sha("z"))
    assert got == {
        ("a", 1): (L.GENESIS, sha(L.GENESIS + sha("x")), 7),
        ("b", 1): (L.GENESIS, one, 7),
        ("b", 2): (one, two, 7),
        ("b", 3): (two, sha(two), 7),
    }
    checked = L.verify_chain(L.issue_chain(records, "chain", "n", "body"), "chain", "n", "body")
    assert {(r["chain"], r["length"], r["ok"], r["first_break"]) for r in checked.collect()} == {("a", 1, True, None), ("b", 3, True, None)}
    assert L.issue_chain(records.limit(0), "chain", "n", "body").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 1024, 1025, 2500])
def test_roots_without_nodes(spark, size):
    leaves = spark.range(size).select(F.col("id").alias("pos"), L.leaf_hash(F.col("id").cast("string")).alias("hash"))
    level = [r["hash"] for r in leaves.orderBy("pos").collect()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + bytes.fromhex("".join(level[i : i + 2]))).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert [tuple(r) for r in L.tree_roots(leaves).collect()] == [(size, level[0])]


def test_roots_of_nothing(spark):
    leaves = spark.createDataFrame([], "pos long, hash string, g int")
    assert [tuple(r) for r in L.tree_roots(leaves).collect()] == [(0, None)]
    assert L.tree_roots(leaves, ["g"]).count() == 0


def test_released_names(spark):
    keys = spark.createDataFrame([("C2",), ("C1",), ("C1",)], "name string")
    asked = spark.createDataFrame([(1, True, ["C2", "C9"]), (2, True, None), (3, False, None), (4, None, ["C1"]), (5, True, [])], "id int, ok boolean, wanted array<string>")
    got = {r["id"]: r["released"] for r in L.released_names(asked, "ok", "wanted", keys, "name").collect()}
    assert got == {1: ["C2"], 2: ["C1", "C2"], 3: [], 4: [], 5: []}


def test_set_digest_ignores_order(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "a")], "g int, x string")
    got = {r["g"]: r["digest"] for r in L.set_digest(rows, "g", F.col("x")).collect()}
    assert got[1] == got[2] != got[3]


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_texts_survive_every_form(spark, tmp_path, form):
    texts = ["", None, " padded ", 'say "no"', "back\\slash, comma", "two\nlines\r\nthree", "\u00e4\u4e2d\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    write_table(rows, str(tmp_path / form), form)
    back = read_table(spark, str(tmp_path / form), rows.schema, form, lines_in_text=True)
    assert {r["id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_split_and_flood(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, F.lit(None)).otherwise(F.col("id") % 3).cast("int").alias("label"))
    split = stratified_split(rows)
    assert split.count() == 1000
    parts = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert {k: v for k, v in parts.items() if k[0] is not None} == {(c, s): n for c in range(3) for s, n in (("heldout", 20), ("eval", 20), ("pool", 160))}
    assert parts[(None, "heldout")] == 40
    batches = split.where("split = 'pool'").select("id", "contributor")
    sizes = {r["contributor"]: r["count"] for r in batches.groupBy("contributor").count().collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 4
    plan = spark.createDataFrame([("C5", 0.03, 5)], "contributor string, share double, copies int")
    after = flooded(batches, plan).cache()
    assert {r["contributor"]: r["count"] for r in after.groupBy("contributor").count().collect()} == sizes
    bases = int(sizes["C5"] * 0.03)
    kinds = {r["gt_attack"]: r["count"] for r in after.where("contributor = 'C5'").groupBy("gt_attack").count().collect()}
    assert kinds == {"dup_source": bases, "ood": bases, "dup": 5 * bases, "none": sizes["C5"] - 7 * bases}
