"""Operators on small fixtures, and properties that any input must keep."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions.scalars import padded_id, status_tier
from probity.functions.vectors import cosine, softmax
from probity.operators import contributors as C
from probity.operators import audits, evaluation, ledger, neighbours, poison
from probity.operators.graph import connected_components, forest
from probity.operators.ordering import dense_index
from probity.plans import vectors as V
from probity.sources import files

SMALL = "/root/testdata/sf0.001"
PEERS = [f"org{i}" for i in range(9)]


def pool_of(spark, raised=()):
    """Nine contributors whose rates lie close together around a level of each metric;
    raised: (contributor, metric) pairs that lie ten floors above."""
    r = random.Random(5)
    level = {m: 0.02 * (k + 1) for k, m in enumerate(C.METRICS)}
    rows = [(c, *[level[m] + r.uniform(-0.1, 0.1) * C.FLOORS[m] + 10 * C.FLOORS[m] * ((c, m) in raised) for m in C.METRICS]) for c in PEERS]
    return C.trust(spark.createDataFrame(rows, "contributor string, " + ", ".join(f"{m} double" for m in C.METRICS))).collect()


@pytest.mark.parametrize("metric", C.METRICS)
def test_each_metric_flags_whoever_is_far_above_the_peers(spark, metric):
    rows = {r["contributor"]: r for r in pool_of(spark, {("org7", metric)})}
    assert [c for c in PEERS if rows[c]["flagged"]] == ["org7"] and rows["org7"]["flag_reasons"] == [metric]
    assert rows["org7"]["trust"] < min(rows[c]["trust"] for c in PEERS if c != "org7")


def test_equals_are_not_flagged_and_several_are_told_from_the_rest(spark):
    assert not any(r["flagged"] for r in pool_of(spark))
    bad = {("org1", C.METRICS[0]), ("org4", C.METRICS[2])}
    rows = sorted(pool_of(spark, bad), key=lambda r: r["trust"])
    assert {r["contributor"] for r in rows[:2]} == {"org1", "org4"} and not any(r["flagged"] for r in rows[2:])


def test_no_spread_is_below_its_floor(spark):
    same = spark.createDataFrame([(2.5,)] * 7 + [(2.6,)], "x double")
    assert {(r["spread_x"], r["median_x"]) for r in C.robust_z(same, {"x": 0.25}).collect()} == {(0.25, 2.5)}


def test_skew_is_zero_for_equal_and_at_most_one(spark):
    rows = [("a", x) for x in "xyz"] + [("b", x) for x in "xyz"] + [("c", "x")] * 3
    skew = {r["contributor"]: r["class_skew"] for r in C.class_skew(spark.createDataFrame(rows, "contributor string, label string")).collect()}
    assert skew["a"] == pytest.approx(skew["b"]) and 0 < skew["c"] <= 1
    assert C.class_skew(spark.createDataFrame([("a", "x")], "contributor string, label string")).first()["class_skew"] == 0


def leaf(data):
    return hashlib.sha256(b"\0" + data).digest()


def folded(row):
    """A tree's root, level by level; a node without a neighbour goes up as it is."""
    while len(row) > 1:
        row = [hashlib.sha256(b"\1" + b"".join(row[i : i + 2])).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 31, 1025])
def test_merkle_roots_and_proofs(spark, n):
    leaves = spark.range(n).select(F.col("id").alias("pos"), ledger.leaf_hash(F.concat(F.lit("entry-"), F.col("id").cast("string"))).alias("hash"))
    root = ledger.tree_roots(leaves).first()
    assert (root["n"], root["root"]) == (n, folded([leaf(f"entry-{i}".encode()) for i in range(n)]).hex())
    proofs = ledger.audit_paths(leaves, leaves)
    good = lambda leaf, pos, size: ledger.verify_inclusion(leaf, pos, size, F.col("proof"), F.lit(root["root"]))
    size = F.lit(n).cast("long")
    got = proofs.agg(F.count_if(good(F.col("leaf_hash"), F.col("pos"), size)).alias("ok"), F.count_if(good(F.reverse("leaf_hash"), F.col("pos"), size)).alias("bad"), F.count_if(good(F.col("leaf_hash"), F.col("pos") + 1, size)).alias("moved")).first()
    assert (got["ok"], got["bad"], got["moved"]) == (n, 0, 0)


def test_chain_names_the_first_break(spark):
    rows = [("a", 1, "h1", ledger.GENESIS), ("a", 2, "h2", "h1"), ("a", 3, "h3", "h2"), ("b", 1, "h1", ledger.GENESIS), ("b", 3, "h3", "h2")]
    got = {r["c"]: (r["ok"], r["first_break"]) for r in ledger.chain_breaks(spark.createDataFrame(rows, "c string, n int, own string, prev string"), "c", "n", "own", "prev").collect()}
    assert got == {"a": (True, None), "b": (False, 3)}


def test_sealed_boxes_open_with_the_right_contributor_only(spark):
    key, iv = F.unhex(F.lit("6b" * 32)), F.unhex(F.lit("00" * 12))
    box = ledger.seal("BOX1", F.lit("data"), key, iv, F.lit("C1").cast("binary"))
    row = spark.range(1).select(ledger.unseal("BOX1", box, key, F.lit("C1").cast("binary")).cast("string").alias("a"), ledger.unseal("BOX1", box, key, F.lit("C2").cast("binary")).alias("b"), ledger.unseal("BOX2", box, key, F.lit("C1").cast("binary")).alias("c")).first()
    assert tuple(row) == ("data", None, None)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_index_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id") % 7919).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    got = [r["i"] for r in dense_index(rows, ["k", "id"], "i").orderBy(F.asc_nulls_first("k"), "id").collect()]
    assert got == list(range(1001))


def test_empty_measures_are_zero(spark):
    row = evaluation.precision_recall(spark.createDataFrame([(None, None)], "p boolean, a boolean"), {"x": (F.col("p"), F.col("a"))}).first()
    assert (row["precision"], row["recall"]) == (0, 0)


def test_scalars(spark):
    row = spark.range(1).select(padded_id("ev", F.lit(12)).alias("a"), padded_id("ev", F.lit(12345678)).alias("b"), status_tier(F.lit("Review")).alias("c"), status_tier(F.lit(None).cast("string")).alias("d"), softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("e"), cosine(F.array(F.lit(1.0)), F.array(F.lit(-2.0))).alias("f")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"]) == ("ev-000012", "ev-12345678", "review", "pending", [0.5, 0.5], -1)


@pytest.mark.parametrize("order", [[6, 1, 3], [3, 1, 6], [1, 6, 3]])
def test_the_first_of_equal_flagged_classes_is_the_target(spark, order):
    found = spark.createDataFrame([("m", c, 9.0 if c == 3 else 2.0, 5.0, c != 3) for c in order], "model string, class int, l1 double, anomaly_index double, flagged boolean").coalesce(1)
    models = spark.createDataFrame([("m", 0.95, None, True, True)], "model string, agreement double, kl double, signed boolean, white_box boolean")
    assert audits.model_verdicts(models, found, "model", "class", "l1").first()["target"] == 1


def test_planted_attacks_are_found(spark):
    found = {r["detector"]: r for r in V._detection(spark, "/root/testdata/sf0.1").collect()}
    assert found["duplicates"]["recall"] >= 0.79 and found["poison"]["recall"] >= 0.85 and found["labels"]["recall"] >= 0.87, found
    # precision as published for duplicates, flips and outliers, and the outliers' recall
    assert found["duplicates"]["precision"] >= 0.46 and found["labels"]["precision"] >= 0.9 and found["ood"]["precision"] >= 0.33 and found["ood"]["recall"] >= 0.55, found


def test_attackers_are_the_least_trusted(spark):
    rows = sorted(V._planted_trust(spark, "/root/testdata/sf0.1").collect(), key=lambda r: r["trust"])
    assert {r["contributor"] for r in rows[:3]} == {"C3", "C4", "C5"}
    assert not any(r["flagged"] for r in rows if r["contributor"] in ("C1", "C2"))
    assert {r["contributor"]: r["reasons"] for r in rows}["C4"] == "label_issue_rate"


def test_trace_names_the_source(spark):
    rows = {r["contributor"]: r for r in V._trace(spark, "/root/testdata/sf0.1").collect()}
    assert rows["C3"]["source"] and rows["C3"]["share"] > 0.5 and rows["C3"]["candidates"] > 5


def test_detectors_do_not_read_ground_truth(spark):
    from probity.operators.fixtures import planted_pool

    rows = planted_pool(V.vectors(spark, SMALL))
    manifest = rows.select(F.col("id").cast("string").alias("sample_id"), "contributor", "gt_attack", F.lit(1).alias("orig_label"))
    assert set(files.public_view(manifest).columns) == {"sample_id", "contributor"}
    flags = poison.spectral_signatures(rows.drop("gt_attack"))
    assert flags.where("ss_flag").count() > 0


def test_knn_small(spark):
    rows = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(20)], "id long, vector array<double>")
    got = neighbours.knn(rows, rows.where("id = 5"), 2).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [4, 6]


@pytest.fixture(scope="module")
def crowd():
    """1,300 vectors in several blocks: forty near copies of one, ten equal ones, and others."""
    r = np.random.default_rng(8)
    x = r.normal(size=(1300, 12))
    x[100:1300:30] = x[0] + r.normal(size=(40, 12)) * 0.02
    x[7:1300:130] = x[3] * 2
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_all_close_pairs_of_a_crowd(spark, crowd):
    x, unit = crowd
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 12), (5001, None)], "id long, vector array<double>").repartition(3)
    near = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(near >= 0.8), strict=True) if i < j}
    got = neighbours.duplicate_edges(rows, 0.8, lambda a, b: a[:, 0] - b[:, 0]).collect()
    assert len(want) > 40 * 41 / 2 and len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["cosine"] - near[r["a"], r["b"]]) < 1e-12 and r["measure"] == x[r["a"], 0] - x[r["b"], 0] for r in got)
    roots = forest(list(want))
    size = {i: sum(roots.get(j, j) == roots.get(i, i) for j in range(1300)) for i in range(1300)}
    clusters = {r["id"]: r for r in neighbours.duplicate_clusters(rows, 0.8).collect()}
    assert len(clusters) == 1302 and clusters[5000]["dup_cluster"] == clusters[5001]["dup_cluster"] == -1
    near[np.diag_indices(1300)] = -1
    for i in range(1300):
        assert (clusters[i]["dup_cluster"], clusters[i]["dup_cluster_size"]) == (roots.get(i, i) if size[i] > 1 else -1, size[i])
        assert clusters[i]["best_cosine"] == pytest.approx(near[i].max(), abs=1e-12) if size[i] > 1 else clusters[i]["best_cosine"] is None


def test_nearest_of_other_peers_in_a_crowd(spark, crowd):
    x, unit = crowd
    peer = [f"p{i % 4}" if i % 9 else None for i in range(1300)]
    rows = spark.createDataFrame([(i, p, v.tolist()) for i, (p, v) in enumerate(zip(peer, x, strict=True))], "id long, peer string, vector array<double>").repartition(3)
    near = np.round(unit @ unit.T, 12)
    got = {}
    for r in neighbours.knn(rows, rows.where("id < 700"), 6, peers_only=True).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert len(got) == 700
    for i in range(700):
        want = sorted((j for j in range(1300) if j != i and peer[j] != peer[i]), key=lambda j: (-near[i, j], j))[:6]
        assert [got[i][k + 1] for k in range(6)] == want


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.py").write_bytes(b"1\r\n2")
    (tmp_path / "x" / "b.py").write_bytes(b"3")
    a, b = (hashlib.sha256(x).digest() for x in (b"1\n2", b"3"))
    assert files.measurement(spark, str(tmp_path / "x")).first()[0] == hashlib.sha256(b"a.py\0" + a + b"b.py\0" + b).hexdigest()
    assert files.file_digests(spark, str(tmp_path / "x")).count() == 2
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    evidence = spark.createDataFrame([("ev-1",)], "evidence_id string")
    files.write_evidence(evidence, str(tmp_path / "e"))
    assert files.read_evidence(spark, str(tmp_path / "e")).first()["evidence_id"] == "ev-1"


def test_signatures(spark):
    from probity.operators import signatures as S

    # the first test of RFC 8032, section 7.1
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert S.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    made = S.sign(seed, b"")
    assert made.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert S.verdict(S.public_key(seed), b"", made) == "valid"
    assert S.verdict(S.public_key(seed), b"x", made) == "altered"
    assert S.verdict(S.public_key(seed), b"", made[:63]) == S.verdict(None, b"", made) == "malformed"
    records = S.sign_records(spark.createDataFrame([(1, b"a"), (2, None)], "id long, body binary"), seed)
    assert {r["id"]: r["verdict"] for r in S.verify_signatures(records).collect()} == {1: "valid", 2: "malformed"}


def test_batches_of_signatures(monkeypatch):
    from probity.operators import signatures as S

    seeds = [bytes([i]) * 32 for i in range(3)]
    good = [(S.public_key(seeds[i % 3]), b"row %d" % i, S.sign(seeds[i % 3], b"row %d" % i)) for i in range(300)]
    done, add = [0], S._add

    def counted(p, q):
        done[0] += 1
        return add(p, q)

    def cost(find):
        done[0] = 0
        return find(), done[0]

    monkeypatch.setattr(S, "_add", counted)
    # another body, another's key, swapped halves of two signatures that would cancel out in a plain sum
    few = list(good)
    few[3], few[77], few[250] = (good[3][0], b"x", good[3][2]), (good[1][0], *good[77][1:]), (None, b"", good[0][2])
    half = int.from_bytes(good[9][2][32:], "little"), int.from_bytes(good[12][2][32:], "little")
    for i, s in ((9, half[0] + 1), (12, half[1] - 1)):
        few[i] = (*good[i][:2], good[i][2][:32] + s.to_bytes(32, "little"))
    many = [(k, b + b"!" if i % 3 else b, s) for i, (k, b, s) in enumerate(good[:60])]
    for rows, gain in ((good, 10), (few, 2), (many, 0), ([], 0)):
        (found, batched), (single, plain) = cost(lambda: S.verdicts(rows)), cost(lambda: [S.verdict(*r) for r in rows])  # noqa: B023
        assert found == single and plain >= gain * batched
    assert [i for i, v in enumerate(S.verdicts(few)) if v == "altered"] == [3, 9, 12, 77]


def test_signatures_of_a_frequent_key(monkeypatch):
    from probity.operators import signatures as S

    seed = b"k" * 32
    (a, _), key = S._secret(seed), S.public_key(seed)
    rows = [(key, b"row %d" % i, S.sign(seed, b"row %d" % i, key)) for i in range(80)]
    body, made = rows[0][1:]
    rows += [(key, b"x", made), (key, body, made[:63]), (key, None, made), (key, body, made[:32] + S.ORDER.to_bytes(32, "little")), (key, body, bytes([255] * 31 + [127]) + made[32:]), (key, body, bytes([2]) + bytes(31) + made[32:])]
    # a nonce that differs by a point of order two holds by the cofactor
    point = S._pack(S._affine(S._add(S._base().times(12345), S._lift((0, S.P - 1)))))
    rows.append((key, b"cofactor", point + ((12345 + S._scalar(point, key, b"cofactor") * a) % S.ORDER).to_bytes(32, "little")))
    rows += [(b"\x02" + bytes(31), body, made)] * 70 + [(b"short", body, made)] * 70
    want = [S.verdict(*r) for r in rows[:90]] + ["malformed"] * (len(rows) - 90)
    assert want[80] == "altered" and set(want[81:86]) == {"malformed"} and want[86] == "valid"
    done, add = [0], S._add

    def counted(p, q):
        done[0] += 1
        return add(p, q)

    monkeypatch.setattr(S, "_add", counted)
    tables = {}
    assert S.verdicts(rows, tables) == want and len(tables) == 3
    # one bad signature costs no second look at the others
    assert S.verdicts(rows[:80] * 20, tables) == want[:80] * 20 and tables[key].width == 8
    done[0] = 0
    assert S.verdicts(rows[:87] * 20, tables) == want[:87] * 20 and done[0] < 87 * 20


def test_detectors_agree_on_most(spark):
    from probity.plans.catalog import QUERIES

    rows = QUERIES["detector_agreement"].run(spark, SMALL).collect()
    assert sum(r["samples"] for r in rows) > 400
    for r in rows:
        # flags that differ are at least the difference of the counts, at most their sum
        differ = round((1 - r["agreement"]) * r["samples"])
        assert abs(r["ac"] - r["ss"]) <= differ <= r["ac"] + r["ss"]


def test_metric_evidence_has_a_row_for_each_metric(spark):
    from probity.plans.catalog import QUERIES

    rows = QUERIES["metric_evidence"].run(spark, SMALL).collect()
    checks = {}
    for r in rows:
        checks.setdefault(r["contributor"], set()).add(r["check"])
        assert r["check"] == "trust_score" or r["flagged"] == (r["score"] >= 3.5)
    assert all(len(c) == 6 for c in checks.values())


def test_roots_after_appends_are_roots_of_prefixes(spark):
    from probity.operators import ledger

    log = spark.range(21).select(F.col("id").alias("pos"), ledger.leaf_hash(F.col("id").cast("string")).alias("hash"))
    got = {r["size"]: r["root"] for r in ledger.append_roots(log).collect()}
    for n in (1, 2, 3, 7, 8, 13, 21):
        assert got[n] == ledger.tree_roots(log.where(F.col("pos") < n)).first()["root"]
    assert len(got) == 21


def test_numbers_in_order_of_the_whole_key(spark):
    from probity.operators.ordering import dense_index

    rows = spark.range(1000).select(F.lit(1).alias("a"), F.concat(F.lit("k"), F.lpad((F.col("id") * 7919 % 1000).cast("string"), 4, "0")).alias("b"))
    got = dense_index(rows, ["a", "b"], "n", start=1).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["b"])] == list(range(1, 1001))


def test_exact_percentile_is_the_built_in_one(spark):
    from probity.operators.ordering import exact_percentile

    rows = spark.range(997).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.sin("id") * (F.col("id") % 17)).alias("x"))
    for share in (0.0, 0.05, 0.5, 0.925, 1.0):
        assert exact_percentile(rows, F.col("x"), share, "p").first()["p"] == rows.agg(F.percentile("x", F.lit(share))).first()[0]
        want = {r[0]: r[1] for r in rows.groupBy("g").agg(F.percentile("x", F.lit(share))).collect()}
        assert {r["g"]: r["p"] for r in exact_percentile(rows, F.col("x"), share, "p", ("g",)).collect()} == want
    assert exact_percentile(rows.where("g > 5"), F.col("x"), 0.5, "p").first()["p"] is None
    assert exact_percentile(rows.where("g > 5"), F.col("x"), 0.5, "p", ("g",)).count() == 0


def test_class_probabilities_of_few_samples(spark):
    empty = spark.createDataFrame([], "id long, label int, vector array<double>")
    assert poison.class_probabilities(empty).count() == 0
    two = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, 1, None)], empty.schema)
    assert [tuple(r) for r in poison.class_probabilities(two).collect()] == [(1, 0, [1.0])]


def test_silhouettes_and_starts(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    z, k = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    z[:, 0] += 3 * k
    k[59] = 7  # alone in its cluster
    pair = ((z[:, None] - z[None]) ** 2).sum(-1)
    want = []
    for i in range(60):
        same = [j for j in range(60) if k[j] == k[i] and j != i]
        b = min(pair[i, k == c].mean() for c in set(k) - {k[i]})
        want.append((b - pair[i, same].mean()) / max(b, pair[i, same].mean()) if same else 0.0)
    rows = [("a", int(c), p.tolist()) for c, p in zip(k, z, strict=True)] + [("one", 1, [1.0, 2.0, 3.0])] * 3 + [("a", 1, None), ("same", 1, [0.0] * 3), ("same", 1, [0.0] * 3), ("same", 2, [0.0] * 3)]
    got = {r["g"]: r for r in poison.silhouettes(spark.createDataFrame(rows, "g string, k int, z array<double>"), "g", "k", "z").collect()}
    assert got["a"]["points"] == 60 and abs(got["a"]["silhouette"] - np.mean(want)) < 1e-9
    assert got["one"]["silhouette"] is None and got["same"]["silhouette"] == 0
    # five clusters around a ring: starts along one axis alone end worse
    ring = [(i, 0, [float(10 * np.cos(i % 5 * 1.2566) + rng.normal() / 5), float(10 * np.sin(i % 5 * 1.2566) + rng.normal() / 5), *[0.0] * 10]) for i in range(200)]
    samples = spark.createDataFrame(ring, "id long, label long, vector array<double>")
    found = poison.class_clusters(samples, starts=6).select("id", "cluster").collect()
    assert len({(r["id"] % 5, r["cluster"]) for r in found}) == 5
    empty = poison.class_clusters(samples.where("id < 0"))
    assert empty.count() == 0 and poison.silhouettes(empty, "label", "cluster", "z").count() == 0


def test_two_means_flags_the_smaller_cluster(spark):
    rows = spark.range(100).select("id", F.lit(0).alias("label"), F.array(F.when(F.col("id") < 20, 5.0).otherwise(0.0) + F.sin("id") * 0.1, F.cos("id") * 0.1).alias("vector"))
    got = poison.two_means(rows).where("tm_flag").select("id").collect()
    assert {r["id"] for r in got} == set(range(20))


def test_scan_and_trace_evidence(spark):
    from probity.plans.catalog import QUERIES

    scan = QUERIES["scan_evidence"].run(spark, SMALL).collect()
    assert {r["check"] for r in scan} >= {"near_duplicate", "out_of_distribution"} and all(r["flagged"] for r in scan)
    assert sorted(r["evidence_id"] for r in scan) == [f"ev-dat-{n:06d}" for n in range(1, len(scan) + 1)]
    assert all(r["score"] > r["threshold"] for r in scan if r["check"] == "out_of_distribution")
    trace = QUERIES["trace_evidence"].run(spark, SMALL).collect()
    assert [r["check"] for r in sorted(trace, key=lambda r: r["evidence_id"])].count("backdoor_source") <= 1
    assert len({r["sha256"] for r in scan + trace}) == len(scan) + len(trace)
    # a seal is the digest of the whole record's canonical JSON, numbers as text
    for r in scan + trace:
        body = {k: v for k, v in r.asDict().items() if k != "sha256"} | {k: r[k] if r[k] is None else f"{r[k]:.4f}" for k in ("score", "threshold")}
        body["details"] = json.loads(r["details"])
        assert len(body) == 15 and r["contributor"] and r["method"] and body["details"]
        if r["check"] != "near_duplicate":  # rounding of scores differs in Python's last digit
            continue
        assert hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() == r["sha256"]


def test_reports_of_the_pool(spark):
    from probity.plans.catalog import QUERIES

    rows = {r["kind"]: r for r in QUERIES["report_entries"].run(spark, SMALL).collect()}
    assert set(rows) == {"risk_report", "trace_report"}
    for kind, prefix in (("risk_report", "risk-"), ("trace_report", "trace-")):
        lines = rows[kind]["payload"].split(";")
        assert [x.split(":")[0] for x in lines] == ["C1", "C2", "C3", "C4", "C5"]
        assert rows[kind]["entry_id"] == prefix + hashlib.sha256(rows[kind]["payload"].encode()).hexdigest()[:16]
    top = QUERIES["trace_top32"].run(spark, SMALL).collect()
    assert len(top) <= 32 and [r["trace_score"] for r in top] == sorted((r["trace_score"] for r in top), reverse=True)


def test_reports_name_their_evidence(spark):
    from probity.operators import contributors as C
    from probity.operators import poison as P
    from probity.plans import evidence as E

    rows = [(f"s{i}", f"C{i % 5 + 1}", i % 3, i % 5 == 2 and i % 2 == 0, False, False, i == 7, -1) for i in range(200)]
    found = spark.createDataFrame(rows, "sample_id string, contributor string, label long, poison_flag boolean, label_issue boolean, in_dup boolean, ood_flag boolean, dup_cluster long")
    trusted = C.trust(C.contributor_metrics(found)).cache()
    risk = E.risk_report(trusted).first()
    said = json.loads(risk["payload"])
    seals = E.contributor_evidence(trusted)
    assert said["flagged"] == sorted(r["contributor"] for r in trusted.where("flagged").collect()) and "C3" in said["flagged"]
    assert {k: float(v) for k, v in said["trust"].items()} == {r["contributor"]: round(r["trust"], 3) for r in trusted.collect()}
    assert risk["entry_id"] == "risk-" + said["evidence_sha256"][:16]
    # the digest covers the seals, whatever their order
    assert E.evidence_entry("risk_report", "risk-", trusted.limit(1).select("contributor"), seals.repartition(7)).first()["entry_id"] == risk["entry_id"]
    assert E.evidence_entry("risk_report", "risk-", trusted.limit(1).select("contributor"), seals.where("evidence_id <> 'ev-rsk-000003'")).first()["entry_id"] != risk["entry_id"]

    samples = spark.createDataFrame([(i, f"C{i % 5 + 1}", 4) for i in range(20)], "id long, contributor string, label long")
    traces = samples.select("id", "contributor", F.lit(0.9).alias("trace_score"), F.lit(0.5).alias("threshold"), F.lit(True).alias("ac_flag"), F.lit(True).alias("over"), ((F.col("contributor") == "C3") | (F.col("id") == 0)).alias("candidate"))
    said = json.loads(E.trace_report(samples, traces).first()["payload"])
    assert (said["target_class"], said["source"], said["source_share"], said["n_candidates"]) == (4, "C3", "0.8000", 5)
    none = E.trace_report(samples, traces.where("false")).first()
    said = json.loads(none["payload"])
    assert (said["target_class"], said["source"], said["n_candidates"]) == (None, None, 0) and none["entry_id"].startswith("trace-")
    assert P.trace_sources(traces, samples).where("source").count() == 1


def test_class_report_counts_every_class(spark):
    from probity.plans.catalog import QUERIES

    rows = QUERIES["activation_report"].run(spark, SMALL).collect()
    assert rows and all(r["samples"] >= poison.LEAST_CLASS and 1 <= r["clusters"] <= poison.CLUSTERS and r["smallest_share"] <= 1 / r["clusters"] + 1e-9 for r in rows)


def test_cosine_transform(spark):
    from probity.functions.vectors import cosine_transform, perceptual_hash

    grid = np.random.default_rng(2).normal(size=(8, 8))
    wave = np.cos(np.pi * (2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] / 16)
    want = (wave @ grid @ wave.T)[:6, :6].ravel()
    df = spark.createDataFrame([(grid.ravel().tolist(),), ([1.0],), (None,)], "v array<double>")
    got = df.select(F.when(F.size("v") == 64, cosine_transform(F.col("v"), 8, 6)).alias("c"), perceptual_hash(F.col("v")).alias("h")).collect()
    assert np.allclose(got[0]["c"], want) and got[1]["h"] is None and got[2]["h"] is None
    assert got[0]["h"] == int("".join("1" if x > np.median(want) else "0" for x in want), 2)


def test_aligned_correlation_finds_shifts_and_mirrors(spark):
    from probity.operators.grids import aligned_correlation

    r = np.random.default_rng(4)
    grid = r.normal(size=(8, 8))
    moved = np.roll(grid, (1, -1), (0, 1)) * 3 + 5
    rows = [(0, grid, grid), (1, grid, grid[:, ::-1]), (2, grid, moved), (3, grid, r.normal(size=(8, 8)))]
    df = spark.createDataFrame([(i, a.ravel().tolist(), b.ravel().tolist()) for i, a, b in rows] + [(4, [1.0], [2.0]), (5, None, [1.0] * 64), (6, [1.0] * 64, [1.0] * 64)], "i int, a array<double>, b array<double>")
    got = {x["i"]: x["c"] for x in df.repartition(2).select("i", aligned_correlation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert min(got[0], got[1], got[2]) > 0.9999 and got[3] < 0.9 and got[4] is None and got[5] is None and got[6] == 0
