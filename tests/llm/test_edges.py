"""Nulls, empty and long texts, repeated rows, empty tables, clashing names: every
operator gives its stated result."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probity.llm import context_mixing, embedding_dedup, licenses, minhash, mixing, packing, pii, prefix_forest, token_files, toxicity
from probity.llm.queries import tokenizer_path
from probity.llm.shared import scratch_path

WORDS = [f"w{i % 97}x{i % 13}" for i in range(6000)]
ROWS = [
    (1, "This work is licensed under the GNU General Public License, version 3.\nMail a.b@c.example.com now", "en", "s1", 80),
    (1, "This work is licensed under the GNU General Public License, version 3.\nMail a.b@c.example.com now", "en", "s1", 80),
    (2, None, None, None, None),
    (None, "one two three four five six seven", "de", "s2", 33),
    (3, "", "en", "s1", 0),
    (4, " \t\n ", "fr", "s2", 4),
    (5, "word", "en", None, 4),
    (6, " ".join(WORDS), "en", "s1", 40000),
    (7, " ".join(WORDS[:5999]), "en", "s2", 40000),
    (8, "you stupid worthless idiot " * 20, "en", "s1", 500),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("node", "size", "block", "grp", "row", "h", "start", "kind", "score", "label", "ids", "bucket", "rank", "_row", "key")


def extra(*without):
    """More columns, named as the operators name their own."""
    return {c: F.lit(1) for c in EXTRA if c not in without}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra()).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_licenses(docs, none):
    got = {(r["doc_id"], r["license"]): r["units"] for r in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "GPL-3.0"): 1}
    assert licenses.scan_licenses(none).count() == 0


def test_token_files(spark, docs, none):
    path = scratch_path(spark, "t")
    token_files.write_token_files(docs, path, tokenizer_path())
    segments = token_files.read_token_files(spark, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.document_digests(segments).collect())
    assert [g[1] for g in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got[:-1], got[1:], strict=True)) and got[3][2] == got[4][2] == 1
    wanted = spark.createDataFrame([(6, 0), (6, got[7][2] - 1), (6, 10**9), (2, 0)], "doc_id long, place long")
    found = {(r["doc_id"], r["place"]): r["token"] for r in token_files.tokens_at(segments, wanted).collect()}
    assert set(found) == {(6, 0), (6, got[7][2] - 1), (2, 0)} and found[2, 0] == found[6, got[7][2] - 1] == 1
    path = scratch_path(spark, "t")
    token_files.write_token_files(none, path, tokenizer_path())
    assert token_files.document_digests(token_files.read_token_files(spark, path)).count() == 0


def test_dac_round_trip():
    ids = np.random.default_rng(0).integers(0, 1 << 20, 5000).astype(np.uint32) >> np.random.default_rng(1).integers(0, 20, 5000).astype(np.uint32)
    levels, bitmaps, ranks = token_files.dac_encode(ids)
    assert np.array_equal(token_files.dac_decode(levels, bitmaps), ids)
    assert all(token_files.dac_get(levels, bitmaps, ranks, i) == ids[i] for i in range(0, 5000, 7))


def test_packing(docs, none):
    rows = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    lengths: dict = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in lengths.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces[:-1], pieces[1:], strict=True)) and sum(n for _, n in pieces) <= 64
    assert {r["doc_id"] for r in rows} == {None, *range(1, 9)}
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_pack_group_holds_everything():
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, 900, 400)] + [5000]
    sequences = packing.pack_group(lengths, 1024)
    assert sorted((d, s + i) for q in sequences for d, s, n in q for i in range(n)) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    fill = [sum(n for _, _, n in q) for q in sequences]
    assert max(fill) <= 1024 and all(f == 1024 or f & (f - 1) == 0 for f in fill)


def test_minhash(docs, none):
    got = {(r["doc_id"], r["n_shingles"]): r for r in minhash.minhash_classes(docs).collect()}
    assert got[2, 0]["component_id"] == 2 and got[3, 0]["kept"] and got[5, 1]["component_id"] == 5
    long = [k for k in got if k[0] in (6, 7)]
    assert {got[k]["component_id"] for k in long} == {6}
    assert got[None, 3]["component_id"] is None and not got[None, 3]["kept"]
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "2", "3", "4", "5", "6", "8", "None"]
    assert minhash.minhash_classes(none).count() == 0 and minhash.deduplicate(none).count() == 0


def test_pii(docs, none):
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs)).collect()}
    assert got[1]["n_email"] == 1 and got[1]["spans"] == "email:76:93" and got[2]["spans"] == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1].endswith("Mail [EMAIL] now") and texts[2] is None and texts[6] == ROWS[7][1]
    assert pii.find_pii(none).count() == 0 and pii.redact(none).count() == 0


def test_pii_beside_other_digits(spark):
    rows = [(i, f"call +1 (269) 555-{3000 + i} today") for i in range(40)] + [(i + 100, f"pay 4404{i:02d}8974608795 x") for i in range(90)]
    rows.append((999, "call +1 (269) 555-3296 4524132264652876 and"))
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert "phone:5:22" in got[999]


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(none).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and mixing.mixed_documents(none).count() == 0
    # a null doc_id is a document too, and what the mix takes whole is what it says
    wide = docs.where("doc_id is null or doc_id in (1, 7)").withColumns({"text": F.lit("one two three"), "source": F.lit("s1")})
    assert sorted(str(r["doc_id"]) for r in mixing.mixed_documents(wide).collect()) == ["1", "1", "7", "None"]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (8, 1), (6, 0), (7, None), (None, 1), (99, 1), (8, 0)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    scores = {(r["doc_id"]): r["score"] for r in toxicity.score(docs, net).collect()}
    assert len(scores) == 9 and all(0 <= s <= 1 for s in scores.values()) and scores[2] == scores[3] == net.share
    assert toxicity.drop_toxic(docs, net).columns == docs.columns
    assert toxicity.score(none, net).count() == 0
    blank = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.0} or blank.share == 0


def test_toxicity_meets_a_lone_word_of_one_letter(spark):
    # the batches after the first bring one new word each
    net = toxicity.Net.new(1)
    rows = [(i, "some words that are known") for i in range(256)] + [(i, "some words") for i in range(256, 511)] + [(511, "x"), (512, "x 7")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), net).collect()
    assert len(got) == 513 and all(0 <= r["score"] <= 1 for r in got)
    _, together, _ = toxicity.features([b"x", b"known"])
    assert toxicity.features([b"x"])[1].tolist() == together[:1].tolist()
    labels = spark.createDataFrame([(i, i % 2) for i in range(513)], "doc_id long, toxic int")
    assert toxicity.fit(spark.createDataFrame(rows[-3:], "doc_id long, text string"), labels).share > 0


def test_context_mixing(docs, none):
    got = context_mixing.score_documents(docs).collect()
    assert len(got) == len(ROWS) and all(r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert context_mixing.score_documents(none).count() == 0
    assert context_mixing.score_documents(docs.select("doc_id", "text").where("doc_id = 5")).count() == 1


def test_byte_tables_sum_all_tasks(spark, monkeypatch):
    """Also where tasks are more than a plan made before the run says."""
    monkeypatch.setattr(context_mixing, "FAN_IN", 2)
    words = [(f"w{i % 7}x{i}".encode(), 1 + i % 3, i % 2) for i in range(60)]
    rows = spark.createDataFrame(words, "word binary, other long, mixers long")
    one, many = rows.coalesce(1), rows.repartition(9)
    monkeypatch.setattr(type(many), "rdd", property(lambda _: SimpleNamespace(getNumPartitions=lambda: 1)))
    assert context_mixing._byte_tables(many) == context_mixing._byte_tables(one)


VECTORS = [(i, [float(np.sin(i * 3.1 + j)) for j in range(8)], i % 2) for i in range(40)]
VECTORS += [(100, VECTORS[0][1], 0), (101, [2 * x for x in VECTORS[0][1]], 0), (102, None, 0), (103, [0.0] * 8, 0), (104, [float("nan")] * 8, 0), (105, VECTORS[0][1], None), (106, [1.0, None] * 4, 1), (None, VECTORS[0][1], 0), (0, VECTORS[0][1], 0), (107, [], 1), (108, [1.0, 2.0], 1)]


def test_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int").withColumns(extra("label")).repartition(3)
    got = {(r["vec_id"]): r for r in embedding_dedup.embedding_classes(v).collect()}
    assert len(got) == 50 and got[100]["component_id"] == 0 == got[101]["component_id"] and got[101]["n_links"] >= 3
    assert all(got[i]["n_links"] == 0 for i in (102, 103, 104, 105, 106, 107, 108, None))
    found = prefix_forest.search(v, F.col("vec_id") % 20 == 0, k=5).collect()
    best = {r["query_id"]: (r["vec_id"], r["score"]) for r in found if r["rank"] == 1}
    assert best[100] == (0, 0.0) and 105 not in {r["vec_id"] for r in found if r["query_id"] == 105} and not {102, 103, 104, 106} & {r["vec_id"] for r in found}
    empty = v.where("vec_id < 0")
    assert embedding_dedup.embedding_classes(empty).count() == 0 and prefix_forest.search(empty, F.lit(True)).count() == 0


def test_pipeline(spark, tmp_path):
    """All stages over documents with nulls, repeated rows and ids, blanks and extra columns."""
    spark.createDataFrame(ROWS, SCHEMA).withColumns(extra()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (6, 0, 0), (8, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, left = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names
        left.append(docs.count())
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert n > 0 or 8 not in ids and ids.count(1) == 2
        assert n > 2 or ids.count(None) == 1
    assert left[1] > left[2] == left[3] and ids.count(1) == 1
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert texts[1].endswith("Mail [EMAIL] now")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(texts)
    for i in texts:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == own[0][2] * sum(s == 0 for s, _, _ in own)


def test_near_duplicates_stage_links_at_080(spark):
    """A pair of Jaccard 0.82: the stage keeps one, the query at 0.85 keeps both."""
    words = [f"v{i}" for i in range(404)]
    other = list(words)
    for at in range(10, 90, 10):
        other[at] = "x"
    pair = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, pair, "").collect()] == [1]
    assert [r["component_id"] for r in minhash.minhash_classes(pair).orderBy("doc_id").collect()] == [1, 2]
    assert (minhash.band_rows(85), minhash.band_rows(80)) == (5, 4)


def test_worker_keeps_little_between_stages(spark, monkeypatch):
    """Tables of shingles' powers stay small, and stages before packing drop its encoders: one process runs all."""
    from probity.llm import encoding, shingles

    shingles._powers_of.clear()
    text = b"some words of a text " * 5000
    sets = shingles.shingle_sets([text] * 20 + [text * 30])
    assert len({x.tobytes() for x in sets[:20]}) == 1
    assert sum(x.nbytes for x in shingles._powers_of.values()) < 1 << 24
    monkeypatch.setitem(encoding._encoders, "a path", None)
    assert [x for x in minhash._describe(iter([]), 80)] == [] and not encoding._encoders
    corpus_pipeline.redact_personal_data(spark, spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024


def test_match_questions_are_small():
    """A part asks with fewer than seven bytes a context, and little comes back of contexts that no other part holds."""
    from probity.llm.context_mixing import _answer, _ask, shrunk

    r = np.random.default_rng(5)
    parts = [r.integers(0, 3000, 40_000) for _ in range(4)]
    hashes = np.append(r.integers(-(1 << 62), 1 << 62, 3000), 0)
    columns = zip(*((p, shrunk(np.full(100, 400, "<u4")), shrunk(np.zeros(100, "u1")), shrunk(x.astype("<u4")), shrunk(np.zeros(0, "<i8"))) for p, x in enumerate(parts)), strict=True)
    asked = list(_ask(hashes, 1, 64 - 20 - 18)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", *"abce"])])))
    size = lambda batches: sum(len(x or b"") for b in batches for c in "abcde" for x in b.column(c).to_pylist())
    assert size(asked) < 7 * 160_000 and size(_answer(iter(asked))) < 160_000 // 4


def test_code_travels_small():
    """What tasks get of a code is less than half its arrays, and the same code."""
    import pickle

    from probity.llm.context_mixing import Code, Matches, Words

    words = Words.fit(np.zeros((2, 5000)), np.tile(1e6 / np.arange(1, 5001), (2, 1)).astype(int))[1]
    code = words.code
    sent = pickle.dumps(code)
    got: Code = pickle.loads(sent)
    assert 2 * len(sent) < code.node.nbytes + code.begin.nbytes + code.bit.nbytes
    assert all((getattr(got, k) == getattr(code, k)).all() and getattr(got, k).dtype == getattr(code, k).dtype for k in ("begin", "node", "bit"))
    assert len(pickle.dumps(Matches.new(words))) < len(pickle.dumps(Matches.new(words).words))
    empty = pickle.loads(pickle.dumps(Code.of(np.ones(1))))
    assert len(empty.begin) == 2 and not len(empty.node)


def test_finished_jobs_keep_no_shuffle_files(spark, monkeypatch):
    """Once answers are written, the questions' shuffle files go; the last join runs with the session's own setting, and again."""
    import time

    def held() -> dict[str, int]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    seen, write = {}, context_mixing.materialize

    def written(df, name):
        before = set(held())
        out = write(df, name)
        for _ in range(100):  # executors delete files in the background
            if not set(held()) - before:
                break
            time.sleep(0.1)
        seen[name] = set(held()) - before
        return out

    monkeypatch.setattr(context_mixing, "materialize", written)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"a b c d e f{i % 7} g h") for i in range(50)], "doc_id long, text string")
    out = context_mixing.score_documents(docs)
    assert {"lm-counts", "lm-answers", "lm-matches"} <= set(seen) and not any(seen.values())
    assert spark.conf.get(name) == was
    assert out.count() == 50 and sorted(out.collect()) == sorted(out.collect())
