"""Operators against brute force on the small tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])}


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def test_token_queries_match_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    at = 0
    got = {r["doc_id"]: r for r in Q.op2_token_files(spark, SMALL).collect()}
    for i in texts:
        own = np.array([*ids[i], 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    pieces = Q.op4_packing(spark, SMALL).collect()
    for r in pieces:
        own = np.array([*ids[r["doc_id"]], 2], "<u4")
        assert len(own) == r["doc_tokens"] and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in pieces) == sum(len(x) + 1 for x in ids.values())


def test_minhash_links(spark, texts):
    keys, sets = list(texts), [shingles(x) for x in texts.values()]
    root = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r for r in Q.op7_minhash(spark, SMALL).collect()}
    for i, k in enumerate(keys):
        assert (got[k]["component_id"], got[k]["n_shingles"]) == (keys[root[i]], len(sets[i]))


def test_near_copies_are_found(spark):
    """Chains of near copies of one text, more than a bucket's subset holds."""
    from probity.llm.minhash import minhash_classes

    r = np.random.default_rng(5)
    base = [f"t{x}" for x in r.integers(0, 5000, 300)]
    rows = []
    for i in range(200):
        own = list(base)
        for p in r.integers(0, 300, i % 5):
            own[p] = f"n{i}"
        rows.append((i, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    got = {x["doc_id"]: x["component_id"] for x in minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(200):
        if any(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in range(200) if j % 5 == 0 and j != i):
            assert got[i] == 0


def components(sets, percent):
    """Smallest place of each set's component."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def filled_templates(pairs):
    """Texts of a template: the two of a pair have a Jaccard of 0.86, others 0.82."""
    r = np.random.default_rng(11)
    base = [f"t{x}" for x in r.integers(0, 50000, 1604)]
    texts = []
    for p in range(pairs):
        places = 4 + 5 * r.permutation(319)[:28]
        for own in (places[:16], places[12:]):
            text = list(base)
            for at in own:
                text[at] = f"p{p}x{at}"
            texts.append(" ".join(text))
    return texts


def test_links_in_buckets_of_filled_templates(spark):
    """All of a bucket's pairs are compared, not the likeliest partners alone."""
    from probity.llm.minhash import minhash_classes

    texts = filled_templates(100)
    want = components([shingles(t) for t in texts], 85)
    assert len(set(want)) > 50
    got = {x["doc_id"]: x["component_id"] for x in minhash_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_language_model_base(spark, texts):
    tokens = {i: [*x.encode().lower().split(), b""] for i, x in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in Q.op6_context_mixing(spark, SMALL).collect():
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)


def test_nearest_neighbours(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in Q.op5_prefix_forest(spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        true = set(ids[np.lexsort((ids, d))[:10]])
        hits += len(true & {v for _, v, _ in got[ids[i]]})
        assert all(abs(s - d[list(ids).index(v)]) < 1e-9 for _, v, s in got[ids[i]])
    assert hits >= 0.9 * 10 * len(got)


def test_ties_among_many_equal_vectors():
    """More equal vectors than any fixed cut: those of the smallest ids are given."""
    from probity.llm.prefix_forest import Forest

    r = np.random.default_rng(9)
    x = r.standard_normal((3000, 16))
    x[r.permutation(3000)[:500]] = x[0]
    ids = np.arange(3000)
    query, got, score = Forest(ids, x, 42).nearest(np.array([5000]), x[:1] + 0.01, 10, 0.6)
    assert got.tolist() == np.flatnonzero((x == x[0]).all(1))[:10].tolist()
    assert len(set(score)) == 1 and (query == 5000).all()


def test_embedding_links(spark):
    from probity.llm.embedding_dedup import embedding_classes

    r = np.random.default_rng(7)
    base = r.standard_normal((300, 32))
    near = base[:60].repeat(3, axis=0) + 0.02 * r.standard_normal((180, 32))
    x = np.concatenate([base, near, base[:5]])
    label = np.concatenate([np.arange(300) % 3, (np.arange(60) % 3).repeat(3), np.arange(5) % 3])
    frame = spark.createDataFrame([(int(i), [float(y) for y in v], int(l)) for i, (v, l) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    for row in embedding_classes(frame).collect():
        assert row["n_links"] == links[row["vec_id"]].sum()
        assert row["component_id"] == min([row["vec_id"], *np.flatnonzero(links[row["vec_id"]])])


def test_windows_widen_across_borders(spark, monkeypatch):
    """Windows of four neighbours: labels with many near vectors spread over dozens of them."""
    from probity.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "WINDOW", 4)
    monkeypatch.setattr(embedding_dedup, "bits_and_passes", lambda classes, threshold: (12, 24))
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((60, 16)), r.standard_normal(16) + 0.05 * r.standard_normal((120, 16))])
    label = np.arange(180) % 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    frame = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = sorted(embedding_dedup.embedding_classes(frame).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in got] == links.sum(1).tolist() and max(links.sum(1)) > 40


def test_embedding_links_in_a_dense_cone(spark):
    """Vectors of one label with a median cosine of about 0.95 to each other: no pair's link is lost."""
    from probity.llm.embedding_dedup import embedding_classes

    r = np.random.default_rng(3)
    base = np.eye(64)[0] + 0.23 * r.standard_normal((3000, 64)) / 8
    move = r.standard_normal((300, 64))
    x = np.concatenate([base, base[:300] + 0.17 * move / np.linalg.norm(move, axis=1, keepdims=True)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert 0.94 < np.median(u @ u.T) < 0.96 and links.sum() >= 600
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_classes(frame).collect()
    want = np.arange(len(x))
    while (lower := np.where(links, want[None, :], len(x)).min(1)).min() < len(x) and (lower < want).any():
        want = np.minimum(want, lower)
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["vec_id"])] == want.tolist()
    assert [r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])] == links.sum(1).tolist()


def test_mix_meets_targets(spark):
    sums: dict = {}
    for r in Q.op9_mixing(spark, SMALL).collect():
        own = sums.setdefault((r["target"], r["source_size"]), [0, 0])
        own[0] += r["taken"]
        own[1] += r["size"]
        assert r["taken"] <= 3 * r["size"]
    for (target, size), (taken, words) in sums.items():
        assert abs(taken - target * words / size) <= words / size


def test_licence_query_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(Q.ORACLE_SQL["op1_licenses"]).fetchall(), key=str)
    got = sorted(((r["doc_id"], r["license"], r["units"], r["dice"]) for r in Q.op1_licenses(spark, SMALL).collect()), key=str)
    assert got == want and got


def test_toxicity_learns(spark):
    """Held-out texts, of which toxic ones hold one of forty words somewhere."""
    from probity.llm import toxicity

    r = np.random.default_rng(1)
    plain, bad = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("no", "si", "ka") for c in ("", "n", "ra")], [f"grub{x}lok" for x in range(40)]
    rows, labels = [], []
    for i in range(900):
        words = list(r.choice(plain, int(r.integers(5, 300))))
        if i % 4 == 0:
            words[int(r.integers(0, len(words)))] = bad[int(r.integers(0, 40))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, learn=toxicity.fold(F.col("doc_id")) != 0, max_toxic=400, max_clean=600)
    held = toxicity.score(docs.where(toxicity.fold(F.col("doc_id")) == 0), net).collect()
    toxic, clean = [x["score"] for x in held if x["doc_id"] % 4 == 0], [x["score"] for x in held if x["doc_id"] % 4]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.8 and np.mean([s >= 0.5 for s in clean]) < 0.05
    # dropped texts are those whose score says so; texts without words stay
    more = docs.union(spark.createDataFrame([(1000, " "), (1001, None)], "doc_id long, text string"))
    stay = {x["doc_id"] for x in toxicity.drop_toxic(more, net).collect()}
    assert stay == {x["doc_id"] for x in toxicity.score(docs, net).collect() if x["score"] < 0.5} | {1000, 1001}


def test_toxicity_scores_step_by_step():
    """Scores of whole texts against the network's equations, word by word and window by window."""
    from probity.llm import toxicity as t

    net = t.Net.new(3)
    p, sigmoid = net.p, lambda x: 1 / (1 + np.exp(-x))
    words = [b"w%d" % (i * i % 83) for i in range(100)]
    x, _ = net.inputs(words)
    best = -np.inf
    for s in t.starts(100):
        states = []
        for d in "fb":
            h, out = np.zeros(t.HIDDEN), {}
            for at in range(s, s + 32) if d == "f" else range(s + 31, s - 1, -1):
                g, u = x[at] @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
                z, r = sigmoid(g[:8] + u[:8]), sigmoid(g[8:16] + u[8:16])
                h = (1 - z) * np.tanh(g[16:] + r * u[16:]) + z * h
                out[at] = h
            states.append(out)
        both = np.array([np.concatenate([states[0][at], states[1][at]]) for at in range(s, s + 32)])
        weight = np.exp(np.tanh(both @ p["att"]) @ p["ask"])
        best = max(best, float((weight / weight.sum()) @ both @ p["out"] + p["bias"][0]))
    assert t.starts(100)[-1] == 68
    assert t.Scorer(net).score([b" ".join(words)])[0] == pytest.approx(sigmoid(best), abs=1e-5)


def test_encoder_is_the_tokenizer():
    """Random strings of special tokens, marks that combine, letters of several scripts and blanks."""
    from tokenizers import Tokenizer

    from probity.llm.encoding import WordEncoder

    whole, own, r = Tokenizer.from_file(Q.tokenizer_path()), WordEncoder(Q.tokenizer_path()), np.random.default_rng(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\u0130", "\u00df", "e\u0301", "\u0958", "a", "B", "hello", ".", ";", "!", "'s", "12", " ", "\u3000", "\u0085", "\x1c", "\n", "\u65e5", "-"]
    for _ in range(3000):
        text = "".join(r.choice(parts, int(r.integers(1, 9))))
        assert own.encode([text.encode()], 2)[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_links_at_the_threshold(spark):
    """Families of texts a few words apart, whose Jaccards lie about the threshold: no component is wrong."""
    from probity.llm.minhash import common_counts, minhash_classes

    r, texts = np.random.default_rng(9), []
    for f in range(12):
        base = [f"f{f}w{x}" for x in r.integers(0, 4000, 220)]
        for i in range(60):
            own = list(base)
            for at in r.integers(0, 220, int(r.integers(1, 4))):
                own[at] = f"n{f}x{i}x{at}"
            texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    want = components(sets, 85)
    got = {x["doc_id"]: x["component_id"] for x in minhash_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    some = [np.unique(r.integers(0, 50_000, n)).astype(np.uint64) for n in (1, 20_000, 30_000, 5, 0)]
    assert common_counts(some[:2], some[1:]).tolist() == [[len(np.intersect1d(a, b)) for b in some[1:]] for a in some[:2]]


def test_near_copies_are_not_all_paired(spark, monkeypatch):
    """Near copies with edits of their own: components as by brute force, and few of their pairs need their texts."""
    from probity.llm import minhash

    made, write = {}, minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    r = np.random.default_rng(21)
    base, texts = [f"t{x}" for x in r.integers(0, 5000, 200)], []
    for i in range(300):  # the more edits, the earlier the row
        own = list(base)
        for at in r.choice(200, 12 - i // 25, replace=False):
            own[at] = f"n{i}x{at}"
        texts.append(" ".join(own))
    want = components([shingles(t) for t in texts], 80)
    assert 20 < len(set(want)) < 250
    got = {x["doc_id"]: x["component_id"] for x in minhash.minhash_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80).collect()}
    assert [got[i] for i in range(300)] == want
    assert made["minhash-links"].count() > 40 and made["minhash-open"].count() < 600


def test_language_model_is_a_distribution():
    """Probabilities of all symbols sum to one, with and without a match, and of a byte's values in its context."""
    from probity.llm.context_mixing import SLOTS, Matches, Mixer, Words, packed_odds, spell

    r = np.random.default_rng(4)
    other, words = Words.fit(r.integers(0, 200, (3, 400)) * (r.random((3, 400)) < 0.3), r.integers(0, 50, (3, 400)))
    for own in (other, words):
        assert (10.0**own.scores.astype(float)).sum(1) == pytest.approx(np.ones(3), abs=1e-4)
    every = np.arange(400)
    matches = Matches.new(words)
    matches.right[:, 1] = 30
    for run, gate, guess in ((0, 1, 7), (3, 2, 399), (7, 0, 0)):
        full = lambda x: np.full(400, x)
        gain = matches.gain(full(gate), full(run), full(2), full(guess), every)
        p = 10.0 ** (words.scores[gate].astype(float) + gain)
        assert p.sum() == pytest.approx(1, abs=1e-3) and gain[guess] > 0
    table = packed_odds(r.integers(0, 9, SLOTS).astype(float), r.integers(0, 9, SLOTS).astype(float))
    # a word's first byte: each value with the blank behind it and all of what may follow
    first = spell(table, Mixer.new(4), [bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)])
    assert (10**first).sum() < 1


def test_copies_are_likelier(spark):
    """A text that another training text repeats is likelier than one as long that none does, whichever of its copies is asked."""
    from probity.llm.context_mixing import score_documents

    r = np.random.default_rng(6)
    vocabulary = [f"v{x}" for x in range(500)]
    rows = [(i, " ".join(r.choice(vocabulary, 200))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # both copies' partner may be held out: then nothing tells that they are two
    told = [i for i in range(30) if zlib.crc32(str(1000 + i).encode()) % 5 != 1]
    assert np.mean([got[i] for i in told]) > np.mean([got[i] for i in range(30, 200)]) + 0.5


def test_every_position_is_asked_for_matches(spark, monkeypatch):
    """Each word behind four that another training text holds gets a guess: that text's most frequent one."""
    from probity.llm import context_mixing

    made, write = {}, context_mixing.materialize
    monkeypatch.setattr(context_mixing, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    r = np.random.default_rng(8)
    rows = [(i, " ".join(r.choice(list("abcde"), 60))) for i in range(40)]
    context_mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count()
    held, want = {}, []
    for i, text in rows:
        words = [*text.split(), ""]
        for at in range(4, len(words)):
            if zlib.crc32(str(i).encode()) % 5 != 1:
                held.setdefault(tuple(words[at - 4 : at]), {}).setdefault(i, words[at])
    for i, text in rows:
        words, n, right = [*text.split(), ""], 0, 0
        for at in range(4, len(words)):
            others = Counter(w for d, w in held.get(tuple(words[at - 4 : at]), {}).items() if d != i)
            n += bool(others)
            first = others.most_common(1)
            right += bool(others) and words[at] == first[0][0] and list(others.values()).count(first[0][1]) == 1
        want.append((n, right))
    got = []
    for x in made["lm-matches"].collect():
        guess, word = (context_mixing.symbols_of(bytes(x[c])) for c in ("guess", "word"))
        got.append((len(x["run"]), int((guess == word).sum())))
    assert sorted(n for n, _ in got) == sorted(n for n, _ in want if n)
    assert sum(x for _, x in got) >= sum(x for _, x in want) > 0


def water_level(sizes, weights, cap):
    """Targets by bisection over the common level."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, cap * s) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (lo, mid)
    return [min(lo * w, cap * s) for s, w in zip(sizes, weights, strict=True)]


def test_mix_targets(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text").collect()
    sizes = Counter()
    for x in rows:
        sizes[x["source"]] += len((x["text"] or "").encode().split())
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    want = dict(zip(names, water_level([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    source = {x["doc_id"]: x["source"] for x in rows}
    taken = Counter()
    for x in Q.op9_mixing(spark, SMALL).collect():
        own = source[x["doc_id"]]
        assert x["source_size"] == sizes[own] and x["target"] == pytest.approx(want[own], rel=1e-6)
        taken[own] += x["taken"]
    assert all(abs(taken[n] - want[n]) <= 1 for n in names)


def base_spans(text):
    import re

    digits = lambda m: [int(c) for c in m if c.isascii() and c.isdigit()]

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(found)


def test_personal_data_base(spark):
    """Base spans of random strings and of the small table against Python's re."""
    import hashlib

    from probity.llm import pii

    r = np.random.default_rng(8)
    parts = ["a", "b.c", "@", ".", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111", "+1", "+49 ", "(0)", "-", " ", "x@y.z", "10.0.0.1", "\n", "\u00e9", "\U0001f600", "555", "%", "_"]
    texts = ["".join(r.choice(parts, int(r.integers(1, 25)))) for _ in range(3000)]
    texts += [x["text"] or "" for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for x in got:
        spans = base_spans(texts[x["doc_id"]])
        joined = ",".join(f"{name}:{start}:{end}" for start, _, end, name in spans)
        assert x["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (texts[x["doc_id"]], joined)
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[3] == k for s in spans) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(x["spans"].split(","))


@pytest.mark.parametrize("times", [5, 2000])
def test_personal_data_beyond_the_base(spark, times):
    """Phones without a country code and spelt addresses are found, however many there are beside the base's."""
    from probity.llm import pii

    r = np.random.default_rng(10)
    rows = [f"phone +1 269 555 {1000 + i} or mail jo{i}@site.org" for i in range(200)]
    rows += [f"card 4111 1111 1111 {1000 + i}" for i in range(200)]  # most fail the check digit
    rows += [f"phone 269-555-{1000 + int(x)} or mail ann{x} [at] host [dot] net" for x in r.integers(0, 8999, times)]
    got = {x["doc_id"]: x for x in pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    for i in range(400, len(rows)):
        assert got[i]["n_phone"] == got[i]["n_email"] == 0 and "phone:6:18" in got[i]["spans"] and "email:27:" in got[i]["spans"]
