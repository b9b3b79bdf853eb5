"""Spelling variants against all edits of all words."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from probity.llm import queries as Q
from probity.llm import spelling

SMALL = "/root/testdata/sf0.001"


def near_words(n):
    letters = set("".join(n))
    out = {}
    for w in n:
        cuts = range(len(w) + 1)
        edits = {w[:i] + w[i + 1 :] for i in cuts} | {w[:i] + c + w[i + k :] for i in cuts for c in letters for k in (0, 1)}
        out[w] = [x for x in edits if x != w and x in n]
    return out


def expected(docs):
    counts = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = near_words(n)
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = got(Q.op12_spelling(spark, SMALL))
    assert found == expected(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    cursor = con.execute(spelling.oracle_sql())
    assert [d[0] for d in cursor.description] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r[0]: r[1:] for r in cursor.fetchall()} == found


def test_edges_and_chains(spark):
    chain = ["abcdef"] * 5 + ["abcdeg"] * 40 + ["abcdhg"] * 250 + ["aaaaaaa"] * 6 + ["aaaaaaaa"] * 30
    docs = [(None, "Éxample éxample ÀÉÎÕÜß÷× " * 9), (1, None), (2, ""), (2, ""), (3, " ".join(chain)), (3, "ABCDEF"), (4, "abcdeé " * 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS signature").repartition(3)
    found = got(spelling.spelling_groups(df))
    assert found == expected(docs) and found["abcdef"][:2] == ("abcdeg", "abcdhg") and found["aaaaaaa"][0] == "aaaaaaaa"
    assert spelling.spelling_groups(df.where("1 = 0")).count() == 0


def test_no_near_pair_is_lost(spark):
    """Random words of three letters, so that edits, repeats and anagrams abound."""
    r = np.random.default_rng(3)
    words = sorted({"".join(r.choice(list("abé"), r.integers(6, 10))) for _ in range(1500)})
    near = near_words(dict.fromkeys(words, 1))
    pairs = {(x["a"], x["b"]) for x in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}
    assert pairs == {(a, b) for a in words for b in near[a] if a < b}
