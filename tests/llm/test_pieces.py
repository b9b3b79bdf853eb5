"""Encoding and decoding against the library that the model belongs to."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from probity.llm import piece_encoding
from probity.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=Q.piece_path())


def same(own, library, texts):
    ids, offsets = own.encode(texts)
    back = own.decode(ids, offsets)
    for i, text in enumerate(texts):
        mine, want = ids[offsets[i] : offsets[i + 1]].tolist(), library.encode(text)
        assert mine == want and back[i] == library.decode(want)


def test_all_documents(spark, library):
    found = {r["doc_id"]: r for r in Q.op13_sentencepiece(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (found[r["doc_id"]]["n_tokens"], found[r["doc_id"]]["ids_sha256"], found[r["doc_id"]]["decoded_sha256"]) == want


def test_merge_order_is_that_of_single_merges(library):
    own, r = piece_encoding.PieceModel(Q.piece_path()), random.Random(7)
    same(own, library, ["", " ", "  a ", "▁▁x", "a\x00b\r\n\t", "<s></s><0x41><unk>", "日本語 😀 é́ � ﻿", "a" * 1200, "ab" * 999, "▁"])
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for letters in ("ab", "aes tion", " \n▁aà", "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x20, 0x3000)], pieces):
        for _ in range(6):
            same(own, library, ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(100)])
    same(own, library, ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6000)), "".join(r.choices(pieces, k=2000)).replace(" ", "")])


def test_decoding_of_any_ids(library):
    own, r = piece_encoding.PieceModel(Q.piece_path()), random.Random(8)
    lists = [[1, 5, 300], [240, 300], [0, 1, 2, 500], [29871, 29871, 500], [13, 29871], []] + [[r.randrange(32000) for _ in range(9)] for _ in range(200)] + [[r.randrange(3, 259) for _ in range(9)] for _ in range(50)]
    offsets = np.cumsum([0, *map(len, lists)])
    assert own.decode(np.array(sum(lists, [])), offsets) == [library.decode(x) for x in lists]


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(piece_encoding, "SLICE", 1 << 10)
    long = "word " * 6000
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, long, "z")], "doc_id long, text string, ids string").repartition(2)
    rows = piece_encoding.encode(docs, Q.piece_path())
    more = rows.unionByName(spark.createDataFrame([(5, None)], "doc_id long, ids array<int>"))
    found = [(r["doc_id"], r["text"]) for r in piece_encoding.decode(more, Q.piece_path()).collect()]
    assert sorted(found, key=str) == sorted([(1, ""), (None, "a b"), (2, ""), (2, ""), (3, long), (5, "")], key=str)
    assert piece_encoding.digest(piece_encoding.decode(piece_encoding.encode(docs.where("1 = 0"), Q.piece_path()), Q.piece_path())).count() == 0
