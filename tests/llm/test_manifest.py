"""The Merkle manifest against trees of plain lists."""

import hashlib
import zlib
from collections import Counter

import pytest

from probity.llm import manifest
from probity.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc, source, lang, n, text = row
    return digest(*map(written, (doc, source, lang, None if n is None else n + more, text)))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    for nodes in levels[:-1]:
        yield at % 2 == 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else None
        at //= 2


def expected(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[2], []).append(r)
    trees = [levels_of([leaf_of(r) for r in g]) for g in groups.values()]
    over = levels_of([t[-1][0] for t in trees])
    out = Counter()
    for i, (g, tree) in enumerate(zip(groups.values(), trees, strict=True)):
        for at, r in enumerate(g):
            path = [*siblings(tree, at), *siblings(over, i)]
            node = leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, h in path:
                node = digest(node) if h is None else digest(h, node) if left else digest(node, h)
            out[r[0], leaf_of(r), tree[-1][0], over[-1][0], digest(*[h for _, h in path if h]), node, node == over[-1][0]] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = got(Q.op11_manifest(spark, SMALL))
    assert found == expected(rows) and {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1025])
def test_sizes_of_trees(spark, n):
    rows = [(i * 97 - 300, "s", "en", i, f"t{i}") for i in range(n)]
    assert got(manifest.dataset_manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_repeats_nulls_and_far_ids(spark):
    rows = [(i * 997 - 5000, "s", (None, "é", "z")[i % 3], None if i % 4 == 0 else i, f"t{i}") for i in range(200)]
    rows += [(None, None, "z", 1, str(i % 7)) for i in range(50)] + [(7, "a", "z", 5, str(i % 9)) for i in range(60)]
    rows += [(8, "a", "y", 5, None), (8, "a", "y", 5, "")] + [(9, "b", "x", 6, "")] * 5 + [(i, "s", "z", 1, "m") for i in (1 << 62, -(1 << 63), (1 << 63) - 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("grp", "id", "leaf", "pos", "number", "slot", "word"):
        docs = docs.withColumn(c, docs["n_chars"] * 0)
    assert got(manifest.dataset_manifest(docs)) == expected(rows)
    assert manifest.dataset_manifest(docs.where("1 = 0")).count() == 0
