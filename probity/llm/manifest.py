"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups.

Bitmap ranks instead of a sort give leaves their places. A group's ids are a bitmap of
64-bit words; only words that hold an id exist. Tasks merge their words by OR, and a
directory holds the rows before each word. A leaf's place is its word's entry plus the
popcount of the bits below its own. Words in which an id is repeated are found by
comparing rows with popcounts; their rows alone are counted by (id, digest) and placed
by running counts, so even an id with a third of all rows is never in one task.

Trees are folded in slot arrays of 1024 neighbours, keyed by group and chunk: ten
levels at once. Two neighbours become H of both, a last one alone H of itself, until
one node remains in a group. Proofs come down the same arrays: each chunk gets the path
above it once, and leaves add the path inside the chunk. H is SHA-256 as lower-case hex
of the concatenated inputs, digests as hex text.

Edge cases. Null ids come first in their group, the null group before others. Rows
of one id are ordered by their digest; equal rows are leaves of their own. Null fields
are written `-`, so they differ from empty ones. An empty table gives no row. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.shared import materialize

CHUNK_LEVELS = 10
BITS = 6  # of an id inside its word


def sha(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` if null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running_totals(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """rows with the sum of amount over all rows before in the given total order. Rows are
    dealt into ranges and written once; the driver holds nothing, one task a row for each range."""
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_offset"))
    total = F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, total).drop("_range", "_offset")


def _shifted(ones: int, number: Column) -> Column:
    """The bits of ones, moved up to that of an id in its word."""
    return F.call_function("shiftleft", F.lit(ones).cast("long"), number.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))


def directory(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaves (grp, id, ...): the words (grp, word, bits, rows, before, number, n) and the
    groups (grp, number, n). before counts the group's rows in earlier words; number is the
    group's place among groups, n its rows."""
    words = leaves.groupBy("grp", F.shiftright("id", BITS).alias("word")).agg(F.bit_or(_shifted(1, F.col("id"))).alias("bits"), F.count("*").alias("rows"))
    words = materialize(running_totals(words, ["grp", "word"], "rows", "upto"), "words")
    groups = words.groupBy("grp").agg(F.min("upto").alias("start"), F.sum("rows").alias("n")).withColumn("one", F.lit(1).cast("long"))
    groups = materialize(running_totals(groups, ["grp"], "one", "number").drop("one"), "groups")
    own = groups.withColumnRenamed("grp", "_grp")
    words = words.join(own, words["grp"].eqNullSafe(own["_grp"])).withColumn("before", F.col("upto") - F.col("start"))
    return words.select("grp", "word", "bits", "rows", "before", "number", "n"), groups.select("grp", "number", "n")


def place(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf, ...) with number, n and pos, the leaf's place in its group."""
    names = [c for c in leaves.columns if c not in ("grp", "id", "leaf")]
    simple = F.col("rows") == F.coalesce(F.bit_count("bits"), F.lit(0))
    keyed = words.select(F.col("grp").alias("_grp"), F.col("word").alias("_word"), "bits", "before", "number", "n", simple.alias("simple"))
    at = (F.col("grp").eqNullSafe(F.col("_grp"))) & (F.shiftright("id", BITS).eqNullSafe(F.col("_word")))
    met = leaves.join(keyed, at)
    below = F.bitwise_not(_shifted(-1, F.col("id")))
    rank = (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below))).alias("pos")
    placed = met.where("simple").select("number", "n", rank, "id", "leaf", *names)
    if keyed.where("not simple").isEmpty():
        return placed
    same = met.where("not simple").groupBy("number", "n", "before", "_word", "id", "leaf", *names).agg(F.count("*").alias("copies"))
    counted = materialize(running_totals(same, ["number", "_word", "id", "leaf"], "copies", "upto"), "repeated")
    first = counted.groupBy("number", F.col("_word").alias("w")).agg(F.min("upto").alias("first")).withColumnRenamed("number", "g")
    counted = counted.join(first, (F.col("number") == F.col("g")) & F.col("_word").eqNullSafe(F.col("w")))
    copy = F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy")
    counted = counted.select("number", "n", "before", "upto", "first", "id", "leaf", *names, copy)
    return placed.unionByName(counted.select("number", "n", (F.col("before") + F.col("upto") - F.col("first") + F.col("copy")).alias("pos"), "id", "leaf", *names))


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _levels(hashes: Column, steps: Column) -> Column:
    """The levels of a slot array from its leaves up, `steps` of them beside the first."""

    def above(below: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: sha(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))))

    # the accumulator's last level is bound once for each step
    return F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(CHUNK_LEVELS)), lambda k: k <= steps), F.array(hashes), lambda acc, _: F.array_append(acc, _let(F.element_at(acc, -1), above)))


@dataclass
class Tree:
    """Slot arrays of each stage of ten levels, and the roots (number, hash)."""

    stages: list[DataFrame]
    roots: DataFrame


def build(nodes: DataFrame, largest: int) -> Tree:
    """Trees over nodes (number, n, pos, leaf, ...); largest is the greatest n."""
    stages: list[DataFrame] = []
    while True:
        level = CHUNK_LEVELS * len(stages)
        names = [c for c in nodes.columns if c not in ("number", "n", "pos")]
        chunk = F.shiftright("pos", CHUNK_LEVELS).alias("chunk")
        slots = F.array_sort(F.collect_list(F.struct(F.col("pos").bitwiseAND(F.lit((1 << CHUNK_LEVELS) - 1)).cast("int").alias("slot"), *names)))
        steps = F.greatest(F.least(_height(F.col("n")) - level, F.lit(CHUNK_LEVELS)), F.lit(0)).alias("steps")
        stage = nodes.groupBy("number", "n", chunk).agg(slots.alias("slots")).select("number", "n", "chunk", steps, "slots")
        stages.append(materialize(stage, f"slots-{len(stages)}"))
        top = F.get(F.element_at(_levels(F.col("slots.leaf"), F.col("steps")), -1), F.lit(0))
        nodes = stages[-1].select("number", "n", F.col("chunk").alias("pos"), top.alias("leaf"))
        if largest <= 1 << (level + CHUNK_LEVELS):
            return Tree(stages, nodes.select("number", F.col("leaf").alias("hash")))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves of a tree with their columns, pos, and path: for each level from the
    bottom up (left, hash), the sibling and whether it stands left; hash is null where there
    is none. above (number, path, ...) is the path from each group's root on, and more."""
    extra = [c for c in above.columns if c not in ("number", "path")]
    upper = above.withColumn("pos", F.lit(0).cast("long"))
    for k, stage in reversed(list(enumerate(tree.stages))):
        here = upper.select("number", F.col("pos").alias("chunk"), F.col("path").alias("upper"), *extra)
        fields = [f for f in stage.schema["slots"].dataType.elementType.names if f != "slot"]

        def local(levels: Column, slot: Column) -> Column:
            within = F.filter(F.sequence(F.lit(0), F.lit(CHUNK_LEVELS - 1)), lambda i: i < F.col("steps"))
            sibling = lambda i: F.get(F.get(levels, i), F.call_function("shiftright", slot, i).bitwiseXOR(F.lit(1)))
            return F.transform(within, lambda i: F.struct((F.getbit(slot, i) == 1).alias("left"), sibling(i).alias("hash")))

        def proven(levels: Column) -> Column:
            return F.transform("slots", lambda x: F.struct(x["slot"].alias("slot"), *[x[f].alias(f) for f in fields], F.concat(local(levels, x["slot"]), "upper").alias("path")))

        rows = stage.join(here, ["number", "chunk"]).select("number", "chunk", *extra, F.inline(_let(_levels(F.col("slots.leaf"), F.col("steps")), proven)))
        upper = rows.select("number", (F.shiftleft("chunk", CHUNK_LEVELS) + F.col("slot")).alias("pos"), *fields, "path", *extra)
    return upper


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    step = lambda acc, x: F.when(x["hash"].isNull(), sha(acc)).when(x["left"], sha(x["hash"], acc)).otherwise(sha(acc, x["hash"]))
    return F.aggregate(path, leaf, step)


def prove(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf, and others) with subroot, root and path; see paths()."""
    leaves = materialize(leaves, "leaves")
    words, groups = directory(leaves)
    words = materialize(words, "directory")
    largest, count = groups.agg(F.max("n"), F.count("*")).first()
    trees = build(place(leaves, words), largest or 0)
    subroots = materialize(trees.roots, "subroots")
    over = build(subroots.select(F.lit(0).cast("long").alias("number"), F.lit(count).cast("long").alias("n"), F.col("number").alias("pos"), F.col("hash").alias("leaf")), count)
    none = F.array().cast("array<struct<left:boolean,hash:string>>").alias("path")
    above = paths(over, over.roots.select("number", none, F.col("hash").alias("root")))
    return paths(trees, above.select(F.col("pos").alias("number"), "path", F.col("leaf").alias("subroot"), "root"))


def document_leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """(grp, id, leaf, tampered) of documents: a leaf over doc_id, source, lang, n_chars and
    text for each row in the group of its lang. Where `every` divides the hash of
    doc_id, tampered is the leaf of a row with n_chars greater by one, else it is the leaf."""
    leaf = lambda n: sha(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    own = leaf(F.col("n_chars"))
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), own.alias("leaf"), F.when(chosen, leaf(F.col("n_chars") + 1)).alias("tampered"))


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    proven = prove(document_leaves(docs))
    folded = proven.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.concat_ws("", F.col("path.hash")), 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, with sorted lists for trees."""
    text = lambda c: f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')"
    leaf = lambda n: f"sha256(concat({', '.join(text(c) for c in ('doc_id', 'source', 'lang', n, 'text'))}))"
    above = "list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(concat(nodes[2 * i + 1], nodes[2 * i + 2])))"
    sibling = "CASE WHEN p % 2 = 1 THEN concat('<', nodes[p]) WHEN p + 2 <= len(nodes) THEN concat('>', nodes[p + 2]) ELSE '=' END"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
leaves AS (
  SELECT doc_id, {leaf("n_chars")} AS leaf, {leaf("(n_chars + 1)")} AS changed, n_chars,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
levels AS (
  SELECT grp, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY grp
  UNION ALL SELECT grp, level + 1, {above} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT grp, nodes[1] AS subroot FROM levels WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY grp) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {above} FROM top WHERE len(nodes) > 1),
lower_siblings AS (
  SELECT doc_id, leaf, grp, level, {sibling} AS s FROM (SELECT doc_id, leaf, grp, level, nodes, pos >> level AS p FROM placed JOIN levels USING (grp) WHERE len(nodes) > 1)),
upper_siblings AS (
  SELECT grp, list(s ORDER BY level) AS s FROM (SELECT grp, level, {sibling} AS s FROM (SELECT grp, level, nodes, grp >> level AS p FROM subroots, top WHERE len(nodes) > 1)) GROUP BY grp),
paths AS (SELECT doc_id, leaf, list(s ORDER BY level) AS s FROM lower_siblings GROUP BY ALL),
proofs AS (
  SELECT p.*, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, list_concat(coalesce(l.s, []), coalesce(u.s, [])) AS s
  FROM placed p JOIN subroots USING (grp) LEFT JOIN paths l ON l.doc_id IS NOT DISTINCT FROM p.doc_id AND l.leaf = p.leaf LEFT JOIN upper_siblings u ON u.grp = p.grp),
folded AS (
  SELECT *, list_reduce(list_prepend(CASE WHEN h % 7 = 0 AND n_chars IS NOT NULL THEN changed ELSE leaf END, s),
    lambda a, b: sha256(CASE WHEN b[1] = '<' THEN concat(b[2:], a) WHEN b[1] = '>' THEN concat(a, b[2:]) ELSE a END)) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded"""
