"""Digests, append-only logs with Merkle trees, hash chains, receipts and quotes.

Hashes are SHA-256 as lower-case hex; a leaf is H(0x00 || data), an inner node
H(0x01 || left || right), an odd node goes up unchanged, and an empty tree's root
is H of nothing. Trees are folded in chunks of 1024 neighbours, ten levels at
once, so a log of a billion entries takes three shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CHUNK_LEVELS = 10
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
GENESIS = "0" * 64


def digest(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """Fields by name, without blanks, nulls written out. Numbers other than
    integers should come as text: engines print them differently."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def leaf_hash(data: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(F.lit("01"), left, right)), 256)


def _next_level(hashes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    at = lambda i: F.get(hashes, i)
    return F.transform(pairs, lambda i: F.when(at(2 * i + 1).isNotNull(), node_hash(at(2 * i), at(2 * i + 1))).otherwise(at(2 * i)))


def tree_nodes(leaves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All nodes (by, level, pos, hash) of the trees over leaves (by, pos, hash);
    pos counts from 0 without gaps. The highest level's only node is the root."""
    by = by or []
    out, level, nodes = None, 0, leaves.select(*by, F.col("pos").cast("long").alias("pos"), "hash")
    size = nodes.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        chunk = nodes.groupBy(*by, F.shiftright("pos", CHUNK_LEVELS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("c"))
        first = F.array(F.transform("c", lambda x: x["hash"]))
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK_LEVELS)), first, lambda acc, _: F.array_append(acc, _next_level(F.element_at(acc, -1))))
        flat = chunk.select(*by, "chunk", F.posexplode(levels).alias("l", "hashes")).select(*by, "chunk", "l", F.posexplode("hashes").alias("i", "hash"))
        here = flat.select(*by, (F.col("l") + level).alias("level"), (F.shiftleft("chunk", 10) / F.pow(F.lit(2.0), F.col("l")) + F.col("i")).cast("long").alias("pos"), "hash")
        kept = here.where(F.col("level") < level + CHUNK_LEVELS)
        out = kept if out is None else out.unionByName(kept)
        level += CHUNK_LEVELS
        nodes = here.where(F.col("level") == level).drop("level")
        if size <= 1 << level:
            return out.unionByName(nodes.withColumn("level", F.lit(level)))


def tree_roots(leaves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, root) of each tree; without by, n is 0 and root null where there is no
    leaf. Inner nodes aren't kept: ten levels of a chunk are folded where it is gathered."""
    by = by or []
    level, nodes = 0, leaves.select(*by, F.col("pos").cast("long").alias("pos"), "hash", F.lit(1).cast("long").alias("n"))
    size = nodes.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while level == 0 or size > 1 << level:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
        chunk = nodes.groupBy(*by, F.shiftright("pos", CHUNK_LEVELS).alias("chunk")).agg(hashes.alias("c"), F.sum("n").alias("n"))
        top = F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK_LEVELS)), F.col("c"), lambda acc, _: _next_level(acc))
        nodes = chunk.select(*by, F.col("chunk").alias("pos"), F.get(top, F.lit(0)).alias("hash"), "n")
        level += CHUNK_LEVELS
    return nodes.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.max("hash").alias("root"))


def append_roots(leaves: DataFrame) -> DataFrame:
    """(size, root) after every append: a prefix's full subtrees, one for each bit of
    its size, folded from the smallest to the largest."""
    nodes = tree_nodes(leaves).select("level", F.col("pos").alias("at"), "hash")
    size = leaves.select((F.col("pos") + 1).cast("long").alias("size"))
    levels = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.expr("1") == F.getbit(F.col("size"), i))
    parts = size.select("size", F.explode(levels).alias("level")).withColumn("at", F.expr("shiftright(size, level) - 1"))
    held = parts.join(nodes, ["level", "at"]).groupBy("size").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("p"))
    fold = F.aggregate(F.slice("p", F.lit(2), F.size("p")), F.col("p")[0]["hash"], lambda acc, x: node_hash(x["hash"], acc))
    return held.select("size", fold.alias("root"))


def audit_paths(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, leaf_hash, proof) for wanted positions: siblings from the bottom up."""
    nodes = tree_nodes(leaves)
    top = nodes.agg(F.max("level").alias("top"))
    asked = wanted.select("pos").join(F.broadcast(top), how="cross").select("pos", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    asked = asked.withColumn("sibling", F.expr("shiftright(pos, level) ^ 1L"))
    found = asked.join(nodes.select("level", F.col("pos").alias("sibling"), "hash"), ["level", "sibling"])
    proofs = found.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "hash"))), lambda x: x["hash"]).alias("proof"))
    own = leaves.select("pos", F.col("hash").alias("leaf_hash")).join(wanted.select("pos"), "pos")
    return own.join(proofs, "pos", "left").withColumn("proof", F.coalesce("proof", F.array().cast("array<string>")))


def verify_inclusion(leaf: Column, pos: Column, size: Column, proof: Column, root: Column) -> Column:
    """Whether the proof leads from the leaf at pos of a tree of size to root."""

    def step(acc: Column, p: Column) -> Column:
        fn, sn = acc["fn"], acc["sn"]
        from_left = (fn.bitwiseAND(F.lit(1)) == 1) | (fn == sn)
        zeros = F.bit_count(fn.bitwiseAND(-fn) - 1)
        shift = F.when(from_left & (fn.bitwiseAND(F.lit(1)) == 0) & (fn != 0), zeros).otherwise(F.lit(0)) + 1
        half = lambda x: F.floor(x / F.pow(F.lit(2.0), shift)).cast("long")
        return F.struct(
            half(fn).alias("fn"), half(sn).alias("sn"),
            F.when(from_left, node_hash(p, acc["r"])).otherwise(node_hash(acc["r"], p)).alias("r"),
            (acc["ok"] & (sn != 0)).alias("ok"),
        )

    start = F.struct(pos.cast("long").alias("fn"), (size - 1).cast("long").alias("sn"), leaf.alias("r"), (pos < size).alias("ok"))
    return F.aggregate(proof, start, step, lambda a: a["ok"] & (a["sn"] == 0) & (a["r"] == root))


def chain_breaks(records: DataFrame, chain: str, order: str, own_hash: str, prev_hash: str) -> DataFrame:
    """Per chain: length, ok, and the first place whose prev_hash isn't the hash of the record before."""
    before = F.lag(own_hash).over(Window.partitionBy(chain).orderBy(order))
    broken = F.coalesce(F.col(prev_hash) != F.coalesce(before, F.lit(GENESIS)), F.lit(True))
    marked = records.withColumn("_broken", broken)
    return marked.groupBy(chain).agg(F.count("*").alias("length"), (F.count_if("_broken") == 0).alias("ok"), F.min(F.when(F.col("_broken"), F.col(order))).alias("first_break"))


def issue_chain(records: DataFrame, chain: str, order: str, body_digest: str) -> DataFrame:
    """records with prev, the own hash of the chain's record before, and own, the hash
    of prev and the record's digest. A chain is sequential by nature: one task walks
    through its sorted records and holds a batch of digests and one hash at a time;
    chains are dealt out by key. Bodies stay in the JVM; records should hold digests."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), GENESIS
        for batch in batches:
            before, own = [], []
            for key, body in zip(batch.column(chain).to_pylist(), batch.column(body_digest).to_pylist(), strict=True):
                if key != at:
                    at, last = key, GENESIS
                before.append(last)
                last = hashlib.sha256((last + (body or "")).encode()).hexdigest()
                own.append(last)
            columns = [*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "prev", "own"])

    schema = StructType([*records.schema.fields, StructField("prev", StringType()), StructField("own", StringType())])
    return records.repartition(chain).sortWithinPartitions(chain, order).mapInArrow(link, schema)


def chained_hash(prev: Column, body_digest: Column) -> Column:
    """A record's own hash, as issue_chain() makes it."""
    return digest(F.concat(prev, F.coalesce(body_digest, F.lit(""))))


def verify_chain(records: DataFrame, chain: str, order: str, body_digest: str) -> DataFrame:
    """Per chain of issued records: length, ok, and first_break, the first record that
    doesn't hash to its own or doesn't name the record before."""
    before = F.coalesce(F.lag("own").over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS))
    holds = (F.col("prev") == before) & (F.col("own") == chained_hash(F.col("prev"), F.col(body_digest)))
    marked = records.withColumn("_broken", ~F.coalesce(holds, F.lit(False)))
    return marked.groupBy(chain).agg(F.count("*").alias("length"), (F.count_if("_broken") == 0).alias("ok"), F.min(F.when(F.col("_broken"), F.col(order))).alias("first_break"))


def set_digest(rows: DataFrame, by: str, member: Column) -> DataFrame:
    """(by, members, digest): a digest of each group's multiset of members, whatever
    their order: two sums of hash digits, so groups are summed up before they shuffle."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(member.cast("binary"), 256), at, 12), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy(by).agg(F.count("*").alias("members"), part(1).alias("_a"), part(13).alias("_b"))
    return sums.select(by, "members", F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("digest"))


def released_names(requests: DataFrame, allowed: str, wanted: str, keys: DataFrame, name: str) -> DataFrame:
    """requests with released: of the wanted names (null: all) those that exist, in
    order, and none where allowed is false or null. keys has a row for each party's key,
    so few that they stand in one row."""
    known = keys.agg(F.array_sort(F.collect_set(name)).alias("_known"))
    some = F.when(F.col(wanted).isNull(), F.col("_known")).otherwise(F.array_intersect("_known", F.coalesce(wanted, F.array().cast("array<string>"))))
    granted = F.when(F.coalesce(F.col(allowed), F.lit(False)), some).otherwise(F.array().cast("array<string>"))
    return requests.join(F.broadcast(known), how="cross").withColumn("released", granted).drop("_known")


def manifest_diff(signed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): changed, missing or added files between two manifests (path, sha256)."""
    both = signed.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def check_matrix(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row for each record and check: n, name, ok (null: skipped)."""
    each = [F.struct(F.lit(i + 1).alias("n"), F.lit(name).alias("name"), ok.alias("ok")) for i, (name, ok) in enumerate(checks.items())]
    return rows.select(key, F.inline(F.array(*each)))


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of checks that are false, joined by '; '; skipped ones don't count."""
    return F.concat_ws("; ", *[F.when(~ok, F.lit(name)) for name, ok in checks.items()])


def all_ok(ok: str) -> Column:
    """Aggregate: no check is false."""
    return F.every(F.coalesce(F.col(ok), F.lit(True)))


def first_uses(uses: DataFrame, nonce: str, at: str, tie: str) -> DataFrame:
    """uses with replayed: an earlier row has the nonce."""
    first = uses.groupBy(nonce).agg(F.min(F.struct(at, tie)).alias("_first"))
    return uses.join(first, nonce).withColumn("replayed", (F.col("_first")[at] != F.col(at)) | (F.col("_first")[tie] != F.col(tie))).drop("_first")


def nonce_verdicts(issues: DataFrame, uses: DataFrame, nonce: str, at: str, use_id: str, ttl_ms: int) -> DataFrame:
    """(nonce, use_id, verdict) of uses (nonce, use_id, at) of issued nonces (nonce, at):
    unknown (not issued by then), released or expired (first use, within the time to live
    or later), replayed (any later use; ties by use_id)."""
    first = issues.groupBy(nonce).agg(F.min(at).alias("_issued"))
    known = uses.join(first, nonce, "left").withColumn("_known", F.coalesce(F.col("_issued") <= F.col(at), F.lit(False)))
    consumed = known.where("_known").groupBy(nonce).agg(F.min(F.struct(F.col(at).alias("at"), F.col(use_id).cast("string").alias("id"))).alias("_use"))
    rows = known.join(consumed, nonce, "left")
    own = F.struct(F.col(at).alias("at"), F.col(use_id).cast("string").alias("id"))
    age = F.unix_millis(F.col(at).cast("timestamp")) - F.unix_millis(F.col("_issued").cast("timestamp"))
    verdict = F.when(~F.col("_known"), "unknown").when(F.col("_use") != own, "replayed").when(age > ttl_ms, "expired").otherwise("released")
    return rows.select(nonce, F.col(use_id).cast("string").alias("use_id"), verdict.alias("verdict"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """current with each key's last change put in."""
    names = [c for c in current.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_new")).select(key, *[F.col(f"_new.{n}").alias(n) for n in names])
    return current.join(last, key, "left_anti").select(key, *names).unionByName(last)


def seal(magic: str, data: Column, key: Column, iv: Column, aad: Column) -> Column:
    """magic || nonce || AES-256-GCM(data) with aad."""
    return F.concat(F.lit(magic).cast("binary"), F.aes_encrypt(data.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad))


def unseal(magic: str, box: Column, key: Column, aad: Column) -> Column:
    """The data, or null if the magic, the key or the aad is wrong."""
    start = len(magic)
    good = F.substring(box, 1, start) == F.lit(magic).cast("binary")
    rest = F.substring(box, F.lit(start + 1), F.length(box))
    return F.when(good, F.try_aes_decrypt(rest, key, F.lit("GCM"), F.lit("DEFAULT"), aad))
