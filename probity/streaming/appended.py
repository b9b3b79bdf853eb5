"""An append-only log that streams write, with dense indices and a root for each batch.

Beside its entries the log keeps a frontier for each append: the hashes of the full
subtrees at the right edge, one for each bit of the size. A batch is hashed by itself:
its leaves are folded into the full subtrees that lie wholly within it, in chunks of
1024 neighbours, and what is left at its two ends, some twenty hashes for each stage, is
merged with the frontier. So a batch's hashing grows with the batch, not with the log.

An append is committed by its frontier, written last. Readers see entries below the
last frontier's size only. A batch that runs again after it was committed changes
nothing; one that failed half-way is written anew in the same place. One stream
writes at a time; streams may take turns.

Layout: entries/seq=N (pos, kind, key, payload, leaf_hash), heads/seq=N (kind, batch,
start, size, root, frontier).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from probity.operators.ledger import EMPTY_ROOT, leaf_hash
from probity.operators.ordering import dense_index
from probity.sources.files import read_or_empty
from probity.sources.scratch import materialize

ENTRIES = "pos LONG, kind STRING, key STRING, payload STRING, leaf_hash STRING, seq LONG"
HEADS = "kind STRING, batch LONG, start LONG, size LONG, root STRING, frontier ARRAY<STRUCT<level: INT, hash: STRING>>, seq LONG"
COVER = "level int, pos long, hash string"
CHUNK_LEVELS = 10


def _parent(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def _cover(chunk: pa.Table) -> pa.Table:
    """The largest full subtrees over neighbours (level, pos, hash) of one chunk and level."""
    order = sorted(zip(chunk.column("pos").to_pylist(), chunk.column("hash").to_pylist(), strict=True))
    level = chunk.column("level")[0].as_py()
    out = []
    for up in range(level, level + CHUNK_LEVELS):
        above, at = [], 0
        while at < len(order):
            pos, own = order[at]
            if pos % 2 == 0 and at + 1 < len(order):
                above.append((pos // 2, _parent(own, order[at + 1][1])))
                at += 2
            else:
                out.append((up, pos, own))
                at += 1
        order = above
    out += [(level + CHUNK_LEVELS, pos, own) for pos, own in order]
    return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["level", "pos", "hash"])


def full_subtrees(leaves: DataFrame) -> DataFrame:
    """(level, pos, hash): the largest full subtrees over leaves (pos, hash), whose
    positions have no gap; some twenty for each ten levels, whatever the number of leaves."""
    level, nodes, done = 0, leaves.select(F.lit(0).alias("level"), F.col("pos").cast("long").alias("pos"), "hash"), []
    while True:
        chunks = nodes.groupBy(F.shiftright("pos", CHUNK_LEVELS).alias("chunk"))
        level += CHUNK_LEVELS
        covered = materialize(chunks.applyInArrow(_cover, COVER), "cover")
        done.append(covered.where(F.col("level") < level))
        nodes = covered.where(F.col("level") == level)
        if nodes.limit(2).count() < 2:
            out = nodes
            for part in done:
                out = out.unionByName(part)
            return out


def merged(frontier: Iterable[tuple[int, str]], parts: Iterable[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """A frontier (level, hash), highest first, after full subtrees (level, pos, hash) that
    follow it from left to right."""
    stack = list(frontier)
    for level, pos, own in parts:
        while pos % 2:
            left_level, left = stack.pop()
            if left_level != level:
                raise ValueError(f"the frontier has no subtree of level {level} before position {pos}")
            level, pos, own = level + 1, pos // 2, _parent(left, own)
        stack.append((level, own))
    return stack


def frontier_root(frontier: list[tuple[int, str]]) -> str:
    """The root of a log with this frontier."""
    if not frontier:
        return EMPTY_ROOT
    root = frontier[-1][1]
    for _, left in reversed(frontier[:-1]):
        root = _parent(left, root)
    return root


def heads(spark: SparkSession, path: str) -> DataFrame:
    """A row for each append: kind, batch, start, size, root, frontier, seq."""
    return read_or_empty(spark, f"{path}/heads", HEADS, "parquet")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The committed entries."""
    last = heads(spark, path).agg(F.max("seq").alias("_last"))
    return read_or_empty(spark, f"{path}/entries", ENTRIES, "parquet").join(F.broadcast(last), F.col("seq") <= F.col("_last")).drop("_last")


def _last(spark: SparkSession, path: str) -> Row | None:
    return heads(spark, path).orderBy(F.desc("seq")).first()


def append_batch(batch: DataFrame, number: int, key: str, payload: str, path: str, kind: str = "record") -> None:
    """Append a batch's rows in the order of their keys. A key that the log holds, of
    whatever kind, isn't appended again, and of equal keys in a batch the one of the smallest
    payload is: null keys and payloads are left out. A batch without new keys is a head of
    the same size."""
    spark = batch.sparkSession
    if heads(spark, path).where((F.col("kind") == kind) & (F.col("batch") == number)).count():
        return
    last = _last(spark, path)
    seq, size = (0, 0) if last is None else (last["seq"] + 1, last["size"])
    rows = batch.where(F.col(key).isNotNull() & F.col(payload).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(payload).cast("string").alias("payload"))
    new = rows.join(entries(spark, path).select("key"), "key", "left_anti")
    placed = dense_index(new, ["key"], "pos", start=size).select("pos", F.lit(kind).alias("kind"), "key", "payload", leaf_hash(F.col("payload")).alias("leaf_hash"))
    written = f"{path}/entries/seq={seq}"
    placed.write.mode("overwrite").parquet(written)
    leaves = spark.read.schema(placed.schema).parquet(written).select("pos", F.col("leaf_hash").alias("hash"))
    parts = sorted((tuple(r) for r in full_subtrees(leaves).select("level", "pos", "hash").collect()), key=lambda x: x[1] << x[0])
    frontier = merged([] if last is None else [tuple(x) for x in last["frontier"]], parts)
    end = sum(1 << level for level, _ in frontier)
    head = spark.createDataFrame([(kind, number, size, end, frontier_root(frontier), frontier)], HEADS.rsplit(",", 1)[0])
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/seq={seq}")


def append_log(records: DataFrame, key: str, payload: str, path: str, checkpoint: str, kind: str = "record") -> StreamingQuery:
    """Append a stream of records to the log at path; see append_batch()."""
    write = lambda batch, number: append_batch(batch, number, key, payload, path, kind)
    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
