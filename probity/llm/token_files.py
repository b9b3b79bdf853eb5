"""Token files of directly addressable codes (DACs).

A token id is split into chunks of eight bits. Level k holds the k-th chunk of
all ids that have one, with a bitmap that says which of them go on at level k+1,
and a directory of the bitmap's ones before every 512th bit. The n-th id is read
from level 0 at n, then at rank(n) of level 1, and so on, without decoding others.

A token file is a Parquet table in which each row is a segment: whole documents
of about a million ids with their doc_ids and lengths, the levels, bitmaps and
rank directories. Spark commits the rows of finished tasks only, so lost
executors leave no half-written file. Documents lie in ascending doc_id order
over parts (writing tasks) and segments.

Edge cases. Null text counts as empty: its document holds the end id alone. Null
doc_id comes first. Repeated rows are documents of their own, ordered by text.
Empty table: no segment, no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.encoding import encoder
from probity.llm.shared import parallelism

SEGMENT_IDS = 1 << 20
RANK_BYTES = 64  # of bitmap to a directory entry
SEGMENT_SCHEMA = (
    "part int, seg int, start_in_part long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)
_SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("seg", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]
    + [(n, pa.list_(pa.binary())) for n in ("levels", "bitmaps", "ranks")]
)


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of ids."""
    levels, bitmaps, ranks = [], [], []
    left = ids.astype(np.uint32)
    while True:
        levels.append((left & 0xFF).astype(np.uint8).tobytes())
        left = left >> 8
        goes_on = left > 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.bitwise_count(bits).astype(np.uint32)
        ones = np.append(ones, np.zeros(-len(ones) % RANK_BYTES, np.uint32)).reshape(-1, RANK_BYTES).sum(1, dtype=np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        left = left[goes_on]
        if not len(left):
            return levels, bitmaps, ranks


def dac_get(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], n: int) -> int:
    """The n-th id, by rank directories alone."""
    value, at = 0, n
    for k, (level, bitmap, rank) in enumerate(zip(levels, bitmaps, ranks, strict=True)):
        value |= level[at] << (8 * k)
        byte, bit = divmod(at, 8)
        if not bitmap[byte] >> bit & 1:
            break
        block = byte // RANK_BYTES
        before = int.from_bytes(rank[4 * block : 4 * block + 4], "little")
        run = int.from_bytes(bitmap[block * RANK_BYTES : byte + 1], "little") & ((1 << (at - block * RANK_BYTES * 8)) - 1)
        at = before + run.bit_count()
    return value


def dac_decode(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids, from the last level up."""
    above = np.zeros(0, np.uint32)
    for level, bitmap in zip(reversed(levels), reversed(bitmaps), strict=True):
        here = np.frombuffer(level, np.uint8).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(here), bitorder="little").astype(bool)
        here[goes_on] |= above << np.uint32(8)
        above = here
    return above


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode every whole text and write the token file at path."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        seg, start, kept, doc_ids, lens, n = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(kept)
            row = {"part": part, "seg": seg, "start_in_part": start, "n_tokens": n, "doc_ids": doc_ids, "doc_tokens": lens}
            row |= dict(zip(("levels", "bitmaps", "ranks"), dac_encode(ids), strict=True))
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT_ARROW)

        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at in range(0, len(texts), 512):
                ids, offsets = enc.encode(texts[at : at + 512], end_id)
                kept.append(ids)
                doc_ids += keys[at : at + 512]
                lens += np.diff(offsets).tolist()
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield flush()
                    seg, start, kept, doc_ids, lens, n = seg + 1, start + n, [], [], [], 0
        if doc_ids:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .repartitionByRange(parallelism(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, SEGMENT_SCHEMA)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`, the ids before each in the whole file.

    The driver sums one number for each part, that is, for each writing task."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in totals]])
    parts = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts[:-1], strict=True)], "part int, part_start long")
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start")


def document_digests(segments: DataFrame) -> DataFrame:
    """Per document of read_token_files(): doc_id, start, n_tokens, ids_crc32, from decoded ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = dac_decode(row["levels"], row["bitmaps"]).astype("<u4")
                lens = np.array(row["doc_tokens"], np.int64)
                at = np.concatenate(([0], np.cumsum(lens)))
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["start"]), pa.array(lens), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("start", "doc_ids", "doc_tokens", "levels", "bitmaps").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: for rows (doc_id, place) of wanted, the id at that place of
    the document (null doc_ids and places outside of it give no row). Segments
    are read at the wanted places only, through their rank directories."""
    docs = segments.select("part", "seg", F.posexplode(F.arrays_zip("doc_ids", "doc_tokens")).alias("nth", "doc"), "doc_tokens").select(
        "part", "seg", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.doc_tokens").alias("n"),
        F.aggregate(F.slice("doc_tokens", F.lit(1), F.col("nth")), F.lit(0).cast("long"), lambda a, x: a + x).alias("before"),
    )
    at = wanted.select("doc_id", "place").join(docs, "doc_id").where("place >= 0 and place < n")
    at = at.groupBy("part", "seg").agg(F.collect_list(F.struct("doc_id", "place", (F.col("before") + F.col("place")).alias("at"))).alias("at"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = [(x["doc_id"], x["place"], dac_get(row["levels"], row["bitmaps"], row["ranks"], x["at"])) for x in row["at"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "place", "token"])

    return at.join(segments.select("part", "seg", "levels", "bitmaps", "ranks"), ["part", "seg"]).drop("part", "seg").mapInArrow(fetch, "doc_id long, place long, token long")
