"""Packing documents into training sequences by first-fit decreasing.

A seeded hash deals the documents into groups of about 1024; each group is packed
alone, so groups run in parallel and none grows with the input. In a group,
documents longer than a sequence give whole sequences first; what is left of each
goes, longest first, into the first bin with room. A tournament tree over the
bins' capacities finds that bin in logarithmic time: each inner node holds the
larger capacity of its two children, and the search goes left where it can.

Gaps that remain are closed by cutting pieces of the emptiest bins into fuller
ones, so at most one bin of a group stays unfilled. Its tokens become sequences
whose lengths are powers of two, which need no padding.

Edge cases. Null text counts as empty: its document is the end id alone. Null
doc_id is kept. Repeated rows are documents of their own. A group that an id
repeated very often has swollen is packed in runs of 4096 documents. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.encoding import encoder, id_width
from probity.llm.shared import parallelism

GROUP_DOCS, RUN_DOCS, RUN_TOKENS = 1024, 4096, 1 << 24
Piece = tuple[int, int, int]  # document's place in its group, start, length


class CapacityTree:
    """Tournament tree of bin capacities."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size; its capacity shrinks by size."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        found = at - self.leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return found


def pack_group(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences, each a list of pieces, that hold every token of the documents once."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        full += [[(doc, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = CapacityTree(len(rest) or 1, capacity)
    bins: dict[int, list[Piece]] = {}
    for piece in rest:
        bins.setdefault(tree.place(piece[2]), []).append(piece)
    fill = lambda pieces: sum(p[2] for p in pieces)
    full += [b for b in bins.values() if fill(b) == capacity]
    open_ = sorted((b for b in bins.values() if fill(b) < capacity), key=lambda b: (fill(b), b))
    while len(open_) > 1:  # cut the emptiest bin's pieces into the fullest one's gap
        target, gap = open_[-1], capacity - fill(open_[-1])
        while gap and len(open_) > 1:
            doc, start, n = open_[0].pop()
            cut = min(n, gap)
            target.append((doc, start + n - cut, cut))
            if n > cut:
                open_[0].append((doc, start, n - cut))
            gap -= cut
            if not open_[0]:
                open_.pop(0)
        if not gap:
            full.append(open_.pop())
    for tail in open_:
        todo, left = tail[::-1], fill(tail)
        while left:  # one sequence for each binary digit of the tail's length
            room = 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                doc, start, n = todo.pop()
                cut = min(n, room)
                sequence.append((doc, start, cut))
                if n > cut:
                    todo.append((doc, start + cut, n - cut))
                room -= cut
            full.append(sequence)
    return full


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, seed: int = 42, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with_ids, the ids themselves (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    width = id_width(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, offsets = enc.encode(part.column("text").to_pylist(), end_id)
                ids = ids.astype(width)
                ends = pa.py_buffer((offsets * ids.itemsize).astype(np.int32).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, ends, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("doc_id"), binary], names=["grp", "doc_id", "ids"])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, doc_ids, ids, tokens, next_id = None, [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, ids, tokens, next_id
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            for sequence in pack_group([len(x) for x in ids], capacity):
                offset = 0
                for doc, start, n in sequence:
                    raw = ids[doc][start : start + n].astype("<u4").tobytes()
                    row = [doc_ids[doc], start, n, zlib.crc32(raw), len(ids[doc]), (group << 32) + next_id, offset, raw]
                    for column, value in zip(rows, row, strict=False):
                        column.append(value)
                    offset += n
                next_id += 1
            doc_ids, ids, tokens = [], [], 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, rows, strict=False)], names=names[: len(rows)])

        for batch in batches:
            for g, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group or len(ids) >= RUN_DOCS or tokens >= RUN_TOKENS:
                    yield from flush()
                    next_id = next_id if g == group else 0
                    group = g
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw, width))
                tokens += len(ids[-1])
        yield from flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    key = F.col("doc_id").cast("long")
    return (
        docs.select(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(groups)).alias("grp"), key.alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(encode, "grp long, doc_id long, ids binary")
        .repartition(parallelism(spark), "grp")
        .sortWithinPartitions("grp", "doc_id", "ids")
        .mapInArrow(sequences, schema)
    )
