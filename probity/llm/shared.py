"""What the operators of this subpackage share: scratch tables and word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from probity.sources.scratch import materialize, scratch_path, shuffles_dropped

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "WORD", "lower_ascii", "materialize", "parallelism", "runs", "scratch_path", "shuffles_dropped", "word_count"]

#: A word is a longest run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows with equal keys, which come together."""
    mark, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        run_of = np.stack([np.asarray(batch.column(c)) for c in keys])
        cuts = [0, *(np.flatnonzero((run_of[:, 1:] != run_of[:, :-1]).any(0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if tuple(run_of[:, a]) != mark:
                if held:
                    yield pa.Table.from_batches(held)
                mark, held = tuple(run_of[:, a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
