"""Trust of contributors over windows of event time.

A first stateful aggregation counts samples and flags by window, contributor and label;
its state grows with these, not with samples. A window leaves it whole, with all its
contributors, once the watermark has passed its end. What follows, peer medians,
robust distances and trust, works on closed windows, in the micro-batch in which
they leave, with the operators of the batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from probity.functions.scalars import flag
from probity.operators.contributors import label_skew, trust

FLAGS = {"poison_rate": "poison_flag", "label_issue_rate": "label_issue", "dup_rate": "in_dup", "ood_rate": "ood_flag"}


def window_counts(samples: DataFrame, at: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, contributor, label, n, and each flag's count) of samples with an event time;
    a stream gives each closed window once (append mode), a batch gives all windows."""
    by = samples.withWatermark(at, late).groupBy(F.window(at, window), "contributor", "label")
    flags = [F.count_if(flag(c)).alias(m) for m, c in FLAGS.items()]
    return by.agg(F.count("*").alias("n"), *flags).select(F.col("window.start").alias("start"), "contributor", "label", "n", *FLAGS)


def window_trust(counts: DataFrame) -> DataFrame:
    """Per window and contributor of window_counts(): n_samples, the metrics, their peer
    medians, spreads and z in the window, risk, trust, flagged, flag_reasons."""
    rates = counts.groupBy("start", "contributor").agg(F.sum("n").alias("n_samples"), *[(F.sum(m) / F.sum("n")).alias(m) for m in FLAGS])
    skew = label_skew(counts.select("start", "contributor", "label", "n"), ("start",))
    return trust(rates.join(skew, ["start", "contributor"]), by=("start",))


def watch_trust(samples: DataFrame, at: str, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Write the trust of each closed window to a table at path, each micro-batch in a folder
    of its own, so one that runs again replaces what it wrote."""

    def write(counts: DataFrame, number: int) -> None:
        window_trust(counts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return window_counts(samples, at, window, late).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
