"""Streams of records. Each function takes and gives streaming DataFrames; stateless ones
and windows work on batches as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.scalars import rate


def first_nonces(uses: DataFrame, nonce: str, at: str, ttl: str = "60 seconds") -> DataFrame:
    """The first use of each nonce within the time to live; replays are dropped."""
    return uses.withWatermark(at, ttl).dropDuplicatesWithinWatermark([nonce])


def fresh(quotes: DataFrame, at: str, max_age: int, skew: int = 5) -> DataFrame:
    """Quotes from skew seconds ahead of now to max_age seconds old."""
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col(at))
    return quotes.where(age.between(-skew, max_age))


def contributor_windows(samples: DataFrame, at: str, contributor: str, flagged: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Samples and flag rate of each contributor and window of event time."""
    by = samples.withWatermark(at, late).groupBy(F.window(at, window), contributor)
    return by.agg(F.count("*").alias("n"), rate(flagged).alias("flag_rate")).select(F.col("window.start").alias("start"), contributor, "n", "flag_rate")
