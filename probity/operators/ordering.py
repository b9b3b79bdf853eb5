"""Dense numbers in a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.sources.scratch import materialize


def dense_index(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with name: start, start + 1, ... in the order of the given columns,
    which must be total. Rows are sorted in ranges of the whole key and written
    once; a range's numbers begin after the ranges before it. Null comes first."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + inside + start).drop("_range", "_at", "_before")


def exact_percentile(rows: DataFrame, value: Column, share: float, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., name): the interpolated percentile of value, for all rows or for each
    group, as F.percentile gives it, but without one task for all distinct values:
    equal values are counted, sorted in ranges and found by their rank. Nulls are
    left out; of no rows it is null (without groups) or absent."""
    counts = rows.select(*by, value.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    ranged = materialize(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "counts")
    inside = Window.partitionBy("_range").orderBy(*by, "_v").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranged.groupBy("_range").agg(F.sum("_c").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_offset"))
    first = F.col("_offset") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    placed = ranged.join(F.broadcast(sizes), "_range").withColumn("_first", first)
    groups = placed.groupBy(*by).agg(F.min("_first").alias("_start"), F.sum("_c").alias("_n"))
    groups = groups.withColumn("_at", F.lit(share) * (F.col("_n") - 1))
    both = placed.join(F.broadcast(groups), list(by)) if by else placed.join(F.broadcast(groups), how="cross")
    own = F.col("_first") - F.col("_start")
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda place: (own <= place) & (place < own + F.col("_c"))
    found = both.where(holds(low) | holds(high)).groupBy(*by).agg(F.max("_at").alias("_at"), F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
    between = (high - F.col("_at")) * F.col("_a") + (F.col("_at") - low) * F.col("_b")
    return found.select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(name))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)
