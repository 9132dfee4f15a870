"""Positions in a total order at any size and skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import write_cut


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: str | None = None, name: str = "_before") -> DataFrame:
    """Adds ``name``: how many rows, or how much ``weight``, of the same keys come before a row.

    Spark's sampled splitters deal the rows into ranges of the order, so no key,
    value or count makes a range larger than its share as long as the order is
    total.  The ranges are written once, sorted; a row knows its place inside its
    range, and running sums over one row per range (and key) give where the
    range begins.
    """
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = write_cut(ranged, "in-order").withColumn("_range", F.shiftright("_at", 33))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    ranges = rows.groupBy(*keys, "_range").agg(size.alias("_n"), F.min("_at").alias("_first"))
    starts = ranges.select(*keys, "_range", "_first", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_n")).alias("_start"))
    placed = rows.join(starts, [*keys, "_range"])
    inside = F.col("_at") - F.col("_first")
    if weight is not None:
        within = W.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(within), F.lit(0))
    return placed.withColumn(name, F.col("_start") + inside).select(*df.columns, name)
