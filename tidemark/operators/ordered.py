"""Ordered windows over logs in which one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lag_in_log(
    log: DataFrame, key: str, order: str, values: Sequence[str], prefix: str, width: int = 1_000_000
) -> DataFrame:
    """Add the previous row's values per key, in `order` (a long, unique per key).

    The order column is cut into ranges of `width`, so a hot key is spread over many tasks. Inside a
    range a plain lag works; the first row of a range takes the last row of the key's nearest
    earlier range, found on one aggregated row per (key, range).
    """
    payload = F.struct(F.col(order).alias("_at"), *values)
    rows = log.withColumn("_range", F.floor(F.col(order) / width))
    inside = W.partitionBy(key, "_range").orderBy(order)
    ends = rows.groupBy(key, "_range").agg(F.max_by(payload, order).alias("_end"))
    before = ends.select(
        key, "_range", F.lag("_end").over(W.partitionBy(key).orderBy("_range")).alias("_before")
    )
    both = rows.withColumn("_prev", F.lag(payload).over(inside)).join(before, [key, "_range"])
    return both.withColumn("_p", F.coalesce("_prev", "_before")).select(
        *log.columns, *[F.col(f"_p.{v}").alias(f"{prefix}{v}") for v in values]
    )
