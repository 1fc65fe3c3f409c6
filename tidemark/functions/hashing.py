"""Fingerprints of tables that do not depend on row order and need no sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = ((1, 15), (16, 15), (31, 15), (46, 15))  # hex digits of the row hash, 60 bits each


def row_text(*values: Column) -> Column:
    """The row as text; NULL and the empty string stay apart."""
    return F.concat_ws(
        "|", *[F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values]
    )


def fingerprint(rows: DataFrame, text: Column, by: Sequence[str] = ()) -> DataFrame:
    """[*by, row_count, sha256] over all rows, or per group.

    The rows' SHA-256 values are added up in four parts (exact, any order, combined before the
    shuffle) and the sums are hashed with the count.
    """
    digest = F.sha2(text, 256)
    sums = [
        F.sum(F.conv(F.substring("_h", start, length), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}")
        for i, (start, length) in enumerate(CHUNKS)
    ]
    totals = rows.select(*by, digest.alias("_h")).groupBy(*by).agg(
        F.count("*").alias("row_count"), *sums
    )
    parts = [F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(len(CHUNKS))]
    return totals.select(
        *by, "row_count",
        F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *parts), 256).alias("sha256"),
    )
