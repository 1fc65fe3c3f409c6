"""Ranking inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.checkpoints import cut

BINS = 64


def rank_in_groups(
    rows: DataFrame, keys: Sequence[str], score: str, tie: str, marked: str | None = None
) -> DataFrame:
    """Add `rank` (score descending, tie ascending) and `group_size` per group.

    A group may hold far more rows than one task should sort. Its scores are cut into bins at
    approximate quantiles, in score order; the exact rank is the number of rows in better bins plus
    the place inside the bin, so only bins meet in a task. A score that fills whole quantiles is a
    bin of its own, and its rows are cut once more by the tie column. With `marked` (a boolean
    column) `marked_rank` numbers the marked rows alone and `group_marked` counts them. Scores and
    ties are numbers; neither may be NULL.
    """
    keys = list(keys)
    flag = F.col(marked).cast("int") if marked else F.lit(0)
    rows = cut(rows)  # read several times below
    cuts = [(i + 1) / BINS for i in range(BINS - 1)]
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx(score, cuts, 1000).alias("_cuts"),
        F.count("*").alias("group_size"),
        F.sum(flag).alias("group_marked"),
    )
    value = F.col(score)
    above = F.size(F.filter("_cuts", lambda b: b > value))
    # Rows on a cut come after the rows between it and the next higher one: an odd bin number apart.
    on_cut = F.array_contains("_cuts", value)
    binned = rows.join(bounds, keys).withColumns(
        {"_bin": above * 2 + on_cut.cast("int"), "_on_cut": on_cut}
    )
    ties = (
        binned.filter("_on_cut")
        .groupBy(*keys, "_bin")
        .agg(F.percentile_approx(tie, cuts, 1000).alias("_ties"))
    )
    place = [*keys, "_bin", "_sub"]
    placed = binned.drop("_cuts").join(ties, [*keys, "_bin"], "left").withColumn(
        "_sub", F.coalesce(F.size(F.filter("_ties", lambda b: b < F.col(tie))), F.lit(0))
    )
    placed = placed.withColumn("_sub", F.when(F.col("_on_cut"), F.col("_sub")).otherwise(0)).drop(
        "_ties", "_on_cut"
    )
    sizes = placed.groupBy(*place).agg(F.count("*").alias("_n"), F.sum(flag).alias("_m"))
    before = W.partitionBy(*keys).orderBy("_bin", "_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *place,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_marked_before"),
    )
    inside = W.partitionBy(*place).orderBy(F.desc(score), F.asc(tie))
    ranked = placed.join(offsets, place).withColumn(
        "rank", F.row_number().over(inside) + F.col("_before")
    )
    if marked:
        seen = F.sum(flag).over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("_marked_before")
        ranked = ranked.withColumn("marked_rank", F.when(F.col(marked), seen))
    else:
        ranked = ranked.drop("group_marked")
    return ranked.drop("_bin", "_sub", "_before", "_marked_before")
