"""Security-master queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import ingest, securities
from tidemark.operators.spread import spread
from tidemark.sources import panel
from tidemark.sources.checkpoints import scratch
from tidemark.sources.ticker_store import apply_ticker_events, stored_history


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    """A new company download against the master an earlier one left.

    The stored master holds every customer but each seventh, with an older name for each ninth,
    another start for each thirteenth and one security the download does not have per nation. Some
    stored securities have a row in the download that is refused.
    """
    download = ingest.parse_companies(panel.raw_company(spark, sf))
    c = F.col("source_id").cast("bigint")
    stored = download.filter(F.col("source_id").isNotNull() & (c % 7 != 0)).select(
        (c + 1).alias("security_id"), "source_id", "ticker",
        F.when(c % 9 == 0, F.concat(F.lit("Old "), "company_name")).otherwise(F.col("company_name")).alias("company_name"),
        "sector", "industry", "category", "sic_code", "exchange", "currency", "country", "related_tickers",
        F.when(c % 13 == 0, F.date_add("first_price_date", 1)).otherwise(F.col("first_price_date")).alias("start_date"),
        ((c % 10 == 0) | (c % 33 == 0)).alias("delisted_flag"),
    )
    gone = panel.table(spark, sf, "supplier").select("s_nationkey").distinct().select(
        (F.col("s_nationkey") - 1000).cast("bigint").alias("security_id"),
        F.concat(F.lit("gone"), F.col("s_nationkey").cast("string")).alias("source_id"),
        F.lit(False).alias("delisted_flag"),
    )
    stored = stored.unionByName(gone, allowMissingColumns=True)
    tickers = stored.filter(~F.col("delisted_flag")).select(
        "security_id",
        F.when(F.col("security_id") % 11 == 0, "OLD").otherwise(F.col("ticker")).alias("open_ticker"),
    )
    return securities.master_diff(download, stored.drop("ticker"), tickers)


def master_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select(
        "source_id", "action", "newly_delisted", F.array_join("changed", ",").alias("changed"),
        F.array_join("notes", "; ").alias("notes"),
    )


def master_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return securities.diff_summary(_diff(spark, sf))


def ticker_events(spark: SparkSession, sf: str) -> DataFrame:
    """Listing at a customer's first order, a ticker change at each later one, close at the last."""
    o = spread(panel.table(spark, sf, "orders").filter("o_custkey IS NOT NULL"), "o_custkey").select(
        F.col("o_custkey").alias("security_id"), F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_orderkey") % 4).alias("letter"),
    )
    per_day = o.groupBy("security_id", "day").agg(F.min("letter").alias("letter"))
    whole = W.partitionBy("security_id").orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edged = per_day.withColumns({"_lo": F.min("day").over(whole), "_hi": F.max("day").over(whole)})
    rows = edged.filter("_hi > _lo").select(
        "security_id",
        F.when(F.col("day") == F.col("_lo"), "open").when(F.col("day") == F.col("_hi"), "close").otherwise("change").alias("kind"),
        F.when(F.col("day") != F.col("_hi"), F.concat(F.lit("K"), F.col("letter").cast("string"))).alias("ticker"),
        F.col("day").alias("effective"),
    )
    return rows


def ticker_history(spark: SparkSession, sf: str) -> DataFrame:
    return securities.ticker_history(ticker_events(spark, sf))


def ticker_history_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same events in three batches: the openings, the changes, the closings; each rebuilds the parts it touches."""
    folder, events = scratch(spark), ticker_events(spark, sf)
    for batch, kind in enumerate(("open", "change", "close")):
        apply_ticker_events(events.filter(F.col("kind") == kind), folder, batch, buckets=16)
    return stored_history(spark, folder)


def row_count_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts per brand of parts against those of order lines, as two snapshots."""
    part = panel.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"))
    left = part.groupBy("name").agg(F.count("*").alias("rows"))
    lines = panel.table(spark, sf, "lineitem").select("l_partkey").distinct()
    right = (
        part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
        .groupBy(F.when(F.col("name") == "Brand#3", "Brand#X").otherwise(F.col("name")).alias("name"))
        .agg(F.count("*").alias("rows"))
    )
    return securities.count_differences(left, right)


QUERIES = {
    "master_diff": master_diff,
    "master_diff_summary": master_diff_summary,
    "ticker_history": ticker_history,
    "ticker_history_batches": ticker_history_batches,
    "row_count_differences": row_count_differences,
}
