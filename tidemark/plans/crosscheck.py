"""Cross-check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import out
from tidemark.functions.text import name_key
from tidemark.operators import crosscheck
from tidemark.plans.screening import classification
from tidemark.sources import panel

ON = "2000-07-31"
REPORT_DATES = ("1999-06-30", "2000-06-30", "2001-01-31")


def records_on(spark: SparkSession, sf: str, *days: str) -> DataFrame:
    """Our records on a fixed handful of dates."""
    dates = spark.createDataFrame([(d,) for d in days], "d string").select(
        F.col("d").cast("date").alias("report_date")
    )
    return crosscheck.our_records(
        classification(spark, sf), panel.security(spark, sf), panel.security_ticker(spark, sf), dates
    )


def our_records(spark: SparkSession, sf: str) -> DataFrame:
    return records_on(spark, sf, ON).drop("report_date")


def vendor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = crosscheck.pair_up(our_records(spark, sf), panel.vendor_report(spark, sf))
    return pairs.select("symbol", "our_status", "their_status", "side", "group")


def vendor_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per side and group."""
    return vendor_pairs(spark, sf).groupBy("side", "group").agg(F.count("*").alias("n"))


def vendor_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = crosscheck.agreement(vendor_pairs(spark, sf))
    for name in ("agreement", "precision", "recall"):
        rows = rows.withColumn(name, out(F.col(name)))
    return rows


def fund_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Fund positions, one per supplier and report date: some by ticker, some by name only."""
    s = F.col("s_suppkey")
    brand = (s % 30).cast("string")
    dates = F.explode(F.array(*[F.lit(d).cast("date") for d in REPORT_DATES]))
    return panel.table(spark, sf, "supplier").select(
        dates.alias("report_date"),
        F.when(s % 7 == 0, "").otherwise(F.concat(F.lit("The Company "), (s % 22).cast("string"), F.lit(", Inc."))).alias("name"),
        F.when(s % 3 == 0, None).when(s % 3 == 1, F.concat(F.lit("t"), brand)).otherwise(F.concat(F.lit("X"), brand)).alias("ticker"),
        F.abs(F.col("s_acctbal")).cast("decimal(18,2)").alias("value_usd"),
        F.when(s % 11 == 0, "STIV").otherwise("EC").alias("asset_category"),
    )


def matched_holdings(spark: SparkSession, sf: str) -> DataFrame:
    ours = records_on(spark, sf, *REPORT_DATES)
    # The fixture's names are "Company n"; legal words are dropped from both sides' keys.
    return crosscheck.match_holdings(fund_holdings(spark, sf), ours)


def holding_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = matched_holdings(spark, sf)
    return rows.select(
        "report_date", "name", "ticker", out(F.col("value_usd"), 2).alias("value_usd"), "status", "security_id"
    )


def holding_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = crosscheck.holding_shares(matched_holdings(spark, sf))
    return rows.select(
        "report_date", "status", "holdings", out(F.col("value"), 2).alias("value"),
        out(F.col("count_share")).alias("count_share"), out(F.col("value_share")).alias("value_share"),
    )


def largest_not_eligible(spark: SparkSession, sf: str) -> DataFrame:
    rows = crosscheck.largest_not_eligible(matched_holdings(spark, sf))
    return rows.select(
        "report_date", "side", "place", "name", "ticker", "status", out(F.col("value_usd"), 2).alias("value_usd")
    )


def company_name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Name keys of customers and suppliers, with punctuation and legal words to drop."""
    c = panel.table(spark, sf, "customer").select(
        F.concat(F.lit("The "), "c_name", F.lit(" & Sons, Inc.")).alias("name")
    )
    s = panel.table(spark, sf, "supplier").select(F.concat("s_name", F.lit("/Holding Co Ltd")).alias("name"))
    return c.unionByName(s).select("name", name_key(F.col("name")).alias("name_key"))


QUERIES = {
    "our_records": our_records,
    "vendor_pairs": vendor_pairs,
    "vendor_crosscheck": vendor_crosscheck,
    "vendor_agreement": vendor_agreement,
    "holding_match": holding_match,
    "holding_shares": holding_shares,
    "largest_not_eligible": largest_not_eligible,
    "company_name_keys": company_name_keys,
}
