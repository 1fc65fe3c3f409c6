"""Screening queries: every security at every month end in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.functions.text import sic_number
from tidemark.operators import asof, calendar, screening
from tidemark.params import COMMON_STOCK_CATEGORIES, Methodology
from tidemark.plans.temporal import FIRST, asof_grid, decisions
from tidemark.sources import panel

METHOD = Methodology()
FIRST_MONTH = FIRST.year * 12 + FIRST.month


@per_session
def manual_list(spark: SparkSession) -> DataFrame:
    """Named companies decided by hand (an example list: a fixed handful)."""
    return spark.createDataFrame(
        [("P13", "NON_HALAL", "pork producer"), ("P22", "PENDING_REVIEW", "mixed business")],
        "source_id string, manual_status string, manual_reason string",
    )


@per_session
def classification(
    spark: SparkSession,
    sf: str,
    key: str = "brand",
    stored: DataFrame | None = None,
    caps: DataFrame | None = None,
) -> DataFrame:
    """Classification records of all months for common stock."""
    securities = panel.security(spark, sf, key).filter(F.col("category").isin(*COMMON_STOCK_CATEGORIES))
    months = calendar.screening_dates(spark, FIRST, panel.last_day(spark, sf))
    grid = asof_grid(securities, months.select("month_no", "screening_date"), "screening_date", panel.last_day(spark, sf))
    return screening.classify(
        spark, securities, grid, panel.fundamental(spark, sf, key),
        caps if caps is not None else panel.daily_market_cap(spark, sf, key), months,
        FIRST_MONTH, METHOD, manual_list(spark), stored,
    )


def screening_results(spark: SparkSession, sf: str) -> DataFrame:
    return classification(spark, sf).select(
        "security_id", "screening_date", "status", "reason", "rule", "category",
        out(F.col("debt_ratio")).alias("debt_ratio"), out(F.col("cash_ratio")).alias("cash_ratio"),
        out(F.col("income_ratio")).alias("income_ratio"),
        F.array_join("problems", " | ").alias("problems"), "effective_from", "effective_to",
    )


def screening_not_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A rerun after the odd months were stored: only the others are screened."""
    done = classification(spark, sf).filter(F.month("screening_date") % 2 == 1)
    fresh = classification(spark, sf, stored=done)
    return fresh.groupBy("screening_date", "status").agg(F.count("*").alias("n"))


def screening_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Which filings each result used."""
    rows = classification(spark, sf).select(
        "security_id", "screening_date", F.posexplode("filings").alias("pos", "f")
    )
    return rows.select("security_id", "screening_date", F.col("pos").cast("bigint").alias("pos"), "f.*")


def business_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    s = panel.security(spark, sf)
    sic = sic_number(F.col("sic_code"))
    return s.select(
        "security_id", sic.alias("sic"),
        screening.business_category(F.col("industry"), sic, METHOD).alias("category"),
    )


def classification_in_effect(spark: SparkSession, sf: str) -> DataFrame:
    """The status that applies on each decision date, and since which screening."""
    return asof.in_effect_monthly(
        classification(spark, sf), decisions(spark, sf), ["security_id"], "decision_date",
        "effective_from", "effective_to", ["status"], "screening_date",
    )


def classification_on_date(spark: SparkSession, sf: str) -> DataFrame:
    """The records in effect on one date."""
    rows = classification(spark, sf).select(
        "security_id", "status", "effective_from", "effective_to", "screening_date"
    )
    on = F.lit("2000-07-31").cast("date")
    return asof.in_effect_on(
        rows, ["security_id"], on, "effective_from", "effective_to", "screening_date"
    )


def wide_screening(spark: SparkSession, sf: str) -> DataFrame:
    """Results per date on a market with a security per supplier."""
    return classification(spark, sf, "supplier").groupBy("screening_date", "status").agg(F.count("*").alias("n"))


QUERIES = {
    "wide_screening": wide_screening,
    "screening": screening_results,
    "screening_not_stored": screening_not_stored,
    "screening_sources": screening_sources,
    "business_exclusions": business_exclusions,
    "classification_in_effect": classification_in_effect,
    "classification_on_date": classification_on_date,
}
