"""Quality-check queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import out
from tidemark.operators import quality
from tidemark.params import QualityThresholds
from tidemark.sources import panel
from tidemark.sources.checkpoints import cut

FIRST, AS_OF = date(1998, 1, 1), date(2004, 11, 3)
TODAY = date(2004, 10, 4)  # prices after this day count as dated in the future
LIMITS = QualityThresholds()


def all_findings(
    spark: SparkSession,
    sf: str,
    t: QualityThresholds = LIMITS,
    key: str = "brand",
    prices: DataFrame | None = None,
    caps: DataFrame | None = None,
    details: bool = True,
    more: tuple[quality.RowCheck, ...] = (),
    own: tuple[quality.TableCheck, ...] = (),
) -> DataFrame:
    """Findings of every check, the caller's (`more`, `own`) among them. Prices are read three times, so they are derived once and stored."""
    prices = prices if prices is not None else cut(panel.daily_price(spark, sf, key))
    caps = caps if caps is not None else panel.market_cap_of(prices)
    securities, last = panel.security(spark, sf, key), panel.last_day(spark, sf)
    price = quality.price_findings(
        spark, prices, panel.corporate_action(spark, sf), panel.security_ticker(spark, sf, key),
        securities, FIRST, last, t, TODAY, details, more,
    )
    filings = panel.fundamental(spark, sf, key)
    filing = quality.filing_findings(filings, FIRST, last, more)
    value = quality.value_findings(caps, FIRST, last, more)
    stale = quality.stale_prices(spark, securities, prices, AS_OF, t)
    found = price.unionByName(filing).unionByName(value).unionByName(stale)
    for rows in quality.table_findings(own, {"prices": prices, "filings": filings, "values": caps, "securities": securities}):
        found = found.unionByName(rows)
    return found


def quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    return all_findings(spark, sf)


def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.counts(spark, all_findings(spark, sf))


def quality_examples(spark: SparkSession, sf: str) -> DataFrame:
    return quality.examples(all_findings(spark, sf))


def thin_years(prices: DataFrame) -> DataFrame:
    """Securities with fewer than 40 prices in a year in which they have any."""
    years = prices.groupBy("security_id", F.trunc("price_date", "year").alias("data_date")).agg(F.count("*").alias("_n"))
    return years.filter("_n < 40").select("security_id", "data_date", F.concat(F.lit("prices="), F.col("_n")).alias("detail"))


#: Checks that are not the library's own, registered the way a user would.
MORE = (
    quality.RowCheck("wide_day", "prices", "high > 1.5 * low", "concat('low=', low, ' high=', high)"),
    quality.RowCheck("slow_filing", "filings", "filing_date > date_add(coalesce(report_period, calendar_date), 60)"),
    quality.RowCheck("small_value", "values", "market_cap_usd BETWEEN 0 AND 1000000"),
)
OWN = (quality.TableCheck("thin_year", ("prices",), thin_years),)


def quality_own_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all checks with four registered from outside, three of them in the scans of the others."""
    found = all_findings(spark, sf, more=MORE, own=OWN)
    return quality.counts(spark, found, (*quality.ALL_CHECKS, *(c.name for c in (*MORE, *OWN))))


def previous_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Each price with the row before it, seen from its yearly chunk."""
    rows = quality.with_previous(panel.daily_price(spark, sf), date(1999, 3, 1), panel.last_day(spark, sf), LIMITS)
    return rows.select(
        "security_id", "price_date", "prev_date", out(F.col("prev_close")).alias("prev_close"),
        out(F.col("prev_unadjusted")).alias("prev_unadjusted"),
    )


def stale_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The staleness check on a day after many securities went quiet."""
    return quality.stale_prices(
        spark, panel.security(spark, sf), panel.daily_price(spark, sf), date(2004, 11, 15), LIMITS
    )


def wide_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of every check on a market with a security per supplier."""
    return all_findings(spark, sf, key="supplier").groupBy("check_name").agg(F.count("*").alias("findings"))


QUERIES = {
    "wide_quality": wide_quality,
    "quality_findings": quality_findings,
    "quality_counts": quality_counts,
    "quality_own_checks": quality_own_checks,
    "quality_examples": quality_examples,
    "previous_prices": previous_prices,
    "stale_prices": stale_prices,
}
