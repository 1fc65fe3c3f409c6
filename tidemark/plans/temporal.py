"""Queries over the calendar and the temporal joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.functions.text import normalise_ticker, strict_date
from tidemark.operators import asof, calendar
from tidemark.sources import panel

FIRST = date(1998, 2, 1)


@per_session
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.decision_dates(spark, FIRST, panel.last_day(spark, sf))


def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    """Every day that has prices, with what the calendar says about it."""
    days = panel.daily_price(spark, sf).groupBy("price_date").agg(F.count("*").alias("prices"))
    cal = F.broadcast(calendar.calendar(spark))
    return days.join(cal, days["price_date"] == cal["day"]).drop("price_date")


def month_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Decision and screening dates of every month with prices, and how many prices it has."""
    counts = (
        panel.daily_price(spark, sf)
        .groupBy(calendar.month_no(F.col("price_date")).alias("month_no"))
        .agg(F.count("*").alias("prices"))
    )
    return counts.join(F.broadcast(calendar.month_table(spark)), "month_no").select(
        F.col("month_no").cast("bigint").alias("month_no"),
        F.col("first_td").alias("decision_date"),
        F.col("last_td").alias("screening_date"),
        F.col("next_first_td").alias("effective_from"),
        F.col("next_last_td").alias("effective_to"),
        "prices",
    )


def load_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly load windows over the range of the filings, with the filings in each."""
    filings = panel.fundamental(spark, sf).select("filing_date", "dimension")
    span = filings.agg(F.min("filing_date").alias("lo"), F.max("filing_date").alias("hi"))
    windows = span.select(F.explode(calendar.month_windows(F.col("lo"), F.col("hi"))).alias("w")).select("w.*")
    counts = filings.groupBy(F.trunc("filing_date", "month").alias("start")).agg(
        F.count("*").alias("filings")
    )
    return windows.join(counts, "start", "left").na.fill(0, ["filings"])


def year_load_windows(spark: SparkSession, sf: str) -> DataFrame:
    """(dimension, year) load windows with the filings in each."""
    filings = panel.fundamental(spark, sf).select("filing_date", "dimension")
    span = filings.groupBy("dimension").agg(
        F.min("filing_date").alias("lo"), F.max("filing_date").alias("hi")
    )
    windows = span.select(
        "dimension", F.explode(calendar.year_windows(F.col("lo"), F.col("hi"))).alias("w")
    ).select("dimension", "w.*")
    counts = filings.groupBy("dimension", F.trunc("filing_date", "year").alias("start")).agg(
        F.count("*").alias("filings")
    )
    return windows.join(counts, ["dimension", "start"], "left").na.fill(0, ["filings"])


def liquidity_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Per decision date: the 20 trading days before it, the staleness cutoff, prices inside."""
    dates = decisions(spark, sf).withColumnRenamed("decision_date", "as_of")
    days = calendar.window_days(dates.select("as_of", "td_index"), spark, 20)
    counts = (
        panel.daily_price(spark, sf)
        .join(F.broadcast(days), F.col("price_date") == F.col("day"))
        .groupBy("as_of")
        .agg(F.count("*").alias("prices"))
    )
    edges = days.groupBy("as_of").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    cut = calendar.shift_back(dates.select("as_of", "td_index"), F.col("td_index") - 4, "cutoff", spark)
    return edges.join(cut.select("as_of", "cutoff"), "as_of").join(counts, "as_of", "left")


def report_age_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest period end each filing date would accept: 16 whole months back, day clamped."""
    return panel.fundamental(spark, sf).select(
        "filing_id",
        F.add_months("filing_date", -16).alias("cutoff"),
        (F.col("calendar_date") < F.add_months("filing_date", -16)).alias("out_of_date"),
    )


def trading_day_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days after the period end up to and including the filing date (0 if none)."""
    cal = F.broadcast(calendar.calendar(spark).select("day", "td_index"))
    f = panel.fundamental(spark, sf).select("filing_id", "calendar_date", "filing_date")
    a = cal.select(F.col("day").alias("calendar_date"), F.coalesce("td_index", F.lit(0)).alias("a"))
    b = cal.select(F.col("day").alias("filing_date"), F.coalesce("td_index", F.lit(0)).alias("b"))
    return (
        f.join(F.broadcast(a), "calendar_date")
        .join(F.broadcast(b), "filing_date")
        .select("filing_id", F.greatest(F.col("b") - F.col("a"), F.lit(0)).cast("bigint").alias("days"))
    )


def price_history(spark: SparkSession, sf: str) -> DataFrame:
    """One security's prices in a date range, oldest first."""
    return (
        panel.daily_price(spark, sf)
        .filter((F.col("security_id") == 7) & F.col("price_date").between("1999-01-01", "1999-12-31"))
        .select("price_date", out(F.col("open")).alias("open"), out(F.col("close")).alias("close"), "volume")
        .orderBy("price_date")
    )


def ticker_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor rows per (ticker, date) with the security that traded under it, or none."""
    raw = panel.raw_price(spark, sf).select(
        normalise_ticker(F.col("ticker")).alias("ticker"),
        strict_date(F.col("date")).alias("price_date"),
    )
    probes = raw.filter("price_date IS NOT NULL AND length(ticker) > 0").groupBy(
        "ticker", "price_date"
    ).agg(F.count("*").alias("n"))
    return asof.resolve_period(
        probes, panel.security_ticker(spark, sf), "ticker", "price_date", "security_id"
    )


@per_session
def screening_grid(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    """[security_id, screening_date] for every security and month it could be screened in."""
    months = calendar.screening_dates(spark, FIRST, panel.last_day(spark, sf)).select("month_no", "screening_date")
    s = panel.security(spark, sf, key).select("security_id", "start_date", "end_date")
    return asof_grid(s, months, "screening_date", panel.last_day(spark, sf))


def asof_grid(securities: DataFrame, months: DataFrame, date_col: str, end: date) -> DataFrame:
    """Securities unrolled over the monthly dates of their life, up to `end`, without a cross join."""
    lo, hi = FIRST.year * 12 + FIRST.month, end.year * 12 + end.month
    first = F.greatest(calendar.month_no(F.coalesce("start_date", F.lit(FIRST))), F.lit(lo))
    last = F.least(calendar.month_no(F.coalesce("end_date", F.lit(end))), F.lit(hi))
    lived = securities.withColumn(
        "month_no", F.explode(F.when(first <= last, F.sequence(first, last)))
    )
    alive = (F.col("start_date").isNull() | (F.col("start_date") <= F.col(date_col))) & (
        F.col("end_date").isNull() | (F.col("end_date") >= F.col(date_col))
    )
    return (
        lived.join(F.broadcast(months), "month_no").filter(alive).select("security_id", date_col)
    )


def filing_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Per security and screening date: the latest filing of each kind filed strictly before."""
    months = calendar.screening_dates(spark, FIRST, panel.last_day(spark, sf)).select("month_no", "screening_date")
    filings = panel.fundamental(spark, sf).filter(F.col("dimension").isin("ARQ", "ARY", "ART"))
    grid = screening_grid(spark, sf).withColumn(
        "dimension", F.explode(F.array(F.lit("ARQ"), F.lit("ARY"), F.lit("ART")))
    )
    got = asof.asof_monthly(
        grid, filings, months, FIRST.year * 12 + FIRST.month, ["security_id", "dimension"],
        "screening_date", "filing_date", ["calendar_date", "debt"], ["calendar_date", "filing_id"],
    )
    return got.select(
        "security_id", "screening_date", "dimension", "filing_date", out(F.col("debt")).alias("debt")
    )


def filing_asof_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Every price row with the latest quarterly filing known before its date."""
    prices = panel.daily_price(spark, sf).select("security_id", "price_date", "close")
    filings = panel.fundamental(spark, sf).filter("dimension = 'ARQ'")
    got = asof.asof_join(
        prices, filings, ["security_id"], "price_date", "filing_date", ["calendar_date", "debt"],
        inclusive=False, tie=["calendar_date", "filing_id"],
    )
    return got.select(
        "security_id", "price_date", "filing_date", out(F.col("debt")).alias("debt"),
        out(F.col("close")).alias("close"),
    )


def filing_asof_same_day(spark: SparkSession, sf: str) -> DataFrame:
    """The inclusive form, not older than 90 days: a filing on the day itself counts."""
    prices = panel.daily_price(spark, sf).select("security_id", "price_date")
    filings = panel.fundamental(spark, sf).filter("dimension = 'ARY'")
    return asof.asof_join(
        prices, filings, ["security_id"], "price_date", "filing_date", ["filing_id"],
        inclusive=True, tie=["calendar_date", "filing_id"], max_age_days=90,
    )


def price_asof_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Latest price on or before each decision date, less than 7 days old."""
    got = asof.asof_within(
        panel.daily_price(spark, sf), decisions(spark, sf), ["security_id"], "price_date",
        "decision_date", ["close_unadjusted"], lookback=7, inclusive=True,
    )
    return got.withColumn("close_unadjusted", out(F.col("close_unadjusted")))


def price_before_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Latest price before each decision date within 60 days."""
    got = asof.asof_within(
        panel.daily_price(spark, sf), decisions(spark, sf), ["security_id"], "price_date",
        "decision_date", ["close_unadjusted"], lookback=60, inclusive=False,
    )
    return got.withColumn("close_unadjusted", out(F.col("close_unadjusted")))


def market_value_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Market value on or before the last close before each decision, within a week."""
    got = asof.asof_within(
        panel.daily_market_cap(spark, sf), decisions(spark, sf), ["security_id"], "cap_date", "prev_td",
        ["market_cap_usd"], lookback=7, inclusive=True,
    )
    return got.withColumn("market_cap_usd", out(F.col("market_cap_usd"), 2))


def market_value_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Market value dated exactly on the screening date, missing ones kept."""
    caps = panel.daily_market_cap(spark, sf).withColumnRenamed("cap_date", "screening_date")
    got = screening_grid(spark, sf).join(caps, ["security_id", "screening_date"], "left")
    return got.withColumn("market_cap_usd", out(F.col("market_cap_usd"), 2))


def ticker_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Ticker periods that overlap, both ways round; one period is stretched to make some."""
    stretched = panel.security_ticker(spark, sf).withColumn(
        "valid_to",
        F.when(F.col("security_id") % 5 == 0, F.add_months("valid_to", 3)).otherwise(F.col("valid_to")),
    )
    kinds = [
        asof.overlapping_periods(stretched, key).select(
            F.lit(key).alias("kind"), "security_id", "ticker", "valid_from", "prev_end"
        )
        for key in ("ticker", "security_id")
    ]
    return kinds[0].unionByName(kinds[1])


QUERIES = {
    "calendar_days": calendar_days,
    "month_grid": month_grid,
    "load_windows": load_windows,
    "year_load_windows": year_load_windows,
    "liquidity_windows": liquidity_windows,
    "report_age_cutoff": report_age_cutoff,
    "trading_day_distance": trading_day_distance,
    "price_history": price_history,
    "ticker_resolve": ticker_resolve,
    "filing_asof": filing_asof,
    "filing_asof_daily": filing_asof_daily,
    "filing_asof_same_day": filing_asof_same_day,
    "price_asof_bounded": price_asof_bounded,
    "price_before_decision": price_before_decision,
    "market_value_asof": market_value_asof,
    "market_value_exact": market_value_exact,
    "ticker_overlaps": ticker_overlaps,
}
