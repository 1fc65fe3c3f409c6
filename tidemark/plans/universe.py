"""Universe queries: all decision dates in one job."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.operators import asof, calendar, universe
from tidemark.params import QualityThresholds, UniverseRules
from tidemark.plans.quality import all_findings
from tidemark.plans.screening import FIRST_MONTH, classification
from tidemark.plans.temporal import asof_grid, decisions
from tidemark.sources import panel
from tidemark.sources.checkpoints import cut

RULES = UniverseRules()
# The given prices are noisy: only moves by a factor of 200 count as suspicious here.
QUALITY = QualityThresholds(max_daily_move=Decimal(200), split_ratio=Decimal(200))


def on_open_days(spark: SparkSession, prices: DataFrame) -> DataFrame:
    """Prices on open days only (the calendar is broadcast: fixed size)."""
    open_days = calendar.trading_days(spark).select(F.col("day").alias("price_date"))
    return prices.join(F.broadcast(open_days), "price_date", "left_semi")


@per_session
def trading_price(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    return on_open_days(spark, panel.daily_price(spark, sf, key))


@per_session
def as_of_dates(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).withColumnRenamed("decision_date", "as_of")


def status_in_effect(
    spark: SparkSession, sf: str, values: list[str], key: str = "brand", caps: DataFrame | None = None
) -> DataFrame:
    records = classification(spark, sf, key, caps=caps) if caps is not None else classification(spark, sf, key)
    return asof.in_effect_monthly(
        records, as_of_dates(spark, sf), ["security_id"], "as_of", "effective_from", "effective_to",
        values, "screening_date",
    ).drop("screening_date")


@per_session
def candidate_grid(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    securities = panel.security(spark, sf, key)
    grid = asof_grid(securities, as_of_dates(spark, sf).select("month_no", "as_of"), "as_of", panel.last_day(spark, sf))
    return universe.candidates(securities, grid, RULES)


def universe_table(
    spark: SparkSession, sf: str, key: str = "brand", rules: UniverseRules = RULES
) -> DataFrame:
    """[as_of, security_id, ..., reason] of all candidates; reason NULL = eligible.

    Six parts of the job read prices: they are derived once and stored.
    """
    stored = cut(panel.daily_price(spark, sf, key))
    prices, caps = on_open_days(spark, stored), panel.market_cap_of(stored)
    findings = all_findings(spark, sf, QUALITY, key, prices=prices, caps=caps, details=False)
    assessed = universe.assess(
        spark, candidate_grid(spark, sf, key), as_of_dates(spark, sf),
        status_in_effect(spark, sf, ["status"], key, caps), prices, findings, rules,
    )
    return universe.build(assessed, panel.security(spark, sf, key), panel.security_ticker(spark, sf, key))


def universe_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Per decision date: how many securities are eligible and why not the others."""
    return universe.funnel(universe_table(spark, sf))


def quality_cover(spark: SparkSession, sf: str) -> DataFrame:
    """[as_of, run_id]: quality runs at the end of each month but every fourth, over two months; the liquidity window must lie inside."""
    px = panel.daily_price(spark, sf)
    month = calendar.month_no(F.col("price_date"))
    runs = px.groupBy(month.cast("bigint").alias("id")).agg(F.max("price_date").alias("last_date")).filter("id % 4 <> 0")
    runs = runs.withColumn("first_date", F.trunc(F.add_months("last_date", -2), "month"))
    dates = as_of_dates(spark, sf).select("as_of", F.date_sub("as_of", 28).alias("first"), F.date_sub("as_of", 1).alias("last"))
    return universe.covering_runs(dates, runs)


def universe_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel with the gate: dates that no quality run covers are refused, with all their candidates."""
    return universe.funnel(universe.gated(universe_table(spark, sf), quality_cover(spark, sf)))


def universe_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = universe.members(universe_table(spark, sf))
    return rows.withColumn("median_usd", out(F.col("median_usd"), 2))


def universe_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return universe.content_hash(universe_table(spark, sf), RULES)


def universe_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_grid(spark, sf)


def median_dollar_volume(spark: SparkSession, sf: str) -> DataFrame:
    got = universe.median_dollar_volume(
        spark, trading_price(spark, sf), as_of_dates(spark, sf).select("as_of", "td_index"), 20
    )
    return got.withColumn("median_usd", out(F.col("median_usd"), 4))


def share_class_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups among all candidates of each date, without the earlier rules."""
    grid = candidate_grid(spark, sf)
    return universe.share_class_groups(
        grid, panel.security(spark, sf), panel.security_ticker(spark, sf)
    )


def largest_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = universe.largest_members(
        universe_table(spark, sf), panel.security(spark, sf), panel.security_ticker(spark, sf),
        panel.daily_market_cap(spark, sf), status_in_effect(spark, sf, ["reason"]),
        as_of_dates(spark, sf).select("month_no", "as_of"), FIRST_MONTH, 3,
    )
    return rows.select(
        "as_of", "place", "security_id", "ticker", "company_name",
        out(F.col("market_cap_usd"), 2).alias("market_cap_usd"), F.col("reason").alias("why"),
    )


def wide_universe(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel of a market with a security per supplier."""
    return universe.funnel(universe_table(spark, sf, "supplier"))


QUERIES = {
    "wide_universe": wide_universe,
    "universe_funnel": universe_funnel,
    "quality_cover": quality_cover,
    "universe_gate": universe_gate,
    "universe_members": universe_members,
    "universe_fingerprint": universe_fingerprint,
    "universe_candidates": universe_candidates,
    "median_dollar_volume": median_dollar_volume,
    "share_class_groups": share_class_groups,
    "largest_members": largest_members,
}
