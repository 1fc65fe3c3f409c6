"""Performance queries over index series (mean adjusted close per industry) and the sweep."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.operators import analytics, net_value, portfolio
from tidemark.plans.portfolio import COSTS, build_panel
from tidemark.plans.universe import trading_price
from tidemark.sources import panel

SERIES = ("Industrial", "Software", "Tobacco")


@per_session
def index_series(spark: SparkSession, sf: str) -> DataFrame:
    """[series, day, nav]: mean adjusted close per industry and open day."""
    rows = trading_price(spark, sf).join(
        panel.security(spark, sf).select("security_id", "industry"), "security_id"
    )
    return rows.groupBy(F.col("industry").alias("series"), F.col("price_date").alias("day")).agg(
        F.round(F.sum("adjusted_close").cast("double") / F.count("*"), 6).alias("nav")
    )


def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.daily_returns(index_series(spark, sf))
    return rows.select("series", "day", out(F.col("ret")).alias("ret"))


def performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.summary(index_series(spark, sf))
    figures = (
        "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "best_month",
        "worst_month",
    )
    return rows.select(
        "series", "first_day", "last_day", "trading_days", "peak_day", "trough_day", "months",
        "positive_months", *[out(F.col(c)).alias(c) for c in figures],
    )


def drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    """The worst fall of every single security."""
    nav = trading_price(spark, sf).select(
        F.col("security_id").alias("series"), F.col("price_date").alias("day"),
        F.col("adjusted_close").cast("double").alias("nav"),
    )
    rows = analytics.max_drawdown(nav)
    return rows.withColumn("max_drawdown", out(F.col("max_drawdown")))


def monthly_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.period_returns(index_series(spark, sf), "month")
    return rows.withColumn("ret", out(F.col("ret")))


def yearly_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.period_returns(index_series(spark, sf), "year")
    return rows.withColumn("ret", out(F.col("ret")))


def rebased_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.rebase(index_series(spark, sf), date(1999, 3, 1), date(2000, 6, 30))
    return rows.withColumn("nav", out(F.col("nav"), 4))


def common_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.common_window(index_series(spark, sf))
    return rows.withColumn("nav", out(F.col("nav"), 4))


def calendar_year_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = analytics.calendar_year_table(index_series(spark, sf), SERIES)
    return rows.select("year", *[out(F.col(s)).alias(s) for s in SERIES])


def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row per strategy and cost case: figures of the net value with turnover and costs."""
    p = build_panel(spark, sf)
    net = net_value.net_nav(p.deltas, p.factors, COSTS)
    start = net.select("strategy", "slippage", "decision_date", "nav_after")
    name = F.concat_ws("/", "strategy", "slippage")
    nav = portfolio.daily_nav(p.grown, start, "nav_after").select(name.alias("series"), "day", "nav")
    moved = p.deltas.groupBy("strategy", "decision_date").agg(F.sum(F.abs("delta")).alias("_w"))
    held = p.holdings.groupBy("strategy", "decision_date").agg(F.count("*").alias("_held"))
    keys = ["strategy", "decision_date"]
    trading = (
        net.join(moved, keys, "left")
        .join(held, keys, "left")
        .na.fill(0, ["_w", "_held"])
        .groupBy(name.alias("series"))
        .agg(
            F.sum(F.col("_w") * F.col("nav_before")).alias("traded_value"),
            F.sum("costs").alias("costs"),
            F.avg("_held").alias("average_holdings"),
            F.count("*").alias("rebalances"),
        )
    )
    rows = analytics.summary(nav, trading)
    return rows.select(
        "series", "trading_days", "months", "positive_months", "rebalances",
        out(F.log1p("total_return")).alias("log_growth"), out(F.col("sharpe")).alias("sharpe"),
        out(F.col("max_drawdown")).alias("max_drawdown"),
        out(F.col("annual_turnover")).alias("annual_turnover"),
        out(F.log("costs_fraction_of_start_nav")).alias("log_costs"),
        out(F.col("average_holdings")).alias("average_holdings"),
    )


QUERIES = {
    "daily_returns": daily_returns,
    "performance_summary": performance_summary,
    "drawdowns": drawdowns,
    "monthly_returns": monthly_returns,
    "yearly_returns": yearly_returns,
    "rebased_series": rebased_series,
    "common_window": common_window,
    "calendar_year_table": calendar_year_table,
    "strategy_summary": strategy_summary,
}
