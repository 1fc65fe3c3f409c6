"""Performance figures per series. A series has one value per day, so its windows are bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.params import DAYS_PER_YEAR, START_NAV, TRADING_DAYS_PER_YEAR

YEAR = float(TRADING_DAYS_PER_YEAR)


def daily_returns(nav: DataFrame) -> DataFrame:
    """[series, day, nav, ret]: NULL on the first day."""
    w = W.partitionBy("series").orderBy("day")
    prev = F.lag("nav").over(w)
    return nav.withColumn("ret", F.when(prev > 0, F.col("nav") / prev - 1))


def growth_figures(nav: DataFrame) -> DataFrame:
    """[series, first_day, last_day, trading_days, total_return, cagr, average_nav]."""
    ends = nav.groupBy("series").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count("*").alias("trading_days"),
        F.min_by("nav", "day").alias("_a"), F.max_by("nav", "day").alias("_b"),
        F.avg("nav").alias("average_nav"),
    )
    grown = F.when((F.col("trading_days") >= 2) & (F.col("_a") > 0), F.col("_b") / F.col("_a") - 1)
    years = F.datediff("last_day", "first_day") / F.lit(DAYS_PER_YEAR)
    cagr = F.when(
        grown.isNotNull() & (years > 0),
        F.when(grown > -1, F.pow(1 + grown, 1 / years) - 1).otherwise(-1.0),
    )
    return ends.withColumns({"total_return": grown, "cagr": cagr, "years": years}).withColumnRenamed(
        "_a", "start_nav"
    ).drop("_b")


def risk_figures(returns: DataFrame) -> DataFrame:
    """[series, volatility, sharpe, sortino]; the risk-free rate is zero."""
    # The first day has no return; least() alone would count it as zero.
    down = F.when(F.col("ret").isNotNull(), F.pow(F.least(F.col("ret"), F.lit(0.0)), 2))
    s = returns.groupBy("series").agg(
        F.count("ret").alias("_n"), F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_dev"), F.sqrt(F.avg(down)).alias("_down"),
    )
    root = F.sqrt(F.lit(YEAR))
    enough = F.col("_n") >= 2
    return s.select(
        "series",
        F.when(enough, F.col("_dev") * root).alias("volatility"),
        F.when(enough & (F.col("_dev") > 0), F.col("_mean") * YEAR / (F.col("_dev") * root)).alias("sharpe"),
        F.when(enough & (F.col("_down") > 0), F.col("_mean") * YEAR / (F.col("_down") * root)).alias("sortino"),
    )


def max_drawdown(nav: DataFrame) -> DataFrame:
    """[series, max_drawdown, peak_day, trough_day]: the first worst fall from a peak.

    The running maximum carries the earliest day it was reached: a new peak must be strictly higher.
    """
    w = W.partitionBy("series").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    top = F.max(F.struct(F.col("nav"), (-F.unix_date("day")).alias("_age"))).over(w)
    rows = nav.withColumn("_top", top).select(
        "series", "day", (F.col("nav") / F.col("_top.nav") - 1).alias("dd"),
        F.date_from_unix_date(-F.col("_top._age")).alias("peak"),
    )
    worst = rows.groupBy("series").agg(F.min(F.struct("dd", "day", "peak")).alias("m"))
    fell = F.col("m.dd") < 0
    return worst.select(
        "series", F.when(fell, F.col("m.dd")).otherwise(0.0).alias("max_drawdown"),
        F.when(fell, F.col("m.peak")).alias("peak_day"), F.when(fell, F.col("m.day")).alias("trough_day"),
    )


def period_returns(nav: DataFrame, unit: str) -> DataFrame:
    """[series, period, ret] per month or year, from the last value of the period before.

    The first period is measured from the first value of the series.
    """
    last = nav.groupBy("series", F.trunc("day", unit).alias("period")).agg(
        F.max_by("nav", "day").alias("_last"), F.min_by("nav", "day").alias("_first")
    )
    w = W.partitionBy("series").orderBy("period")
    before = F.coalesce(F.lag("_last").over(w), F.col("_first"))
    return last.withColumn("_before", before).filter("_before > 0").select(
        "series", "period", (F.col("_last") / F.col("_before") - 1).alias("ret")
    )


def summary(nav: DataFrame, trading: DataFrame | None = None) -> DataFrame:
    """One row of figures per series.

    trading: [series, traded_value, costs, average_holdings], where known.
    """
    months = period_returns(nav, "month").groupBy("series").agg(
        F.count("*").alias("months"), F.count(F.when(F.col("ret") > 0, 1)).alias("positive_months"),
        F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"),
    )
    rows = (
        growth_figures(nav)
        .join(risk_figures(daily_returns(nav)), "series")
        .join(max_drawdown(nav), "series")
        .join(months, "series")
    )
    if trading is None:
        return rows.drop("years", "average_nav", "start_nav")
    rows = rows.join(trading, "series", "left")
    turnover = F.when(
        (F.col("years") > 0) & (F.col("average_nav") > 0),
        F.col("traded_value") / 2 / F.col("average_nav") / F.col("years"),
    )
    return rows.withColumns(
        {"annual_turnover": turnover, "costs_fraction_of_start_nav": F.col("costs") / F.col("start_nav")}
    ).drop("years", "average_nav", "start_nav", "traded_value", "costs")


def rebase(nav: DataFrame, first: object | None = None, last: object | None = None) -> DataFrame:
    """The part of each series in [first, last], scaled to start at the common value."""
    inside = nav
    if first is not None:
        inside = inside.filter(F.col("day") >= F.lit(first))
    if last is not None:
        inside = inside.filter(F.col("day") <= F.lit(last))
    base = F.first("nav").over(W.partitionBy("series").orderBy("day"))
    return inside.withColumn("_base", base).filter("_base > 0").select(
        "series", "day", (F.lit(float(START_NAV)) * F.col("nav") / F.col("_base")).alias("nav")
    )


def common_window(nav: DataFrame) -> DataFrame:
    """Every series cut to the days all of them have, restarted at the common value."""
    total = nav.agg(F.count_distinct("series").alias("_all"))
    shared = (
        nav.groupBy("day")
        .agg(F.count("*").alias("_n"))
        .join(F.broadcast(total))  # one row
        .filter("_n = _all")
        .select("day")
    )
    return rebase(nav.join(shared, "day", "left_semi"))


def calendar_year_table(nav: DataFrame, series: Sequence[str]) -> DataFrame:
    """Years down, series across."""
    rows = period_returns(nav, "year").withColumn("year", F.year("period").cast("bigint"))
    return rows.groupBy("year").pivot("series", list(series)).agg(F.first("ret"))
