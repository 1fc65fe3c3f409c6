"""Score, ranking and selection queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.operators import calendar, scoring
from tidemark.params import Strategy, strategy_sweep
from tidemark.plans.universe import candidate_grid, trading_price
from tidemark.sources import panel
from tidemark.sources.checkpoints import cut

# The prices start in 1998: a year and a half of history before the first decision.
SWEEP_FIRST = date(1999, 7, 1)


@per_session
def sweep_dates(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.decision_dates(spark, SWEEP_FIRST, panel.last_day(spark, sf))


@per_session
def members(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    return candidate_grid(spark, sf, key).withColumnRenamed("as_of", "decision_date")


def scores(
    spark: SparkSession, sf: str, strategies: tuple[Strategy, ...], key: str = "brand", scorers: tuple[scoring.Scorer, ...] = ()
) -> DataFrame:
    prices = panel.daily_price(spark, sf, key)
    if len({s.ranking for s in strategies}) > 1:
        prices = cut(prices)  # each ranking reads them
    return scoring.all_scores(
        spark, prices, panel.market_cap_of(prices), sweep_dates(spark, sf), strategies, scorers
    )


def ranked(
    spark: SparkSession, sf: str, strategies: tuple[Strategy, ...], key: str = "brand", scorers: tuple[scoring.Scorer, ...] = ()
) -> DataFrame:
    return scoring.rank_scores(
        scores(spark, sf, strategies, key, scorers), members(spark, sf, key), trading_price(spark, sf, key)
    )


def _rank_report(
    spark: SparkSession, sf: str, strategies: tuple[Strategy, ...], key: str = "brand", scorers: tuple[scoring.Scorer, ...] = ()
) -> DataFrame:
    return ranked(spark, sf, strategies, key, scorers).select(
        "kind", "decision_date", "security_id", out(F.col("score")).alias("score"), "rank",
        "tradable_rank", "scored",
    )


def momentum_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_report(spark, sf, tuple(s for s in strategy_sweep() if s.ranking == "momentum"))


def low_volatility_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_report(spark, sf, (Strategy("calm", "low_volatility", 126),))


def market_cap_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_report(spark, sf, (Strategy("large", "market_cap"),))


def reversal(prices: DataFrame, dates: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """The losers first: momentum of the same windows, turned round."""
    rows = scoring.momentum_scores(prices.sparkSession, prices, dates, windows)
    window = F.split("kind", "_")
    return rows.select(
        "security_id", "decision_date", window[1].cast("int").alias("lookback"), window[2].cast("int").alias("skip"),
        (F.lit(0.0) - F.col("score")).alias("score"),
    )


REVERSAL = scoring.Scorer("reversal", ("prices", "dates"), reversal)


def reversal_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by a scorer that is not the library's own, registered the way a user would."""
    strategies = (Strategy("losers", "reversal", 63, 0), Strategy("older-losers", "reversal", 126, 21))
    return _rank_report(spark, sf, strategies, scorers=(REVERSAL,))


@per_session
def market_series(spark: SparkSession, sf: str) -> DataFrame:
    """The market: mean adjusted close of all securities per open day."""
    return trading_price(spark, sf).groupBy("price_date").agg(
        F.sum("adjusted_close").alias("_s"), F.count("*").alias("_n")
    ).select(
        F.lit("SPY").alias("symbol"), "price_date",
        F.round(F.col("_s").cast("double") / F.col("_n"), 6).alias("adjusted_close"),
    )


def trend_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The trend signal of every decision date, also the early ones that are too short."""
    dates = calendar.decision_dates(spark, date(1998, 2, 1), panel.last_day(spark, sf))
    return scoring.trend_signal(market_series(spark, sf), dates, [150, 200], "SPY")


# The sweep with holdings that fit 25 securities: the top_n of the study is divided by ten.
SWEEP = tuple(
    Strategy(
        s.version, s.ranking, s.lookback, s.skip,
        None if s.top_n is None else s.top_n // 10, s.trend_days, s.trend_symbol,
    )
    for s in strategy_sweep()
)


@per_session
def trend_of_sweep(spark: SparkSession, sf: str, lengths: tuple[int, ...]) -> DataFrame:
    """The trend signal of every date of the sweep; refused if one of them has none."""
    signal = scoring.trend_signal(market_series(spark, sf), sweep_dates(spark, sf), list(lengths), "SPY")
    return scoring.require_signal(cut(signal))


def holdings(
    spark: SparkSession, sf: str, strategies: tuple[Strategy, ...] = SWEEP, key: str = "brand"
) -> DataFrame:
    trend = sorted({s.trend_days for s in strategies if s.trend_days})
    signal = trend_of_sweep(spark, sf, tuple(trend)) if trend else None
    return scoring.select_holdings(
        ranked(spark, sf, strategies, key), scoring.strategy_table(spark, strategies), signal
    )


def sweep_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """What each of the 31 strategies holds from each decision date on."""
    return holdings(spark, sf).select(
        "strategy", "decision_date", "security_id", "rank", "held", out(F.col("weight")).alias("weight")
    )


def wide_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """All momentum ranks on a market with a security per supplier."""
    strategies = tuple(s for s in strategy_sweep() if s.ranking == "momentum")
    return _rank_report(spark, sf, strategies, "supplier")


QUERIES = {
    "wide_momentum": wide_momentum,
    "momentum_rank": momentum_rank,
    "low_volatility_rank": low_volatility_rank,
    "market_cap_rank": market_cap_rank,
    "reversal_rank": reversal_rank,
    "trend_filter": trend_filter,
    "sweep_holdings": sweep_holdings,
}
