"""Portfolio queries: the whole sweep, all months, all cost cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import fingerprint, row_text
from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.operators import net_value, portfolio, reports, scoring
from tidemark.params import Costs
from tidemark.plans.scoring import SWEEP, holdings, members, ranked, sweep_dates, trend_of_sweep
from tidemark.plans.universe import status_in_effect, trading_price
from tidemark.sources import panel
from tidemark.sources.checkpoints import cut, scratch

COSTS = Costs()
# The given prices are noisy and compound to huge values: logs and rates are reported.
def net_figures() -> list[Column]:
    return [
        out(F.log("nav_before")).alias("log_before"),
        out(F.col("costs") / F.col("nav_before"), 8).alias("cost_rate"),
        out(F.log("nav_after")).alias("log_after"),
    ]


@dataclass
class Panel:
    holdings: DataFrame
    path: DataFrame
    grown: DataFrame
    factors: DataFrame
    deltas: DataFrame


def build_panel(spark: SparkSession, sf: str, strategies=SWEEP, key: str = "brand") -> Panel:
    """Holdings and what follows from them. Holdings and paths are read several times, so they are stored."""
    held = cut(holdings(spark, sf, strategies, key))
    days = portfolio.month_days(spark, sweep_dates(spark, sf), panel.last_day(spark, sf))
    path = cut(portfolio.paths(held, trading_price(spark, sf, key), days))
    grown = cut(portfolio.growth(held, path, days, [s.version for s in strategies]))
    factors = portfolio.month_factors(grown)
    return Panel(held, path, grown, factors, portfolio.order_deltas(held, path, grown, factors))


def portfolio_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_panel(spark, sf).path
    return rows.select(
        "decision_date", "security_id", "day", out(F.col("rel")).alias("rel"),
        out(F.col("unadjusted")).alias("unadjusted"),
    )


def gross_nav(spark: SparkSession, sf: str) -> DataFrame:
    p = build_panel(spark, sf)
    start = p.factors.select("strategy", "decision_date", "nav_before")
    nav = portfolio.daily_nav(p.grown, start, "nav_before")
    return nav.select("strategy", F.col("day").alias("date"), out(F.log("nav")).alias("log_nav"))


def order_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_panel(spark, sf).deltas
    return rows.filter(F.abs("delta") * F.col("nav_before") >= portfolio.CENT).select(
        "strategy", "decision_date", "security_id", "side", "kind",
        *[out(F.col(c)).alias(c) for c in ("before", "target", "delta", "unadjusted")],
    )


def order_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of all orders at the gross value, per strategy, date and slippage case."""
    rows = portfolio.priced_orders(build_panel(spark, sf).deltas, COSTS)
    return rows.groupBy("strategy", "decision_date", "slippage").agg(
        F.count("*").alias("orders"), out(F.sum(F.col("notional") / F.col("nav_before"))).alias("traded"),
        out(F.sum("cost") / F.sum("notional"), 8).alias("cost_rate"),
    )


def net_nav(spark: SparkSession, sf: str) -> DataFrame:
    """Value before and after costs at every decision date."""
    p = build_panel(spark, sf)
    rows = net_value.net_nav(p.deltas, p.factors, COSTS)
    return rows.select(
        "strategy", "slippage", "decision_date",
        *net_figures(),
    )


def rebalance_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = build_panel(spark, sf)
    net = net_value.net_nav(p.deltas, p.factors, COSTS)
    rows = portfolio.rebalance_summary(
        net, p.deltas, p.holdings, ranked(spark, sf, SWEEP), members(spark, sf),
        scoring.strategy_table(spark, SWEEP),
    )
    return rows.select(
        "strategy", "slippage", "decision_date", "eligible", "scored", "selected",
        out(F.col("turnover")).alias("turnover"),
        *net_figures(),
    )


def trade_reasons(spark: SparkSession, sf: str) -> DataFrame:
    p = build_panel(spark, sf)
    dates = sweep_dates(spark, sf)
    orders = p.deltas.filter(F.abs("delta") * F.col("nav_before") >= portfolio.CENT).select(
        "strategy", "decision_date", "security_id", "delta", F.col("kind").alias("kind_of_trade")
    )
    rank = cut(ranked(spark, sf, SWEEP))
    status = status_in_effect(spark, sf, ["status", "reason"]).select(
        "security_id", F.col("as_of").alias("decision_date"), "status", F.col("reason").alias("why")
    )
    pairs = sorted({(s.lookback, s.skip) for s in SWEEP if s.ranking == "momentum"})
    windows = scoring.momentum_windows(spark, dates, pairs)
    calm = scoring.momentum_windows(spark, dates, [(126, 0)]).withColumn("kind", F.lit("low_volatility_126"))
    large = dates.select(
        "decision_date", F.lit("market_cap").alias("kind"), F.col("prev_td").alias("window_start"),
        F.col("prev_td").alias("window_end"),
    )
    off = trend_of_sweep(spark, sf, (150, 200)).filter(~F.col("risk_on")).select("decision_date", "trend_days")
    rows = portfolio.trade_reasons(
        orders, scoring.strategy_table(spark, SWEEP), rank, members(spark, sf), status,
        windows.unionByName(calm).unionByName(large), off,
    )
    return rows.select(
        "strategy", "decision_date", "security_id", "kind_of_trade", "cause", "rank", "ranked", out(F.col("score")).alias("score"),
        "window_start", "window_end", "status",
    )


def nav_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings fingerprint per strategy: the same inputs must give the same value."""
    held = holdings(spark, sf)
    text = row_text(F.col("decision_date"), F.col("security_id"), F.col("rank"), F.col("held"))
    return fingerprint(held, text, ["strategy"])


def _run_results(net: DataFrame) -> DataFrame:
    """[strategy_version, slippage_case, row_count, result_sha256] of net values to the hundredth of a percent."""
    value = F.round(F.log("nav_after") * 10_000).cast("bigint")
    return fingerprint(net, row_text(F.col("decision_date"), value), ["strategy", "slippage"]).select(
        F.col("strategy").alias("strategy_version"), F.col("slippage").alias("slippage_case"), "row_count",
        F.col("sha256").alias("result_sha256"),
    )


@per_session
def run_store(spark: SparkSession, sf: str) -> str:
    """A folder with the records of one run per strategy and case. One record is not what the computation gives: the value
    of one date was changed before it was written."""
    p = build_panel(spark, sf)
    net = cut(net_value.net_nav(p.deltas, p.factors, COSTS))
    wrong = (F.col("strategy") == "momentum-v1") & (F.col("slippage") == "base")
    first = net.agg(F.min("decision_date").alias("_first"))
    written = net.join(F.broadcast(first)).withColumn(  # one row
        "nav_after", F.when(wrong & (F.col("decision_date") == F.col("_first")), F.col("nav_after") * 2).otherwise(F.col("nav_after"))
    )
    figures = net.groupBy("strategy", "slippage").agg(F.max("nav_after").alias("_high"), F.min("decision_date").alias("first_date"), F.max("decision_date").alias("last_date"))
    rows = _run_results(written).join(
        figures.withColumnsRenamed({"strategy": "strategy_version", "slippage": "slippage_case"}), ["strategy_version", "slippage_case"]
    )
    path = scratch(spark)
    rows.select(
        F.pmod(F.xxhash64("strategy_version", "slippage_case"), F.lit(1 << 40)).alias("id"), "strategy_version", "slippage_case",
        portfolio.period_label(F.col("first_date"), F.col("last_date")).alias("period_name"), "row_count", "result_sha256",
        F.sha2(row_text(F.col("strategy_version"), F.col("slippage_case"), F.col("first_date"), F.col("last_date")), 256).alias("run_key"),
        F.struct(
            F.lit(None).cast("double").alias("cagr"), F.lit(None).cast("double").alias("volatility"),
            F.lit(None).cast("double").alias("sharpe"), F.col("_high").alias("max_drawdown"),
        ).alias("metrics"),
    ).write.parquet(f"{path}/runs")
    return f"{path}/runs"


RUNS = (
    "id bigint, strategy_version string, slippage_case string, period_name string, row_count bigint, result_sha256 string, "
    "run_key string, metrics struct<cagr:double,volatility:double,sharpe:double,max_drawdown:double>"
)


def reproducibility(spark: SparkSession, sf: str) -> DataFrame:
    """Stored runs against the computation repeated: which results are the same."""
    stored = spark.read.schema(RUNS).parquet(run_store(spark, sf))
    p = build_panel(spark, sf)
    again = _run_results(net_value.net_nav(p.deltas, p.factors, COSTS))
    keys = ["strategy_version", "slippage_case"]
    pairs = stored.select(*keys, F.col("result_sha256").alias("_stored")).join(again.select(*keys, "result_sha256"), keys, "full")
    return pairs.select(*keys, F.col("_stored").eqNullSafe(F.col("result_sha256")).alias("same"))


def stored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The stored runs of one period and version prefix."""
    stored = spark.read.schema(RUNS).parquet(run_store(spark, sf))
    return reports.stored_runs(stored, "custom", "momentum_l", 1000).select("strategy_version", "slippage_case")


def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The research period of each price day, and of each security's whole history."""
    px = panel.daily_price(spark, sf)
    days = px.select("price_date").distinct().select(
        F.lit("day").alias("what"), F.col("price_date").alias("first"), F.col("price_date").alias("last")
    )
    runs = px.groupBy("security_id").agg(
        F.min("price_date").alias("first"), F.max("price_date").alias("last")
    ).select(F.concat(F.lit("run "), F.col("security_id").cast("string")).alias("what"), "first", "last")
    both = days.unionByName(runs)
    return both.withColumn("period", portfolio.period_label(F.col("first"), F.col("last")))


def whole_share_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Two portfolios: holdings are the positive positions of even and of odd orders."""
    fills = panel.order_fill(spark, sf)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = (
        fills.groupBy((F.col("order_id") % 2).alias("portfolio"), "symbol")
        .agg(F.sum(signed).alias("q"))
        .filter("q > 0")
        .select("portfolio", "symbol", F.floor("q").alias("held"))
    )
    last = panel.daily_price(spark, sf).groupBy("security_id").agg(
        F.max_by("close", "price_date").alias("last_price")
    )
    # Among the targets: a price of zero, one that is missing, and one that is missing everywhere; a held name has none either.
    s = F.col("security_id")
    prices = last.filter("security_id NOT IN (13, 14)").select(F.concat(F.lit("T"), s.cast("string")).alias("symbol"), "last_price")
    targets = last.filter("last_price < 40000 OR security_id IN (11, 12, 14)").filter("security_id <> 13").select(
        F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("portfolio"),
        F.concat(F.lit("T"), s.cast("string")).alias("symbol"),
        F.when(s == 11, 0).when(~s.isin(12, 14), F.col("last_price")).cast("decimal(18,2)").alias("price"),
    )
    nav = fills.groupBy((F.col("order_id") % 2).alias("portfolio")).agg(
        (F.sum("quantity") * 100).cast("decimal(24,4)").alias("nav")
    )
    rows = portfolio.whole_share_orders(targets, held, prices, nav)
    return rows.select(
        "portfolio", "symbol", "side", F.col("quantity").cast("bigint").alias("quantity"),
        out(F.col("price")).alias("price"), "reason",
    )


QUERIES = {
    "portfolio_paths": portfolio_paths,
    "gross_nav": gross_nav,
    "order_deltas": order_deltas,
    "order_costs": order_costs,
    "net_nav": net_nav,
    "rebalance_summary": rebalance_summary,
    "trade_reasons": trade_reasons,
    "nav_fingerprint": nav_fingerprint,
    "reproducibility": reproducibility,
    "stored_runs": stored_runs,
    "period_labels": period_labels,
    "whole_share_orders": whole_share_orders,
}
