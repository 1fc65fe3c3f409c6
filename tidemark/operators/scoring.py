"""Scores and selection for many strategies at once.

Scores depend on (ranking, lookback, skip), not on the whole strategy, so each is computed once and
strategies fan out only after the ranking. Every window ends before the decision date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import asof, calendar
from tidemark.operators.ranking import rank_in_groups
from tidemark.params import MAX_PRICE_AGE_DAYS, Strategy


class TrendError(Exception):
    """The market series cannot give the average asked for."""


@dataclass(frozen=True)
class Scorer:
    """A caller's ranking, for strategies with its name.

    `inputs` are of prices, values and dates; `score` gets them, in order, and all (lookback, skip) that the strategies ask for, and gives
    [security_id, decision_date, lookback, skip, score], higher scores first in rank.
    """

    ranking: str
    inputs: tuple[str, ...]
    score: Callable[..., DataFrame]


def score_kind(s: Strategy) -> str:
    """Strategies of one kind share their scores."""
    if s.ranking == "market_cap":
        return "market_cap"
    if s.ranking == "low_volatility":
        return f"low_volatility_{s.lookback}"
    return f"{s.ranking}_{s.lookback}_{s.skip}"


def strategy_table(spark: SparkSession, strategies: Iterable[Strategy]) -> DataFrame:
    """The sweep as a table; a fixed handful of rows."""
    rows = [
        (s.version, score_kind(s), s.ranking, s.lookback, s.skip, s.top_n, s.trend_days)
        for s in strategies
    ]
    return spark.createDataFrame(
        rows,
        "strategy string, kind string, ranking string, lookback int, skip int, top_n int, trend_days int",
    )


def _each(items: list[tuple[int, ...]], *names: str) -> Column:
    """Explode fixed tuples beside every row (no join)."""
    return F.explode(
        F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(i, names, strict=True)]) for i in items])
    )


def momentum_windows(
    spark: SparkSession, dates: DataFrame, pairs: list[tuple[int, int]]
) -> DataFrame:
    """[decision_date, kind, window_start, window_end] per date and (lookback, skip)."""
    w = dates.select("decision_date", "td_index", _each(pairs, "lookback", "skip").alias("p"))
    w = w.select("decision_date", "td_index", "p.*")
    end = F.col("td_index") - F.col("skip")
    w = calendar.shift_back(w, end, "window_end", spark)
    w = calendar.shift_back(w, end - F.col("lookback"), "window_start", spark)
    kind = F.concat_ws("_", F.lit("momentum"), "lookback", "skip")
    return w.select("decision_date", kind.alias("kind"), "window_start", "window_end").filter(
        "window_start IS NOT NULL"
    )


def momentum_scores(
    spark: SparkSession, prices: DataFrame, dates: DataFrame, pairs: list[tuple[int, int]]
) -> DataFrame:
    """[security_id, decision_date, kind, score]: adjusted close at window end over start, minus 1.

    The prices needed are looked up once for the distinct window edges of all kinds; both edges of
    a window then meet in one aggregation.
    """
    windows = momentum_windows(spark, dates, pairs)
    edges = windows.select("decision_date", "kind", F.col("window_end").alias("edge"), F.lit(1).alias("_end"))
    edges = edges.unionByName(
        windows.select("decision_date", "kind", F.col("window_start").alias("edge"), F.lit(0).alias("_end"))
    )
    points = asof.asof_within(
        prices, edges.select("edge"), ["security_id"], "price_date", "edge", ["adjusted_close"],
        lookback=MAX_PRICE_AGE_DAYS, inclusive=True,
    )
    both = (
        points.join(F.broadcast(edges), "edge")
        .groupBy("security_id", "decision_date", "kind")
        .agg(
            F.max(F.when(F.col("_end") == 1, F.col("adjusted_close"))).alias("_last"),
            F.max(F.when(F.col("_end") == 0, F.col("adjusted_close"))).alias("_first"),
        )
    )
    score = F.col("_last").cast("double") / F.col("_first").cast("double") - 1
    return both.filter("_last IS NOT NULL AND _first > 0").select(
        "security_id", "decision_date", "kind", score.alias("score")
    )


def low_volatility_scores(
    spark: SparkSession, prices: DataFrame, dates: DataFrame, lookbacks: list[int]
) -> DataFrame:
    """[security_id, decision_date, kind, score]: minus the population deviation of daily returns.

    The window holds lookback + 1 trading days and needs closes on 80% of `lookback`. Where a window begins or has ended, the calendar
    is cut into blocks, so a window is a run of whole blocks. Every price goes into one block: per security and block a count, the
    least close and the moments of the returns within it are kept, and apart from them the return that leads into the
    block, which counts for a window only if the close before it does. Blocks, not prices, meet the windows over them.
    """
    w = dates.select(
        "decision_date", "td_index", F.col("prev_td").alias("window_end"),
        _each([(n,) for n in lookbacks], "lookback").alias("p"),
    ).select("decision_date", "td_index", "window_end", "p.*")
    w = calendar.shift_back(w, F.col("td_index") - F.col("lookback"), "window_start", spark).filter(
        "window_start IS NOT NULL"
    )
    days = w.select(
        "decision_date", "lookback", "window_start", F.explode(F.sequence("window_start", "window_end")).alias("price_date")
    )
    edges = w.select(F.explode(F.array("window_start", F.date_add("window_end", 1))).alias("price_date")).distinct()
    marked = days.select("price_date").distinct().join(edges.withColumn("_edge", F.col("price_date")), "price_date", "left")
    so_far = W.orderBy("price_date")  # a calendar's worth of rows
    blocks = marked.select("price_date", F.max("_edge").over(so_far).alias("block"))
    cover = days.join(blocks, "price_date").select("decision_date", "lookback", "window_start", "block").distinct()

    by_day = W.partitionBy("security_id").orderBy("price_date")
    close = F.col("adjusted_close").cast("double")
    moves = prices.select(
        "security_id", "price_date", close.alias("close"),
        F.lag("price_date").over(by_day).alias("prev_date"),
        (F.try_divide(close, F.lag(close).over(by_day)) - 1).alias("move"),
    )
    within = F.when(F.col("prev_date") >= F.col("block"), F.col("move"))
    led_in = F.when(F.col("prev_date") < F.col("block"), F.struct("price_date", "prev_date", "move"))
    moments = (
        moves.join(F.broadcast(blocks), "price_date")
        .groupBy("security_id", "block")
        .agg(
            F.count("*").alias("closes"), F.min("close").alias("low"), F.count(within).alias("n"),
            F.coalesce(F.avg(within), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(within), F.lit(0.0)).alias("variance"),
            F.min(led_in).alias("led"),
        )
    )
    first = F.when(F.col("led.prev_date") >= F.col("window_start"), F.col("led.move"))
    n = F.sum("n") + F.count(first)
    total = F.sum(F.col("n") * F.col("mean")) + F.coalesce(F.sum(first), F.lit(0.0))
    squares = F.sum(F.col("n") * F.col("mean") * F.col("mean")) + F.coalesce(F.sum(first * first), F.lit(0.0))
    stats = (
        moments.join(F.broadcast(cover), "block")
        .groupBy("security_id", "decision_date", "lookback")
        .agg(
            F.sum("closes").alias("_n"), F.min("low").alias("_low"), n.alias("_moves"), total.alias("_total"),
            squares.alias("_squares"), F.sum(F.col("n") * F.col("variance")).alias("_within"),
        )
    )
    # What the means of blocks differ by; next to nothing is the rounding of equal means.
    between = F.col("_squares") - F.try_divide(F.col("_total") * F.col("_total"), F.col("_moves"))
    between = F.when(between > F.col("_squares") * 1e-13, between).otherwise(0.0)
    deviation = F.sqrt(F.try_divide(F.col("_within") + between, F.col("_moves")))
    stats = stats.withColumn("_dev", F.when(F.col("_moves") > 0, deviation))
    enough = (F.col("_n") >= F.floor(F.col("lookback") * 4 / 5)) & (F.col("_low") > 0)
    kind = F.concat_ws("_", F.lit("low_volatility"), "lookback")
    return stats.filter(enough & F.col("_dev").isNotNull()).select(
        "security_id", "decision_date", kind.alias("kind"), (-F.col("_dev")).alias("score")
    )


def market_cap_scores(caps: DataFrame, dates: DataFrame) -> DataFrame:
    """[security_id, decision_date, kind, score]: positive market value at the last close before."""
    at = asof.asof_within(
        caps, dates, ["security_id"], "cap_date", "prev_td", ["market_cap_usd"],
        lookback=MAX_PRICE_AGE_DAYS, inclusive=True,
    )
    return at.join(F.broadcast(dates.select("decision_date", "prev_td")), "prev_td").filter(
        "market_cap_usd > 0"
    ).select(
        "security_id", "decision_date", F.lit("market_cap").alias("kind"),
        F.col("market_cap_usd").cast("double").alias("score"),
    )


def all_scores(
    spark: SparkSession,
    prices: DataFrame,
    caps: DataFrame,
    dates: DataFrame,
    strategies: Iterable[Strategy],
    scorers: Iterable[Scorer] = (),
) -> DataFrame:
    """The scores of every kind the strategies need; rankings that are neither the library's nor a scorer's are refused."""
    strategies, given = list(strategies), {s.ranking: s for s in scorers}
    unknown = sorted({s.ranking for s in strategies} - {"momentum", "low_volatility", "market_cap", *given})
    if unknown:
        raise ValueError(f"no scorer for {', '.join(unknown)}")
    pairs = sorted({(s.lookback, s.skip) for s in strategies if s.ranking == "momentum"})
    calm = sorted({s.lookback for s in strategies if s.ranking == "low_volatility"})
    parts = []
    if pairs:
        parts.append(momentum_scores(spark, prices, dates, pairs))
    if calm:
        parts.append(low_volatility_scores(spark, prices, dates, calm))
    if any(s.ranking == "market_cap" for s in strategies):
        parts.append(market_cap_scores(caps, dates))
    tables = {"prices": prices, "values": caps, "dates": dates}
    for ranking, scorer in given.items():
        asked = sorted({(s.lookback, s.skip) for s in strategies if s.ranking == ranking})
        if asked:
            rows = scorer.score(*(tables[i] for i in scorer.inputs), asked)
            kind = F.concat_ws("_", F.lit(ranking), "lookback", "skip").alias("kind")
            parts.append(rows.select("security_id", "decision_date", kind, F.col("score").cast("double").alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rank_scores(scores: DataFrame, members: DataFrame, prices: DataFrame) -> DataFrame:
    """Rank the members per kind and date; `tradable_rank` counts those with a price that day.

    members: [security_id, decision_date]. Best score first, ties by security id.
    """
    keys = ["security_id", "decision_date"]
    today = prices.select(
        "security_id", F.col("price_date").alias("decision_date"), F.lit(True).alias("_priced")
    )
    rows = (
        scores.join(members.select(*keys), keys)
        .join(today, keys, "left")
        .withColumn("tradable", F.coalesce("_priced", F.lit(False)))
        .drop("_priced")
    )
    ranked = rank_in_groups(rows, ["kind", "decision_date"], "score", "security_id", "tradable")
    return ranked.withColumnsRenamed(
        {"marked_rank": "tradable_rank", "group_size": "scored", "group_marked": "tradable_count"}
    )


def trend_signal(
    closes: DataFrame, dates: DataFrame, lengths: list[int], symbol: str
) -> DataFrame:
    """[decision_date, trend_days, risk_on, problem]: newest of the last n closes above their mean.

    closes: [symbol, price_date, adjusted_close], one market series, at most one row per day. Too
    few closes, or a newest close more than a week old, is a problem, not a signal.
    """
    w = W.partitionBy("symbol").orderBy("price_date")
    value = F.col("adjusted_close").cast("double")
    rows = closes.filter(F.col("symbol") == symbol).select(
        "symbol", "price_date", value.alias("close"), F.row_number().over(w).alias("n"),
        *[F.avg(value).over(w.rowsBetween(1 - k, 0)).alias(f"mean_{k}") for k in lengths],
    )
    probe = dates.select("decision_date", "prev_td").withColumn("symbol", F.lit(symbol))
    at = asof.asof_join(
        probe, rows, ["symbol"], "prev_td", "price_date",
        ["close", "n", *[f"mean_{k}" for k in lengths]], inclusive=True, unique=True,
    )
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("trend_days"), F.col(f"mean_{k}").alias("mean"))
                for k in lengths
            ]
        )
    )
    out = at.select("decision_date", "prev_td", "price_date", "close", "n", each.alias("t")).select(
        "*", "t.*"
    )
    bad = (F.coalesce("n", F.lit(0)) < F.col("trend_days")) | (
        F.col("price_date") < F.date_sub("prev_td", 7)
    )
    return out.select(
        "decision_date", "trend_days",
        F.when(~bad, F.col("close") > F.col("mean")).alias("risk_on"),
        F.when(bad, F.lit("series too short or stale")).alias("problem"),
    )


def require_signal(signal: DataFrame) -> DataFrame:
    """The signal, or an error that names the first date it cannot be given for."""
    bad = signal.filter("problem IS NOT NULL").orderBy("decision_date").limit(1).collect()
    if bad:
        raise TrendError(f"{bad[0]['problem']} on {bad[0]['decision_date']}")
    return signal


def select_holdings(
    ranked: DataFrame, strategies: DataFrame, signal: DataFrame | None = None
) -> DataFrame:
    """[strategy, decision_date, security_id, score, rank, scored, held, weight].

    The best top_n tradable names, all of them if top_n is null; none on a date whose trend filter is
    off or cannot tell (`require_signal` refuses the latter).
    """
    inside = F.col("tradable") & (F.col("top_n").isNull() | (F.col("tradable_rank") <= F.col("top_n")))
    picks = ranked.join(F.broadcast(strategies), "kind").filter(inside)
    if signal is not None:
        # Strategies x dates at most; the signal has one row per date and length.
        off = signal.filter(~F.coalesce("risk_on", F.lit(False))).select("decision_date", "trend_days")
        picks = picks.join(F.broadcast(off), ["decision_date", "trend_days"], "left_anti")
    held = F.least(F.col("tradable_count"), F.col("top_n").cast("bigint"))  # a null limit does not count
    return picks.withColumn("held", held).select(
        "strategy", "decision_date", "security_id", "score", "rank", "scored", "held",
        (F.lit(1.0) / F.col("held")).alias("weight"),
    )
