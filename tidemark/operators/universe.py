"""The eligible universe: for every decision date, who may be held and why the others may not.

All dates are one job: `as_of` is a column. A decision reads only rows dated before it; a
classification counts from its first effective day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.hashing import fingerprint, row_text
from tidemark.functions.text import company_key
from tidemark.operators import asof, calendar
from tidemark.operators.graph import connected_components
from tidemark.params import UniverseRules
from tidemark.sources.checkpoints import cut


class NoQualityRun(Exception):
    """No data-quality run covers the window, so nothing may be trusted."""


def median_of_window(values: Column, length: int) -> Column:
    """Exact median over `length` days where a day without a value counts as zero.

    `values` is an array of at most `length` non-negative amounts, one per day.
    """
    zero = F.lit(0).cast("decimal(38,6)")
    padded = F.concat(F.array_repeat(zero, length - F.size(values)), F.array_sort(values))
    if length % 2:
        return F.element_at(padded, length // 2 + 1)
    return (F.element_at(padded, length // 2) + F.element_at(padded, length // 2 + 1)) / 2


def median_dollar_volume(
    spark: SparkSession, prices: DataFrame, dates: DataFrame, length: int
) -> DataFrame:
    """[security_id, as_of, median_usd] for securities with a price in the window.

    `dates` is [as_of, td_index]. Prices meet the window days in a broadcast equi-join; a group
    holds at most `length` rows, one per trading day.
    """
    days = calendar.window_days(dates, spark, length)
    dollars = (F.col("close") * F.col("volume")).cast("decimal(38,6)")
    return (
        prices.select("security_id", "price_date", dollars.alias("usd"))
        .join(F.broadcast(days), F.col("price_date") == F.col("day"))
        .groupBy("security_id", "as_of")
        .agg(F.collect_list("usd").alias("_usd"))
        .select("security_id", "as_of", median_of_window(F.col("_usd"), length).alias("median_usd"))
    )


def flagged(spark: SparkSession, findings: DataFrame, dates: DataFrame, length: int) -> DataFrame:
    """[security_id, as_of]: a finding dated inside the liquidity window, closed days included."""
    edges = calendar.window_days(dates, spark, length).groupBy("as_of").agg(
        F.min("day").alias("lo"), F.max("day").alias("hi")
    )
    days = edges.select("as_of", F.explode(F.sequence("lo", "hi")).alias("data_date"))
    return (
        findings.select("security_id", "data_date")
        .distinct()
        .join(F.broadcast(days), "data_date")
        .select("security_id", "as_of")
        .distinct()
        .withColumn("has_finding", F.lit(True))
    )


def covering_runs(dates: DataFrame, runs: DataFrame) -> DataFrame:
    """[as_of, run_id]: for every date the newest quality run whose range covers its [first, last], or null.

    dates: [as_of, first, last], a calendar's worth; runs: [id, first_date, last_date], which may be many. A run's ends are looked up
    in a table of days and become the places of the earliest first and the latest last that it holds, so runs shrink to one per pair of
    places before anything else. A run counts for the blocks of 1, 2, 4, ... places around its first; a date asks the
    few blocks that make up all places up to its own, and in each block a running maximum from the latest last down answers.
    """
    span = dates.agg(F.min("first"), F.max("last")).first()
    if span[0] is None:
        return dates.select("as_of", F.lit(None).cast(runs.schema["id"].dataType).alias("run_id"))
    low, high = (F.lit(day) for day in span)
    by_day = W.orderBy("day")  # a calendar's worth of rows

    def places(end: str) -> DataFrame:
        ends = dates.select(F.col(end).alias("day")).distinct()
        return ends.withColumn("_at", F.row_number().over(by_day) - 1)

    days = dates.sparkSession.range(1).select(F.explode(F.sequence(low, high)).alias("day"))
    firsts, lasts = places("first"), places("last")
    later = F.min("_at").over(by_day.rowsBetween(0, W.unboundedFollowing)).alias("_first")
    earlier = F.max("_at").over(by_day.rowsBetween(W.unboundedPreceding, 0)).alias("_last")
    from_day = days.join(firsts, "day", "left").select(F.col("day").alias("_from"), later)
    to_day = days.join(lasts, "day", "left").select(F.col("day").alias("_to"), earlier)
    cells = (
        runs.filter("first_date IS NOT NULL AND last_date IS NOT NULL")
        .select("id", F.greatest("first_date", low).alias("_from"), F.least("last_date", high).alias("_to"))
        .join(F.broadcast(from_day), "_from")
        .join(F.broadcast(to_day), "_to")
        .filter("_first IS NOT NULL AND _last IS NOT NULL")
        .groupBy("_first", "_last")
        .agg(F.max("id").alias("id"))
    )
    levels = F.sequence(F.lit(0), F.lit((span[1] - span[0]).days.bit_length()))
    held = cells.withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(_first, level)"))
    held = held.groupBy("level", "block", "_last").agg(F.max("id").alias("id"))
    asked = (
        dates.join(firsts.select(F.col("day").alias("first"), (F.col("_at") + 1).alias("_n")), "first")
        .join(lasts.select(F.col("day").alias("last"), F.col("_at").alias("_last")), "last")
        .withColumn("level", F.explode(levels))
        .filter("shiftright(_n, level) % 2 = 1")
        .select("as_of", "level", F.expr("shiftright(_n, level) - 1").alias("block"), "_last")
    )
    down = W.partitionBy("level", "block").orderBy(F.desc("_last")).rangeBetween(W.unboundedPreceding, 0)
    both = held.withColumn("as_of", F.lit(None).cast(dates.schema["as_of"].dataType)).unionByName(
        asked.withColumn("id", F.lit(None).cast(runs.schema["id"].dataType))
    )
    found = both.withColumn("_newest", F.max("id").over(down)).filter("as_of IS NOT NULL")
    newest = found.groupBy("as_of").agg(F.max("_newest").alias("run_id"))
    return dates.select("as_of").join(newest, "as_of", "left")


def gated(universe: DataFrame, cover: DataFrame) -> DataFrame:
    """A universe in which dates without a covering quality run are refused: every candidate with that reason."""
    rows = universe.join(F.broadcast(cover), "as_of", "left")
    reason = F.when(F.col("run_id").isNull(), "no_quality_run").otherwise(F.col("reason"))
    return rows.withColumn("reason", reason)


def covering_run(runs: DataFrame, first: object, last: object) -> int:
    """The newest quality run whose range covers [first, last]; none is an error."""
    covered = runs.filter((F.col("first_date") <= F.lit(first)) & (F.col("last_date") >= F.lit(last)))
    newest = covered.agg(F.max("id")).first()[0]
    if newest is None:
        raise NoQualityRun(f"No data-quality run covers {first} to {last}: no universe is built.")
    return int(newest)


def share_class_groups(
    members: DataFrame, securities: DataFrame, periods: DataFrame
) -> DataFrame:
    """[as_of, security_id, company]: one company label per set of share classes.

    Two securities belong together when one lists the other's ticker of that day as related and
    both carry the same company name; both must be among `members` of that day. A security whose
    related tickers are NULL is grouped by its name alone.
    """
    info = securities.select(
        "security_id", company_key(F.col("company_name")).alias("name_key"), "related_tickers"
    )
    rows = members.select("as_of", "security_id").join(info, "security_id")
    named = asof.resolve_period(rows, periods, "security_id", "as_of", "ticker")
    wanted = rows.select(
        "as_of", "name_key", F.col("security_id").alias("from_id"),
        F.explode(F.filter(F.split("related_tickers", " "), lambda t: t != "")).alias("ticker"),
    )
    edges = wanted.join(
        named.select("as_of", "name_key", "ticker", F.col("security_id").alias("to_id")),
        ["as_of", "name_key", "ticker"],
    )
    parts = connected_components(edges, ["as_of"], "from_id", "to_id")
    label = F.when(
        F.col("related_tickers").isNull(), F.concat(F.lit("name:"), "name_key")
    ).otherwise(
        F.concat(F.lit("rel:"), F.coalesce("component", "security_id").cast("string"))
    )
    return rows.join(
        parts.withColumnRenamed("node", "security_id"), ["as_of", "security_id"], "left"
    ).select("as_of", "security_id", label.alias("company"))


def candidates(securities: DataFrame, grid: DataFrame, rules: UniverseRules) -> DataFrame:
    """The (security, as_of) pairs of the allowed categories; `grid` already obeys lifecycles."""
    allowed = securities.filter(F.col("category").isin(*rules.categories)).select("security_id")
    return grid.join(allowed, "security_id", "left_semi")


def assess(
    spark: SparkSession,
    grid: DataFrame,
    dates: DataFrame,
    status: DataFrame,
    prices: DataFrame,
    findings: DataFrame,
    rules: UniverseRules,
) -> DataFrame:
    """Candidates with the first rule they fail (NULL = passed all but the share-class rule).

    grid: [security_id, as_of] candidates; dates: [as_of, td_index]; status: [security_id, as_of,
    status].
    """
    latest = asof.asof_within(
        prices, dates, ["security_id"], "price_date", "as_of", ["close_unadjusted"],
        lookback=rules.price_lookback_days, inclusive=False,
    )
    cutoffs = calendar.shift_back(
        dates.select("as_of", "td_index"),
        F.col("td_index") - (rules.max_price_age_trading_days - 1), "cutoff", spark,
    ).select("as_of", "cutoff")
    liquidity = median_dollar_volume(spark, prices, dates.select("as_of", "td_index"), rules.liquidity_days)
    marks = flagged(spark, findings, dates.select("as_of", "td_index"), rules.liquidity_days)
    keys = ["security_id", "as_of"]
    rows = (
        grid.join(status, keys, "left")
        .join(latest, keys, "left")
        .join(liquidity, keys, "left")
        .join(marks, keys, "left")
        .join(F.broadcast(cutoffs), "as_of")
        .withColumn("median_usd", F.coalesce("median_usd", F.lit(0).cast("decimal(38,6)")))
    )
    stale = F.col("price_date").isNull() | (F.col("price_date") < F.col("cutoff"))
    reason = (
        F.when(F.col("status").isNull(), "sharia_no_record")
        .when(F.col("status") != "HALAL", F.concat(F.lit("sharia_"), F.lower("status")))
        .when(stale, "stale_price")
        .when(F.col("close_unadjusted") < F.lit(rules.min_price), "below_min_price")
        .when(F.col("median_usd") < F.lit(rules.min_median_dollar_volume), "below_min_liquidity")
        .when(F.col("has_finding"), "data_quality_finding")
    )
    return rows.select(
        "as_of", "security_id", "status", "price_date", "close_unadjusted", "median_usd",
        reason.alias("reason"),
    )


def build(
    assessed: DataFrame, securities: DataFrame, periods: DataFrame
) -> DataFrame:
    """Add `reason = duplicate_share_class`: of one company only the most liquid class stays."""
    stored = cut(assessed)  # read by the graph rounds and by the result
    passed = stored.filter("reason IS NULL")
    groups = share_class_groups(passed, securities, periods)
    w = W.partitionBy("as_of", "company").orderBy(F.desc("median_usd"), "security_id")
    extra = (
        passed.join(groups, ["as_of", "security_id"])
        .withColumn("_place", F.row_number().over(w))
        .filter("_place > 1")
        .select("as_of", "security_id", F.lit("duplicate_share_class").alias("_extra"))
    )
    return stored.join(extra, ["as_of", "security_id"], "left").withColumn(
        "reason", F.coalesce("reason", "_extra")
    ).drop("_extra")


def funnel(universe: DataFrame) -> DataFrame:
    """[as_of, reason, n]; members are counted under `eligible`."""
    return universe.groupBy("as_of", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(
        F.count("*").alias("n")
    )


def members(universe: DataFrame) -> DataFrame:
    return universe.filter("reason IS NULL").select("as_of", "security_id", "median_usd")


def content_hash(universe: DataFrame, rules: UniverseRules) -> DataFrame:
    """[as_of, row_count, sha256]: a universe by its rules and its members, in any order."""
    text = row_text(
        F.lit(rules.version), F.lit(rules.methodology), F.lit(",".join(sorted(rules.categories))),
        F.col("as_of"), F.col("security_id"),
    )
    return fingerprint(members(universe), text, ["as_of"])


def largest_members(
    universe: DataFrame,
    securities: DataFrame,
    periods: DataFrame,
    caps: DataFrame,
    reasons: DataFrame,
    months: DataFrame,
    first_month: int,
    k: int,
) -> DataFrame:
    """The k largest members of each date with ticker, latest market value before it and reason.

    Market value and screening reason are looked up for all members at once; the rank limit is
    applied before the shuffle as well.
    """
    rows = asof.asof_monthly(
        members(universe).select("security_id", "as_of"), caps, months, first_month,
        ["security_id"], "as_of", "cap_date", ["market_cap_usd"],
    )
    named = asof.resolve_period(rows, periods, "security_id", "as_of", "ticker").filter(
        "ticker IS NOT NULL"
    )
    full = named.join(securities.select("security_id", "company_name"), "security_id").join(
        reasons, ["security_id", "as_of"], "left"
    )
    w = W.partitionBy("as_of").orderBy(F.desc(F.coalesce("market_cap_usd", F.lit(0))), "security_id")
    return full.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
