"""Cross-checks of our records with outside opinions and with fund holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import name_key, normalise_symbol
from tidemark.operators import asof, calendar

# The nine groups of a (our status, their status) pair.
AGREE, AGREE_NOT = "agree_halal", "agree_not_halal"
WE_YES_THEY_NO, WE_NO_THEY_YES = "we_halal_zoya_non_compliant", "we_non_halal_zoya_compliant"
WE_YES_THEY_DOUBT, WE_NO_THEY_DOUBT = "we_halal_zoya_questionable", "we_non_halal_zoya_questionable"
WE_UNDECIDED, THEY_UNRATED, BOTH_UNDECIDED = (
    "we_unknown_zoya_decided", "we_decided_zoya_unrated", "both_undecided",
)
REPORT_STATUSES = ("COMPLIANT", "NON_COMPLIANT", "QUESTIONABLE", "UNRATED")
NOT_OURS = "NOT_IN_OUR_UNIVERSE"


def pair_group(ours: Column, theirs: Column) -> Column:
    def by(yes: str, no: str, doubt: str) -> Column:
        return (
            F.when(theirs == "COMPLIANT", yes)
            .when(theirs == "NON_COMPLIANT", no)
            .when(theirs == "QUESTIONABLE", doubt)
            .otherwise(THEY_UNRATED)
        )

    return (
        F.when(ours == "HALAL", by(AGREE, WE_YES_THEY_NO, WE_YES_THEY_DOUBT))
        .when(ours == "NON_HALAL", by(WE_NO_THEY_YES, AGREE_NOT, WE_NO_THEY_DOUBT))
        .when(theirs == "UNRATED", BOTH_UNDECIDED)
        .otherwise(WE_UNDECIDED)
    )


def our_records(
    records: DataFrame, securities: DataFrame, periods: DataFrame, dates: DataFrame
) -> DataFrame:
    """[report_date, symbol, security_id, ticker, company_name, status, reason] on each date.

    dates: [report_date], calendar-sized. Records in effect are keyed by the symbol in use that
    day; two securities with one symbol leave the later id.
    """
    months = dates.select(calendar.month_no(F.col("report_date")).alias("month_no"), "report_date")
    current = asof.in_effect_monthly(
        records, months, ["security_id"], "report_date", "effective_from", "effective_to",
        ["status", "reason"], "screening_date",
    )
    named = asof.resolve_period(current, periods, "security_id", "report_date", "ticker").filter(
        "ticker IS NOT NULL"
    )
    rows = named.join(securities.select("security_id", "company_name"), "security_id").withColumn(
        "symbol", normalise_symbol(F.col("ticker"))
    )
    last = F.max_by(F.struct("ticker", "company_name", "status", "reason"), "security_id")
    return (
        rows.groupBy("report_date", "symbol")
        .agg(F.max("security_id").alias("security_id"), last.alias("_r"))
        .select("report_date", "symbol", "security_id", "_r.*")
    )


def pair_up(ours: DataFrame, reports: DataFrame) -> DataFrame:
    """Full outer join on the symbol: [symbol, our_status, their_status, side, group].

    reports: [symbol, status, position]; of several reports for one spelling, whatever its form, the one
    with the last position stays.
    """
    theirs = reports.select(normalise_symbol(F.col("symbol")).alias("symbol"), "status", "position").groupBy("symbol").agg(
        F.max_by("status", "position").alias("their_status")
    )
    rows = ours.select("symbol", F.col("status").alias("our_status"), "security_id", "reason").join(
        theirs, "symbol", "full"
    )
    side = (
        F.when(F.col("their_status").isNull(), "only_ours")
        .when(F.col("our_status").isNull(), "only_theirs")
        .otherwise("matched")
    )
    return rows.withColumn("side", side).withColumn(
        "group", F.when(F.col("side") == "matched", pair_group(F.col("our_status"), F.col("their_status")))
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: sizes of both sides, firm pairs, agreement, precision and recall."""

    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    g, side = F.col("group"), F.col("side")
    counts = pairs.agg(
        n(side != "only_theirs").alias("ours_total"), n(side != "only_ours").alias("theirs_total"),
        n(side == "matched").alias("matched"), n(side == "only_ours").alias("only_ours"),
        n(side == "only_theirs").alias("only_theirs"),
        n(g == AGREE).alias("_yes"), n(g == AGREE_NOT).alias("_no"),
        n(g == WE_YES_THEY_NO).alias("_over"), n(g == WE_NO_THEY_YES).alias("_under"),
    )
    c = F.col
    firm = c("_yes") + c("_no") + c("_over") + c("_under")
    return counts.select(
        "ours_total", "theirs_total", "matched", "only_ours", "only_theirs", firm.alias("firm_pairs"),
        F.try_divide(c("_yes") + c("_no"), firm).alias("agreement"),
        F.try_divide(c("_yes"), c("_yes") + c("_over")).alias("precision"),
        F.try_divide(c("_yes"), c("_yes") + c("_under")).alias("recall"),
    )


def match_holdings(holdings: DataFrame, ours: DataFrame) -> DataFrame:
    """Common-equity holdings with our record by symbol, else by company name.

    holdings: [report_date, name, ticker, value_usd, asset_category]; ours: [report_date, symbol,
    company_name, status, reason, security_id] as in effect on each report date.
    """
    stocks = holdings.filter(
        (F.col("asset_category") == "EC")
        & ((F.coalesce("ticker", F.lit("")) != "") | (F.coalesce("name", F.lit("")) != ""))
    ).withColumns(
        {
            "symbol": normalise_symbol(F.col("ticker")),
            "name_key": F.when(F.col("name") != "", name_key(F.col("name"))),
        }
    )
    one = ours.select(
        "report_date", "symbol", F.struct("status", "reason", "security_id").alias("_by_symbol")
    )
    rows = stocks.join(one, ["report_date", "symbol"], "left").join(
        by_name(ours), ["report_date", "name_key"], "left"
    )
    hit = F.coalesce("_by_symbol", "_by_name")
    return rows.select(
        "report_date", "name", "ticker", "value_usd",
        F.coalesce(hit["status"], F.lit(NOT_OURS)).alias("status"), hit["reason"].alias("reason"),
        hit["security_id"].alias("security_id"),
    )


def by_name(ours: DataFrame) -> DataFrame:
    """[report_date, name_key, _by_name]: the record a company name stands for on a date.

    Classes with a decision speak for the company when they agree; if they differ the name is
    ambiguous and gets NULL; with none decided the first security counts.
    """
    decided = F.col("status") != "UNKNOWN"
    row = F.struct("status", "reason", "security_id")
    grouped = ours.groupBy("report_date", name_key(F.col("company_name")).alias("name_key")).agg(
        F.min(F.when(decided, F.col("status"))).alias("_lo"),
        F.max(F.when(decided, F.col("status"))).alias("_hi"),
        F.min_by(F.when(decided, row), F.when(decided, F.col("security_id"))).alias("_decided"),
        F.min_by(row, F.col("security_id")).alias("_first"),
    )
    chosen = F.when(F.col("_lo").isNull(), F.col("_first")).when(
        F.col("_lo") == F.col("_hi"), F.col("_decided")
    )
    return grouped.select("report_date", "name_key", chosen.alias("_by_name"))


def holding_shares(matched: DataFrame) -> DataFrame:
    """[report_date, status, holdings, value, count_share, value_share]."""
    by = matched.groupBy("report_date", "status").agg(
        F.count("*").alias("holdings"), F.sum("value_usd").alias("value")
    )
    w = W.partitionBy("report_date")  # at most one row per status
    return by.withColumns(
        {
            "count_share": F.col("holdings") / F.sum("holdings").over(w),
            "value_share": F.try_divide(
                F.col("value").cast("double"), F.sum("value").over(w).cast("double")
            ),
        }
    )


def largest_not_eligible(matched: DataFrame, k: int = 12) -> DataFrame:
    """The k largest holdings per report date we do not call eligible, and the k unmatched ones."""
    side = F.when(F.col("status") == NOT_OURS, "unmatched").when(F.col("status") != "HALAL", "not_eligible")
    w = W.partitionBy("report_date", "side").orderBy(F.desc("value_usd"), "name", "ticker")
    rows = matched.withColumn("side", side).filter("side IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
