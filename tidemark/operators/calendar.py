"""The exchange calendar 1998-2027 as a table, and the date grids built from it.

The table has one row per calendar day (10,957 rows whatever the data size), so every join to it
may be broadcast. `td_index` counts trading days: on a trading day it is the day's own number, on a
closed day the number of the last trading day before it. Date shifts become index arithmetic.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.memo import per_session

FIRST_YEAR, LAST_YEAR = 1998, 2027
FIRST_DAY, LAST_DAY = date(FIRST_YEAR, 1, 1), date(LAST_YEAR, 12, 31)

# One-off full closures, one-off early closes, and the day the early-close rule
# would get wrong.
SPECIAL_CLOSURES = {
    "2001-09-11": "September 11 attacks",
    "2001-09-12": "September 11 attacks",
    "2001-09-13": "September 11 attacks",
    "2001-09-14": "September 11 attacks",
    "2004-06-11": "National day of mourning (Ronald Reagan)",
    "2007-01-02": "National day of mourning (Gerald Ford)",
    "2012-10-29": "Hurricane Sandy",
    "2012-10-30": "Hurricane Sandy",
    "2018-12-05": "National day of mourning (George H. W. Bush)",
    "2025-01-09": "National day of mourning (Jimmy Carter)",
}
SPECIAL_EARLY_CLOSES = ("1999-12-31", "2002-07-05", "2003-12-26")
NOT_EARLY_CLOSES = ("2002-07-03",)

MON, TUE, WED, THU, FRI, SAT, SUN = range(7)


def _easter(year: Column) -> Column:
    """Western Easter Sunday by Gauss's rule in its 1900-2099 form."""
    d = (year % 19 * 19 + 24) % 30
    e = (year % 4 * 2 + year % 7 * 4 + d * 6 + 5) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (d + e).cast("int"))


def _holiday(day: Column) -> Column:
    """Name of the rule holiday that closes a weekday, else NULL."""
    year, month, dom, dow = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)

    def nth(in_month: int, weekday: int, n: int) -> Column:
        return (month == in_month) & (dow == weekday) & dom.between(7 * n - 6, 7 * n)

    def observed(in_month: int, fixed: int) -> Column:
        """The date itself, the Friday before a Saturday, the Monday after a Sunday."""

        def hits(shift: int) -> Column:
            moved = F.date_add(day, shift)
            return (F.month(moved) == in_month) & (F.dayofmonth(moved) == fixed)

        return hits(0) | ((dow == FRI) & hits(1)) | ((dow == MON) & hits(-1))

    new_year = ((month == 1) & (dom == 1)) | ((month == 1) & (dom == 2) & (dow == MON))
    return (
        F.when(new_year, "New Year's Day")
        .when(nth(1, MON, 3), "Martin Luther King Jr. Day")
        .when(nth(2, MON, 3), "Washington's Birthday")
        .when(F.date_add(day, 2) == _easter(year), "Good Friday")
        .when((month == 5) & (dow == MON) & (dom >= 25), "Memorial Day")
        .when((year >= 2022) & observed(6, 19), "Juneteenth")
        .when(observed(7, 4), "Independence Day")
        .when(nth(9, MON, 1), "Labor Day")
        .when(nth(11, THU, 4), "Thanksgiving Day")
        .when(observed(12, 25), "Christmas Day")
    )


def _early_pattern(day: Column) -> Column:
    month, dom = F.month(day), F.dayofmonth(day)
    after_thanksgiving = (month == 11) & (F.weekday(day) == FRI) & dom.between(23, 29)
    before_fourth = (
        (month == 7) & (dom == 3) & F.weekday(F.date_add(day, 1)).between(TUE, FRI)
    )
    return after_thanksgiving | ((month == 12) & (dom == 24)) | before_fourth


@per_session
def calendar(spark: SparkSession) -> DataFrame:
    """[day, is_trading, holiday, is_early_close, td_index, prev_td, next_td], one row per day.

    Kept in memory once per session: every job joins to it, and a lost block is recomputed from the
    rules. Its size is fixed.
    """
    return _calendar(spark).coalesce(1).cache()


def _calendar(spark: SparkSession) -> DataFrame:
    days = (LAST_DAY - FIRST_DAY).days + 1
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_CLOSURES.items() for x in pair])
    base = spark.range(0, days, 1, 1).select(
        F.date_add(F.lit(FIRST_DAY), F.col("id").cast("int")).alias("day")
    )
    text = F.date_format("day", "yyyy-MM-dd")
    base = base.select(
        "day",
        F.when(F.weekday("day") < SAT, F.coalesce(special[text], _holiday(F.col("day")))).alias(
            "holiday"
        ),
    ).withColumn("is_trading", (F.weekday("day") < SAT) & F.col("holiday").isNull())
    early = F.col("is_trading") & (
        text.isin(*SPECIAL_EARLY_CLOSES)
        | (_early_pattern(F.col("day")) & ~text.isin(*NOT_EARLY_CLOSES))
    )
    trading_day = F.when(F.col("is_trading"), F.col("day"))
    # Windows without a partition key: the input is the fixed calendar, never data.
    up = W.orderBy("day")
    return base.select(
        "day",
        "is_trading",
        "holiday",
        early.alias("is_early_close"),
        F.sum(F.col("is_trading").cast("int")).over(up).cast("int").alias("td_index"),
        F.max(trading_day).over(up.rowsBetween(W.unboundedPreceding, -1)).alias("prev_td"),
        F.min(trading_day)
        .over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1))
        .alias("next_td"),
    )


@per_session
def trading_days(spark: SparkSession) -> DataFrame:
    """[day, td_index] of open days only."""
    return calendar(spark).filter("is_trading").select("day", "td_index")


@per_session
def month_table(spark: SparkSession) -> DataFrame:
    """[month_no, first_td, last_td, next_last_td, next_first_td] per calendar month.

    first_td is the decision date of the month, last_td its screening date; a screening result is
    in effect from next_first_td to next_last_td, both included.
    """
    months = (
        trading_days(spark)
        .groupBy(month_no(F.col("day")).alias("month_no"))
        .agg(F.min("day").alias("first_td"), F.max("day").alias("last_td"))
    )
    w = W.orderBy("month_no")
    return months.select(
        "*",
        F.lead("last_td").over(w).alias("next_last_td"),
        F.lead("first_td").over(w).alias("next_first_td"),
    )


def month_no(day: Column) -> Column:
    """A running month number: year * 12 + month."""
    return F.year(day) * 12 + F.month(day)


@per_session
def screening_dates(spark: SparkSession, first: date, last: date) -> DataFrame:
    """[month_no, screening_date, effective_from, effective_to] of the months first..last."""
    lo, hi = first.year * 12 + first.month, last.year * 12 + last.month
    return (
        month_table(spark)
        .filter(F.col("month_no").between(lo, hi))
        .select(
            "month_no",
            F.col("last_td").alias("screening_date"),
            F.col("next_first_td").alias("effective_from"),
            F.col("next_last_td").alias("effective_to"),
        )
    )


@per_session
def decision_dates(spark: SparkSession, first: date, last: date) -> DataFrame:
    """[month_no, decision_date, prev_td, td_index]: first trading day of each month in range.

    td_index is that of prev_td, the last close a decision may look at.
    """
    cal = calendar(spark)
    firsts = (
        cal.filter("is_trading")
        .groupBy(month_no(F.col("day")).alias("month_no"))
        .agg(
            F.min("day").alias("decision_date"),
            F.min_by("prev_td", "day").alias("prev_td"),
            (F.min("td_index") - 1).alias("td_index"),
        )
    )
    return firsts.filter(F.col("decision_date").between(F.lit(first), F.lit(last)))


def shift_back(dates: DataFrame, index: Column, name: str, spark: SparkSession) -> DataFrame:
    """Add `name`: the trading day with the given td_index. Both sides are calendar-sized."""
    days = trading_days(spark).select(F.col("day").alias(name), F.col("td_index").alias("_ti"))
    return dates.withColumn("_want", index).join(
        F.broadcast(days), F.col("_want") == F.col("_ti"), "left"
    ).drop("_want", "_ti")


def window_days(dates: DataFrame, spark: SparkSession, length: int) -> DataFrame:
    """[as_of, day] for the `length` trading days strictly before each as_of.

    `dates` holds [as_of, td_index] with td_index of the last trading day before as_of.
    """
    want = dates.select(
        "as_of",
        F.explode(F.sequence(F.col("td_index") - (length - 1), F.col("td_index"))).alias("_want"),
    )
    return want.join(
        F.broadcast(trading_days(spark)), F.col("_want") == F.col("td_index")
    ).select("as_of", "day")


def month_windows(first: Column, last: Column) -> Column:
    """Array of load windows [start, end], one per calendar month of first..last."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(
        months, lambda m: F.struct(m.alias("start"), F.last_day(m).alias("end"))
    )


def year_windows(first: Column, last: Column) -> Column:
    """Array of load windows [start, end], one per calendar year of first..last."""
    years = F.sequence(F.year(first), F.year(last))
    return F.transform(
        years,
        lambda y: F.struct(
            F.make_date(y, F.lit(1), F.lit(1)).alias("start"),
            F.make_date(y, F.lit(12), F.lit(31)).alias("end"),
        ),
    )
