"""Data-quality checks. Each finding is [security_id, check_name, data_date, detail].

All price checks run in one pass: one scan, one window per security for the previous row, and small
equi-joins; the failed checks of a row are built as an array and exploded. A security has at most
one row per day, so its window is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import calendar
from tidemark.params import QualityThresholds

PRICE_CHECKS = (
    "ohlc_inconsistent",
    "bad_price_date",
    "abnormal_jump",
    "price_gap",
    "possible_missing_split",
    "price_outside_ticker_history",
)
FILING_CHECKS = ("filing_before_period_end", "negative_balance_sheet_value")
VALUE_CHECKS = ("non_positive_market_value",)
ALL_CHECKS = (*PRICE_CHECKS, *FILING_CHECKS, *VALUE_CHECKS, "stale_price")
BALANCE_AMOUNTS = (
    "debt",
    "cash_and_equivalents",
    "investments",
    "investments_current",
    "investments_noncurrent",
)


@dataclass(frozen=True)
class RowCheck:
    """A caller's check of single rows, planned into the scan of the library's own checks of that table.

    `failed` and `detail` are SQL expressions over the row. Price rows also have the row before (prev_date, prev_close,
    prev_unadjusted), the calendar's is_trading and td, near_split, end_date and the ticker spans.
    """

    name: str
    table: str  # prices, filings or values
    failed: str
    detail: str = "''"


@dataclass(frozen=True)
class TableCheck:
    """A caller's check from tables to [security_id, data_date, detail]; `inputs` names the tables it is given, in order."""

    name: str
    inputs: tuple[str, ...]
    find: Callable[..., DataFrame]


def _own(more: Sequence[RowCheck], table: str) -> list[tuple[str, Column, Column]]:
    return [(m.name, F.expr(m.failed), F.expr(m.detail).cast("string")) for m in more if m.table == table]


def table_findings(checks: Sequence[TableCheck], tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """The findings of callers' table checks; a check that asks for an unknown table is refused."""
    found = []
    for check in checks:
        lacking = [i for i in check.inputs if i not in tables]
        if lacking:
            raise ValueError(f"{check.name} asks for unknown tables: {', '.join(lacking)}")
        rows = check.find(*(tables[i] for i in check.inputs))
        found.append(rows.select("security_id", F.lit(check.name).alias("check_name"), "data_date", "detail"))
    return found


def with_previous(prices: DataFrame, first: date, last: date, t: QualityThresholds) -> DataFrame:
    """Each price in [first, last] with the row before it.

    Checks run year by year in principle and look back `lookback_days` before each chunk, so a
    previous row older than that counts as none. The date filter comes before the window.
    """
    span = prices.filter(
        F.col("price_date").between(F.date_sub(F.lit(first), t.lookback_days), F.lit(last))
    )
    w = W.partitionBy("security_id").orderBy("price_date")
    chunk = F.greatest(F.lit(first), F.trunc("price_date", "year"))
    prev = F.lag("price_date").over(w)
    near = prev >= F.date_sub(chunk, t.lookback_days)
    return (
        span.withColumn("prev_date", F.when(near, prev))
        .withColumn("prev_close", F.when(near, F.lag("close").over(w)))
        .withColumn("prev_unadjusted", F.when(near, F.lag("close_unadjusted").over(w)))
        .filter(F.col("price_date") >= F.lit(first))
    )


def _text(*parts: object) -> Column:
    return F.concat(
        *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    )


def _explode(rows: DataFrame, day: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """A finding for each of the (name, failed, detail) that fails; only rows that fail one get to the array of findings."""
    some = F.lit(False)
    for _, failed, _ in checks:
        some = some | F.coalesce(failed, F.lit(False))
    findings = [
        F.when(failed, F.struct(F.lit(name).alias("check_name"), detail.alias("detail"))) for name, failed, detail in checks
    ]
    found = F.explode(F.filter(F.array(*findings), lambda f: f.isNotNull()))
    return rows.filter(some).select("security_id", F.col(day).alias("data_date"), found.alias("_f")).select(
        "security_id", "_f.check_name", "data_date", "_f.detail"
    )


def split_days(actions: DataFrame, window_days: int) -> DataFrame:
    """[security_id, price_date]: every day a SPLIT action explains a move on."""
    d = F.col("effective_date")
    around = F.sequence(F.date_sub(d, window_days), F.date_add(d, window_days))
    return (
        actions.filter("action_type = 'SPLIT'")
        .select("security_id", F.explode(around).alias("price_date"))
        .distinct()
        .withColumn("near_split", F.lit(True))
    )


def ticker_spans(periods: DataFrame) -> DataFrame:
    """[security_id, spans]: the ticker periods of a security; they cannot overlap, so few."""
    return periods.groupBy("security_id").agg(
        F.collect_list(F.struct("valid_from", "valid_to")).alias("spans")
    )


def price_findings(
    spark: SparkSession,
    prices: DataFrame,
    actions: DataFrame,
    periods: DataFrame,
    securities: DataFrame,
    first: date,
    last: date,
    t: QualityThresholds,
    today: date,
    details: bool = True,
    more: Sequence[RowCheck] = (),
) -> DataFrame:
    """All price checks and `more` of the caller's. Without `details` the texts are left out, for callers that only need dates."""
    cal = calendar.calendar(spark).select(
        F.col("day").alias("price_date"), "is_trading", F.col("td_index").alias("td")
    )
    prev_cal = calendar.calendar(spark).select(
        F.col("day").alias("prev_date"), F.col("td_index").alias("prev_ti")
    )
    master = securities.select("security_id", "end_date").join(
        ticker_spans(periods), "security_id", "left"
    ).withColumn("_known", F.lit(True))
    rows = (
        with_previous(prices, first, last, t)
        .join(F.broadcast(cal), "price_date", "left")
        .join(F.broadcast(prev_cal), "prev_date", "left")
        .join(split_days(actions, t.split_window_days), ["security_id", "price_date"], "left")
        .join(master, "security_id", "left")
    )
    c = F.col
    day = c("price_date")
    outside = (c("open") > c("high")) | (c("open") < c("low")) | (c("close") > c("high")) | (
        c("close") < c("low")
    )
    ohlc = (c("high") < c("low")) | outside
    future = day > F.lit(today)
    closed = c("is_trading") == F.lit(False)
    # Moves by multiplication: exact in decimal, no division by a zero price.
    up, down = F.lit(1 + t.max_daily_move), F.lit(1 - t.max_daily_move)
    jump = (c("prev_close") > 0) & (
        (c("close") > c("prev_close") * up) | (c("close") < c("prev_close") * down)
    )
    move = (c("close").cast("double") / c("prev_close").cast("double") - 1) * 100
    move_text = F.round(move, 1).cast("decimal(20,1)").cast("string")
    missing = c("td") - c("prev_ti") - 1
    gap = missing > t.max_gap_trading_days
    now, before = c("close_unadjusted"), c("prev_unadjusted")
    factor = F.lit(t.split_ratio)
    split = (
        (before > 0) & (now > 0) & ((before >= now * factor) | (now >= before * factor))
        & c("near_split").isNull()
    )
    has_ticker = F.coalesce(
        F.exists(
            "spans",
            lambda s: (s["valid_from"] <= day) & (s["valid_to"].isNull() | (day < s["valid_to"])),
        ),
        F.lit(False),
    )
    after_end = day > c("end_date")
    checks = [
            (
                "ohlc_inconsistent", ohlc,
                _text("open=", c("open"), " high=", c("high"), " low=", c("low"), " close=", c("close")),
            ),
            (
                "bad_price_date", future | closed,
                F.when(future, "future").otherwise("closed"),
            ),
            (
                "abnormal_jump", jump,
                _text("from=", c("prev_close"), " to=", c("close"), " percent=", move_text, " since=", c("prev_date")),
            ),
            (
                "price_gap", gap, _text("days=", missing, " since=", c("prev_date"))),
            (
                "possible_missing_split", split,
                _text("from=", before, " to=", now),
            ),
            (
                "price_outside_ticker_history",
                c("_known").isNotNull() & (~has_ticker | F.coalesce(after_end, F.lit(False))),
                F.when(has_ticker, _text("ended=", c("end_date"))).otherwise(
                    "no_ticker"
                ),
            ),
    ]
    checks += _own(more, "prices")
    return _explode(rows, "price_date", [(n, f, d if details else F.lit("")) for n, f, d in checks])


def filing_findings(filings: DataFrame, first: date, last: date, more: Sequence[RowCheck] = ()) -> DataFrame:
    c = F.col
    inside = filings.filter(c("filing_date").between(F.lit(first), F.lit(last)))
    period_end = F.coalesce("report_period", "calendar_date")
    negative = F.greatest(*[F.coalesce(c(a) < 0, F.lit(False)) for a in BALANCE_AMOUNTS])
    return _explode(
        inside,
        "filing_date",
        [
            (
                "filing_before_period_end", c("filing_date") < period_end,
                _text("kind=", c("dimension"), " period_end=", period_end),
            ),
            (
                "negative_balance_sheet_value", negative,
                _text("kind=", c("dimension")),
            ),
            *_own(more, "filings"),
        ],
    )


def value_findings(caps: DataFrame, first: date, last: date, more: Sequence[RowCheck] = ()) -> DataFrame:
    c = F.col
    inside = caps.filter(c("cap_date").between(F.lit(first), F.lit(last)))
    checks = [("non_positive_market_value", c("market_cap_usd") <= 0, _text("value=", c("market_cap_usd"))), *_own(more, "values")]
    return _explode(inside, "cap_date", checks)


def stale_prices(
    spark: SparkSession, securities: DataFrame, prices: DataFrame, as_of: date, t: QualityThresholds
) -> DataFrame:
    """Active, started securities whose latest price up to `as_of` is too old, or missing."""
    latest = (
        prices.filter(F.col("price_date") <= F.lit(as_of))
        .groupBy("security_id")
        .agg(F.max("price_date").alias("last_price"))
    )
    on = calendar.calendar(spark).filter(F.col("day") == F.lit(as_of))
    # The n-th trading day strictly before as_of.
    cutoff = calendar.shift_back(
        on.select((F.col("td_index") - F.col("is_trading").cast("int")).alias("_before")),
        F.col("_before") - (t.max_price_age_trading_days - 1), "cutoff", spark,
    ).select("cutoff")
    live = securities.filter(
        F.col("active_flag") & (F.col("start_date").isNull() | (F.col("start_date") <= F.lit(as_of)))
    ).select("security_id")
    rows = live.join(latest, "security_id", "left").join(F.broadcast(cutoff))  # one row
    return rows.filter(F.col("last_price").isNull() | (F.col("last_price") < F.col("cutoff"))).select(
        "security_id",
        F.lit("stale_price").alias("check_name"),
        F.lit(as_of).alias("data_date"),
        F.when(F.col("last_price").isNull(), "no_price")
        .otherwise(_text("latest=", F.col("last_price")))
        .alias("detail"),
    )


def counts(spark: SparkSession, findings: DataFrame, checks: tuple[str, ...] = ALL_CHECKS) -> DataFrame:
    """[check_name, findings]: every check that ran, also those that found nothing."""
    names = spark.createDataFrame([(c,) for c in checks], "check_name string")
    n = findings.groupBy("check_name").agg(F.count("*").alias("findings"))
    return names.join(n, "check_name", "left").na.fill(0, ["findings"])


def examples(findings: DataFrame, per_check: int = 5) -> DataFrame:
    """The first findings of each check. The rank limit is applied before the shuffle as well."""
    w = W.partitionBy("check_name").orderBy("data_date", "security_id", "detail")
    return findings.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_check)
