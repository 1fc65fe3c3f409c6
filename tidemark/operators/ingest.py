"""Vendor rows (all text) to typed rows, with the first reason why a row cannot be used.

A parse operator returns the typed columns, the source columns that say where the row came from, and
`skip_reason`; accepted rows have NULL there. Reasons are one `when` chain, so a row is judged in one
pass and only once.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import (
    blank_to_null,
    is_bad,
    normalise_ticker,
    strict_date,
    strict_decimal,
)
from tidemark.operators import asof
from tidemark.params import ACTION_TYPES, VALUED_ACTIONS
from tidemark.schemas import ACTION_VALUE, AMOUNT, AMOUNT_COLUMNS, DIMENSIONS, PRICE

SCALE = "decimal(38,8)"  # wide enough to read any source number before it is stored
PRICE_NUMBERS = {
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "adjusted_close": "closeadj",
    "close_unadjusted": "closeunadj",
    "volume": "volume",
}


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def _numbers(raw: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, Column, Column]:
    """Parse text numbers: the frame with them, "any is bad" and "any is missing".

    Blanks and "N/A" fail the cast like broken text does; which of the two it was is only asked for
    rows in which a cast failed, so the common row costs one cast per column.
    """
    typed = raw.withColumns({f"n_{name}": F.col(c).try_cast(SCALE) for name, c in columns.items()})
    failed = F.lit(False)
    for name in columns:
        failed = failed | F.col(f"n_{name}").isNull()
    texts = F.array(*[F.when(F.col(f"n_{name}").isNull(), F.col(c)) for name, c in columns.items()])
    given = F.exists(texts, lambda t: ~F.upper(F.trim(t)).isin("", "N/A"))
    return typed, failed & F.coalesce(given, F.lit(False)), failed


def parse_prices(raw: DataFrame, periods: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Price rows with security, typed values and skip_reason; volume is rounded half up.

    `keep` names source columns (position in the file) to carry along.
    """
    typed, bad, missing = _numbers(raw, PRICE_NUMBERS)
    typed = typed.withColumns(
        {
            "ticker_text": blank_to_null(F.col("ticker")),
            "price_date": strict_date(F.col("date")),
            "_bad": bad | is_bad(F.col("date"), strict_date(F.col("date"))),
            "_missing": missing,
        }
    ).withColumn("ticker_key", normalise_ticker(F.col("ticker_text")))
    found = asof.resolve_period(
        typed, periods.withColumnRenamed("ticker", "ticker_key"), "ticker_key", "price_date", "security_id"
    )
    positive = [F.col(f"n_{name}") <= 0 for name in PRICE_NUMBERS if name != "volume"]
    impossible = _any([*positive, F.col("n_volume") < 0])
    reason = (
        F.when(F.col("ticker_text").isNull(), "missing_ticker")
        .when(F.col("_bad"), "bad_value")
        .when(F.col("price_date").isNull(), "missing_date")
        .when(F.col("_missing"), "missing_value")
        .when(F.col("security_id").isNull(), "no_security_for_ticker_on_date")
        .when(impossible, "impossible_price_or_volume")
    )
    return found.select(
        *keep, F.col("ticker_key").alias("ticker"), "security_id", "price_date",
        *[F.col(f"n_{name}").cast(PRICE).alias(name) for name in PRICE_NUMBERS if name != "volume"],
        F.round("n_volume").cast("bigint").alias("volume"), reason.alias("skip_reason"),
    )


def parse_market_caps(raw: DataFrame, periods: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Market values in USD (the source has millions); non-positive values are kept."""
    typed = raw.withColumns(
        {
            "ticker_key": normalise_ticker(blank_to_null(F.col("ticker"))),
            "cap_date": strict_date(F.col("date")),
            "_millions": strict_decimal(F.col("marketcap"), SCALE),
        }
    )
    found = asof.resolve_period(
        typed, periods.withColumnRenamed("ticker", "ticker_key"), "ticker_key", "cap_date", "security_id"
    )
    bad = is_bad(F.col("date"), F.col("cap_date")) | is_bad(F.col("marketcap"), F.col("_millions"))
    reason = (
        F.when(F.col("ticker_key").isNull(), "missing_ticker")
        .when(bad, "bad_value")
        .when(F.col("cap_date").isNull(), "missing_date")
        .when(F.col("_millions").isNull(), "missing_value")
        .when(F.col("security_id").isNull(), "no_security_for_ticker_on_date")
    )
    return found.select(
        *keep, F.col("ticker_key").alias("ticker"), "security_id", "cap_date",
        (F.col("_millions").cast("decimal(30,8)") * F.lit(Decimal(1_000_000))).cast(AMOUNT).alias("market_cap_usd"),
        reason.alias("skip_reason"),
    )


def parse_fundamentals(raw: DataFrame, periods: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """As-reported filings with their 19 amounts; the ticker must match on the filing date."""
    typed, bad, _ = _numbers(raw, AMOUNT_COLUMNS)
    days = {"calendar_date": "calendardate", "filing_date": "date", "report_period": "reportperiod"}
    typed = typed.withColumns({name: strict_date(F.col(c)) for name, c in days.items()}).withColumns(
        {
            "ticker_key": normalise_ticker(blank_to_null(F.col("ticker"))),
            "dim": F.upper(blank_to_null(F.col("dimension"))),
        }
    )
    bad = bad | _any([is_bad(F.col(c), F.col(name)) for name, c in days.items()])
    found = asof.resolve_period(
        typed.withColumn("_bad", bad), periods.withColumnRenamed("ticker", "ticker_key"), "ticker_key",
        "filing_date", "security_id",
    )
    reason = (
        F.when(F.col("ticker_key").isNull(), "missing_ticker")
        .when(~F.coalesce(F.col("dim").isin(*DIMENSIONS), F.lit(False)), "not_an_as_reported_dimension")
        .when(F.col("_bad"), "bad_value")
        .when(F.col("calendar_date").isNull() | F.col("filing_date").isNull(), "missing_date")
        .when(F.col("security_id").isNull(), "no_security_for_ticker_on_date")
    )
    return found.select(
        *keep, F.col("ticker_key").alias("ticker"), "security_id", F.col("dim").alias("dimension"), *days,
        blank_to_null(F.col("fiscalperiod")).alias("fiscal_period"),
        *[F.col(f"n_{name}").cast(AMOUNT).alias(name) for name in AMOUNT_COLUMNS],
        reason.alias("skip_reason"),
    )


def parse_actions(raw: DataFrame, periods: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Corporate actions: vendor code to type, both tickers resolved, value only where it counts."""
    code = F.lower(F.coalesce(blank_to_null(F.col("action")), F.lit("")))
    types = F.create_map(*[F.lit(x) for pair in ACTION_TYPES.items() for x in pair])
    typed = raw.withColumns(
        {
            "code": code,
            "ticker_key": normalise_ticker(blank_to_null(F.col("ticker"))),
            "contra_key": normalise_ticker(blank_to_null(F.col("contraticker"))),
            "effective_date": strict_date(F.col("date")),
            "_value": strict_decimal(F.col("value"), SCALE),
        }
    ).withColumn("action_type", F.try_element_at(types, F.col("code")))
    found = asof.resolve_period(
        typed, periods.withColumnRenamed("ticker", "ticker_key"), "ticker_key", "effective_date", "security_id"
    )
    found = asof.resolve_period(
        found, periods.withColumnRenamed("ticker", "contra_key"), "contra_key", "effective_date",
        "security_id", "related_security_id",
    )
    bad = is_bad(F.col("date"), F.col("effective_date")) | is_bad(F.col("value"), F.col("_value"))
    valued = F.col("action_type").isin(*VALUED_ACTIONS)
    reason = (
        F.when((F.col("code") == "") | F.col("ticker_key").isNull(), "missing_key_field")
        .when(F.col("action_type").isNull(), F.concat(F.lit("unmapped_action:"), "code"))
        .when(bad, "bad_value")
        .when(F.col("effective_date").isNull(), "missing_date")
        .when(F.col("security_id").isNull(), "no_security_for_ticker_on_date")
        .when(valued & ~F.coalesce(F.col("_value") > 0, F.lit(False)), "bad_value")
    )
    details = F.struct(
        F.col("code").alias("vendor_action"),
        F.col("contra_key").alias("contra_ticker"),
        blank_to_null(F.col("contraname")).alias("contra_name"),
        F.when(~valued, F.col("_value")).alias("vendor_value"),
    )
    return found.select(
        *keep, F.col("ticker_key").alias("ticker"), "security_id", "action_type", "effective_date",
        F.when(valued, F.col("_value")).cast(ACTION_VALUE).alias("value"), "related_security_id",
        details.alias("details"), reason.alias("skip_reason"),
    )


def parse_companies(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Company rows; rows that cannot be dated or identified get one of six reasons."""

    def clean(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit(""))

    def iso(name: str) -> Column:
        return F.when(clean(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), clean(name).try_cast("date"))

    flag = F.upper(F.trim(F.coalesce("isdelisted", F.lit(""))))
    first, last = iso("firstpricedate"), iso("lastpricedate")
    bad_date = (clean("firstpricedate").isNotNull() & first.isNull()) | (
        clean("lastpricedate").isNotNull() & last.isNull()
    )
    delisted = flag == "Y"
    identity = [clean(n) for n in ("permaticker", "ticker", "name")]
    reason = (
        F.when(_any([c.isNull() for c in identity]), "missing_identity")
        .when(~flag.isin("Y", "N"), "bad_isdelisted_flag")
        .when(bad_date, "bad_date")
        .when(first.isNull(), "no_first_price_date")
        .when(delisted & last.isNull(), "delisted_without_last_price_date")
        .when(delisted & (last < first), "last_price_before_first")
    )
    related = F.split(F.trim(F.upper(F.coalesce("relatedtickers", F.lit("")))), r"\s+")
    related = F.array_sort(F.array_distinct(F.filter(related, lambda t: ~t.isin("", "N/A"))))
    return raw.select(
        *keep, clean("permaticker").alias("source_id"), F.upper(clean("ticker")).alias("ticker"),
        clean("name").alias("company_name"), clean("exchange").alias("exchange"),
        clean("currency").alias("currency"), clean("location").alias("country"),
        clean("sector").alias("sector"), clean("industry").alias("industry"),
        clean("category").alias("category"), clean("siccode").alias("sic_code"),
        F.array_join(related, " ").alias("related_tickers"), first.alias("first_price_date"),
        F.when(delisted, last).alias("last_price_date"), reason.alias("skip_reason"),
    )


def parse_membership(raw: DataFrame, index_name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Index changes keyed by (date, lower-case action, ticker)."""
    day = strict_date(F.col("date"))
    fields = [blank_to_null(F.col(c)) for c in ("action", "ticker", "date")]
    reason = F.when(_any([f.isNull() for f in fields]), "missing_key_field").when(day.isNull(), "bad_date")
    return raw.select(
        *keep, F.lit(index_name).alias("index_name"), day.alias("record_date"),
        F.lower(blank_to_null(F.col("action"))).alias("action"),
        normalise_ticker(blank_to_null(F.col("ticker"))).alias("ticker"),
        blank_to_null(F.col("name")).alias("company_name"),
        normalise_ticker(blank_to_null(F.col("contraticker"))).alias("contra_ticker"),
        blank_to_null(F.col("contraname")).alias("contra_name"), blank_to_null(F.col("note")).alias("note"),
        reason.alias("skip_reason"),
    )


def parse_benchmark(raw: DataFrame, symbol: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prices of one fund; rows of other tickers are skipped with a reason."""
    columns = {"adjusted_close": "closeadj", "close_unadjusted": "closeunadj", "volume": "volume"}
    typed, bad, missing = _numbers(raw, columns)
    day = strict_date(F.col("date"))
    other = F.coalesce(normalise_ticker(blank_to_null(F.col("ticker"))), F.lit("")) != symbol.upper()
    impossible = (F.col("n_adjusted_close") <= 0) | (F.col("n_close_unadjusted") <= 0) | (F.col("n_volume") < 0)
    reason = (
        F.when(other, "other_ticker")
        .when(bad | is_bad(F.col("date"), day), "bad_value")
        .when(day.isNull() | missing, "missing_value")
        .when(impossible, "impossible_price_or_volume")
    )
    return typed.select(
        *keep, F.lit(symbol.upper()).alias("symbol"), day.alias("price_date"),
        F.col("n_close_unadjusted").cast(PRICE).alias("close_unadjusted"),
        F.col("n_adjusted_close").cast(PRICE).alias("adjusted_close"),
        F.round("n_volume").cast("bigint").alias("volume"), reason.alias("skip_reason"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("skip_reason IS NULL").drop("skip_reason")


def keep_first(rows: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first by source position, and `copies`, how many there were.

    NULL keys are equal to each other. One min_by per key, combined before the shuffle: many copies
    of one key cost no more than a few.
    """
    row = F.struct(*rows.columns)
    first = rows.groupBy(*keys).agg(F.min_by(row, F.struct(*position)).alias("_r"), F.count("*").alias("copies"))
    return first.select("_r.*", "copies")


def first_or_rejected(parsed: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """`keep_first` of the accepted rows together with every rejected row as it is, in one pass.

    A rejected row is a group of its own, so equal ones stay as many and none meets a common key.
    """
    own = F.when(F.col("skip_reason").isNotNull(), F.monotonically_increasing_id())
    rest = [c for c in parsed.columns if c not in keys and c not in position]
    # One struct that is both order and row, without the keys: rows are sorted here, so their width counts.
    groups = parsed.withColumn("_own", own).groupBy(*keys, "_own")
    first = groups.agg(F.min(F.struct(*position, *rest)).alias("_r"), F.count("*").alias("copies"))
    return first.select(*keys, "_r.*", "copies").select(*parsed.columns, "copies")


def new_rows(fresh: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows whose key is not stored yet (NULLs in keys count as equal)."""
    s = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return fresh.join(s, match, "left_anti")


def restated(fresh: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Fresh rows whose stored copy has other values; fresh values are cast to the stored type first."""
    types = {f.name: f.dataType for f in stored.schema.fields}
    s = stored.select(*keys, F.struct(*values).alias("_stored"))
    cast = F.struct(*[F.col(v).cast(types[v]).alias(v) for v in values])
    both = fresh.withColumn("_fresh", cast).join(s, list(keys))
    return both.filter(~F.col("_fresh").eqNullSafe(F.col("_stored"))).drop("_fresh", "_stored")


def import_summary(
    parsed: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str],
    position: Sequence[str],
) -> DataFrame:
    """[what, n]: rows inserted, already present, restated, and skipped by reason.

    One pass: skipped rows are counted per reason and accepted ones per key in the same aggregation
    (combined before the shuffle), then meet the stored rows.
    """
    good = F.col("skip_reason").isNull()
    keyed = parsed.withColumns({k: F.when(good, F.col(k)) for k in keys})
    first = keyed.groupBy("skip_reason", *keys).agg(
        F.min_by(F.struct(*values), F.struct(*position)).alias("_v"), F.count("*").alias("copies")
    )
    types = {f.name: f.dataType for f in stored.schema.fields}
    cast = F.struct(*[F.col(f"_v.{v}").cast(types[v]).alias(v) for v in values])
    both = first.withColumn("_fresh", cast).join(
        stored.select(*keys, F.struct(*values).alias("_stored")), list(keys), "left"
    )
    there, same = F.col("_stored").isNotNull(), F.col("_fresh").eqNullSafe(F.col("_stored"))

    def entry(what: Column, n: Column) -> Column:
        return F.struct(what.alias("what"), n.cast("bigint").alias("n"))

    def flag(test: Column) -> Column:
        return F.when(good & test, 1).otherwise(0)

    entries = [
        entry(F.lit("inserted"), flag(~there)),
        entry(F.lit("already_present"), flag(there)),
        entry(F.lit("restated"), flag(there & ~same)),
        entry(F.lit("skipped:duplicate_in_download"), F.when(good, F.col("copies") - 1).otherwise(0)),
        entry(F.concat(F.lit("skipped:"), F.coalesce("skip_reason", F.lit(""))), F.when(~good, F.col("copies")).otherwise(0)),
    ]
    rows = both.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return rows.groupBy("what").agg(F.sum("n").alias("n")).filter("what <> 'skipped:'")


def unmatched_tickers(parsed: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent tickers no security traded under on the row's date."""
    return (
        parsed.filter("skip_reason = 'no_security_for_ticker_on_date'")
        .groupBy("ticker")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "ticker")
        .limit(top)
    )
