"""Ingest queries: vendor text to stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.hashing import fingerprint, row_text
from tidemark.functions.numeric import out
from tidemark.functions.text import blank_to_null, company_key, normalise_symbol, related_set, strict_date, strict_decimal
from tidemark.operators import ingest
from tidemark.sources import panel, sinks
from tidemark.sources.checkpoints import scratch

POSITION = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
PRICE_KEY = ("security_id", "price_date")


@per_session
def parsed_prices(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_prices(
        panel.raw_price(spark, sf), panel.security_ticker(spark, sf), keep=POSITION
    )


def price_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per reason, with the volume of the accepted ones."""
    rows = parsed_prices(spark, sf)
    return rows.groupBy(F.coalesce("skip_reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("volume"))), F.lit(0)).alias("volume"),
    )


def clean_values(spark: SparkSession, sf: str) -> DataFrame:
    """Blank, date and number cleaning of every raw row, counted by outcome."""
    raw = panel.raw_price(spark, sf)
    day, low = strict_date(F.col("date")), strict_decimal(F.col("low"))
    return raw.groupBy(
        blank_to_null(F.col("ticker")).alias("ticker"), day.isNull().alias("no_date"),
        low.isNull().alias("no_low"), blank_to_null(F.col("open")).isNull().alias("no_open"),
    ).agg(F.count("*").alias("n"))


def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol spellings, company keys and related-ticker sets of the company rows."""
    return panel.raw_company(spark, sf).select(
        normalise_symbol(F.concat("ticker", F.lit("-a/b"))).alias("symbol"),
        company_key(F.concat(F.lit("  "), "c_name", F.lit("   inc"))).alias("company_key"),
        F.array_join(related_set(F.col("relatedtickers")), " ").alias("related"),
    )


def first_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The first of repeated price keys in the download, with the number of copies."""
    rows = ingest.keep_first(ingest.accepted(parsed_prices(spark, sf)), PRICE_KEY, (*POSITION, "close", "volume"))
    return rows.select(*PRICE_KEY, "l_orderkey", out(F.col("close")).alias("close"), "volume", "copies")


def _stored_prices(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier load left: odd months, with the last traded close of the day."""
    px = panel.daily_price(spark, sf).filter(F.month("price_date") % 2 == 1)
    return px.select(*PRICE_KEY, F.col("close").cast("decimal(30,6)").alias("close"), "volume")


def price_import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.import_summary(
        parsed_prices(spark, sf), _stored_prices(spark, sf), PRICE_KEY, ("close", "volume"),
        (*POSITION, "close", "volume"),
    )


def unmatched_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.unmatched_tickers(parsed_prices(spark, sf))


def new_price_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the download that are not stored yet."""
    fresh = ingest.keep_first(ingest.accepted(parsed_prices(spark, sf)), PRICE_KEY, (*POSITION, "close", "volume"))
    return ingest.new_rows(fresh, _stored_prices(spark, sf), PRICE_KEY).select(*PRICE_KEY)


def restated_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Stored keys whose values differ in the download."""
    fresh = ingest.keep_first(ingest.accepted(parsed_prices(spark, sf)), PRICE_KEY, (*POSITION, "close", "volume"))
    rows = ingest.restated(fresh, _stored_prices(spark, sf), PRICE_KEY, ("close", "volume"))
    return rows.select(*PRICE_KEY, out(F.col("close")).alias("close"), "volume")


def market_cap_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = panel.raw_price(spark, sf).withColumnRenamed("close", "marketcap")
    rows = ingest.parse_market_caps(raw, panel.security_ticker(spark, sf), keep=POSITION)
    return rows.groupBy("security_id", "skip_reason").agg(
        F.count("*").alias("n"), out(F.sum("market_cap_usd"), 2).alias("usd")
    )


def benchmark_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.parse_benchmark(panel.raw_price(spark, sf), "t7", keep=POSITION)
    return rows.groupBy("skip_reason").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def action_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.parse_actions(panel.raw_action(spark, sf), panel.security_ticker(spark, sf), keep=("o_orderkey",))
    good = F.col("skip_reason").isNull()
    return rows.select(
        "o_orderkey", "skip_reason", F.when(good, F.col("security_id")).alias("security_id"),
        F.when(good, F.col("action_type")).alias("action_type"), F.when(good, out(F.col("value"))).alias("value"),
        F.when(good, F.col("related_security_id")).alias("related_security_id"),
        F.when(good, F.col("details.contra_name")).alias("contra_name"),
    )


def distinct_actions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per action key; a missing value is a value of the key."""
    rows = ingest.accepted(
        ingest.parse_actions(panel.raw_action(spark, sf), panel.security_ticker(spark, sf), keep=("o_orderkey",))
    )
    first = ingest.keep_first(rows, ("security_id", "action_type", "effective_date", "value"), ("o_orderkey",))
    return first.select(
        "security_id", "action_type", "effective_date", out(F.col("value")).alias("value"), "o_orderkey", "copies"
    )


def fundamental_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.parse_fundamentals(panel.raw_fundamental(spark, sf), panel.security_ticker(spark, sf))
    return rows.groupBy("security_id", "dimension", "skip_reason").agg(
        F.count("*").alias("n"), out(F.sum("debt"), 2).alias("debt")
    )


def company_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.parse_companies(panel.raw_company(spark, sf), keep=("c_name",))
    return rows.select(
        "c_name", "source_id", "ticker", "related_tickers", "first_price_date", "last_price_date", "skip_reason"
    )


def membership_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = panel.raw_action(spark, sf).withColumns({"name": F.col("contraname"), "note": F.lit("")})
    rows = ingest.parse_membership(raw, "sp500", keep=("o_orderkey",))
    return rows.select("o_orderkey", "record_date", "action", "ticker", "company_name", "contra_ticker", "skip_reason")


def data_version(spark: SparkSession, sf: str) -> DataFrame:
    """Row count and fingerprint of the raw download, independent of row order."""
    raw = panel.raw_price(spark, sf)
    return fingerprint(raw, row_text(*[F.col(c) for c in ("ticker", "date", "open", "high", "low", "close", "volume")]))


def version_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Downloads registered one after the other, one of them twice: the first record of equal data stays."""
    path = f"{scratch(spark)}/versions"
    raw = panel.raw_price(spark, sf)
    text = row_text(*[F.col(c) for c in ("ticker", "date", "open", "high", "low", "close", "volume")])
    for source, rows in (("first", raw), ("again", raw.hint("rebalance")), ("part", raw.filter("l_orderkey % 2 = 0"))):
        sinks.register_version(rows, text, "prices", source, path)
    stored = spark.read.schema("dataset string, sha256 string, version string, source string, row_count bigint, downloaded_at timestamp").parquet(path)
    return stored.select("dataset", "sha256", "version", "source", "row_count")


QUERIES = {
    "price_parse": price_parse,
    "clean_values": clean_values,
    "text_keys": text_keys,
    "first_copies": first_copies,
    "price_import_summary": price_import_summary,
    "unmatched_tickers": unmatched_tickers,
    "new_price_keys": new_price_keys,
    "restated_prices": restated_prices,
    "market_cap_parse": market_cap_parse,
    "benchmark_parse": benchmark_parse,
    "action_parse": action_parse,
    "distinct_actions": distinct_actions,
    "fundamental_parse": fundamental_parse,
    "company_parse": company_parse,
    "membership_parse": membership_parse,
    "data_version": data_version,
    "version_registry": version_registry,
}
