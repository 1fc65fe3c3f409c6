"""The driver's tables in the shape of the domain tables.

Every function takes (spark, directory) and returns a lazy DataFrame over the Parquet files; the
needed columns and the date filter reach the scan. `key` chooses what plays the security: "brand"
(25 wide securities, the shape of the correctness queries), "supplier" or "part" (wide panels for
the bench).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.schemas import AMOUNT_COLUMNS


# Schemas are given, so planning opens no file.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


#: The given order dates begin in 1995, the trading calendar in 1998: dates move by 157 whole weeks.
SHIFT_DAYS = 1099
_DATED = {"lineitem": "l_shipdate", "orders": "o_orderdate"}


@per_session
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")
    if day := _DATED.get(name):
        rows = rows.withColumn(day, F.col(day) + F.expr(f"INTERVAL {SHIFT_DAYS} DAYS"))
    return rows


@per_session
def last_day(spark: SparkSession, sf: str) -> date:
    """The newest price date of the data: where date grids end. One row reaches the driver, once, as the shared grids hold it anyway."""
    return table(spark, sf, "lineitem").agg(F.max("l_shipdate").cast("date")).first()[0]


def _brand() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


def _with_security(lines: DataFrame, spark: SparkSession, sf: str, key: str) -> DataFrame:
    if key == "brand":
        brands = table(spark, sf, "part").select("p_partkey", _brand().alias("security_id"))
        return lines.join(brands, F.col("l_partkey") == F.col("p_partkey"))
    column = {"supplier": "l_suppkey", "part": "l_partkey"}[key]
    return lines.withColumn("security_id", F.col(column) + 1)


@per_session
def daily_price(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    """One row per (security_id, price_date): first, highest, lowest and last trade of the day.

    The aggregates are combined before the shuffle, so a hot security or day costs no more. First and last are each one
    struct that is both order and value: rows are sorted here, so their width counts.
    """
    lines = table(spark, sf, "lineitem")
    rows = _with_security(lines, spark, sf, key).select(
        "security_id",
        F.col("l_shipdate").cast("date").alias("price_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("p"),
        F.col("l_quantity").cast("bigint").alias("q"),
        "l_orderkey",
        "l_linenumber",
    )
    order = F.struct("l_orderkey", "l_linenumber", "p")
    day = rows.groupBy("security_id", "price_date").agg(
        F.min(order)["p"].alias("open"),
        F.max("p").alias("_high"),
        F.min("p").alias("low"),
        F.max(order)["p"].alias("close"),
        F.sum("q").cast("bigint").alias("volume"),
    )
    broken = F.col("security_id") + F.dayofmonth("price_date") == 40
    halved = (F.col("security_id") % 5 == 0) & (F.col("price_date") < F.lit("2000-01-03").cast("date"))
    return day.select(
        "security_id",
        "price_date",
        "open",
        F.when(broken, F.col("low") - 1).otherwise(F.col("_high")).cast("decimal(18,2)").alias("high"),
        "low",
        "close",
        F.col("close").alias("adjusted_close"),
        (F.col("close") * F.when(halved, 2).otherwise(1)).cast("decimal(18,2)").alias("close_unadjusted"),
        "volume",
    )


@per_session
def security(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    if key == "brand":
        ids = table(spark, sf, "part").select(_brand().alias("security_id")).distinct()
    else:
        name, column = {"supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey")}[key]
        ids = table(spark, sf, name).select((F.col(column) + 1).alias("security_id"))
    b = F.col("security_id")
    return ids.select(
        "security_id",
        F.concat(F.lit("P"), b.cast("string")).alias("source_id"),
        F.concat(F.lit("Company "), (b % 20).cast("string")).alias("company_name")
        if key == "brand"
        else F.concat(F.lit("Company "), F.floor(b / 2).cast("string")).alias("company_name"),
        F.when(b % 6 == 0, "Tobacco").when(b % 6 == 1, "Software").otherwise("Industrial").alias("industry"),
        F.when(b % 4 == 0, "Technology").when(b % 4 == 1, "Energy").otherwise("Health").alias("sector"),
        F.when(b % 9 == 0, "6022").when(b % 9 == 1, "N/A").otherwise("7372").alias("sic_code"),
        F.when(b % 8 == 7, "ADR Common Stock")
        .when(b % 8 == 6, "Domestic Common Stock Secondary Class")
        .otherwise("Domestic Common Stock")
        .alias("category"),
        F.when(b <= 3, F.concat(F.lit("T"), (b + 21).cast("string")))
        .when(~b.isin(4, 24), "")
        .alias("related_tickers"),
        F.lit("1998-01-01").cast("date").alias("start_date"),
        F.when(b % 12 == 0, F.lit("2001-03-30").cast("date")).alias("end_date"),
        (b % 12 != 0).alias("active_flag"),
    )


@per_session
def security_ticker(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    ids = security(spark, sf, key).select("security_id")
    b = F.col("security_id")
    turn = F.lit("2000-01-01").cast("date")
    return ids.select(
        "security_id",
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("T"), b.cast("string")).alias("ticker"),
                    F.lit("1998-01-01").cast("date").alias("valid_from"),
                    turn.alias("valid_to"),
                ),
                F.struct(
                    F.concat(F.lit("T"), (b + 1).cast("string")).alias("ticker"),
                    turn.alias("valid_from"),
                    F.lit(None).cast("date").alias("valid_to"),
                ),
            )
        ).alias("t"),
    ).select("security_id", "t.*")


@per_session
def fundamental(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    """One filing per order. For wide panels the securities are as many as suppliers or parts."""
    width = {"brand": 25, "supplier": None, "part": None}[key]
    o = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    orders = table(spark, sf, "orders")
    security_id = (
        (F.col("o_custkey") % width + 1).cast("int") if width else (F.col("o_custkey") + 1)
    )
    day = F.col("o_orderdate").cast("date")
    split = (o % 7 == 0) & (o % 2 == 0)  # total missing, both parts given
    part = (total * F.lit(0.05).cast("decimal(4,2)")).cast("decimal(24,4)")
    return orders.select(
        security_id.alias("security_id"),
        o.alias("filing_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "ARQ")
        .when(F.col("o_orderpriority") == "2-HIGH", "ARY")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ART")
        .otherwise("MRQ")
        .alias("dimension"),
        day.alias("filing_date"),
        F.date_sub(day, (o % 700 - 20).cast("int")).alias("calendar_date"),
        F.lit(None).cast("date").alias("report_period"),
        (F.when(o % 17 == 0, -1).otherwise(1) * total).cast("decimal(24,4)").alias("debt"),
        F.when(o % 11 != 0, (total * F.lit(0.5).cast("decimal(4,2)")).cast("decimal(24,4)")).alias(
            "cash_and_equivalents"
        ),
        F.when(o % 7 != 0, (total * F.lit(0.1).cast("decimal(4,2)")).cast("decimal(24,4)")).alias(
            "investments"
        ),
        F.when(split, part).alias("investments_current"),
        F.when(split, part).alias("investments_noncurrent"),
        (F.when(o % 13 == 0, -1).otherwise(4) * total).cast("decimal(24,4)").alias("revenue"),
        (total * 2).cast("decimal(24,4)").alias("ebit"),
        (total * (2 - F.lit(0.05).cast("decimal(4,2)") * (o % 6).cast("int")))
        .cast("decimal(24,4)")
        .alias("operating_income"),
    )


def market_cap_of(prices: DataFrame) -> DataFrame:
    """The market-value table that belongs to a price table."""
    zero = F.col("security_id") + F.dayofmonth("price_date") == 53
    return prices.select(
        "security_id",
        F.col("price_date").alias("cap_date"),
        F.when(zero, 0)
        .otherwise(F.col("close") * F.col("volume"))
        .cast("decimal(24,4)")
        .alias("market_cap_usd"),
    )


@per_session
def daily_market_cap(spark: SparkSession, sf: str, key: str = "brand") -> DataFrame:
    return market_cap_of(daily_price(spark, sf, key))


@per_session
def corporate_action(spark: SparkSession, sf: str) -> DataFrame:
    """SPLIT actions on the split day for some of the split securities (10 and 20 are missing)."""
    ids = security(spark, sf).filter(F.col("security_id").isin(5, 15, 25))
    return ids.select(
        "security_id",
        F.lit("SPLIT").alias("action_type"),
        F.lit("2000-01-03").cast("date").alias("effective_date"),
        F.lit(2).cast("decimal(19,8)").alias("value"),
    )


@per_session
def order_state_event(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("order_id"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.when(kind == "signup", "APPROVED")
        .when(kind == "view", "SUBMITTED")
        .when(kind == "click", "ACKNOWLEDGED")
        .when(kind == "purchase", "FILLED")
        .otherwise("FAILED")
        .alias("state"),
        "value",
    )


@per_session
def order_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            e.alias("exec_id"),
            F.col("user_id").alias("order_id"),
            F.concat(F.lit("T"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"),
            F.when(e % 2 == 0, "BUY").otherwise("SELL").alias("side"),
            F.col("value").cast("decimal(18,2)").alias("quantity"),
        )
    )


def timed_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The fills with the time of their event; one event is one execution."""
    times = table(spark, sf, "events").select(F.col("event_id").alias("exec_id"), F.col("ts").alias("filled_at"))
    return order_fill(spark, sf).join(times, "exec_id")


@per_session
def broker_order(spark: SparkSession, sf: str) -> DataFrame:
    """One order per user that appears in the log; the quantity asked is taken from its id."""
    u = F.col("user_id")
    ids = table(spark, sf, "events").select("user_id").distinct()
    return ids.select(
        u.alias("order_id"),
        F.concat(F.lit("T"), (u % 25 + 1).cast("string")).alias("symbol"),
        F.when(u % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        (u % 7 * 60 + 40).cast("decimal(18,2)").alias("quantity"),
        F.concat(F.lit("ref-"), u.cast("string")).alias("idempotency_key"),
    )


@per_session
def vendor_report(spark: SparkSession, sf: str) -> DataFrame:
    """Outside opinions, one per customer in the order of their keys. Some customers have a second one under another
    spelling, of which every other stands before all the others (position: place in the file)."""
    c = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    status = F.when(seg == "BUILDING", "COMPLIANT").when(seg == "MACHINERY", "NON_COMPLIANT").when(seg == "AUTOMOBILE", "QUESTIONABLE").otherwise("UNRATED")
    one = F.struct(F.concat(F.lit("t"), c.cast("string")).alias("symbol"), status.alias("status"), c.alias("position"))
    again = F.struct(
        F.concat(F.lit(" T"), c.cast("string")).alias("symbol"),
        F.when(status == "COMPLIANT", "UNRATED").otherwise("COMPLIANT").alias("status"),
        F.when(c % 2 == 0, -c).otherwise(c + 1_000_000_000).alias("position"),
    )
    reports = F.when(c % 5 == 2, F.array(one, again)).otherwise(F.array(one))
    return table(spark, sf, "customer").select(F.explode(reports).alias("r")).select("r.*")


@per_session
def raw_price(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor price rows, all text, one per order line, with the usual defects."""
    o = F.col("l_orderkey")
    lines = table(spark, sf, "lineitem")
    rows = _with_security(lines, spark, sf, "brand")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    text = price.cast("string")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(o % 97 == 0, " n/a ")
        .when(o % 101 == 0, "ZZZ")
        .otherwise(F.concat(F.lit(" t"), F.col("security_id").cast("string")))
        .alias("ticker"),
        F.when(o % 89 == 0, "2024")
        .when(o % 83 == 0, "")
        .otherwise(F.col("l_shipdate").cast("date").cast("string"))
        .alias("date"),
        F.when(o % 79 == 0, "N/A").otherwise(text).alias("open"),
        text.alias("high"),
        F.when(o % 73 == 0, "NaN").otherwise(text).alias("low"),
        F.when(o % 71 == 0, "-1.5").otherwise(text).alias("close"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5")).alias("volume"),
        text.alias("closeadj"),
        text.alias("closeunadj"),
    )


@per_session
def raw_action(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor action rows, all text, one per order: every code, some unmapped, some broken."""
    o = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in (*ACTION_CODES, "spinoff", "")])
    ticker = F.concat(F.lit("t"), (F.col("o_custkey") % 25 + 1).cast("string"))
    contra = F.concat(F.lit("T"), (o % 25 + 1).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(o % 61 == 0, "2001-02-30")
        .otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"))
        .alias("date"),
        F.element_at(codes, (o % 14 + 1).cast("int")).alias("action"),
        F.when(o % 53 == 0, "N/A").otherwise(ticker).alias("ticker"),
        F.when(o % 47 == 0, "x1").when(o % 43 == 0, "").otherwise((o % 9).cast("string")).alias("value"),
        F.when(o % 3 == 0, "N/A").otherwise(contra).alias("contraticker"),
        F.when(o % 3 == 0, "n/a").otherwise(F.concat(F.lit("Contra "), contra)).alias("contraname"),
    )


# The vendor's action codes.
ACTION_CODES = (
    "split", "dividend", "acquisitionof", "acquisitionby", "mergerfrom", "mergerto", "tickerchangefrom",
    "tickerchangeto", "delisted", "regulatorydelisting", "voluntarydelisting", "bankruptcyliquidation",
)


@per_session
def raw_company(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor company rows, all text, one per customer, with each defect."""
    c = F.col("c_custkey")
    day = lambda base, step: F.date_format(F.date_add(F.lit(base).cast("date"), (c % step).cast("int")), "yyyy-MM-dd")  # noqa: E731,E501
    return table(spark, sf, "customer").select(
        F.when(c % 41 == 0, " ").otherwise(c.cast("string")).alias("permaticker"),
        F.concat(F.lit(" c"), c.cast("string")).alias("ticker"),
        "c_name",
        F.when(c % 37 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(c % 31 == 0, "?").when(c % 5 == 0, "y").otherwise("N").alias("isdelisted"),
        F.lit("Domestic Common Stock").alias("category"),
        F.lit("7372").alias("siccode"),
        F.col("c_mktsegment").alias("sector"),
        F.col("c_mktsegment").alias("industry"),
        F.lit("USD").alias("currency"),
        F.lit("NYSE").alias("exchange"),
        F.lit("US").alias("location"),
        F.concat(F.lit("zz "), c.cast("string"), F.lit(" N/A zz")).alias("relatedtickers"),
        F.when(c % 29 == 0, "1999-13-01").when(c % 23 == 0, "").otherwise(day("1998-01-01", 400)).alias("firstpricedate"),
        F.when(c % 20 == 0, "").when(c % 15 == 0, "1997-06-30").otherwise(day("2000-01-01", 600)).alias("lastpricedate"),
    )


@per_session
def raw_fundamental(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor filing rows, all text, one per order."""
    o = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    amounts = {
        "debt": total, "revenue": total, "ebit": F.when(o % 19 == 0, "oops").otherwise(total), "cashneq": total,
    }
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(o % 59 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("o_custkey") % 25 + 1).cast("string"))).alias("ticker"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "arq").when(F.col("o_orderpriority") == "2-HIGH", "ARY")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ART").otherwise("MRQ").alias("dimension"),
        F.when(o % 17 == 0, "N/A").otherwise(day).alias("calendardate"),
        day.alias("date"),
        F.lit("").alias("reportperiod"),
        F.lit("2000-Q1").alias("fiscalperiod"),
        *[amounts.get(c, F.lit("")).alias(c) for c in AMOUNT_COLUMNS.values()],
    )
