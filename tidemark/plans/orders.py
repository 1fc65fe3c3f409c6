"""Order-log, risk and monitoring queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import out
from tidemark.operators import order_batch as sequence
from tidemark.operators import orders, risk
from tidemark.params import RiskLimits
from tidemark.sources import panel

LIMITS = RiskLimits(approved_funds=("T1", "T2"))


def order_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return orders.latest_state(panel.order_state_event(spark, sf), "order_id")


def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders.illegal_transitions(panel.order_state_event(spark, sf))
    return rows.select("order_id", "id", "from_state", "state")


def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders.illegal_transitions(panel.order_state_event(spark, sf))
    return rows.groupBy("from_state", "state").agg(F.count("*").alias("n"))


def switch_state(spark: SparkSession, sf: str) -> DataFrame:
    """Error events engage the switch, signups release it; the newest decides."""
    events = panel.table(spark, sf, "events").filter("event_type IN ('error', 'signup')")
    return orders.switch_engaged(
        events.select(F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("engaged"))
    )


def positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders.positions(panel.order_fill(spark, sf), _baseline(spark, sf))
    return rows.withColumn("quantity", out(F.col("quantity"), 2))


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Shares held before the log starts: one line per supplier nation."""
    n = F.col("s_nationkey")
    return panel.table(spark, sf, "supplier").groupBy(
        F.concat(F.lit("T"), (n + 1).cast("string")).alias("symbol")
    ).agg((F.count("*") * 10).cast("decimal(18,2)").alias("quantity"))


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    """What the broker says: fills of every 50th execution never reached it."""
    return orders.positions(panel.order_fill(spark, sf).filter("exec_id % 50 <> 0"))


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders.position_mismatches(
        orders.positions(panel.order_fill(spark, sf)), _reported(spark, sf)
    )
    return rows.select(
        "symbol", out(F.col("expected"), 2).alias("expected"), out(F.col("reported"), 2).alias("reported")
    )


def unknown_open_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders at the broker, one per customer; ours are those of the log."""
    open_orders = panel.table(spark, sf, "customer").select(
        F.concat(F.lit("ref-"), F.col("c_custkey").cast("string")).alias("client_ref")
    )
    return orders.unknown_orders(open_orders, panel.broker_order(spark, sf))


def order_overview(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders.order_overview(
        panel.broker_order(spark, sf), panel.order_state_event(spark, sf), panel.order_fill(spark, sf)
    )
    return rows.select(
        "order_id", "symbol", "side", out(F.col("quantity"), 2).alias("quantity"), "state",
        out(F.col("filled"), 2).alias("filled"),
    )


def derived_status(spark: SparkSession, sf: str) -> DataFrame:
    """The broker reports the newest error or signup of an order as rejected or cancelled."""
    e = panel.table(spark, sf, "events").filter("event_type IN ('error', 'signup')")
    kind = F.when(F.col("event_type") == "error", "REJECTED").otherwise("CANCELLED")
    reported = e.groupBy(F.col("user_id").alias("order_id")).agg(F.max_by(kind, "event_id").alias("reported"))
    # Executions are delivered twice; each counts once.
    fills = panel.order_fill(spark, sf)
    rows = orders.derived_status(panel.broker_order(spark, sf), fills.unionByName(fills), reported)
    return rows.withColumn("filled", out(F.col("filled"), 2))


def orders_in_doubt(spark: SparkSession, sf: str) -> DataFrame:
    states = orders.latest_state(panel.order_state_event(spark, sf), "order_id")
    return orders.orders_in(states, ("FAILED", "SUBMISSION_UNKNOWN")).select("order_id", "state")


def orders_by_state(spark: SparkSession, sf: str) -> DataFrame:
    return orders.count_by_state(orders.latest_state(panel.order_state_event(spark, sf), "order_id"))


def valued_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Positions at the last close; two vintages, of which the newer is still building."""
    px = panel.daily_price(spark, sf)
    symbol = F.concat(F.lit("T"), F.col("security_id").cast("string")).alias("symbol")
    both = F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("vintage_id")
    prices = px.select(both, symbol, "price_date",
        F.when(F.col("security_id") != 9, F.col("adjusted_close")).alias("adjusted_close"),
    )
    vintages = spark.createDataFrame(
        [("v1", "complete", "2002-01-01"), ("v2", "building", None)],
        "vintage_id string, status string, finished_at string",
    )
    rows = orders.valued_holdings(
        orders.positions(panel.order_fill(spark, sf)), vintages, prices, LIMITS.approved_funds
    )
    return rows.select(
        "symbol", out(F.col("quantity"), 2).alias("quantity"), "price_date",
        out(F.col("value"), 4).alias("value"), out(F.col("weight")).alias("weight"), "kind",
    )


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    return panel.table(spark, sf, "events").select(
        F.col("event_id").alias("sequence"), F.col("ts").alias("occurred_at"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"),
    )


def audit_trail(spark: SparkSession, sf: str) -> DataFrame:
    return orders.audit_trail(audit_events(spark, sf), 100).select("sequence", "actor", "action")


def audit_last_day(spark: SparkSession, sf: str) -> DataFrame:
    events = audit_events(spark, sf)
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    inside = events.filter(F.col("occurred_at") <= now)
    return orders.recent_count(inside, now, 24)


def risk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One order per log order against its portfolio (100 portfolios) and its security's facts."""
    o = F.col("order_id")
    last = panel.daily_price(spark, sf).groupBy("security_id").agg(
        F.max_by("close", "price_date").alias("last_close")
    )
    symbol = F.concat(F.lit("T"), F.col("security_id").cast("string"))
    price = last.select(symbol.alias("symbol"), (F.col("last_close") / 500).cast("decimal(18,2)").alias("price"))
    requests = (
        panel.broker_order(spark, sf)
        .join(price, "symbol")
        .select(
            (o % 100).alias("portfolio"), "order_id",
            F.when(o % 29 == 0, "ZZZ").otherwise(F.col("symbol")).alias("symbol"), "side",
            F.when(o % 31 == 0, 0).otherwise(F.col("quantity")).cast("decimal(18,2)").alias("quantity"), "price",
        )
    )
    return risk.order_facts(requests, risk_facts(spark, sf), risk_positions(spark, sf), risk_portfolios(spark, sf))


def risk_facts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("security_id")
    return panel.security(spark, sf).select(
        F.concat(F.lit("T"), s.cast("string")).alias("symbol"),
        F.when(s <= 3, "fund").otherwise("stock").alias("instrument"),
        F.when(s % 7 == 0, "NON_HALAL").when(s % 11 != 0, "HALAL").alias("status"),
        F.when(s % 13 != 0, s % 5).alias("price_age_days"),
        (s * 150_000).cast("decimal(18,2)").alias("volume_usd"), "sector",
    )


def risk_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Open positions: each portfolio's fills at a flat price of 10."""
    held = (
        panel.order_fill(spark, sf)
        .groupBy((F.col("order_id") % 100).alias("portfolio"), "symbol")
        .agg((F.sum("quantity") * 10).cast("decimal(18,2)").alias("market_value"))
    )
    return held.join(risk_facts(spark, sf).select("symbol", "instrument", "sector"), "symbol")


def risk_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("portfolio")
    ids = panel.broker_order(spark, sf).select((F.col("order_id") % 100).alias("portfolio")).distinct()
    return ids.select(
        "portfolio", (20_000 + p * 2_000).cast("decimal(18,2)").alias("nav"),
        (p * 900).cast("decimal(18,2)").alias("cash"),
        F.when(p % 10 == 1, 20_000 + p * 2_200).otherwise(20_000 + p * 2_000).cast("decimal(18,2)").alias("day_start_nav"),
        F.when(p % 10 == 2, 40_000 + p * 4_000).otherwise(20_000 + p * 2_000).cast("decimal(18,2)").alias("peak_nav"),
        (p * 100).cast("decimal(18,2)").alias("traded_today"), (p % 17 != 0).alias("connected"),
        (p % 23 == 0).alias("stopped"),
    )


def order_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = risk.check_orders(risk_rows(spark, sf), LIMITS)
    return rows.select(
        "order_id", "portfolio", "symbol", "side", out(F.col("notional"), 2).alias("notional"),
        "reason_code", "result",
    )


def fired_rules(spark: SparkSession, sf: str) -> DataFrame:
    return risk.fired_rules(risk.check_orders(risk_rows(spark, sf), LIMITS))


def order_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The same orders in sequence per portfolio."""
    rows = sequence.check_batch(risk_rows(spark, sf), risk_positions(spark, sf), LIMITS)
    return rows.select("portfolio", "place", "order_id", "symbol", "side", "reason_code", "result")


def system_alerts(spark: SparkSession, sf: str) -> DataFrame:
    states = orders.latest_state(panel.order_state_event(spark, sf), "order_id")
    checked = risk.check_orders(risk_rows(spark, sf), LIMITS)
    today = date(2004, 11, 23)
    # The broker missed every 50th execution; each was noted on one of the last 15 days.
    missed = panel.order_fill(spark, sf).filter("exec_id % 50 = 0")
    mismatch = missed.select(F.date_sub(F.lit(today), (F.col("exec_id") % 15).cast("int")).alias("occurred_on"))
    rows = orders.alerts(
        spark, today, switch_state(spark, sf), states, mismatch,
        checked.filter("result = 'REQUIRES_MANUAL_REVIEW'"), panel.daily_price(spark, sf),
    )
    return rows.select("severity", "code", "n", "since")


QUERIES = {
    "order_latest_state": order_latest_state,
    "illegal_transitions": illegal_transitions,
    "transition_counts": transition_counts,
    "switch_state": switch_state,
    "positions": positions,
    "reconciliation": reconciliation,
    "unknown_open_orders": unknown_open_orders,
    "order_overview": order_overview,
    "derived_status": derived_status,
    "orders_in_doubt": orders_in_doubt,
    "orders_by_state": orders_by_state,
    "valued_holdings": valued_holdings,
    "audit_trail": audit_trail,
    "audit_last_day": audit_last_day,
    "order_check": order_check,
    "fired_rules": fired_rules,
    "order_batch": order_batch,
    "system_alerts": system_alerts,
}
