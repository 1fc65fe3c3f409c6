"""Order logs: latest states, illegal steps, positions, reconciliation, valuation, alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calendar
from tidemark.operators.ordered import lag_in_log
from tidemark.params import ORDER_STEPS


def latest_state(events: DataFrame, key: str, state: str = "state", at: str = "created_at") -> DataFrame:
    """The newest event of each key. Combined before the shuffle, so a hot key is one row per task."""
    newest = F.max_by(F.struct(state, at), "id")
    return events.groupBy(key).agg(newest.alias("_n")).select(key, "_n.*")


def switch_engaged(events: DataFrame) -> DataFrame:
    """One row [engaged]: the newest switch event; without events it is not engaged."""
    return events.agg(F.coalesce(F.max_by("engaged", "id"), F.lit(False)).alias("engaged"))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Log rows whose step from the state before is not allowed. A first event is always allowed."""
    allowed = F.concat_ws(">", "from_state", "state").isin(*[f"{a}>{b}" for a, b in ORDER_STEPS])
    rows = lag_in_log(events, "order_id", "id", ["state"], "from_")
    return rows.filter(F.col("from_state").isNotNull() & ~allowed)


def signed_quantity() -> Column:
    return F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))


def positions(fills: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """[symbol, quantity]: the baseline plus every fill, signed by side; zero positions dropped."""
    moves = fills.select("symbol", signed_quantity().alias("quantity"))
    if baseline is not None:
        moves = moves.unionByName(baseline.select("symbol", "quantity"))
    return moves.groupBy("symbol").agg(F.sum("quantity").alias("quantity")).filter("quantity <> 0")


def position_mismatches(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """Symbols on which the two sides differ; a missing side counts as zero."""
    zero = F.lit(0).cast("decimal(28,2)")
    both = expected.select("symbol", F.col("quantity").alias("_e")).join(
        reported.select("symbol", F.col("quantity").alias("_r")), "symbol", "full"
    )
    return both.select(
        "symbol", F.coalesce("_e", zero).alias("expected"), F.coalesce("_r", zero).alias("reported")
    ).filter("expected <> reported")


def unknown_orders(open_orders: DataFrame, known: DataFrame) -> DataFrame:
    """Orders open at the broker whose reference we never sent."""
    return open_orders.join(
        known.select(F.col("idempotency_key").alias("client_ref")), "client_ref", "left_anti"
    )


def filled_amounts(fills: DataFrame) -> DataFrame:
    """[order_id, filled, fills]: every execution counted once."""
    once = fills.groupBy("order_id", "exec_id").agg(F.max("quantity").alias("quantity"))
    return once.groupBy("order_id").agg(
        F.sum("quantity").alias("filled"), F.count("*").alias("fills")
    )


def order_overview(orders: DataFrame, events: DataFrame, fills: DataFrame) -> DataFrame:
    """Every order with its latest state and the amount filled."""
    return (
        orders.join(latest_state(events, "order_id"), "order_id", "left")
        .join(filled_amounts(fills), "order_id", "left")
        .withColumn("filled", F.coalesce("filled", F.lit(0).cast("decimal(28,2)")))
        .drop("fills")
    )


def derived_status(orders: DataFrame, fills: DataFrame, reported: DataFrame) -> DataFrame:
    """[order_id, filled, status]: fills decide, then what the broker reports."""
    filled = F.coalesce("filled", F.lit(0).cast("decimal(28,2)"))
    status = (
        F.when(filled >= F.col("quantity"), "FILLED")
        .when(filled > 0, "PARTIALLY_FILLED")
        .when(F.col("reported") == "REJECTED", "REJECTED_BY_BROKER")
        .when(F.col("reported") == "CANCELLED", "CANCELLED")
        .otherwise("ACKNOWLEDGED")
    )
    return (
        orders.join(filled_amounts(fills), "order_id", "left")
        .join(reported, "order_id", "left")
        .select("order_id", filled.alias("filled"), status.alias("status"))
    )


def valued_holdings(
    held: DataFrame, vintages: DataFrame, prices: DataFrame, approved: tuple[str, ...]
) -> DataFrame:
    """Positions at the last price of the newest complete vintage, with their weights.

    prices: [vintage_id, symbol, price_date, adjusted_close].
    """
    newest = (
        vintages.filter("status = 'complete'")
        .orderBy(F.desc_nulls_last("finished_at"))
        .limit(1)
        .select("vintage_id")
    )
    last = (
        prices.filter("adjusted_close IS NOT NULL")
        .join(F.broadcast(newest), "vintage_id", "left_semi")  # one row
        .groupBy("symbol")
        .agg(F.max("price_date").alias("price_date"), F.max_by("adjusted_close", "price_date").alias("_px"))
    )
    rows = held.join(last, "symbol", "left").withColumn(
        "value", F.col("quantity").cast("double") * F.col("_px").cast("double")
    )
    total = rows.agg(F.sum("value").alias("_total"))
    return rows.join(F.broadcast(total)).select(  # one row
        "symbol", "quantity", "price_date", "value",
        F.try_divide(F.col("value"), F.col("_total")).alias("weight"),
        F.when(F.upper("symbol").isin(*approved), "approved fund").otherwise("stock").alias("kind"),
    )


def orders_in(states: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    return states.filter(F.col("state").isin(*wanted))


def count_by_state(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))


def audit_trail(events: DataFrame, n: int) -> DataFrame:
    """The newest n audit events."""
    return events.orderBy(F.desc("sequence")).limit(n)


def recent_count(events: DataFrame, now: Column, hours: int) -> DataFrame:
    since = now - F.expr(f"interval {hours} hours")
    return events.filter(F.col("occurred_at") > since).agg(F.count("*").alias("events"))


def alerts(
    spark: SparkSession,
    today: date,
    engaged: DataFrame,
    states: DataFrame,
    mismatches: DataFrame,
    waiting: DataFrame,
    prices: DataFrame,
    max_age: int = 1,
) -> DataFrame:
    """[rank, severity, code, n, since], most serious first. Each input is reduced to one row.

    mismatches: audit events [occurred_on] of reconciliation mismatches, of which the last 7 days count; waiting:
    proposals to be approved. n is how many there are (for STALE_DATA the age of the newest price in trading days), since the first day it
    goes back to, where there is one.
    """
    c = F.col
    recent = c("occurred_on").between(F.date_sub(F.lit(today), 6), F.lit(today))
    facts = (
        engaged.select(c("engaged").cast("bigint").alias("stop"))
        .join(states.agg(F.count_if(c("state") == "SUBMISSION_UNKNOWN").alias("doubt"), F.count_if(c("state") == "FAILED").alias("failed")))
        .join(mismatches.filter(recent).agg(F.count("*").alias("mismatch"), F.min("occurred_on").alias("mismatch_since")))
        .join(waiting.agg(F.count("*").alias("waiting")))
        .join(prices.agg(F.max("price_date").alias("newest")))
    )
    cal = calendar.calendar(spark).select("day", "td_index", "is_trading")
    # Index of the last open day before today; one step back from there per trading day of age.
    now = cal.filter(c("day") == F.lit(today)).select((c("td_index") - c("is_trading").cast("int")).alias("_back"))
    then = cal.select(c("day").alias("newest"), c("td_index").alias("_at"))
    facts = facts.join(F.broadcast(now)).join(F.broadcast(then), "newest", "left")
    age = F.when(c("newest") >= F.lit(today), 0).otherwise(F.greatest(c("_back") - c("_at") + 1, F.lit(0)))
    none = F.lit(None).cast("date")
    raised = [
        ("CRITICAL", "KILL_SWITCH", c("stop") > 0, c("stop"), none),
        ("CRITICAL", "ORDER_IN_DOUBT", c("doubt") > 0, c("doubt"), none),
        ("CRITICAL", "RECONCILIATION_MISMATCH", c("mismatch") > 0, c("mismatch"), c("mismatch_since")),
        ("WARNING", "ORDERS_FAILED", c("failed") > 0, c("failed"), none),
        ("WARNING", "APPROVALS_WAITING", c("waiting") > 0, c("waiting"), none),
        ("WARNING", "NO_PRICES", c("newest").isNull(), F.lit(0), none),
        ("WARNING", "STALE_DATA", age > max_age, age, c("newest")),
    ]
    rows = [
        F.when(
            test,
            F.struct(
                F.lit(int(severity != "CRITICAL")).alias("rank"), F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                n.cast("bigint").alias("n"), since.alias("since"),
            ),
        )
        for severity, code, test, n, since in raised
    ]
    return facts.select(F.explode(F.array_compact(F.array(*rows))).alias("a")).select("a.*").orderBy("rank")
