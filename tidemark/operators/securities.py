"""Security master: differences between two states, and ticker history from change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DESCRIPTIVE = (
    "company_name", "exchange", "currency", "country", "sector", "industry", "category", "sic_code",
    "related_tickers",
)


def master_diff(download: DataFrame, stored: DataFrame, open_tickers: DataFrame) -> DataFrame:
    """[source_id, action, newly_delisted, changed, notes] of one full outer join on source_id.

    download: all parsed company rows, with the refused ones (skip_reason) among them; stored: the master;
    open_tickers: [security_id, open_ticker]. An id counts as seen once it has a row, refused or not: a stored security whose row was
    refused is `refused`, not `missing`. Facts that disagree but are not ours to change become notes: a code and the figures.
    """
    s = stored.join(open_tickers, "security_id", "left")
    s = s.select(F.col("source_id"), F.struct(*s.columns).alias("old"))
    seen = download.filter(F.col("source_id").isNotNull())
    d = seen.filter("skip_reason IS NULL").select(F.col("source_id"), F.struct(*download.columns).alias("new"))
    refused = seen.filter("skip_reason IS NOT NULL").groupBy("source_id").agg(F.min("skip_reason").alias("_refused"))
    rows = d.join(s, "source_id", "full").join(refused, "source_id", "left")
    new, old = F.col("new"), F.col("old")
    have = [c for c in DESCRIPTIVE if c in stored.columns and c in download.columns]
    changed = F.filter(
        F.array(*[F.when(~new[c].eqNullSafe(old[c]), F.lit(c)) for c in have]), lambda x: x.isNotNull()
    )
    delisting = new["last_price_date"].isNotNull() & ~old["delisted_flag"]
    action = (
        F.when(new.isNull() & F.col("_refused").isNotNull(), "refused")
        .when(new.isNull(), "missing")
        .when(old.isNull(), "created")
        .when(F.size("changed") > 0, "updated")
        .when(F.col("newly_delisted"), "newly_delisted")
        .otherwise("unchanged")
    )
    known = new.isNotNull() & old.isNotNull()

    def note(test: Column, code: str, *figures: Column) -> Column:
        return F.when(test, F.concat_ws(" ", F.lit(code), *[f.cast("string") for f in figures]))

    notes = F.array(
        note(known & (old["open_ticker"] != new["ticker"]), "ticker_differs", old["open_ticker"], new["ticker"]),
        note(known & ~old["start_date"].eqNullSafe(new["first_price_date"]), "start_differs", old["start_date"], new["first_price_date"]),
        note(known & old["delisted_flag"] & new["last_price_date"].isNull(), "active_again"),
        note(new.isNull(), "no_row", F.col("_refused")),
    )
    return (
        rows.withColumn("changed", F.when(known, changed).otherwise(F.array().cast("array<string>")))
        .withColumn("newly_delisted", F.coalesce(known & delisting, F.lit(False)))
        .withColumn("action", action)
        .withColumn("notes", F.filter(notes, lambda x: x.isNotNull()))
        .select("source_id", "action", "newly_delisted", "changed", "notes")
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """[what, n]: created, updated, unchanged, newly delisted, missing, refused, notes to review."""
    n = lambda test: F.count(F.when(test, 1))
    a = F.col("action")
    totals = diff.agg(
        n(a == "created").alias("created"), n(a == "updated").alias("updated"),
        n(a == "unchanged").alias("unchanged"), n(F.col("newly_delisted")).alias("newly_delisted"),
        n(a == "missing").alias("missing"), n(a == "refused").alias("refused"), F.coalesce(F.sum(F.size("notes")), F.lit(0)).alias("notes"),
    )
    pairs = [F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in totals.columns]
    return totals.select(F.explode(F.array(*pairs)).alias("t")).select("t.*")


def ticker_history(events: DataFrame) -> DataFrame:
    """[security_id, ticker, valid_from, valid_to, refusal] from listing, change and delisting events.

    events: [security_id, kind, ticker, effective] with kind open, change or close, one per security,
    day and kind. A change starts the new ticker on its day and ends the old one; a close ends the
    ticker the day after the last trading day. Refused, and without effect, are a change or close
    while no ticker is open, a change to the same ticker, and a change on the day the current one
    starts. A security has few events. Clashes between securities: `asof.overlapping_periods`.
    """
    order = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "change", 1).otherwise(2)
    w = W.partitionBy("security_id").orderBy("effective", "_o")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    # An opening stands before the changes of its day.
    opened = F.last(F.when(F.col("kind") == "open", F.col("effective")), True).over(earlier)
    rows = events.withColumn("_o", order).withColumn(
        "_too_early", (F.col("kind") == "change") & F.coalesce(opened == F.col("effective"), F.lit(False))
    )
    # A change to the ticker already held changes nothing, so it may stand for the current one.
    counts = ~F.col("_too_early")
    prev_ticker = F.last(F.when((F.col("kind") != "close") & counts, F.col("ticker")), True).over(earlier)
    prev_kind = F.last(F.when(F.col("kind") != "change", F.col("kind")), True).over(earlier)
    closed = prev_kind.isNull() | (prev_kind == "close")
    refusal = (
        F.when(F.col("_too_early"), "not after the current start")
        .when((F.col("kind") != "open") & closed, "no current ticker")
        .when((F.col("kind") == "change") & (F.col("ticker") == prev_ticker), "already trades as this ticker")
    )
    judged = rows.withColumn("refusal", refusal)
    good = F.col("refusal").isNull()
    stop = F.when(F.col("kind") == "close", F.date_add("effective", 1)).otherwise(F.col("effective"))
    after = F.lead(stop).over(W.partitionBy("security_id", good).orderBy("effective", "_o"))
    spans = judged.withColumn("_after", after).filter(~good | (F.col("kind") != "close"))
    return spans.select(
        "security_id", "ticker", F.col("effective").alias("valid_from"), F.when(good, F.col("_after")).alias("valid_to"), "refusal"
    )


def count_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tables whose row counts differ between two snapshots: [name, left_rows, right_rows, problem]."""
    both = left.select("name", F.col("rows").alias("left_rows")).join(
        right.select("name", F.col("rows").alias("right_rows")), "name", "full"
    )
    problem = (
        F.when(F.col("left_rows").isNull(), "extra")
        .when(F.col("right_rows").isNull(), "missing")
        .when(F.col("left_rows") != F.col("right_rows"), "different")
    )
    return both.withColumn("problem", problem).filter("problem IS NOT NULL")
