from datetime import date

from pyspark.sql import functions as F

from tidemark.operators.securities import diff_summary, master_diff, ticker_history
from tidemark.operators.spread import spread
from tidemark.plans import ingest as plans_ingest

D = date


def test_ticker_history(spark):
    events = [
        (1, "open", "A", D(2020, 1, 1)), (1, "change", "B", D(2020, 3, 1)), (1, "change", "B", D(2020, 4, 1)),
        (1, "close", None, D(2021, 1, 29)), (1, "change", "C", D(2021, 2, 1)),
        (2, "open", "X", D(2020, 1, 1)), (2, "change", "Y", D(2020, 1, 1)), (2, "change", "Y", D(2020, 6, 1)),
        (3, "change", "Q", D(2020, 1, 1)), (1, "change", "D", D(2021, 3, 1)),
    ]
    df = spark.createDataFrame(events, "security_id int, kind string, ticker string, effective date")
    got = sorted((tuple(r) for r in ticker_history(df).collect()), key=str)
    assert got == sorted(
        [
            (1, "A", D(2020, 1, 1), D(2020, 3, 1), None),
            (1, "B", D(2020, 3, 1), D(2021, 1, 30), None),
            (1, "B", D(2020, 4, 1), None, "already trades as this ticker"),
            (1, "C", D(2021, 2, 1), None, "no current ticker"),
            (1, "D", D(2021, 3, 1), None, "no current ticker"),
            (2, "X", D(2020, 1, 1), D(2020, 6, 1), None),
            (2, "Y", D(2020, 1, 1), None, "not after the current start"),
            (2, "Y", D(2020, 6, 1), None, None),
            (3, "Q", D(2020, 1, 1), None, "no current ticker"),
        ],
        key=str,
    )


def test_a_refused_row_is_not_a_missing_one(spark):
    download = spark.createDataFrame(
        [("1", "A", "One", D(2000, 1, 3), None, None), ("2", None, "Two", None, None, "missing_identity"), ("4", "N", "New", D(2000, 1, 3), None, None)],
        "source_id string, ticker string, company_name string, first_price_date date, last_price_date date, skip_reason string",
    )
    stored = spark.createDataFrame(
        [(k, str(k), name, D(2000, 1, 3), False) for k, name in ((1, "One"), (2, "Two"), (3, "Three"))],
        "security_id bigint, source_id string, company_name string, start_date date, delisted_flag boolean",
    )
    tickers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "security_id bigint, open_ticker string")
    diff = master_diff(download, stored, tickers)
    assert {r.source_id: (r.action, list(r.notes)) for r in diff.collect()} == {
        "1": ("unchanged", []),
        "2": ("refused", ["no_row missing_identity"]),
        "3": ("missing", ["no_row"]),
        "4": ("created", []),
    }
    assert {r.what: r.n for r in diff_summary(diff).collect()}["missing"] == 1


def test_tasks_follow_the_rows(spark):
    """Few rows stay as they are; many are dealt over more tasks than the session has, and the window adds no shuffle."""
    rows = spark.range(1000).select((F.col("id") % 50).alias("security_id"), F.lit("open").alias("kind"), F.lit("A").alias("ticker"), F.date_add(F.lit(D(2020, 1, 1)), F.col("id").cast("int")).alias("effective"))
    assert spread(rows, "security_id", each=400) is rows
    dealt = ticker_history(spread(rows, "security_id", each=50))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(security_id" in plan and ", 20)" in plan and dealt.count() == 1000
    assert "Union" not in plan


def test_registered_download_is_read_in_small_parts(spark, sf, monkeypatch):
    """The second download is dealt by size, not over a fixed number of tasks."""
    seen = []
    monkeypatch.setattr(plans_ingest.sinks, "register_version", lambda rows, *a: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(plans_ingest, "scratch", lambda spark: sf)
    try:
        plans_ingest.version_registry(spark, sf)
    except Exception:  # noqa: BLE001 - nothing was registered, so nothing can be read
        pass
    assert "RebalancePartitions" in seen[1] and "Repartition 3" not in seen[1]
