"""Graph groups, median, quality lag, funnel pieces on small data."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, quality, universe
from tidemark.operators.graph import connected_components
from tidemark.params import QualityThresholds
from tidemark.sources import panel


def test_components_against_union_find(spark):
    rng = random.Random(2)
    # A star with a hot centre, a long chain, and random links.
    edges = [(1, 0, i) for i in range(1, 40)] + [(1, i, i + 1) for i in range(100, 160)]
    edges += [(s, rng.randint(200, 260), rng.randint(200, 260)) for s in (1, 2) for _ in range(40)]
    df = spark.createDataFrame(edges, "s int, a int, b int")
    got = {(r.s, r.node): r.component for r in connected_components(df, ["s"], "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in edges:
        x, y = find((s, a)), find((s, b))
        parent[max(x, y)] = min(x, y)
    for (s, node), component in got.items():
        assert component == find((s, node))[1]
    assert set(got) == {(s, n) for s, a, b in edges if a != b for n in (a, b)}


def shape(spark, kind):
    """(edges over ids that are mixed up, number of nodes, number of components): about 100,000 edges in one component, with one apart."""
    mixed = lambda c: (F.col(c) * 7919) % 100_003
    if kind == "star":
        pairs = spark.range(1, 100_001).select(F.lit(0).alias("a"), F.col("id").alias("b"))
    elif kind == "chain":
        pairs = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    else:
        nodes = spark.range(450)
        pairs = nodes.select(F.col("id").alias("a")).join(nodes.select(F.col("id").alias("b")), F.expr("a < b"))
    apart = spark.createDataFrame([(200_000, 200_001), (200_002, 200_002)], "a long, b long")
    return pairs.select(mixed("a").alias("a"), mixed("b").alias("b")).unionByName(apart)


@pytest.mark.parametrize(("kind", "nodes"), [("star", 100_001), ("chain", 100_001), ("clique", 450)])
def test_large_components(spark, kind, nodes):
    labels = connected_components(shape(spark, kind), [], "a", "b")
    sizes = {r.component: r["count"] for r in labels.groupBy("component").count().collect()}
    assert sizes == {0: nodes, 200_000: 2}


def test_no_slot_holds_a_hub(spark):
    links = shape(spark, "star").filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("node"))
    least = links.groupBy("node").agg(F.min("node").alias("least"), F.count("*").alias("degree"))
    met = graph.salted(links, [], "node", "high", least, 200_000)
    assert met.count() == links.count() and set(met.columns) == {"high", "node", "least"}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot" in plan
    slots = links.withColumn("slot", F.pmod(F.xxhash64("high"), F.lit(200)).cast("int")).groupBy("node", "slot").count()
    assert slots.agg(F.max("count")).first()[0] < 2 * graph.HUB


def test_components_of_nothing(spark):
    for rows in ([], [(1, 1)], [(None, 2), (3, None)]):
        edges = spark.createDataFrame(rows, "a int, b int")
        assert connected_components(edges, [], "a", "b").collect() == []


@pytest.mark.parametrize(
    ("values", "length", "want"), [([5, 1], 4, 0.5), ([5, 1, 3], 3, 3), ([], 4, 0), ([1, 2, 3, 10], 4, 2.5)]
)
def test_median_counts_missing_days_as_zero(spark, values, length, want):
    row = spark.createDataFrame([([D(v) for v in values],)], "v array<decimal(38,6)>")
    got = row.select(universe.median_of_window(F.col("v"), length).cast("double")).first()[0]
    assert got == want


def windows(spark, rng, count, straight):
    """Dates with windows of some days; `straight` ones move forward together, others lie anyhow."""
    days = [date(2005, 1, 1) + timedelta(days=30 * k if straight else rng.randrange(900)) for k in range(count)]
    rows = [(date(2010, 1, 1) + timedelta(days=k), d, d + timedelta(days=rng.randrange(1, 120))) for k, d in enumerate(days)]
    return rows, spark.createDataFrame(rows, "as_of date, first date, last date")


@pytest.mark.parametrize(("seed", "straight"), [(1, True), (2, False), (3, False)])
def test_covering_runs_by_brute_force(spark, seed, straight):
    rng = random.Random(seed)
    rows, dates = windows(spark, rng, 40, straight)
    starts = [date(2004, 6, 1) + timedelta(days=rng.randrange(1500)) for _ in range(60)]
    runs = [(i, d, d + timedelta(days=rng.randrange(-10, 700))) for i, d in enumerate(starts)]
    runs += [(100, None, date(2020, 1, 1)), (101, date(2000, 1, 1), None), (7, date(2005, 1, 1), date(2005, 3, 1))]
    frame = spark.createDataFrame(runs, "id int, first_date date, last_date date").repartition(3)
    got = {r.as_of: r.run_id for r in universe.covering_runs(dates, frame).collect()}
    want = {a: max((i for i, x, y in runs if x and y and x <= f and y >= t), default=None) for a, f, t in rows}
    assert got == want and len(set(want.values())) > 3
    assert {r.run_id for r in universe.covering_runs(dates, frame.limit(0)).collect()} == {None}
    assert universe.covering_runs(dates.limit(0), frame).collect() == []


def test_a_million_runs_meet_dates_by_equality(spark):
    rows, dates = windows(spark, random.Random(9), 60, True)
    start = F.date_add(F.lit(date(2004, 1, 1)), (F.xxhash64("id") % 1500 + 1500).cast("int"))
    runs = spark.range(1_000_000).select("id", start.alias("first_date"))
    runs = runs.withColumn("last_date", F.date_add("first_date", (F.xxhash64("id", F.lit(1)) % 200).cast("int")))
    found = universe.covering_runs(dates, runs)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.as_of: r.run_id for r in found.collect()}
    listed = runs.toPandas()
    for a, f, t in rows:
        held = listed[(listed.first_date <= f) & (listed.last_date >= t)].id
        assert got[a] == (None if held.empty else held.max())


def prices(spark, rows):
    data = [(1, d, *([D(c)] * 6), 1000, "x", "v") for d, c in rows]
    from tidemark.schemas import DAILY_PRICE

    return spark.createDataFrame(data, DAILY_PRICE)


def run(spark, rows, first=date(2011, 1, 1), last=date(2011, 12, 31), periods=None):
    actions = spark.createDataFrame([], "security_id bigint, action_type string, effective_date date")
    spans = spark.createDataFrame(
        periods or [(1, date(1998, 1, 1), None)], "security_id bigint, valid_from date, valid_to date"
    )
    master = spark.createDataFrame([(1, None)], "security_id bigint, end_date date")
    found = quality.price_findings(
        spark, prices(spark, rows), actions, spans, master, first, last, QualityThresholds(), date(2027, 1, 1)
    )
    return sorted((r.check_name, r.data_date, r.detail) for r in found.collect())


def test_jump_and_gap(spark):
    got = run(spark, [(date(2011, 3, 1), 10), (date(2011, 3, 2), 11), (date(2011, 3, 3), 22), (date(2011, 3, 21), 22)])
    assert got == [
        ("abnormal_jump", date(2011, 3, 3), "from=11.000000 to=22.000000 percent=100.0 since=2011-03-02"),
        ("possible_missing_split", date(2011, 3, 3), "from=11.000000 to=22.000000"),
        ("price_gap", date(2011, 3, 21), "days=11 since=2011-03-03"),
    ]


def test_a_move_of_exactly_the_limit_is_no_jump_and_saturdays_are_found(spark):
    assert run(spark, [(date(2011, 3, 1), 10), (date(2011, 3, 2), 15)]) == []
    assert [r[0] for r in run(spark, [(date(2011, 3, 5), 10)])] == ["bad_price_date"]


def test_lookback_reaches_over_the_year_end_but_not_further_than_30_days(spark):
    near = run(spark, [(date(2010, 12, 30), 10), (date(2011, 1, 3), 30)])
    assert "abnormal_jump" in [r[0] for r in near]
    far = run(spark, [(date(2010, 11, 1), 10), (date(2011, 1, 3), 30)])
    assert far == []


def test_price_without_a_ticker(spark):
    got = run(spark, [(date(2011, 3, 1), 10)], periods=[(1, date(2011, 3, 2), None)])
    assert got[0][0] == "price_outside_ticker_history" and got[0][2] == "no_ticker"


def test_covering_run(spark):
    runs = spark.createDataFrame(
        [(1, date(2000, 1, 1), date(2000, 12, 31)), (2, date(2000, 1, 1), date(2000, 6, 30))],
        "id int, first_date date, last_date date",
    )
    assert universe.covering_run(runs, date(2000, 2, 1), date(2000, 3, 1)) == 2
    assert universe.covering_run(runs, date(2000, 2, 1), date(2000, 9, 1)) == 1
    with pytest.raises(universe.NoQualityRun):
        universe.covering_run(runs, date(1999, 2, 1), date(2000, 9, 1))


def test_dates_without_a_covering_run_are_refused(spark):
    dates = spark.createDataFrame(
        [(date(2000, 3, 1), date(2000, 2, 1), date(2000, 2, 29)), (date(2001, 3, 1), date(2001, 2, 1), date(2001, 2, 28))],
        "as_of date, first date, last date",
    )
    runs = spark.createDataFrame(
        [(1, date(2000, 1, 1), date(2000, 12, 31)), (2, date(2000, 2, 1), date(2000, 2, 29)), (3, date(2001, 2, 2), date(2002, 1, 1))],
        "id bigint, first_date date, last_date date",
    )
    cover = universe.covering_runs(dates, runs)
    assert {r.as_of: r.run_id for r in cover.collect()} == {date(2000, 3, 1): 2, date(2001, 3, 1): None}
    rows = spark.createDataFrame([(date(2000, 3, 1), 1, None), (date(2001, 3, 1), 1, None)], "as_of date, security_id bigint, reason string")
    assert {r.as_of: r.reason for r in universe.gated(rows, cover).collect()} == {date(2000, 3, 1): None, date(2001, 3, 1): "no_quality_run"}


def test_the_last_day_is_read_once(spark, sf):
    session, jobs = spark.newSession(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("last day", "")
    try:
        days, ran = set(), []
        for _ in range(2):
            days.add(panel.last_day(session, sf))
            ran.append(len(jobs.getJobIdsForGroup("last day")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(days) == 1 and ran[0] > 0 and ran[1] == ran[0]


def test_rows_without_a_finding_do_not_reach_the_array_of_findings(spark):
    rows = [(1, date(2020, 1, 2), D(5)), (2, date(2020, 1, 2), D(0)), (3, date(2020, 1, 2), None)]
    caps = spark.createDataFrame(rows, "security_id int, cap_date date, market_cap_usd decimal(24,4)")
    found = quality.value_findings(caps, date(2020, 1, 1), date(2020, 12, 31))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generate = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    kept = [line.split("size(filter")[0] for line in plan[generate + 1 :] if "Filter" in line]
    assert any("(market_cap_usd" in line and "<= 0" in line for line in kept)
    assert [(r.security_id, r.check_name, r.detail) for r in found.collect()] == [(2, "non_positive_market_value", "value=0.0000")]
