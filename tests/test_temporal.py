"""Temporal joins against brute force, with hot keys, ties and look-ahead checks."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, calendar
from tidemark.operators.ordered import lag_in_log
from tidemark.operators.ranking import rank_in_groups

D0 = date(1999, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    # One key holds most of the rows.
    build = [(1 if rng.random() < 0.7 else rng.randint(2, 6), day(rng.randint(-200, 400)), i) for i in range(600)]
    probe = sorted({(rng.randint(1, 7), day(rng.randint(-100, 420))) for _ in range(300)})
    b = spark.createDataFrame(build, "k int, at date, v int")
    p = spark.createDataFrame(probe, "k int, d date")
    return build, probe, b, p


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("age", [None, 10])
def test_asof_join(data, inclusive, age):
    build, probe, b, p = data
    got = asof.asof_join(p, b, ["k"], "d", "at", ["v"], inclusive, tie=["v"], max_age_days=age)
    got = {(r.k, r.d): (r["at"], r.v) for r in got.collect()}
    for k, d in probe:
        seen = [(t, v) for kk, t, v in build if kk == k and (t <= d if inclusive else t < d)]
        best = max(seen, default=(None, None))
        if age is not None and best[0] is not None and (d - best[0]).days >= age:
            best = (None, None)
        assert got[(k, d)] == best, (k, d)


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_within(spark, data, inclusive):
    build, _, b, _ = data
    unique = b.groupBy("k", "at").agg(F.max("v").alias("v"))
    rows = [tuple(r) for r in unique.collect()]
    dates = [day(n) for n in (5, 40, 41, 333)]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    got = asof.asof_within(unique, df, ["k"], "at", "d", ["v"], 7, inclusive)
    got = {(r.k, r.d): (r["at"], r.v) for r in got.collect()}
    want = {}
    for d in dates:
        lo, hi = (d - timedelta(6), d) if inclusive else (d - timedelta(7), d - timedelta(1))
        for k in range(1, 7):
            seen = [(t, v) for kk, t, v in rows if kk == k and lo <= t <= hi]
            if seen:
                want[(k, d)] = max(seen)
    assert got == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_monthly(spark, data, inclusive):
    build, _, b, _ = data
    months = calendar.screening_dates(spark, date(1999, 1, 1), date(2000, 1, 1)).select("month_no", "screening_date")
    dates = [r.screening_date for r in months.collect()]
    grid = spark.createDataFrame([(k, d) for k in range(1, 8) for d in dates], "k int, screening_date date")
    got = asof.asof_monthly(grid, b, months, 1999 * 12 + 1, ["k"], "screening_date", "at", ["v"], ["v"], inclusive)
    got = {(r.k, r.screening_date): (r["at"], r.v) for r in got.collect()}
    assert len(got) == 7 * len(dates)
    for (k, d), found in got.items():
        seen = [(t, v) for kk, t, v in build if kk == k and (t <= d if inclusive else t < d)]
        assert found == max(seen, default=(None, None))


def test_poisoned_future_changes_nothing(data):
    build, probe, b, p = data
    cut = day(100)
    early = p.filter(F.col("d") <= F.lit(cut))
    poisoned = b.withColumn("v", F.when(F.col("at") >= F.lit(cut), F.col("v") * 1000).otherwise(F.col("v")))
    a = asof.asof_join(early, b, ["k"], "d", "at", ["v"], False, tie=["v"])
    c = asof.asof_join(early, poisoned, ["k"], "d", "at", ["v"], False, tie=["v"])
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, c.collect()), key=str)


def test_ticker_periods(spark):
    periods = spark.createDataFrame(
        [("ZQA", 1, date(2020, 1, 1), None), ("ZQB", 2, date(2020, 1, 1), date(2022, 1, 1)),
         ("ZQB", 3, date(2023, 1, 1), None)],
        "ticker string, security_id int, valid_from date, valid_to date",
    )
    rows = spark.createDataFrame(
        [("ZQA", date(2019, 12, 31)), ("ZQA", date(2020, 1, 1)), ("ZQB", date(2021, 12, 31)),
         ("ZQB", date(2022, 1, 1)), ("ZQB", date(2023, 1, 1))],
        "ticker string, d date",
    )
    got = asof.resolve_period(rows, periods, "ticker", "d", "security_id").orderBy("ticker", "d").collect()
    assert [r.security_id for r in got] == [None, 1, 2, None, 3]
    assert asof.overlapping_periods(periods, "ticker").count() == 0


def test_overlap_with_a_period_that_is_not_the_neighbour(spark):
    periods = spark.createDataFrame(
        [("A", date(2020, 1, 1), date(2024, 1, 1)), ("A", date(2020, 2, 1), date(2020, 3, 1)),
         ("A", date(2021, 1, 1), None)],
        "ticker string, valid_from date, valid_to date",
    )
    assert asof.overlapping_periods(periods, "ticker").count() == 2


def test_lag_in_log_across_ranges(spark):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(1000), 300))
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, f"s{i}") for i in ids]
    log = spark.createDataFrame(rows, "k int, id bigint, s string")
    got = {r.id: r.prev_s for r in lag_in_log(log, "k", "id", ["s"], "prev_", width=37).collect()}
    last = {}
    for k, i, s in rows:
        assert got[i] == last.get(k)
        last[k] = s


def test_rank_in_groups_is_exact(spark):
    rng = random.Random(5)
    # One group holds most rows; many equal scores.
    rows = [("a" if rng.random() < 0.8 else rng.choice("bc"), i, float(rng.randint(0, 40)), rng.random() < 0.6) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, id int, score double, ok boolean")
    got = {r.id: r for r in rank_in_groups(df, ["g"], "score", "id", "ok").collect()}
    for g in "abc":
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        marked = 0
        for place, (_, i, _, ok) in enumerate(part, 1):
            marked += ok
            assert got[i]["rank"] == place and got[i]["group_size"] == len(part)
            assert got[i]["marked_rank"] == (marked if ok else None)
