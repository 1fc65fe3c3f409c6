"""Volatility from block moments against plain windows."""

import math
import random
import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, scoring

PRICES = "security_id int, price_date date, adjusted_close decimal(18,6)"


def market(spark, rng, days):
    """Prices with gaps, late starts, constant stretches and closes of zero."""
    rows = []
    for s in range(14):
        level, held = rng.uniform(1, 200), [d for d in days[rng.randrange(40) :] if rng.random() < (0.6, 0.85, 0.97, 1.0)[s % 4]]
        for k, d in enumerate(held):
            level *= 1.0 if s == 3 and k < 100 else 1 + rng.gauss(0, 0.02)
            rows.append((s, d, D(0) if s == 5 and k == 60 else D(f"{level:.6f}")))
    return rows, spark.createDataFrame(rows, PRICES).repartition(3)


@pytest.mark.parametrize("lookbacks", [[20], [5, 63, 40]])
def test_low_volatility_by_brute_force(spark, lookbacks):
    days = [r.day for r in calendar.trading_days(spark).filter("day BETWEEN '2003-01-01' AND '2003-10-31'").orderBy("day").collect()]
    dates = calendar.decision_dates(spark, days[30], days[-1])
    rows, prices = market(spark, random.Random(8), days)
    got = {}
    for r in scoring.low_volatility_scores(spark, prices, dates, lookbacks).collect():
        assert (r.security_id, r.decision_date, r.kind) not in got
        got[r.security_id, r.decision_date, r.kind] = r.score
    want, index = {}, {r.day: r.td_index for r in calendar.trading_days(spark).collect()}
    day_at = {i: d for d, i in index.items()}
    for d in dates.collect():
        for n in lookbacks:
            start = day_at.get(d.td_index - n)
            for s in range(14):
                closes = [float(c) for q, x, c in rows if q == s and start <= x <= d.prev_td]
                if len(closes) < n * 4 // 5 or len(closes) < 2 or min(closes) <= 0:
                    continue
                want[s, d.decision_date, f"low_volatility_{n}"] = -statistics.pstdev([b / a - 1 for a, b in zip(closes, closes[1:], strict=False)])
    assert got.keys() == want.keys() and len(want) > 50
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_no_nested_loop_and_empty_inputs(spark):
    days = [r.day for r in calendar.trading_days(spark).filter("day BETWEEN '2003-01-01' AND '2003-10-31'").orderBy("day").collect()]
    dates = calendar.decision_dates(spark, days[130], days[-1])
    _, prices = market(spark, random.Random(8), days)
    scores = scoring.low_volatility_scores(spark, prices, dates, [126])
    scores.collect()
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert scoring.low_volatility_scores(spark, prices.limit(0), dates, [126]).collect() == []
    assert scoring.low_volatility_scores(spark, prices, dates.filter(F.lit(False)), [126]).collect() == []
