"""Net value fold, costs and analytics against plain loops."""

import math
import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest

from tidemark.operators import analytics, net_value, portfolio, scoring
from tidemark.params import Costs
from tidemark.plans import portfolio as plans

COSTS = Costs()
DATES = [date(2000 + m // 12, m % 12 + 1, 3) for m in range(30)]


def cost(n, u, bps):
    return n * bps / 10_000 + min(max(n / u * 0.005, 1.0), n * 0.01)


def invested(seed, count=40, dates=DATES):
    """(factors, deltas, {date: (growth, orders)}): weights near the kinks of the commission rule, tiny ones, and cheap shares."""
    rng = random.Random(seed)
    factors, deltas, months, gross = [], [], {}, 100_000.0
    for i, d in enumerate(dates):
        g = 1.0 if i == 0 else rng.uniform(0.9, 1.12)
        gross *= g
        factors.append(("s", d, g, gross))
        orders = [(rng.choice([1e-7, 5e-4, 1e-3, 2e-3, 0.02, 0.2]) * rng.uniform(0.8, 1.2) * 40 / count, rng.choice([0.3, 0.5, 5.0, 60.0])) for _ in range(count)]
        months[d] = (g, orders)
        deltas += [("s", d, j, w * rng.choice([-1, 1]), u) for j, (w, u) in enumerate(orders)]
    return factors, deltas, months


def frames(spark, factors, deltas):
    f = spark.createDataFrame(factors, "strategy string, decision_date date, growth_in double, nav_before double")
    return spark.createDataFrame(deltas, "strategy string, decision_date date, security_id int, delta double, unadjusted double"), f


# Without passes nearly all orders stay single and maps have many pieces; with a month to a segment only the chain carries values.
@pytest.mark.parametrize(("seed", "passes", "length"), [(0, 3, 12), (1, 0, 12), (2, 1, 7), (3, 2, 1), (4, 3, 100)])
def test_net_nav_equals_a_loop_over_months(spark, seed, passes, length):
    factors, deltas, months = invested(seed)
    got = {(r.slippage, r.decision_date): r for r in net_value.net_nav(*frames(spark, factors, deltas), COSTS, passes, length).collect()}
    assert len(got) == 3 * len(DATES)
    for name, bps in COSTS.slippage_bps:
        nav = 100_000.0
        for d, (g, orders) in months.items():
            before = nav * g
            paid = sum(cost(w * before, u, bps) for w, u in orders if w * before >= 0.01)
            nav = before - paid
            r = got[(name, d)]
            assert math.isclose(r.nav_before, before, rel_tol=1e-9)
            assert math.isclose(r.costs, paid, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r.nav_after, nav, rel_tol=1e-9)


def test_passes_leave_few_orders_single(spark):
    factors, deltas, _ = invested(5)
    left = [net_value.refined(*frames(spark, factors, deltas), COSTS, passes)[1].count() for passes in range(4)]
    assert left[0] > 300 and left == sorted(left, reverse=True) and left[3] <= 15


def test_bounds_hold_the_value(spark):
    factors, deltas, _ = invested(6)
    pair = frames(spark, factors, deltas)
    months, _ = net_value.refined(*pair, COSTS)
    got = months.join(net_value.net_nav(*pair, COSTS), net_value.CASE).collect()
    assert len(got) == 3 * len(DATES) and all(r.lo <= r.nav_before <= r.hi and r.hi / r.lo < 1.001 for r in got)


def test_months_without_orders_and_no_months(spark):
    factors, deltas, _ = invested(7, dates=DATES[:14])
    o, f = frames(spark, factors, deltas)
    idle = net_value.net_nav(o.limit(0), f, COSTS).collect()
    assert len(idle) == 42 and all(r.costs == 0 and math.isclose(r.nav_after, dict((d, g) for _, d, _, g in factors)[r.decision_date], rel_tol=1e-12) for r in idle)
    assert net_value.net_nav(o, f.limit(0), COSTS).collect() == []


def test_commission_minimum_comes_before_the_cap(spark):
    rows = spark.createDataFrame([(10_000.0, 50.0), (50.0, 50.0), (10_000.0, 0.1)], "n double, u double")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(portfolio.order_cost(F.col("n"), F.col("u"), COSTS, F.lit(10.0))).collect()]
    assert got == pytest.approx([10 + 1.0, 0.05 + 0.5, 10 + 100.0])


def test_drawdown_keeps_the_first_worst(spark):
    d = [date(2020, 1, 1) + timedelta(days=i) for i in range(7)]
    nav = [("a", x, v) for x, v in zip(d, [100.0, 120.0, 90.0, 120.0, 90.0, 130.0, 125.0], strict=True)]
    nav += [("up", x, float(100 + i)) for i, x in enumerate(d)]
    got = {r.series: r for r in analytics.max_drawdown(spark.createDataFrame(nav, "series string, day date, nav double")).collect()}
    assert got["a"].max_drawdown == pytest.approx(-0.25)
    assert (got["a"].peak_day, got["a"].trough_day) == (d[1], d[2])
    assert (got["up"].max_drawdown, got["up"].peak_day) == (0.0, None)


def test_summary_of_a_short_series(spark):
    d = [date(2020, 1, 30), date(2020, 1, 31), date(2020, 2, 3), date(2020, 2, 28)]
    nav = spark.createDataFrame([("a", x, v) for x, v in zip(d, [100.0, 110.0, 99.0, 121.0], strict=True)], "series string, day date, nav double")
    r = analytics.summary(nav).first()
    rets = [0.1, -0.1, 121 / 99 - 1]
    mean = sum(rets) / 3
    dev = math.sqrt(sum((x - mean) ** 2 for x in rets) / 2)
    down = math.sqrt(0.01 / 3)
    assert r.total_return == pytest.approx(0.21)
    assert r.volatility == pytest.approx(dev * math.sqrt(252))
    assert r.sharpe == pytest.approx(mean * 252 / (dev * math.sqrt(252)))
    assert r.sortino == pytest.approx(mean * 252 / (down * math.sqrt(252)))
    assert (r.months, r.positive_months) == (2, 2)
    assert r.best_month == pytest.approx(0.1) and r.worst_month == pytest.approx(0.1)


def test_zero_and_missing_prices_give_rows_not_errors(spark):
    targets = spark.createDataFrame([(1, "A", D("10")), (1, "B", D("0")), (1, "C", None), (1, "E", None)], "portfolio int, symbol string, price decimal(18,2)")
    held = spark.createDataFrame([(1, "A", 1), (1, "D", 5), (1, "F", 5)], "portfolio int, symbol string, held bigint")
    prices = spark.createDataFrame([("C", D("20")), ("D", D("4"))], "symbol string, last_price decimal(18,2)")
    nav = spark.createDataFrame([(1, D("4000"))], "portfolio int, nav decimal(24,4)")
    rows = portfolio.whole_share_orders(targets, held, prices, nav).collect()
    assert {r.symbol: (r.quantity, r.reason) for r in rows} == {
        "A": (99, "below_weight"), "B": (None, "no_price"), "C": (50, "below_weight"), "D": (5, "no_target"),
        "E": (None, "no_price"), "F": (None, "no_price"),
    }


def test_hold_all_has_no_limit_and_an_unknown_trend_holds_nothing(spark):
    ranked = spark.createDataFrame(
        [("k", date(2000, m, 3), s, 1.0 / s, s, s, 50, 50, True) for m in (1, 2, 3) for s in range(1, 51)],
        "kind string, decision_date date, security_id int, score double, rank int, tradable_rank int, scored bigint, tradable_count bigint, tradable boolean",
    )
    strategies = spark.createDataFrame([("all", "k", None, 200), ("ten", "k", 10, None)], "strategy string, kind string, top_n int, trend_days int")
    signal = spark.createDataFrame([(date(2000, 1, 3), 200, True), (date(2000, 2, 3), 200, False), (date(2000, 3, 3), 200, None)], "decision_date date, trend_days int, risk_on boolean")
    held = scoring.select_holdings(ranked, strategies, signal).groupBy("strategy", "decision_date").count().collect()
    assert {(r.strategy, r.decision_date.month): r["count"] for r in held} == {("all", 1): 50, ("ten", 1): 10, ("ten", 2): 10, ("ten", 3): 10}


def test_stored_runs_build_one_panel(monkeypatch):
    built = []

    class Reached(Exception):
        pass

    def net_nav(*_):
        raise Reached

    monkeypatch.setattr(plans, "build_panel", lambda *_: built.append(1) or portfolio_panel)
    monkeypatch.setattr(plans.net_value, "net_nav", net_nav)
    portfolio_panel = plans.Panel(None, None, None, None, None)
    with pytest.raises(Reached):
        plans.run_store.__wrapped__(None, "")
    assert len(built) == 1
