from __future__ import annotations

from oracle import portfolio  # noqa: F401
from oracle.views import VIEWS, build

VIEWS["series"] = """
SELECT industry AS series, price_date AS day, round(CAST(sum(adjusted_close) AS DOUBLE) / count(*), 6) AS nav
FROM trading_price JOIN security USING (security_id) GROUP BY 1, 2
"""
VIEWS["ret"] = """
SELECT series, day, nav, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM series
"""


def drawdown(source: str) -> str:
    """First worst fall: self-contained, per series."""
    return f"""
SELECT series, least(min(dd), 0) AS max_drawdown,
  CASE WHEN min(dd) < 0 THEN min_by(peak_day, (dd, day)) END AS peak_day, CASE WHEN min(dd) < 0 THEN min_by(day, (dd, day)) END AS trough_day
FROM (SELECT series, day, nav / top - 1 AS dd, min(CASE WHEN nav = top THEN day END) OVER (PARTITION BY series, top) AS peak_day
      FROM (SELECT *, max(nav) OVER (PARTITION BY series ORDER BY day) AS top FROM {source}) a) b GROUP BY series
"""


def period(source: str, unit: str) -> str:
    return f"""
SELECT series, period, last / coalesce(lag(last) OVER (PARTITION BY series ORDER BY period), first) - 1 AS ret
FROM (SELECT series, CAST(date_trunc('{unit}', day) AS DATE) AS period, arg_max(nav, day) AS last, arg_min(nav, day) AS first FROM {source} GROUP BY 1, 2) p
"""


VIEWS["drawdown"] = drawdown("series")
VIEWS["month_ret"] = period("series", "month")
VIEWS["year_ret"] = period("series", "year")
VIEWS["net_series"] = """
SELECT concat(n.strategy, '/', n.slippage) AS series, g.day, n.nav_after * g.growth AS nav FROM grown g JOIN net n USING (strategy, decision_date)
WHERE g.next_decision IS NULL OR g.day < g.next_decision
"""
VIEWS["net_drawdown"] = drawdown("net_series")
VIEWS["net_month"] = period("net_series", "month")
VIEWS["net_ret"] = VIEWS["ret"].replace("FROM series", "FROM net_series")
SQL = {
    "daily_returns": "SELECT series, day, round(ret, 6) AS ret FROM ret",
    "performance_summary": """
SELECT g.series, first_day, last_day, trading_days, d.peak_day, d.trough_day, m.months, m.positive_months,
  round(b / a - 1, 6) AS total_return, round(pow(b / a, 365.25 / (last_day - first_day)) - 1, 6) AS cagr,
  round(dev * sqrt(252), 6) AS volatility, round(mean * 252 / (dev * sqrt(252)), 6) AS sharpe, round(mean * 252 / (down * sqrt(252)), 6) AS sortino,
  round(d.max_drawdown, 6) AS max_drawdown, round(m.best, 6) AS best_month, round(m.worst, 6) AS worst_month
FROM (SELECT series, min(day) AS first_day, max(day) AS last_day, count(*) AS trading_days, arg_min(nav, day) AS a, arg_max(nav, day) AS b FROM series GROUP BY series) g
JOIN (SELECT series, avg(ret) AS mean, stddev_samp(ret) AS dev, sqrt(avg(pow(least(ret, 0), 2))) AS down FROM ret WHERE ret IS NOT NULL GROUP BY series) r USING (series)
JOIN drawdown d USING (series)
JOIN (SELECT series, count(*) AS months, count(*) FILTER (WHERE ret > 0) AS positive_months, max(ret) AS best, min(ret) AS worst FROM month_ret GROUP BY series) m USING (series)
""",
    "drawdowns": "SELECT series, round(max_drawdown, 6) AS max_drawdown, peak_day, trough_day FROM ("
    + drawdown("(SELECT security_id AS series, price_date AS day, CAST(adjusted_close AS DOUBLE) AS nav FROM trading_price) s")
    + ") z",
    "monthly_returns": "SELECT series, period, round(ret, 6) AS ret FROM month_ret",
    "yearly_returns": "SELECT series, period, round(ret, 6) AS ret FROM year_ret",
    "rebased_series": """
SELECT series, day, round(100000 * nav / first_value(nav) OVER (PARTITION BY series ORDER BY day), 4) AS nav FROM series WHERE day BETWEEN DATE '1999-03-01' AND DATE '2000-06-30'
""",
    "common_window": """
SELECT series, day, round(100000 * nav / first_value(nav) OVER (PARTITION BY series ORDER BY day), 4) AS nav FROM series
WHERE day IN (SELECT day FROM series GROUP BY day HAVING count(*) = (SELECT count(DISTINCT series) FROM series))
""",
    "calendar_year_table": """
SELECT CAST(year(period) AS BIGINT) AS year, round(max(CASE WHEN series = 'Industrial' THEN ret END), 6) AS "Industrial",
  round(max(CASE WHEN series = 'Software' THEN ret END), 6) AS "Software", round(max(CASE WHEN series = 'Tobacco' THEN ret END), 6) AS "Tobacco" FROM year_ret GROUP BY 1
""",
    "strategy_summary": """
SELECT g.series, trading_days, m.months, m.positive_months, t.rebalances, round(ln(b / a), 6) AS log_growth,
  round(CASE WHEN dev > 0 THEN mean * 252 / (dev * sqrt(252)) END, 6) AS sharpe, round(d.max_drawdown, 6) AS max_drawdown,
  round(t.traded / 2 / average / ((last_day - first_day) / 365.25), 6) AS annual_turnover, round(ln(nullif(t.costs, 0) / a), 6) AS log_costs, round(t.held, 6) AS average_holdings
FROM (SELECT series, min(day) AS first_day, max(day) AS last_day, count(*) AS trading_days, arg_min(nav, day) AS a, arg_max(nav, day) AS b, avg(nav) AS average FROM net_series GROUP BY series) g
JOIN (SELECT series, avg(ret) AS mean, stddev_samp(ret) AS dev FROM net_ret WHERE ret IS NOT NULL GROUP BY series) r USING (series)
JOIN net_drawdown d USING (series)
JOIN (SELECT series, count(*) AS months, count(*) FILTER (WHERE ret > 0) AS positive_months FROM net_month GROUP BY series) m USING (series)
JOIN (SELECT concat(n.strategy, '/', n.slippage) AS series, sum(coalesce(w, 0) * n.nav_before) AS traded, sum(n.costs) AS costs, avg(coalesce(held, 0)) AS held, count(*) AS rebalances FROM net n
  LEFT JOIN (SELECT strategy, decision_date, sum(abs(delta)) AS w FROM delta GROUP BY 1, 2) d USING (strategy, decision_date)
  LEFT JOIN (SELECT strategy, decision_date, count(*) AS held FROM holding GROUP BY 1, 2) h USING (strategy, decision_date) GROUP BY 1) t USING (series)
""",
}
SQL = {name: build(body) for name, body in SQL.items()}
