from __future__ import annotations

from oracle import scoring  # noqa: F401
from oracle.universe import fingerprint
from oracle.views import VIEWS, build

DRAG = "(1 - 0.00015 / 252)"
VIEWS["month_day"] = """
SELECT s.decision_date, s.next_decision, t.day, t.td_index - s.td_index - 1 AS k
FROM (SELECT *, lead(decision_date) OVER (ORDER BY decision_date) AS next_decision FROM sweep_date) s
JOIN td t ON t.day >= s.decision_date AND t.day <= coalesce(s.next_decision, (SELECT max(price_date) FROM daily_price))
"""
VIEWS["held_path"] = """
SELECT h.decision_date, h.security_id, m.next_decision, m.day, m.k,
  last_value(CAST(p.adjusted_close AS DOUBLE) IGNORE NULLS) OVER w / first_value(CAST(p.adjusted_close AS DOUBLE)) OVER w AS rel,
  last_value(CAST(p.close_unadjusted AS DOUBLE) IGNORE NULLS) OVER w AS unadjusted
FROM (SELECT DISTINCT decision_date, security_id FROM holding) h JOIN month_day m USING (decision_date)
LEFT JOIN trading_price p ON p.security_id = h.security_id AND p.price_date = m.day
WINDOW w AS (PARTITION BY h.decision_date, h.security_id ORDER BY m.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
VIEWS["grown"] = f"""
SELECT s.strategy, m.decision_date, m.next_decision, m.day, m.k, coalesce(g.mean_rel * pow({DRAG}, m.k), 1.0) AS growth
FROM month_day m JOIN strategy s ON TRUE LEFT JOIN (
  SELECT h.strategy, h.decision_date, p.day, avg(p.rel) AS mean_rel FROM holding h JOIN held_path p ON p.decision_date = h.decision_date AND p.security_id = h.security_id GROUP BY ALL) g
  ON g.strategy = s.strategy AND g.decision_date = m.decision_date AND g.day = m.day
"""
VIEWS["factor"] = """
SELECT strategy, decision_date, growth_in, 100000 * exp(sum(ln(growth_in)) OVER (PARTITION BY strategy ORDER BY decision_date)) AS nav_before
FROM (SELECT strategy, decision_date, coalesce(lag(max(CASE WHEN day = next_decision THEN growth END)) OVER (PARTITION BY strategy ORDER BY decision_date), 1.0) AS growth_in
      FROM grown GROUP BY strategy, decision_date) f
"""
VIEWS["delta"] = f"""
SELECT coalesce(b.strategy, t.strategy) AS strategy, coalesce(b.decision_date, t.decision_date) AS decision_date, coalesce(b.security_id, t.security_id) AS security_id,
  coalesce(b.before, 0) AS before, coalesce(t.target, 0) AS target, coalesce(t.target, 0) - coalesce(b.before, 0) AS delta, coalesce(t.unadjusted, b.unadjusted) AS unadjusted,
  CASE WHEN b.before IS NULL THEN 'open' WHEN t.target IS NULL THEN 'close' ELSE 'rebalance' END AS kind
FROM (SELECT h.strategy, p.next_decision AS decision_date, h.security_id, 1.0 / h.held * p.rel * pow({DRAG}, p.k) / g.growth AS before, p.unadjusted
      FROM holding h JOIN held_path p ON p.decision_date = h.decision_date AND p.security_id = h.security_id AND p.day = p.next_decision
      JOIN grown g ON g.strategy = h.strategy AND g.decision_date = h.decision_date AND g.day = p.day) b
FULL JOIN (SELECT h.strategy, h.decision_date, h.security_id, 1.0 / h.held AS target, p.unadjusted
      FROM holding h JOIN held_path p ON p.decision_date = h.decision_date AND p.security_id = h.security_id AND p.k = 0) t
  ON t.strategy = b.strategy AND t.decision_date = b.decision_date AND t.security_id = b.security_id
"""
VIEWS["order_row"] = """
SELECT d.*, f.nav_before, abs(d.delta) * f.nav_before AS notional FROM delta d JOIN factor f USING (strategy, decision_date) WHERE abs(d.delta) * f.nav_before >= 0.01
"""
VIEWS["cost_case"] = "SELECT * FROM (VALUES ('optimistic', 5.0), ('base', 10.0), ('stress', 25.0)) v(slippage, bps)"
COST = "({n} * {bps} / 10000 + least(greatest({n} / {u} * 0.005, 1.0), {n} * 0.01))"
VIEWS["step"] = """
SELECT f.strategy, f.decision_date, f.growth_in, row_number() OVER (PARTITION BY f.strategy ORDER BY f.decision_date) AS i,
  coalesce(o.orders, []) AS orders
FROM factor f LEFT JOIN (SELECT strategy, decision_date, list({'w': CAST(abs(delta) AS DOUBLE), 'u': CAST(unadjusted AS DOUBLE)}) AS orders FROM delta GROUP BY ALL) o USING (strategy, decision_date)
"""
_COST_AT = (
    "coalesce(list_sum(list_transform({orders}, lambda o: CASE WHEN o.w * {nav} >= 0.01 THEN "
    + COST.format(n="(o.w * {nav})", bps="{bps}", u="o.u")
    + " ELSE 0.0 END)), 0.0)"
)
VIEWS["net"] = f"""
WITH RECURSIVE walk AS (
  SELECT strategy, slippage, bps, i, decision_date, nav_before, costs, nav_before - costs AS nav_after FROM (
    SELECT s.strategy, c.slippage, CAST(c.bps AS DOUBLE) AS bps, s.i, s.decision_date, 100000.0::DOUBLE AS nav_before, {_COST_AT.format(orders="s.orders", nav="100000.0::DOUBLE", bps="c.bps")} AS costs
    FROM step s JOIN cost_case c ON TRUE WHERE s.i = 1) a
  UNION ALL
  SELECT strategy, slippage, bps, i, decision_date, nav_before, costs, nav_before - costs FROM (
    SELECT *, {_COST_AT.format(orders="orders", nav="nav_before", bps="bps")} AS costs FROM (
      SELECT w.strategy, w.slippage, w.bps, s.i, s.decision_date, s.orders, w.nav_after * s.growth_in AS nav_before
      FROM walk w JOIN step s ON s.strategy = w.strategy AND s.i = w.i + 1) z) b)
SELECT * FROM walk
"""

SQL = {
    "portfolio_paths": "SELECT decision_date, security_id, day, round(rel, 6) AS rel, unadjusted FROM held_path",
    "gross_nav": """
SELECT g.strategy, g.day AS date, round(ln(f.nav_before * g.growth), 6) AS log_nav FROM grown g JOIN factor f USING (strategy, decision_date)
WHERE g.next_decision IS NULL OR g.day < g.next_decision
""",
    "order_deltas": """
SELECT strategy, decision_date, security_id, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, kind,
  round(before, 6) AS before, round(target, 6) AS target, round(delta, 6) AS delta, unadjusted FROM order_row
""",
    "order_costs": f"""
SELECT strategy, decision_date, slippage, count(*) AS orders, round(sum(notional / nav_before), 6) AS traded,
  round(sum({COST.format(n="notional", bps="bps", u="unadjusted")}) / sum(notional), 8) AS cost_rate
FROM order_row JOIN cost_case ON TRUE GROUP BY 1, 2, 3
""",
    "net_nav": """
SELECT strategy, slippage, decision_date, round(ln(nav_before), 6) AS log_before, round(costs / nav_before, 8) AS cost_rate, round(ln(nav_after), 6) AS log_after FROM net
""",
    "rebalance_summary": """
SELECT n.strategy, n.slippage, n.decision_date, coalesce(e.eligible, 0) AS eligible, coalesce(r.scored, 0) AS scored, coalesce(h.selected, 0) AS selected,
  round(coalesce(d.moved, 0) / 2, 6) AS turnover, round(n.costs / n.nav_before, 8) AS cost_rate, round(ln(n.nav_before), 6) AS log_before, round(ln(n.nav_after), 6) AS log_after
FROM net n JOIN strategy s USING (strategy)
LEFT JOIN (SELECT as_of, count(*) AS eligible FROM candidate GROUP BY 1) e ON e.as_of = n.decision_date
LEFT JOIN (SELECT kind, decision_date, count(*) AS scored FROM ranked GROUP BY 1, 2) r ON r.kind = s.kind AND r.decision_date = n.decision_date
LEFT JOIN (SELECT strategy, decision_date, count(*) AS selected FROM holding GROUP BY 1, 2) h ON h.strategy = n.strategy AND h.decision_date = n.decision_date
LEFT JOIN (SELECT strategy, decision_date, sum(abs(delta)) AS moved FROM delta GROUP BY 1, 2) d ON d.strategy = n.strategy AND d.decision_date = n.decision_date
""",
    "trade_reasons": """
SELECT o.strategy, o.decision_date, o.security_id, o.kind AS kind_of_trade,
  CASE WHEN o.kind = 'open' THEN 'entered' WHEN o.kind <> 'close' THEN 'reweighted' WHEN NOT t.risk_on THEN 'trend_off'
    WHEN o.security_id NOT IN (SELECT security_id FROM candidate x WHERE x.as_of = o.decision_date) THEN 'not_eligible' WHEN r.security_id IS NULL THEN 'unscored' ELSE 'outranked' END AS cause,
  r.rank, n.of AS ranked, round(r.score, 6) AS score, CASE WHEN s.kind = 'market_cap' THEN d.prev_td ELSE ts.day END AS window_start,
  CASE WHEN s.kind = 'market_cap' THEN d.prev_td ELSE te.day END AS window_end, e.status
FROM order_row o JOIN (SELECT *, CASE WHEN kind = 'market_cap' THEN 0 ELSE CAST(string_split(kind, '_')[-CASE WHEN kind LIKE 'low%' THEN 1 ELSE 2 END] AS INT) END AS lb,
    CASE WHEN kind LIKE 'momentum%' THEN CAST(string_split(kind, '_')[-1] AS INT) ELSE 0 END AS sk FROM strategy) s USING (strategy)
JOIN sweep_date d ON d.decision_date = o.decision_date JOIN td te ON te.td_index = d.td_index - s.sk JOIN td ts ON ts.td_index = d.td_index - s.sk - s.lb
LEFT JOIN ranked r ON r.kind = s.kind AND r.decision_date = o.decision_date AND r.security_id = o.security_id
LEFT JOIN (SELECT kind, decision_date, count(*) AS of FROM ranked GROUP BY 1, 2) n ON n.kind = s.kind AND n.decision_date = o.decision_date
LEFT JOIN trend t ON t.decision_date = o.decision_date AND t.trend_days = s.trend_days
LEFT JOIN in_effect e ON e.security_id = o.security_id AND e.decision_date = o.decision_date
""",
    "nav_fingerprint": fingerprint(
        "holding", "concat('=', decision_date, '|=', security_id, '|=', rank, '|=', held)", "strategy"
    ),
    "reproducibility": """
SELECT strategy AS strategy_version, slippage AS slippage_case, NOT (strategy = 'momentum-v1' AND slippage = 'base') AS same FROM (SELECT DISTINCT strategy, slippage FROM net) n
""",
    "stored_runs": "SELECT DISTINCT strategy AS strategy_version, slippage AS slippage_case FROM net WHERE strategy LIKE 'momentum\\_l%' ESCAPE '\\'",
    "period_labels": """
SELECT what, first, last, CASE WHEN first >= DATE '1998-12-01' AND last <= DATE '2003-12-31' THEN 'burn_in' WHEN first >= DATE '2004-01-01' AND last <= DATE '2013-12-31' THEN 'in_sample' ELSE 'custom' END AS period FROM (
  SELECT DISTINCT 'day' AS what, price_date AS first, price_date AS last FROM daily_price
  UNION ALL SELECT concat('run ', security_id), min(price_date), max(price_date) FROM daily_price GROUP BY security_id) x
""",
    "whole_share_orders": """
SELECT * FROM (WITH wallet AS (SELECT order_id % 2 AS portfolio, sum(quantity) * 100 AS nav FROM order_fill GROUP BY 1
), known AS (SELECT concat('T', security_id) AS symbol, close FROM last_close WHERE security_id NOT IN (13, 14)
), aim AS (
  SELECT w.portfolio, w.nav, concat('T', l.security_id) AS symbol, CASE l.security_id WHEN 11 THEN 0 WHEN 12 THEN l.close WHEN 14 THEN NULL ELSE l.close END AS px
  FROM last_close l JOIN wallet w ON TRUE WHERE (l.close < 40000 OR l.security_id IN (11, 12, 14)) AND l.security_id <> 13
), sized AS (SELECT *, floor(nav / count(*) OVER (PARTITION BY portfolio) / nullif(px, 0)) AS wanted FROM aim
), own AS (
  SELECT order_id % 2 AS portfolio, symbol, floor(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END)) AS held FROM order_fill
  GROUP BY 1, 2 HAVING sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) > 0
), pair AS (
  SELECT portfolio, symbol, s.symbol IS NOT NULL AS aimed, coalesce(s.px, k.close) AS px, coalesce(wanted, 0) - coalesce(held, 0) AS d
  FROM sized s FULL JOIN own o USING (portfolio, symbol) LEFT JOIN known k USING (symbol)
)
SELECT portfolio, symbol, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN px > 0 THEN CAST(abs(d) AS BIGINT) END AS quantity, CAST(px AS DOUBLE) AS price,
  CASE WHEN coalesce(px, 0) <= 0 THEN 'no_price' WHEN NOT aimed THEN 'no_target' WHEN d > 0 THEN 'below_weight' ELSE 'above_weight' END AS reason
FROM pair WHERE coalesce(px, 0) <= 0 OR (d <> 0 AND NOT (aimed AND abs(d) * px < 50))) z
""",
}
VIEWS["last_close"] = "SELECT security_id, max_by(close, price_date) AS close FROM daily_price GROUP BY security_id"
SQL = {name: build(body) for name, body in SQL.items()}
