from __future__ import annotations

from oracle.views import VIEWS, build

VIEWS["state_now"] = "SELECT order_id, arg_max(state, id) AS state, arg_max(created_at, id) AS created_at FROM order_state_event GROUP BY order_id"
VIEWS["allowed_step"] = """
SELECT * FROM (VALUES ('APPROVED','SUBMITTED'),('APPROVED','FAILED'),('APPROVED','CANCELLED'),('SUBMITTED','ACKNOWLEDGED'),('SUBMITTED','PARTIALLY_FILLED'),('SUBMITTED','FILLED'),
  ('SUBMITTED','REJECTED_BY_BROKER'),('SUBMITTED','CANCELLED'),('SUBMITTED','SUBMISSION_UNKNOWN'),('SUBMITTED','FAILED'),('ACKNOWLEDGED','PARTIALLY_FILLED'),('ACKNOWLEDGED','FILLED'),
  ('ACKNOWLEDGED','CANCELLED'),('ACKNOWLEDGED','REJECTED_BY_BROKER'),('PARTIALLY_FILLED','PARTIALLY_FILLED'),('PARTIALLY_FILLED','FILLED'),('PARTIALLY_FILLED','CANCELLED')) v(a, b)
"""
VIEWS["illegal"] = """
SELECT order_id, id, from_state, state FROM (SELECT *, lag(state) OVER (PARTITION BY order_id ORDER BY id) AS from_state FROM order_state_event) x
WHERE from_state IS NOT NULL AND (from_state, state) NOT IN (SELECT (a, b) FROM allowed_step)
"""
VIEWS["signed"] = "SELECT *, CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS q FROM order_fill"
VIEWS["expected"] = "SELECT symbol, sum(q) AS q FROM signed GROUP BY symbol HAVING sum(q) <> 0"
VIEWS["reported"] = "SELECT symbol, sum(q) AS q FROM signed WHERE exec_id % 50 <> 0 GROUP BY symbol HAVING sum(q) <> 0"
VIEWS["mismatch"] = """
SELECT symbol, coalesce(e.q, 0) AS expected, coalesce(r.q, 0) AS reported FROM expected e FULL JOIN reported r USING (symbol) WHERE coalesce(e.q, 0) <> coalesce(r.q, 0)
"""
VIEWS["filled"] = "SELECT order_id, sum(quantity) AS filled FROM order_fill GROUP BY order_id"
VIEWS["risk_fact"] = """
SELECT concat('T', security_id) AS symbol, CASE WHEN security_id <= 3 THEN 'fund' ELSE 'stock' END AS instrument,
  CASE WHEN security_id % 7 = 0 THEN 'NON_HALAL' WHEN security_id % 11 <> 0 THEN 'HALAL' END AS status, CASE WHEN security_id % 13 <> 0 THEN security_id % 5 END AS age,
  security_id * 150000 AS volume, sector FROM security
"""
VIEWS["risk_position"] = """
SELECT order_id % 100 AS portfolio, symbol, sum(quantity) * 10 AS mv, f.instrument, f.sector FROM order_fill JOIN risk_fact f USING (symbol) GROUP BY ALL
"""
VIEWS["risk_order"] = """
SELECT order_id, p, symbol, side, quantity, price, quantity * price AS n, 20000 + p * 2000 AS nav, p * 900 AS cash,
  CASE WHEN p % 10 = 1 THEN 20000 + p * 2200 ELSE 20000 + p * 2000 END AS day_start, CASE WHEN p % 10 = 2 THEN 40000 + p * 4000 ELSE 20000 + p * 2000 END AS peak, p * 100 AS traded
FROM (SELECT o.order_id, o.order_id % 100 AS p, CASE WHEN o.order_id % 29 = 0 THEN 'ZZZ' ELSE o.symbol END AS symbol, o.side,
    CASE WHEN o.order_id % 31 = 0 THEN 0 ELSE o.quantity END AS quantity, CAST(round(l.close / 500, 2) AS DECIMAL(18,2)) AS price
  FROM broker_order o JOIN last_price l ON o.symbol = concat('T', l.security_id)) x
"""
VIEWS["last_price"] = "SELECT security_id, arg_max(close, price_date) AS close FROM daily_price GROUP BY security_id"
VIEWS["checked"] = """
SELECT *, CASE code WHEN 'OK' THEN 'APPROVED' WHEN 'MANUAL_REVIEW_ORDER_SIZE' THEN 'REQUIRES_MANUAL_REVIEW' ELSE 'REJECTED' END AS result FROM (
  SELECT o.*, CASE WHEN p % 23 = 0 THEN 'KILL_SWITCH_ENGAGED' WHEN quantity <= 0 OR price <= 0 THEN 'BAD_ORDER' WHEN f.symbol IS NULL THEN 'UNKNOWN_SECURITY'
    WHEN side = 'BUY' AND f.instrument = 'fund' AND o.symbol NOT IN ('T1', 'T2') THEN 'FUND_NOT_APPROVED'
    WHEN side = 'BUY' AND f.instrument = 'stock' AND f.status = 'NON_HALAL' THEN 'SHARIA_NON_HALAL' WHEN side = 'BUY' AND f.instrument = 'stock' AND f.status IS NULL THEN 'SHARIA_UNKNOWN'
    WHEN f.age IS NULL OR f.age > 3 THEN 'STALE_PRICE' WHEN side = 'BUY' AND f.volume < 1000000 THEN 'ILLIQUID'
    WHEN side = 'BUY' AND (peak - nav) * 100 >= 25 * peak THEN 'PORTFOLIO_DRAWDOWN_LIMIT' WHEN side = 'BUY' AND (day_start - nav) * 100 >= 5 * day_start THEN 'DAILY_LOSS_LIMIT'
    WHEN side = 'BUY' AND (coalesce(h.mv, 0) + n) * 100 > CASE f.instrument WHEN 'fund' THEN 60 ELSE 10 END * nav THEN 'POSITION_LIMIT'
    WHEN side = 'BUY' AND f.instrument = 'stock' AND (coalesce(s.mv, 0) + n) * 100 > 30 * nav THEN 'SECTOR_LIMIT'
    WHEN side = 'BUY' AND (coalesce(t.mv, 0) + n) * 100 > 100 * nav THEN 'EXPOSURE_LIMIT' WHEN side = 'BUY' AND n > cash THEN 'CASH_INSUFFICIENT'
    WHEN n > 50000 THEN 'ORDER_TOO_LARGE' WHEN (traded + n) * 100 > 60 * nav THEN 'DAILY_TURNOVER_LIMIT' WHEN p % 17 = 0 THEN 'BROKER_DISCONNECTED' WHEN n > 20000 THEN 'MANUAL_REVIEW_ORDER_SIZE' ELSE 'OK' END AS code
  FROM risk_order o LEFT JOIN risk_fact f USING (symbol)
  LEFT JOIN (SELECT portfolio, symbol, sum(mv) AS mv FROM risk_position GROUP BY 1, 2) h ON h.portfolio = o.p AND h.symbol = o.symbol
  LEFT JOIN (SELECT portfolio, sector, sum(mv) AS mv FROM risk_position WHERE instrument = 'stock' GROUP BY 1, 2) s ON s.portfolio = o.p AND s.sector = f.sector
  LEFT JOIN (SELECT portfolio, sum(mv) AS mv FROM risk_position GROUP BY 1) t ON t.portfolio = o.p) z
"""
# Orders in sequence: one step of the recursion judges the next order of every portfolio. State: what is
# held by symbol and by sector (maps), in all, spent and traded.
VIEWS["batch_order"] = """
SELECT o.*, f.instrument, f.sector, c.code AS alone, row_number() OVER (PARTITION BY o.p ORDER BY o.side <> 'SELL', o.symbol, o.order_id) AS k
FROM risk_order o JOIN checked c USING (order_id) LEFT JOIN risk_fact f ON f.symbol = o.symbol
"""
BATCH = """
SELECT * FROM (WITH RECURSIVE start AS (
  SELECT p, CAST(coalesce((SELECT sum(mv) FROM risk_position h WHERE h.portfolio = p), 0) AS DECIMAL(28,4)) AS invested,
    coalesce((SELECT map_from_entries(list((symbol, CAST(mv AS DECIMAL(28,4))))) FROM risk_position h WHERE h.portfolio = p), MAP {}) AS held,
    coalesce((SELECT map_from_entries(list((sector, v))) FROM (SELECT sector, CAST(sum(mv) AS DECIMAL(28,4)) AS v FROM risk_position h
      WHERE h.portfolio = p AND instrument = 'stock' AND sector <> '' GROUP BY 1) s), MAP {}) AS sectors
  FROM (SELECT DISTINCT p FROM risk_order) d
), walk AS (
  SELECT p, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS VARCHAR) AS code,
    invested, held, sectors, CAST(0 AS DECIMAL(28,4)) AS spent, CAST(0 AS DECIMAL(28,4)) AS traded_now FROM start
  UNION ALL
  SELECT p, k, order_id, symbol, side, code, CAST(invested + change AS DECIMAL(28,4)),
    map_concat(held, MAP {symbol: CAST(own + change AS DECIMAL(28,4))}),
    CASE WHEN instrument = 'stock' AND sector <> '' THEN map_concat(sectors, MAP {sector: CAST(peers + change AS DECIMAL(28,4))}) ELSE sectors END,
    CAST(spent + CASE WHEN NOT filled THEN 0 WHEN side = 'BUY' THEN n ELSE -n END AS DECIMAL(28,4)), CAST(traded_now + CASE WHEN filled THEN n ELSE 0 END AS DECIMAL(28,4))
  FROM (
    SELECT *, code IN ('OK', 'MANUAL_REVIEW_ORDER_SIZE') AS filled, CASE WHEN code NOT IN ('OK', 'MANUAL_REVIEW_ORDER_SIZE') THEN 0
        WHEN side = 'BUY' THEN n WHEN own - n > 0.005 THEN -n ELSE -own END AS change
    FROM (
      SELECT *, CASE WHEN early THEN alone
          WHEN side = 'BUY' AND (own + n) * 100 > CASE instrument WHEN 'fund' THEN 60 ELSE 10 END * nav THEN 'POSITION_LIMIT'
          WHEN side = 'BUY' AND instrument = 'stock' AND sector <> '' AND (peers + n) * 100 > 30 * nav THEN 'SECTOR_LIMIT'
          WHEN side = 'BUY' AND (invested + n) * 100 > 100 * nav THEN 'EXPOSURE_LIMIT' WHEN side = 'BUY' AND n > cash - spent THEN 'CASH_INSUFFICIENT'
          WHEN n > 50000 THEN 'ORDER_TOO_LARGE' WHEN (traded + traded_now + n) * 100 > 60 * nav THEN 'DAILY_TURNOVER_LIMIT'
          WHEN p % 17 = 0 THEN 'BROKER_DISCONNECTED' WHEN n > 20000 THEN 'MANUAL_REVIEW_ORDER_SIZE' ELSE 'OK' END AS code
      FROM (
        SELECT o.p, o.k, o.order_id, o.symbol, o.side, o.n, o.nav, o.cash, o.traded, o.instrument, o.sector, o.alone, w.invested, w.held, w.sectors, w.spent, w.traded_now,
          o.alone IN ('KILL_SWITCH_ENGAGED', 'BAD_ORDER', 'UNKNOWN_SECURITY', 'FUND_NOT_APPROVED', 'SHARIA_NON_HALAL', 'SHARIA_UNKNOWN', 'STALE_PRICE', 'ILLIQUID',
            'PORTFOLIO_DRAWDOWN_LIMIT', 'DAILY_LOSS_LIMIT') AS early,
          coalesce(w.held[o.symbol], 0) AS own, coalesce(w.sectors[o.sector], 0) AS peers
        FROM walk w JOIN batch_order o ON o.p = w.p AND o.k = w.k + 1) a) b) c
)
SELECT p AS portfolio, k AS place, order_id, symbol, side, code AS reason_code,
  CASE code WHEN 'OK' THEN 'APPROVED' WHEN 'MANUAL_REVIEW_ORDER_SIZE' THEN 'REQUIRES_MANUAL_REVIEW' ELSE 'REJECTED' END AS result
FROM walk WHERE k > 0) judged
"""
SQL = {
    "order_batch": BATCH,
    "order_latest_state": "SELECT * FROM state_now",
    "illegal_transitions": "SELECT * FROM illegal",
    "transition_counts": "SELECT from_state, state, count(*) AS n FROM illegal GROUP BY 1, 2",
    "switch_state": "SELECT coalesce(arg_max(event_type = 'error', event_id), FALSE) AS engaged FROM events WHERE event_type IN ('error', 'signup')",
    "positions": """
SELECT symbol, CAST(sum(q) AS DOUBLE) AS quantity FROM (
  SELECT symbol, q FROM signed UNION ALL SELECT concat('T', s_nationkey + 1), count(*) * 10 FROM supplier GROUP BY s_nationkey) x GROUP BY symbol HAVING sum(q) <> 0
""",
    "reconciliation": "SELECT symbol, CAST(expected AS DOUBLE) AS expected, CAST(reported AS DOUBLE) AS reported FROM mismatch",
    "unknown_open_orders": "SELECT concat('ref-', c_custkey) AS client_ref FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "order_overview": """
SELECT o.order_id, o.symbol, o.side, CAST(o.quantity AS DOUBLE) AS quantity, s.state, CAST(coalesce(f.filled, 0) AS DOUBLE) AS filled
FROM broker_order o LEFT JOIN state_now s USING (order_id) LEFT JOIN filled f USING (order_id)
""",
    "derived_status": """
SELECT o.order_id, CAST(coalesce(filled, 0) AS DOUBLE) AS filled, CASE WHEN coalesce(filled, 0) >= o.quantity THEN 'FILLED' WHEN filled > 0 THEN 'PARTIALLY_FILLED'
    WHEN r.last = 'error' THEN 'REJECTED_BY_BROKER' WHEN r.last = 'signup' THEN 'CANCELLED' ELSE 'ACKNOWLEDGED' END AS status
FROM broker_order o LEFT JOIN filled f USING (order_id) LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS last FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1) r ON r.user_id = o.order_id
""",
    "orders_in_doubt": "SELECT order_id, state FROM state_now WHERE state IN ('FAILED', 'SUBMISSION_UNKNOWN')",
    "orders_by_state": "SELECT state, count(*) AS n FROM state_now GROUP BY 1",
    "valued_holdings": """
SELECT e.symbol, CAST(e.q AS DOUBLE) AS quantity, p.price_date, round(CAST(e.q AS DOUBLE) * p.px, 4) AS value,
  round(CAST(e.q AS DOUBLE) * p.px / sum(CAST(e.q AS DOUBLE) * p.px) OVER (), 6) AS weight, CASE WHEN e.symbol IN ('T1', 'T2') THEN 'approved fund' ELSE 'stock' END AS kind
FROM expected e LEFT JOIN (SELECT concat('T', security_id) AS symbol, max(price_date) AS price_date, CAST(arg_max(adjusted_close, price_date) AS DOUBLE) AS px FROM daily_price WHERE security_id <> 9 GROUP BY security_id) p USING (symbol)
""",
    "audit_trail": "SELECT event_id AS sequence, concat('user:', user_id) AS actor, event_type AS action FROM events ORDER BY event_id DESC LIMIT 100",
    "audit_last_day": "SELECT count(*) AS events FROM events WHERE ts > TIMESTAMP '2024-01-14 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'",
    "order_check": "SELECT order_id, p AS portfolio, symbol, side, CAST(n AS DOUBLE) AS notional, code AS reason_code, result FROM checked",
    "fired_rules": "SELECT code AS reason_code, count(*) AS n FROM checked WHERE result <> 'APPROVED' GROUP BY 1",
    "system_alerts": """
SELECT * FROM (WITH noted AS (SELECT DATE '2004-11-23' - CAST(exec_id % 15 AS INT) AS d FROM order_fill WHERE exec_id % 50 = 0
), facts AS (
  SELECT 'CRITICAL' AS severity, 'KILL_SWITCH' AS code, CAST((SELECT arg_max(event_type = 'error', event_id) FROM events WHERE event_type IN ('error', 'signup')) AS INT) AS n, NULL AS since
  UNION ALL SELECT 'CRITICAL', 'ORDER_IN_DOUBT', count(*), NULL FROM state_now WHERE state = 'SUBMISSION_UNKNOWN'
  UNION ALL SELECT 'CRITICAL', 'RECONCILIATION_MISMATCH', count(*), min(d) FROM noted WHERE d > DATE '2004-11-16'
  UNION ALL SELECT 'WARNING', 'ORDERS_FAILED', count(*), NULL FROM state_now WHERE state = 'FAILED'
  UNION ALL SELECT 'WARNING', 'APPROVALS_WAITING', count(*), NULL FROM checked WHERE result = 'REQUIRES_MANUAL_REVIEW'
  UNION ALL SELECT 'WARNING', 'STALE_DATA', CASE WHEN age > 1 THEN age ELSE 0 END, newest
  FROM (SELECT newest, (SELECT count(*) FROM td WHERE day > newest AND day < DATE '2004-11-23') + 1 AS age FROM (SELECT max(price_date) AS newest FROM daily_price) m) s
)
SELECT severity, code, CAST(n AS BIGINT) AS n, since FROM facts WHERE n > 0) raised
""",
}
SQL = {name: build(body) for name, body in SQL.items()}
