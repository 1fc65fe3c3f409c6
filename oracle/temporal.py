from __future__ import annotations

from oracle.views import VIEWS, build

VIEWS["screening_month"] = """
SELECT month_no, last_td AS screening_date, next_first_td AS effective_from, next_last_td AS effective_to
FROM mon WHERE month_no >= 1998 * 12 + 2 AND month_no <= (SELECT max(year(price_date) * 12 + month(price_date)) FROM daily_price)
"""
VIEWS["screening_grid"] = """
SELECT security_id, screening_date FROM security JOIN screening_month
  ON start_date <= screening_date AND (end_date IS NULL OR end_date >= screening_date)
"""

SQL = {
    "calendar_days": """
SELECT c.day, c.is_trading, c.holiday,
  coalesce(c.is_trading AND (c.day IN (DATE '1999-12-31', DATE '2002-07-05', DATE '2003-12-26')
    OR (c.day <> DATE '2002-07-03' AND (p.holiday = 'Thanksgiving Day' OR strftime(c.day, '%m-%d') = '12-24'
        OR (strftime(c.day, '%m-%d') = '07-03' AND isodow(c.day + 1) BETWEEN 2 AND 5)))), FALSE) AS is_early_close,
  coalesce(c.td_index, 0) AS td_index, c.prev_td, c.next_td, x.prices
FROM (SELECT price_date, count(*) AS prices FROM daily_price GROUP BY price_date) x
JOIN cal c ON c.day = x.price_date LEFT JOIN (SELECT day + 1 AS after, holiday FROM cal) p ON p.after = c.day AND month(c.day) = 11
""",
    "month_grid": """
SELECT CAST(m.month_no AS BIGINT) AS month_no, first_td AS decision_date, last_td AS screening_date,
  next_first_td AS effective_from, next_last_td AS effective_to, count(*) AS prices
FROM daily_price JOIN mon m ON m.month_no = year(price_date) * 12 + month(price_date)
GROUP BY ALL
""",
    "load_windows": """
SELECT start, CAST(start + INTERVAL 1 MONTH AS DATE) - 1 AS "end",
  (SELECT count(*) FROM fundamental f WHERE date_trunc('month', f.filing_date) = start) AS filings
FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(filing_date)), date_trunc('month', max(filing_date)), INTERVAL 1 MONTH)) AS DATE) AS start FROM fundamental) w
""",
    "year_load_windows": """
SELECT w.dimension, make_date(y, 1, 1) AS start, make_date(y, 12, 31) AS "end", count(f.filing_id) AS filings
FROM (SELECT dimension, CAST(unnest(generate_series(year(min(filing_date)), year(max(filing_date)))) AS INT) AS y FROM fundamental GROUP BY dimension) w
LEFT JOIN fundamental f ON f.dimension = w.dimension AND year(f.filing_date) = w.y GROUP BY w.dimension, y
""",
    "liquidity_windows": """
SELECT d.decision_date AS as_of, min(t.day) AS first_day, max(t.day) AS last_day,
  max(CASE WHEN t.td_index = d.td_index - 4 THEN t.day END) AS cutoff,
  CAST(sum((SELECT count(*) FROM daily_price p WHERE p.price_date = t.day)) AS BIGINT) AS prices
FROM decision d JOIN td t ON t.td_index BETWEEN d.td_index - 19 AND d.td_index GROUP BY d.decision_date
""",
    "report_age_cutoff": """
SELECT filing_id, CAST(filing_date - INTERVAL 16 MONTH AS DATE) AS cutoff, calendar_date < filing_date - INTERVAL 16 MONTH AS out_of_date FROM fundamental
""",
    "trading_day_distance": """
SELECT filing_id, CAST(greatest(coalesce(b.td_index, 0) - coalesce(a.td_index, 0), 0) AS BIGINT) AS days
FROM fundamental JOIN cal a ON a.day = calendar_date JOIN cal b ON b.day = filing_date
""",
    "price_history": """
SELECT price_date, CAST(open AS DOUBLE) AS open, CAST(close AS DOUBLE) AS close, volume FROM daily_price
WHERE security_id = 7 AND price_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' ORDER BY price_date
""",
    "ticker_resolve": """
SELECT r.ticker, r.price_date, r.n, t.security_id
FROM (SELECT upper(trim(ticker)) AS ticker, try_cast(date AS DATE) AS price_date, count(*) AS n FROM raw_price
      WHERE length(date) = 10 GROUP BY 1, 2) r
LEFT JOIN security_ticker t ON t.ticker = r.ticker AND r.price_date >= t.valid_from AND (t.valid_to IS NULL OR r.price_date < t.valid_to)
""",
    "filing_asof": """
SELECT g.security_id, g.screening_date, k.dimension, f.filing_date, CAST(f.debt AS DOUBLE) AS debt
FROM screening_grid g JOIN (VALUES ('ARQ'), ('ARY'), ('ART')) k(dimension) ON TRUE
LEFT JOIN LATERAL (SELECT filing_date, debt FROM fundamental f WHERE f.security_id = g.security_id AND f.dimension = k.dimension
  AND f.filing_date < g.screening_date ORDER BY filing_date DESC, calendar_date DESC, filing_id DESC LIMIT 1) f ON TRUE
""",
    "filing_asof_daily": """
SELECT p.security_id, p.price_date, f.filing_date, CAST(f.debt AS DOUBLE) AS debt, CAST(p.close AS DOUBLE) AS close
FROM daily_price p ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, filing_date ORDER BY calendar_date DESC, filing_id DESC) AS k FROM fundamental WHERE dimension = 'ARQ') z WHERE k = 1) f
  ON p.security_id = f.security_id AND p.price_date > f.filing_date
""",
    "filing_asof_same_day": """
SELECT p.security_id, p.price_date, CASE WHEN p.price_date - f.filing_date < 90 THEN f.filing_date END AS filing_date,
  CASE WHEN p.price_date - f.filing_date < 90 THEN f.filing_id END AS filing_id
FROM daily_price p ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, filing_date ORDER BY calendar_date DESC, filing_id DESC) AS k FROM fundamental WHERE dimension = 'ARY') z WHERE k = 1) f
  ON p.security_id = f.security_id AND p.price_date >= f.filing_date
""",
    "price_asof_bounded": """
SELECT p.security_id, d.decision_date, max(p.price_date) AS price_date, CAST(max_by(p.close_unadjusted, p.price_date) AS DOUBLE) AS close_unadjusted
FROM decision d JOIN daily_price p ON p.price_date <= d.decision_date AND p.price_date > d.decision_date - 7 GROUP BY 1, 2
""",
    "price_before_decision": """
SELECT p.security_id, d.decision_date, max(p.price_date) AS price_date, CAST(max_by(p.close_unadjusted, p.price_date) AS DOUBLE) AS close_unadjusted
FROM decision d JOIN daily_price p ON p.price_date < d.decision_date AND p.price_date >= d.decision_date - 60 GROUP BY 1, 2
""",
    "market_value_asof": """
SELECT m.security_id, d.prev_td, max(m.cap_date) AS cap_date, CAST(max_by(m.market_cap_usd, m.cap_date) AS DOUBLE) AS market_cap_usd
FROM decision d JOIN daily_market_cap m ON m.cap_date <= d.prev_td AND m.cap_date > d.prev_td - 7 GROUP BY 1, 2
""",
    "market_value_exact": """
SELECT g.security_id, g.screening_date, CAST(m.market_cap_usd AS DOUBLE) AS market_cap_usd
FROM screening_grid g LEFT JOIN daily_market_cap m ON m.security_id = g.security_id AND m.cap_date = g.screening_date
""",
    "ticker_overlaps": """
SELECT kind, security_id, ticker, valid_from, prev_end FROM (
  SELECT 'ticker' AS kind, *, max(coalesce(vt, DATE '9999-12-31')) OVER (PARTITION BY ticker ORDER BY valid_from, coalesce(vt, DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM stretched
  UNION ALL
  SELECT 'security_id', *, max(coalesce(vt, DATE '9999-12-31')) OVER (PARTITION BY security_id ORDER BY valid_from, coalesce(vt, DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM stretched) x
WHERE valid_from < prev_end
""",
}
VIEWS["stretched"] = """
SELECT security_id, ticker, valid_from, CASE WHEN security_id % 5 = 0 THEN CAST(valid_to + INTERVAL 3 MONTH AS DATE) ELSE valid_to END AS vt FROM security_ticker
"""
SQL = {name: build(body) for name, body in SQL.items()}
