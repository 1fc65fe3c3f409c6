"""Domain views over the driver tables as SQL common table expressions.

`build(body)` puts the views a statement names, and what those need, in front of it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

# Dates move by 157 weeks, so that the first lies inside the calendar.
VIEWS["line"] = "SELECT * REPLACE (l_shipdate + INTERVAL 1099 DAY AS l_shipdate) FROM lineitem"
VIEWS["ord"] = "SELECT * REPLACE (o_orderdate + INTERVAL 1099 DAY AS o_orderdate) FROM orders"
VIEWS["px"] = """
SELECT CAST(substr(p_brand,7) AS INT) AS security_id, CAST(l_shipdate AS DATE) AS price_date,
  l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS BIGINT) AS q
FROM line JOIN part ON l_partkey = p_partkey
"""
VIEWS["px_r"] = """
SELECT *, row_number() OVER (PARTITION BY security_id, price_date ORDER BY l_orderkey, l_linenumber, p, q) AS rn,
  count(*) OVER (PARTITION BY security_id, price_date) AS n FROM px
"""
VIEWS["daily_price"] = """
SELECT security_id, price_date, max(CASE WHEN rn = 1 THEN p END) AS open,
  CASE WHEN security_id + day(price_date) = 40 THEN min(p) - 1 ELSE max(p) END AS high, min(p) AS low,
  max(CASE WHEN rn = n THEN p END) AS close, max(CASE WHEN rn = n THEN p END) AS adjusted_close,
  max(CASE WHEN rn = n THEN p END) * CASE WHEN security_id % 5 = 0 AND price_date < DATE '2000-01-03' THEN 2 ELSE 1 END AS close_unadjusted,
  CAST(sum(q) AS BIGINT) AS volume
FROM px_r GROUP BY security_id, price_date
"""
VIEWS["security"] = """
SELECT b AS security_id, concat('P', b) AS source_id, concat('Company ', b % 20) AS company_name,
  CASE b % 6 WHEN 0 THEN 'Tobacco' WHEN 1 THEN 'Software' ELSE 'Industrial' END AS industry,
  CASE b % 4 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Energy' ELSE 'Health' END AS sector,
  CASE b % 9 WHEN 0 THEN '6022' WHEN 1 THEN 'N/A' ELSE '7372' END AS sic_code,
  CASE b % 8 WHEN 7 THEN 'ADR Common Stock' WHEN 6 THEN 'Domestic Common Stock Secondary Class' ELSE 'Domestic Common Stock' END AS category,
  CASE WHEN b <= 3 THEN concat('T', b + 21) WHEN b IN (4, 24) THEN NULL ELSE '' END AS related_tickers,
  DATE '1998-01-01' AS start_date, CASE WHEN b % 12 = 0 THEN DATE '2001-03-30' END AS end_date, b % 12 <> 0 AS active_flag
FROM (SELECT DISTINCT CAST(substr(p_brand,7) AS INT) AS b FROM part) x
"""
VIEWS["security_ticker"] = """
SELECT security_id, concat('T', security_id) AS ticker, DATE '1998-01-01' AS valid_from, DATE '2000-01-01' AS valid_to FROM security
UNION ALL
SELECT security_id, concat('T', security_id + 1), DATE '2000-01-01', CAST(NULL AS DATE) FROM security
"""
VIEWS["fundamental"] = """
SELECT CAST(o_custkey % 25 + 1 AS INT) AS security_id, o_orderkey AS filing_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ARQ' WHEN '2-HIGH' THEN 'ARY' WHEN '3-MEDIUM' THEN 'ART' ELSE 'MRQ' END AS dimension,
  CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 700 - 20 AS INT) AS calendar_date,
  CAST(NULL AS DATE) AS report_period,
  CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS debt,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) * 0.5 END AS cash_and_equivalents,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) * 0.1 END AS investments,
  CASE WHEN o_orderkey % 14 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 0.05 END AS investments_current,
  CASE WHEN o_orderkey % 14 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 0.05 END AS investments_noncurrent,
  CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 4 END * CAST(o_totalprice AS DECIMAL(18,2)) AS revenue,
  CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS ebit,
  CAST(o_totalprice AS DECIMAL(18,2)) * (2 - 0.05 * CAST(o_orderkey % 6 AS INT)) AS operating_income
FROM ord
"""
VIEWS["daily_market_cap"] = """
SELECT security_id, price_date AS cap_date,
  CASE WHEN security_id + day(price_date) = 53 THEN 0 ELSE CAST(close * volume AS DECIMAL(24,4)) END AS market_cap_usd
FROM daily_price
"""
VIEWS["corporate_action"] = """
SELECT security_id, 'SPLIT' AS action_type, DATE '2000-01-03' AS effective_date FROM security WHERE security_id IN (5, 15, 25)
"""
VIEWS["order_state_event"] = """
SELECT user_id AS order_id, event_id AS id, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'APPROVED' WHEN 'view' THEN 'SUBMITTED' WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'purchase' THEN 'FILLED' ELSE 'FAILED' END AS state, value
FROM events
"""
VIEWS["order_fill"] = """
SELECT event_id AS exec_id, user_id AS order_id, concat('T', user_id % 25 + 1) AS symbol,
  CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(value AS DECIMAL(18,2)) AS quantity
FROM events WHERE event_type = 'purchase'
"""
VIEWS["broker_order"] = """
SELECT DISTINCT user_id AS order_id, concat('T', user_id % 25 + 1) AS symbol,
  CASE WHEN user_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CAST(user_id % 7 * 60 + 40 AS DECIMAL(18,2)) AS quantity,
  concat('ref-', user_id) AS idempotency_key
FROM events
"""
VIEWS["vendor_report"] = """
SELECT *, c_custkey AS position FROM (
  SELECT c_custkey, concat('t', c_custkey) AS symbol,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'COMPLIANT' WHEN 'MACHINERY' THEN 'NON_COMPLIANT' WHEN 'AUTOMOBILE' THEN 'QUESTIONABLE' ELSE 'UNRATED' END AS status FROM customer) a
UNION ALL
SELECT c_custkey, concat(' T', c_custkey), CASE WHEN c_mktsegment = 'BUILDING' THEN 'UNRATED' ELSE 'COMPLIANT' END, CASE WHEN c_custkey % 2 = 0 THEN -c_custkey ELSE c_custkey + 1000000000 END
FROM customer WHERE c_custkey % 5 = 2
"""
VIEWS["raw_price"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 97 = 0 THEN ' n/a ' WHEN l_orderkey % 101 = 0 THEN 'ZZZ' ELSE concat(' t', CAST(substr(p_brand,7) AS INT)) END AS ticker,
  CASE WHEN l_orderkey % 89 = 0 THEN '2024' WHEN l_orderkey % 83 = 0 THEN '' ELSE strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') END AS date,
  CASE WHEN l_orderkey % 79 = 0 THEN 'N/A' ELSE t END AS open, t AS high,
  CASE WHEN l_orderkey % 73 = 0 THEN 'NaN' ELSE t END AS low, CASE WHEN l_orderkey % 71 = 0 THEN '-1.5' ELSE t END AS close,
  concat(CAST(l_quantity AS INT), '.5') AS volume, t AS closeadj, t AS closeunadj
FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS t FROM line) l
JOIN part ON l_partkey = p_partkey
"""

VIEWS["raw_action"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 61 = 0 THEN '2001-02-30' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date,
  (['split','dividend','acquisitionof','acquisitionby','mergerfrom','mergerto','tickerchangefrom','tickerchangeto','delisted','regulatorydelisting','voluntarydelisting','bankruptcyliquidation','spinoff',''])[o_orderkey % 14 + 1] AS action,
  CASE WHEN o_orderkey % 53 = 0 THEN 'N/A' ELSE concat('t', o_custkey % 25 + 1) END AS ticker,
  CASE WHEN o_orderkey % 47 = 0 THEN 'x1' WHEN o_orderkey % 43 = 0 THEN '' ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE concat('T', o_orderkey % 25 + 1) END AS contraticker,
  CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE concat('Contra T', o_orderkey % 25 + 1) END AS contraname
FROM ord
"""
VIEWS["raw_company"] = """
SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE CAST(c_custkey AS VARCHAR) END AS permaticker, concat(' c', c_custkey) AS ticker,
  CASE WHEN c_custkey % 37 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 31 = 0 THEN '?' WHEN c_custkey % 5 = 0 THEN 'y' ELSE 'N' END AS isdelisted, c_mktsegment AS sector,
  CASE WHEN c_custkey % 29 = 0 THEN '1999-13-01' WHEN c_custkey % 23 = 0 THEN '' ELSE strftime(DATE '1998-01-01' + CAST(c_custkey % 400 AS INT), '%Y-%m-%d') END AS firstpricedate,
  CASE WHEN c_custkey % 20 = 0 THEN '' WHEN c_custkey % 15 = 0 THEN '1997-06-30' ELSE strftime(DATE '2000-01-01' + CAST(c_custkey % 600 AS INT), '%Y-%m-%d') END AS lastpricedate
FROM customer
"""
VIEWS["raw_fundamental"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE concat('T', o_custkey % 25 + 1) END AS ticker,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'arq' WHEN '2-HIGH' THEN 'ARY' WHEN '3-MEDIUM' THEN 'ART' ELSE 'MRQ' END AS dimension,
  CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS calendardate, CAST(o_orderdate AS DATE) AS filed,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total
FROM ord
"""

# The calendar, written from a list of holidays (Good Fridays as fixed dates).
VIEWS["cal_day"] = """
SELECT CAST(g.d AS DATE) AS day FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '2027-12-31', INTERVAL 1 DAY) AS g(d)
"""
VIEWS["cal_fixed"] = """
SELECT name, make_date(y, m, dd) AS d
FROM (SELECT CAST(g.y AS INT) AS y FROM generate_series(1998, 2028) AS g(y)) yy,
     (VALUES ('New Year''s Day', 1, 1, 1998), ('Juneteenth', 6, 19, 2022), ('Independence Day', 7, 4, 1998), ('Christmas Day', 12, 25, 1998)) f(name, m, dd, since)
WHERE y >= since
"""
VIEWS["cal_holiday"] = """
SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS day, name
FROM cal_fixed WHERE NOT (name = 'New Year''s Day' AND isodow(d) = 6)
UNION ALL
SELECT day, name FROM (
  SELECT day, month(day) AS m, isodow(day) AS w,
    row_number() OVER (PARTITION BY year(day), month(day), isodow(day) ORDER BY day) AS k,
    row_number() OVER (PARTITION BY year(day), month(day), isodow(day) ORDER BY day DESC) AS kd
  FROM cal_day) c
JOIN (VALUES ('Martin Luther King Jr. Day', 1, 1, 3), ('Washington''s Birthday', 2, 1, 3), ('Memorial Day', 5, 1, -1), ('Labor Day', 9, 1, 1), ('Thanksgiving Day', 11, 4, 4)) r(name, rm, rw, rk)
  ON m = rm AND w = rw AND (k = rk OR (rk = -1 AND kd = 1))
UNION ALL
SELECT CAST(x AS DATE), 'Good Friday' FROM (SELECT unnest(['1998-04-10','1999-04-02','2000-04-21','2001-04-13','2002-03-29','2003-04-18','2004-04-09','2005-03-25','2006-04-14','2007-04-06','2008-03-21','2009-04-10','2010-04-02','2011-04-22','2012-04-06','2013-03-29','2014-04-18','2015-04-03','2016-03-25','2017-04-14','2018-03-30','2019-04-19','2020-04-10','2021-04-02','2022-04-15','2023-04-07','2024-03-29','2025-04-18','2026-04-03','2027-03-26']) AS x) gf
UNION ALL
SELECT CAST(a AS DATE), b FROM (VALUES ('2001-09-11', 'September 11 attacks'), ('2001-09-12', 'September 11 attacks'), ('2001-09-13', 'September 11 attacks'), ('2001-09-14', 'September 11 attacks'),
  ('2004-06-11', 'National day of mourning (Ronald Reagan)'), ('2007-01-02', 'National day of mourning (Gerald Ford)'), ('2012-10-29', 'Hurricane Sandy'), ('2012-10-30', 'Hurricane Sandy'),
  ('2018-12-05', 'National day of mourning (George H. W. Bush)'), ('2025-01-09', 'National day of mourning (Jimmy Carter)')) s(a, b)
"""
VIEWS["td"] = """
SELECT day, row_number() OVER (ORDER BY day) AS td_index FROM cal_day
WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM cal_holiday)
"""
VIEWS["cal"] = """
SELECT c.day, t.day IS NOT NULL AS is_trading,
  CASE WHEN isodow(c.day) < 6 THEN h.name END AS holiday,
  max(t.td_index) OVER (ORDER BY c.day) AS td_index,
  max(t.day) OVER (ORDER BY c.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_td,
  min(t.day) OVER (ORDER BY c.day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_td
FROM cal_day c LEFT JOIN td t ON t.day = c.day LEFT JOIN cal_holiday h ON h.day = c.day
"""
VIEWS["mon"] = """
SELECT year(day) * 12 + month(day) AS month_no, min(day) AS first_td, max(day) AS last_td,
  lead(max(day)) OVER (ORDER BY year(day) * 12 + month(day)) AS next_last_td,
  lead(min(day)) OVER (ORDER BY year(day) * 12 + month(day)) AS next_first_td
FROM td GROUP BY year(day) * 12 + month(day)
"""
VIEWS["decision"] = """
SELECT m.month_no, m.first_td AS decision_date, c.prev_td, t.td_index - 1 AS td_index
FROM mon m JOIN td t ON t.day = m.first_td JOIN cal c ON c.day = m.first_td
WHERE m.first_td >= DATE '1998-02-01' AND m.first_td <= (SELECT max(price_date) FROM daily_price)
"""

# The same market with a security per supplier: more names, other ranks, larger groups.
WIDE = {
    "px": VIEWS["px"].replace("CAST(substr(p_brand,7) AS INT)", "l_suppkey + 1").replace("FROM line JOIN part ON l_partkey = p_partkey", "FROM line"),
    "security": VIEWS["security"].replace("b % 20", "b // 2").replace("SELECT DISTINCT CAST(substr(p_brand,7) AS INT) AS b FROM part", "SELECT s_suppkey + 1 AS b FROM supplier"),
    "fundamental": VIEWS["fundamental"].replace("CAST(o_custkey % 25 + 1 AS INT)", "o_custkey + 1"),
}

_NAME = re.compile(r"[a-z_]+[a-z0-9_]*")


def build(body: str, extra: dict[str, str] | None = None) -> str:
    """`body` with every view it uses as a WITH clause, in dependency order."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str, above: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN|IN \(SELECT \w+ FROM|,)\s+([a-z_][a-z0-9_]*)", text)):
            if name in views and name not in order and name not in above:
                visit(views[name], (*above, name))
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({views[name].strip()})" for name in order)
    return f"WITH {ctes}\n{body.strip()}"
