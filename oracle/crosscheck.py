from __future__ import annotations

from oracle import screening  # noqa: F401
from oracle.views import VIEWS, build


def ours(day: str) -> str:
    return f"""
SELECT * FROM (SELECT upper(t.ticker) AS symbol, c.security_id, t.ticker, s.company_name, c.status, c.reason, DATE '{day}' AS report_date,
    row_number() OVER (PARTITION BY t.ticker ORDER BY c.security_id DESC) AS k
  FROM classification c JOIN security s USING (security_id)
  JOIN security_ticker t ON t.security_id = c.security_id AND t.valid_from <= DATE '{day}' AND (t.valid_to IS NULL OR t.valid_to > DATE '{day}')
  WHERE DATE '{day}' BETWEEN c.effective_from AND c.effective_to) x WHERE k = 1
"""


VIEWS["ours"] = ours("2000-07-31")
VIEWS["ours_then"] = " UNION ALL ".join(ours(d) for d in ("1999-06-30", "2000-06-30", "2001-01-31"))
VIEWS["pair"] = """
SELECT symbol, our_status, their_status, CASE WHEN their_status IS NULL THEN 'only_ours' WHEN our_status IS NULL THEN 'only_theirs' ELSE 'matched' END AS side,
  CASE WHEN their_status IS NULL OR our_status IS NULL THEN NULL
    WHEN our_status = 'HALAL' THEN CASE their_status WHEN 'COMPLIANT' THEN 'agree_halal' WHEN 'NON_COMPLIANT' THEN 'we_halal_zoya_non_compliant' WHEN 'QUESTIONABLE' THEN 'we_halal_zoya_questionable' ELSE 'we_decided_zoya_unrated' END
    WHEN our_status = 'NON_HALAL' THEN CASE their_status WHEN 'NON_COMPLIANT' THEN 'agree_not_halal' WHEN 'COMPLIANT' THEN 'we_non_halal_zoya_compliant' WHEN 'QUESTIONABLE' THEN 'we_non_halal_zoya_questionable' ELSE 'we_decided_zoya_unrated' END
    WHEN their_status = 'UNRATED' THEN 'both_undecided' ELSE 'we_unknown_zoya_decided' END AS "group"
FROM (SELECT symbol, status AS our_status FROM ours) o FULL JOIN (SELECT upper(trim(symbol)) AS symbol, arg_max(status, position) AS their_status FROM vendor_report GROUP BY 1) v USING (symbol)
"""
VIEWS["held"] = """
SELECT CAST(d AS DATE) AS report_date, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('The Company ', s_suppkey % 22, ', Inc.') END AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN concat('t', s_suppkey % 30) ELSE concat('X', s_suppkey % 30) END AS ticker,
  CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS value_usd, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 22 AS VARCHAR) END AS key
FROM supplier JOIN (SELECT unnest(['1999-06-30', '2000-06-30', '2001-01-31']) AS d) dd ON TRUE WHERE s_suppkey % 11 <> 0
  AND NOT (s_suppkey % 7 = 0 AND s_suppkey % 3 = 0)
"""
VIEWS["name_side"] = """
SELECT report_date, substr(company_name, 9) AS key,
  CASE WHEN count(DISTINCT CASE WHEN status <> 'UNKNOWN' THEN status END) = 0 THEN min(security_id)
       WHEN count(DISTINCT CASE WHEN status <> 'UNKNOWN' THEN status END) = 1 THEN min(CASE WHEN status <> 'UNKNOWN' THEN security_id END) END AS security_id
FROM ours_then GROUP BY 1, 2
"""
VIEWS["matched"] = """
SELECT h.report_date, h.name, h.ticker, h.value_usd, coalesce(a.security_id, n.security_id) AS security_id, coalesce(a.status, b.status, 'NOT_IN_OUR_UNIVERSE') AS status
FROM held h LEFT JOIN ours_then a ON a.report_date = h.report_date AND a.symbol = upper(h.ticker)
LEFT JOIN name_side n ON n.report_date = h.report_date AND n.key = h.key LEFT JOIN ours_then b ON b.report_date = h.report_date AND b.security_id = n.security_id
"""
SQL = {
    "our_records": "SELECT symbol, security_id, ticker, company_name, status, reason FROM ours",
    "vendor_pairs": "SELECT * FROM pair",
    "vendor_crosscheck": 'SELECT side, "group", count(*) AS n FROM pair GROUP BY 1, 2',
    "vendor_agreement": """
SELECT count(*) FILTER (WHERE side <> 'only_theirs') AS ours_total, count(*) FILTER (WHERE side <> 'only_ours') AS theirs_total, count(*) FILTER (WHERE side = 'matched') AS matched,
  count(*) FILTER (WHERE side = 'only_ours') AS only_ours, count(*) FILTER (WHERE side = 'only_theirs') AS only_theirs, CAST(sum(y + n + o + u) AS BIGINT) AS firm_pairs,
  CASE WHEN sum(y + n + o + u) > 0 THEN round(sum(y + n) / sum(y + n + o + u), 6) END AS agreement, CASE WHEN sum(y + o) > 0 THEN round(sum(y) / sum(y + o), 6) END AS precision,
  CASE WHEN sum(y + u) > 0 THEN round(sum(y) / sum(y + u), 6) END AS recall
FROM (SELECT side, CAST(coalesce("group" = 'agree_halal', FALSE) AS INT) AS y, CAST(coalesce("group" = 'agree_not_halal', FALSE) AS INT) AS n,
  CAST(coalesce("group" = 'we_halal_zoya_non_compliant', FALSE) AS INT) AS o, CAST(coalesce("group" = 'we_non_halal_zoya_compliant', FALSE) AS INT) AS u FROM pair) p
""",
    "holding_match": "SELECT report_date, name, ticker, CAST(value_usd AS DOUBLE) AS value_usd, status, security_id FROM matched",
    "holding_shares": """
SELECT report_date, status, count(*) AS holdings, CAST(sum(value_usd) AS DOUBLE) AS value, round(count(*) / sum(count(*)) OVER (PARTITION BY report_date), 6) AS count_share,
  round(CAST(sum(value_usd) AS DOUBLE) / CAST(sum(sum(value_usd)) OVER (PARTITION BY report_date) AS DOUBLE), 6) AS value_share FROM matched GROUP BY 1, 2
""",
    "largest_not_eligible": """
SELECT report_date, side, place, name, ticker, status, CAST(value_usd AS DOUBLE) AS value_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY report_date, side ORDER BY value_usd DESC, name, ticker) AS place
  FROM (SELECT *, CASE WHEN status = 'NOT_IN_OUR_UNIVERSE' THEN 'unmatched' WHEN status <> 'HALAL' THEN 'not_eligible' END AS side FROM matched) m WHERE side IS NOT NULL) x WHERE place <= 12
""",
    "company_name_keys": """
SELECT name, key AS name_key FROM (
  SELECT concat('The ', c_name, ' & Sons, Inc.') AS name, concat(upper(replace(c_name, '#', ' ')), ' AND SONS') AS key FROM customer
  UNION ALL SELECT concat(s_name, '/Holding Co Ltd'), concat(upper(replace(s_name, '#', ' ')), ' HOLDING') FROM supplier) x
""",
}
SQL = {name: build(body) for name, body in SQL.items()}
