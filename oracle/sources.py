from __future__ import annotations

from oracle import crosscheck, ingest  # noqa: F401
from oracle.views import build

SQL = {
    "csv_scan": "SELECT reason AS skip_reason, count(*) AS n, CAST(sum(v) AS BIGINT) AS volume FROM parsed_price GROUP BY 1",
    "xml_holdings": """
SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN concat('t', s_suppkey % 30) ELSE concat('X', s_suppkey % 30) END AS ticker,
  CASE WHEN s_suppkey % 11 = 0 THEN 'STIV' ELSE 'EC' END AS asset_category, 3 * count(*) AS holdings, CAST(3 * sum(CAST(abs(s_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM supplier GROUP BY 1, 2
""",
    "report_snapshot": """
SELECT status, report_date, skip_reason, count(*) AS n, count(ratio) AS with_ratio FROM (
  SELECT status, CASE WHEN c % 2 = 0 THEN DATE '2001-03-01' END AS report_date, CASE WHEN c % 5 = 0 THEN 1 END AS ratio,
    CASE WHEN status = 'MAYBE' THEN 'unknown_status' WHEN (c % 2 = 1 AND c % 29 = 0) OR (c % 5 <> 0 AND c % 23 = 0) THEN 'malformed' END AS skip_reason
  FROM (SELECT c_custkey AS c, CASE WHEN c_custkey % 19 = 0 THEN 'MAYBE' WHEN c_mktsegment = 'BUILDING' THEN 'COMPLIANT' WHEN c_mktsegment = 'MACHINERY' THEN 'NON_COMPLIANT' ELSE 'UNRATED' END AS status FROM customer) a) b
GROUP BY 1, 2, 3
""",
    "filing_index": """
SELECT cik, min(accession) AS accession, report_date FROM (
  SELECT o_custkey % 25 AS cik, concat('acc-', o_orderkey % 5000) AS accession, max(CAST(o_orderdate AS DATE)) AS report_date FROM ord
  WHERE o_orderkey % 4 <> 0 AND o_orderkey % 37 <> 0 AND day(o_orderdate) >= 28 AND o_orderkey % 5000 % 3 <> 0 GROUP BY 1, 2) x
GROUP BY cik, report_date
""",
    "price_sink": """
SELECT 'prices' AS what, strftime(price_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM daily_price GROUP BY 1, 2
UNION ALL SELECT 'v1', strftime(price_date, '%Y-%m'), count(*), CAST(sum(volume) AS BIGINT) FROM daily_price GROUP BY 1, 2
""",
    "stream_price_ingest": """
SELECT security_id, price_date, CAST(c AS DOUBLE) AS close, v AS volume FROM parsed_price WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY security_id, price_date ORDER BY l_orderkey % 2, l_orderkey, l_linenumber, c, v) = 1
""",
    "stream_positions": """
SELECT symbol, CAST(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS DOUBLE) AS quantity FROM order_fill GROUP BY 1 HAVING quantity <> 0
""",
    "stream_fills_lateness": """
SELECT * FROM (WITH timed AS (SELECT f.*, e.ts, f.exec_id % 50 = 7 AS held FROM order_fill f JOIN events e ON e.event_id = f.exec_id
), judged AS (SELECT *, held AND ts < (SELECT max(ts) FROM timed WHERE NOT held) - INTERVAL 2 DAY AS late FROM timed)
SELECT symbol, CAST(nullif(sum(CASE WHEN late THEN 0 WHEN side = 'BUY' THEN quantity ELSE -quantity END), 0) AS DOUBLE) AS quantity,
  count(*) FILTER (WHERE late) AS late
FROM judged GROUP BY 1 HAVING quantity IS NOT NULL OR count(*) FILTER (WHERE late) > 0) counted
""",
    "stream_states": "SELECT order_id, arg_max(state, id) AS state FROM order_state_event GROUP BY 1",
}
SQL = {name: build(body) for name, body in SQL.items()}
