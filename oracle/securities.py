from __future__ import annotations

from oracle import ingest  # noqa: F401
from oracle.views import VIEWS, build

VIEWS["diff"] = """
SELECT source_id, CASE WHEN c % 7 = 0 THEN 'created' WHEN c % 9 = 0 THEN 'updated' WHEN nd THEN 'newly_delisted' ELSE 'unchanged' END AS action, nd AS newly_delisted,
  CASE WHEN c % 7 <> 0 AND c % 9 = 0 THEN 'company_name' ELSE '' END AS changed,
  concat_ws('; ', CASE WHEN c % 7 <> 0 AND NOT od AND (c + 1) % 11 = 0 THEN concat('ticker_differs OLD ', tk) END,
    CASE WHEN c % 7 <> 0 AND c % 13 = 0 THEN concat('start_differs ', f + 1, ' ', f) END, CASE WHEN c % 7 <> 0 AND od AND isdelisted <> 'y' THEN 'active_again' END) AS notes
FROM (SELECT *, c % 7 <> 0 AND isdelisted = 'y' AND NOT od AS nd FROM (
  SELECT *, c_custkey AS c, upper(trim(ticker)) AS tk, c_custkey % 10 = 0 OR c_custkey % 33 = 0 AS od FROM company_row WHERE reason IS NULL) x) y
UNION ALL SELECT source_id, 'refused', FALSE, '', concat('no_row ', reason) FROM company_row WHERE reason IS NOT NULL AND source_id IS NOT NULL AND c_custkey % 7 <> 0
UNION ALL SELECT concat('gone', s_nationkey), 'missing', FALSE, '', 'no_row' FROM (SELECT DISTINCT s_nationkey FROM supplier) g
"""
VIEWS["ticker_event"] = """
SELECT o_custkey AS security_id, day, min(letter) AS letter, min(day) OVER (PARTITION BY o_custkey) AS lo, max(day) OVER (PARTITION BY o_custkey) AS hi
FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS letter FROM ord) o GROUP BY o_custkey, day
"""
VIEWS["judged_event"] = """
SELECT *, day > lo AND day < hi AND concat('K', letter) = prev AS refused FROM (
  SELECT *, lag(concat('K', letter)) OVER (PARTITION BY security_id ORDER BY day) AS prev FROM ticker_event WHERE hi > lo) e
"""
SQL = {
    "master_diff": "SELECT * FROM diff",
    "master_diff_summary": """
SELECT 'created' AS what, count(*) AS n FROM diff WHERE action = 'created' UNION ALL SELECT 'updated', count(*) FROM diff WHERE action = 'updated'
UNION ALL SELECT 'unchanged', count(*) FROM diff WHERE action = 'unchanged' UNION ALL SELECT 'newly_delisted', count(*) FROM diff WHERE newly_delisted
UNION ALL SELECT 'missing', count(*) FROM diff WHERE action = 'missing' UNION ALL SELECT 'refused', count(*) FROM diff WHERE action = 'refused' UNION ALL SELECT 'notes', CAST(sum(CASE WHEN notes = '' THEN 0 ELSE len(string_split(notes, '; ')) END) AS BIGINT) FROM diff
""",
    "ticker_history": """
SELECT security_id, ticker, day AS valid_from, valid_to, NULL AS refusal FROM (
  SELECT security_id, concat('K', letter) AS ticker, day, hi, lead(CASE WHEN day = hi THEN day + 1 ELSE day END) OVER (PARTITION BY security_id ORDER BY day) AS valid_to FROM judged_event WHERE NOT refused) k WHERE day < hi
UNION ALL SELECT security_id, concat('K', letter), day, NULL, 'already trades as this ticker' FROM judged_event WHERE refused
""",
    "row_count_differences": """
SELECT name, a.n AS left_rows, b.n AS right_rows, CASE WHEN a.n IS NULL THEN 'extra' WHEN b.n IS NULL THEN 'missing' ELSE 'different' END AS problem
FROM (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1) a
FULL JOIN (SELECT CASE WHEN p_brand = 'Brand#3' THEN 'Brand#X' ELSE p_brand END AS name, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1) b USING (name)
WHERE a.n IS DISTINCT FROM b.n
""",
}
SQL["ticker_history_batches"] = SQL["ticker_history"]
SQL = {name: build(body) for name, body in SQL.items()}
