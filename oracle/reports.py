"""Report questions, each asked of the history in another way than the operators ask it: neighbours by
self-join on the month, runs by their first and last months, causes from a table of rules."""

from __future__ import annotations

from oracle import universe  # noqa: F401
from oracle.views import VIEWS, build

VIEWS["monthly"] = """
SELECT security_id, screening_date, status, reason, dense_rank() OVER (ORDER BY screening_date) AS m FROM classification
"""
VIEWS["recorded"] = "SELECT *, (SELECT max(b.m) FROM monthly b WHERE b.security_id = a.security_id AND b.m < a.m) AS earlier FROM monthly a"
VIEWS["step"] = """
SELECT r.security_id, r.screening_date, o.screening_date AS since, o.status AS was, r.status AS now, r.reason FROM recorded r JOIN monthly o ON o.security_id = r.security_id AND o.m = r.earlier
"""
VIEWS["turn"] = "SELECT * FROM step WHERE was <> now"
VIEWS["newest"] = "SELECT * FROM monthly WHERE m = (SELECT max(m) FROM monthly)"
VIEWS["cal_month"] = "SELECT security_id, status, year(screening_date) * 12 + month(screening_date) AS k, screening_date FROM monthly WHERE status = 'UNKNOWN'"
VIEWS["run"] = """
SELECT e.security_id, e.k - max(b.k) + 1 AS months, e.screening_date AS last_seen
FROM (SELECT * FROM cal_month x WHERE NOT EXISTS (SELECT 1 FROM cal_month y WHERE y.security_id = x.security_id AND y.k = x.k + 1)) e
JOIN (SELECT * FROM cal_month x WHERE NOT EXISTS (SELECT 1 FROM cal_month y WHERE y.security_id = x.security_id AND y.k = x.k - 1)) b ON b.security_id = e.security_id AND b.k <= e.k
GROUP BY e.security_id, e.k, e.screening_date
"""
VIEWS["yearly"] = "SELECT CAST(year(screening_date) AS BIGINT) AS year, screening_date, status FROM monthly"
VIEWS["cause"] = """
SELECT * FROM (VALUES ('market_value:missing%', 'no_market_value'), ('market_value:not%', 'bad_market_value'), ('sheet:none%', 'no_filing'), ('income:none%', 'no_filing'), ('sheet:too%', 'old_filing'),
  ('income:too%', 'old_filing'), ('debt:missing%', 'missing_figure'), ('sheet_values%', 'missing_figure'), ('debt:negative%', 'negative_figure'), ('cash:negative%', 'negative_figure'),
  ('revenue:%', 'bad_revenue'), ('income_values:missing revenue%', 'no_revenue'), ('income_values:missing e%', 'missing_figure'), ('income_values:missing c%', 'missing_figure')) v(pattern, label)
"""
SQL = {
    "status_transitions": "SELECT CAST(year(screening_date) AS BIGINT) AS year, was AS previous, now AS status, count(*) AS n FROM turn GROUP BY ALL",
    "transition_matrix": """
SELECT CAST(year(screening_date) AS BIGINT) AS year, count(*) AS changes, CAST(sum(CAST(was || now = 'HALALNON_HALAL' AS INT)) AS BIGINT) AS halal_to_non_halal,
  CAST(sum(CAST(was || now = 'NON_HALALHALAL' AS INT)) AS BIGINT) AS non_halal_to_halal FROM turn GROUP BY 1
""",
    "screened_by_year": """
SELECT y.year, y.n AS records, s.n AS screenings, coalesce(h.n, 0) AS halal, coalesce(u.n, 0) AS unknown, round(coalesce(u.n, 0) / y.n, 6) AS unknown_share
FROM (SELECT year, count(*) AS n FROM yearly GROUP BY 1) y JOIN (SELECT year, count(*) AS n FROM (SELECT DISTINCT year, screening_date FROM yearly) d GROUP BY 1) s USING (year)
LEFT JOIN (SELECT year, count(*) AS n FROM yearly WHERE status = 'HALAL' GROUP BY 1) h USING (year) LEFT JOIN (SELECT year, count(*) AS n FROM yearly WHERE status = 'UNKNOWN' GROUP BY 1) u USING (year)
""",
    "latest_changes": """
SELECT x.screening_date, s.company_name, p.ticker, x.was AS previous, x.now AS status, x.reason AS why
FROM step x JOIN newest n USING (security_id, screening_date) JOIN security s USING (security_id)
LEFT JOIN security_ticker p ON p.security_id = x.security_id AND x.screening_date >= p.valid_from AND x.screening_date < coalesce(p.valid_to, DATE '9999-12-31')
WHERE x.was <> x.now
""",
    "most_changes": """
SELECT security_id, changes, company_name FROM (SELECT t.security_id, s.company_name, count(*) AS changes FROM turn t JOIN security s ON s.security_id = t.security_id GROUP BY ALL) z
ORDER BY changes DESC, company_name, security_id LIMIT 15
""",
    "unknown_reasons": """
SELECT CASE WHEN s.category LIKE '%Secondary Class' AND n.reason LIKE 'market_value:missing%' THEN 'secondary_class' ELSE coalesce(c.label, 'other') END AS why, count(*) AS n
FROM newest n JOIN security s USING (security_id) LEFT JOIN cause c ON n.reason LIKE c.pattern WHERE n.status = 'UNKNOWN' GROUP BY 1
""",
    "unknown_streaks": "SELECT security_id, CAST(months AS BIGINT) AS months, last_seen FROM run",
    "longest_unknown": """
SELECT r.security_id, CAST(r.months AS BIGINT) AS months, r.last_seen, s.company_name FROM run r JOIN newest n ON n.security_id = r.security_id AND n.screening_date = r.last_seen
JOIN security s ON s.security_id = r.security_id AND s.category NOT LIKE '%Secondary Class' ORDER BY r.months DESC, s.company_name, r.security_id LIMIT 15
""",
    "latest_screening_counts": """
SELECT screening_date, status, count(*) AS n FROM classification WHERE screening_date = (SELECT max(screening_date) FROM classification) GROUP BY 1, 2
""",
    "latest_universe": "SELECT as_of, CAST(sum(CAST(reason IS NULL AS INT)) AS BIGINT) AS member_count FROM universe GROUP BY 1 QUALIFY row_number() OVER (ORDER BY as_of DESC) = 1",
}
SQL = {name: build(body) for name, body in SQL.items()}
