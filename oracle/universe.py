from __future__ import annotations

from oracle import quality, screening  # noqa: F401  (registers their views)
from oracle.views import VIEWS, WIDE, build

VIEWS["trading_price"] = "SELECT p.* FROM daily_price p JOIN td ON td.day = p.price_date"
VIEWS["prev_trading_price"] = VIEWS["prev_price"].replace("FROM daily_price", "FROM trading_price")
VIEWS["loose_finding"] = quality.findings("200", "200", "trading_price")
VIEWS["as_of_date"] = """
SELECT d.decision_date AS as_of, d.month_no, min(t.day) AS lo, max(t.day) AS hi, max(CASE WHEN t.td_index = d.td_index - 4 THEN t.day END) AS cutoff
FROM decision d JOIN td t ON t.td_index BETWEEN d.td_index - 19 AND d.td_index GROUP BY 1, 2
"""
VIEWS["candidate"] = """
SELECT security_id, a.* FROM common_stock JOIN as_of_date a ON start_date <= as_of AND (end_date IS NULL OR end_date >= as_of)
"""
VIEWS["median_usd"] = """
SELECT security_id, as_of, median(usd) AS median_usd FROM (
  SELECT c.security_id, c.as_of, coalesce(CAST(p.close * p.volume AS DOUBLE), 0) AS usd
  FROM candidate c JOIN td t ON t.day BETWEEN c.lo AND c.hi LEFT JOIN trading_price p ON p.security_id = c.security_id AND p.price_date = t.day) x
GROUP BY 1, 2
"""
VIEWS["assessed"] = """
SELECT c.as_of, c.security_id, m.median_usd,
  CASE WHEN e.status IS NULL THEN 'sharia_no_record' WHEN e.status <> 'HALAL' THEN concat('sharia_', lower(e.status))
    WHEN l.price_date IS NULL OR l.price_date < c.cutoff THEN 'stale_price' WHEN l.close_unadjusted < 5 THEN 'below_min_price'
    WHEN m.median_usd < 1000000 THEN 'below_min_liquidity'
    WHEN EXISTS (SELECT 1 FROM loose_finding f WHERE f.security_id = c.security_id AND f.data_date BETWEEN c.lo AND c.hi) THEN 'data_quality_finding' END AS reason
FROM candidate c JOIN median_usd m ON m.security_id = c.security_id AND m.as_of = c.as_of
LEFT JOIN in_effect e ON e.security_id = c.security_id AND e.decision_date = c.as_of
LEFT JOIN LATERAL (SELECT price_date, close_unadjusted FROM trading_price p WHERE p.security_id = c.security_id AND p.price_date < c.as_of AND p.price_date >= c.as_of - 60 ORDER BY price_date DESC LIMIT 1) l ON TRUE
"""


def groups(source: str) -> str:
    """Company labels by transitive closure over the links of each date."""
    return f"""
WITH RECURSIVE node AS (SELECT a.as_of, a.security_id, s.related_tickers, upper(s.company_name) AS name, t.ticker
    FROM {source} a JOIN security s USING (security_id) JOIN security_ticker t ON t.security_id = a.security_id AND t.valid_from <= a.as_of AND (t.valid_to IS NULL OR t.valid_to > a.as_of)),
  link AS (SELECT a.as_of, a.security_id AS x, b.security_id AS y FROM node a JOIN node b ON a.as_of = b.as_of AND a.name = b.name AND list_contains(string_split(a.related_tickers, ' '), b.ticker)),
  both_ways AS (SELECT as_of, x, y FROM link UNION SELECT as_of, y, x FROM link),
  reach AS (SELECT as_of, security_id AS x, security_id AS y FROM node UNION SELECT r.as_of, r.x, b.y FROM reach r JOIN both_ways b ON b.as_of = r.as_of AND b.x = r.y)
SELECT n.as_of, n.security_id, CASE WHEN n.related_tickers IS NULL THEN concat('name:', n.name) ELSE concat('rel:', min(r.y)) END AS company
FROM node n JOIN reach r ON r.as_of = n.as_of AND r.x = n.security_id GROUP BY n.as_of, n.security_id, n.related_tickers, n.name
"""


VIEWS["passed"] = "SELECT * FROM assessed WHERE reason IS NULL"
VIEWS["passed_group"] = groups("passed")
VIEWS["candidate_group"] = groups("candidate")
VIEWS["universe"] = """
SELECT a.as_of, a.security_id, a.median_usd, CASE WHEN a.reason IS NULL AND k > 1 THEN 'duplicate_share_class' ELSE a.reason END AS reason
FROM assessed a LEFT JOIN (SELECT g.as_of, g.security_id, row_number() OVER (PARTITION BY g.as_of, g.company ORDER BY p.median_usd DESC, g.security_id) AS k
  FROM passed_group g JOIN passed p ON p.as_of = g.as_of AND p.security_id = g.security_id) x ON x.as_of = a.as_of AND x.security_id = a.security_id
"""
VIEWS["member"] = "SELECT * FROM universe WHERE reason IS NULL"


def fingerprint(source: str, text: str, by: str = "") -> str:
    """The order-free table fingerprint: row hashes added up in four 60-bit parts."""
    parts = ", ':', ".join(
        f"CAST(coalesce(sum(CAST(('0x' || substr(h, {i}, 15)) AS HUGEINT)), 0) AS VARCHAR)" for i in (1, 16, 31, 46)
    )
    select = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {select}count(*) AS row_count, sha256(concat(CAST(count(*) AS VARCHAR), ':', {parts})) AS sha256
FROM (SELECT *, sha256({text}) AS h FROM {source}) fp {group}
"""


VIEWS["cover"] = """
SELECT d.decision_date AS as_of, (SELECT max(r.id) FROM (
    SELECT year(price_date) * 12 + month(price_date) AS id, max(price_date) AS hi FROM daily_price GROUP BY 1) r
  WHERE r.id % 4 <> 0 AND date_trunc('month', r.hi - INTERVAL 2 MONTH) <= d.decision_date - 28 AND r.hi >= d.decision_date - 1) AS run_id
FROM decision d
"""
SQL = {
    "quality_cover": "SELECT as_of, CAST(run_id AS BIGINT) AS run_id FROM cover",
    "universe_gate": "SELECT as_of, CASE WHEN run_id IS NULL THEN 'no_quality_run' ELSE coalesce(reason, 'eligible') END AS reason, count(*) AS n FROM universe JOIN cover USING (as_of) GROUP BY 1, 2",
    "universe_funnel": "SELECT as_of, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM universe GROUP BY 1, 2",
    "universe_members": "SELECT as_of, security_id, round(CAST(median_usd AS DOUBLE), 2) AS median_usd FROM member",
    "universe_fingerprint": fingerprint(
        "member",
        "concat('=universe-v1|=AAOIFI-v1|=Domestic Common Stock,Domestic Common Stock Primary Class,Domestic Common Stock Secondary Class|=', as_of, '|=', security_id)",
        "as_of",
    ),
    "universe_candidates": "SELECT security_id, as_of FROM candidate",
    "median_dollar_volume": """
SELECT security_id, as_of, round(CAST(median(usd) AS DOUBLE), 4) AS median_usd FROM (
  SELECT s.security_id, a.as_of, coalesce(CAST(p.close * p.volume AS DOUBLE), 0) AS usd, p.price_date
  FROM security s JOIN as_of_date a ON TRUE JOIN td t ON t.day BETWEEN a.lo AND a.hi LEFT JOIN trading_price p ON p.security_id = s.security_id AND p.price_date = t.day) x
GROUP BY 1, 2 HAVING count(price_date) > 0
""",
    "share_class_groups": "SELECT * FROM candidate_group",
    "largest_members": """
SELECT as_of, place, security_id, ticker, company_name, market_cap_usd, why FROM (
  SELECT m.as_of, row_number() OVER (PARTITION BY m.as_of ORDER BY coalesce(c.market_cap_usd, 0) DESC, m.security_id) AS place, m.security_id, t.ticker, s.company_name,
    CAST(c.market_cap_usd AS DOUBLE) AS market_cap_usd, k.reason AS why
  FROM member m JOIN security s USING (security_id)
  JOIN security_ticker t ON t.security_id = m.security_id AND t.valid_from <= m.as_of AND (t.valid_to IS NULL OR t.valid_to > m.as_of)
  LEFT JOIN LATERAL (SELECT market_cap_usd FROM daily_market_cap d WHERE d.security_id = m.security_id AND d.cap_date < m.as_of ORDER BY cap_date DESC LIMIT 1) c ON TRUE
  LEFT JOIN in_effect e ON e.security_id = m.security_id AND e.decision_date = m.as_of
  LEFT JOIN classification k ON k.security_id = m.security_id AND k.screening_date = e.screening_date) x WHERE place <= 3
""",
}
SQL = {name: build(body) for name, body in SQL.items()}
SQL["wide_universe"] = build("SELECT as_of, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM universe GROUP BY 1, 2", WIDE)
