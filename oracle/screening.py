from __future__ import annotations

from oracle import temporal  # noqa: F401  (registers the grid views)
from oracle.views import VIEWS, WIDE, build

VIEWS["common_stock"] = """
SELECT *, try_cast(trim(sic_code) AS INT) AS sic,
  CASE WHEN try_cast(trim(sic_code) AS INT) BETWEEN 6000 AND 6411 THEN 'conventional_finance' WHEN industry = 'Tobacco' THEN 'tobacco' END AS business
FROM security WHERE category <> 'ADR Common Stock'
"""
VIEWS["latest_filing"] = """
SELECT g.security_id, g.screening_date, k.dimension AS kind, f.*
FROM (SELECT g.* FROM screening_grid g JOIN common_stock USING (security_id)) g JOIN (VALUES ('ARQ'), ('ARY'), ('ART')) k(dimension) ON TRUE
JOIN LATERAL (SELECT dimension, filing_date, coalesce(report_period, calendar_date) AS period_end, debt, cash_and_equivalents AS cash,
    coalesce(investments, investments_current + investments_noncurrent) AS inv, revenue, ebit, operating_income AS core
  FROM fundamental f WHERE f.security_id = g.security_id AND f.dimension = k.dimension AND f.filing_date < g.screening_date
  ORDER BY filing_date DESC, calendar_date DESC, filing_id DESC LIMIT 1) f ON TRUE
"""
VIEWS["screen_input"] = """
SELECT g.security_id, g.screening_date, c.source_id, c.industry, c.sic, c.business, m.market_cap_usd AS mv,
  b.filing_date AS b_filed, b.dimension AS b_dim, b.period_end AS b_end, b.debt, b.cash, b.inv,
  i.filing_date AS i_filed, i.dimension AS i_dim, i.period_end AS i_end, i.revenue, i.ebit, i.core,
  coalesce(b.period_end >= g.screening_date - INTERVAL 16 MONTH, FALSE) AS b_ok, coalesce(i.period_end >= g.screening_date - INTERVAL 16 MONTH, FALSE) AS i_ok,
  CASE c.source_id WHEN 'P13' THEN 'NON_HALAL' WHEN 'P22' THEN 'PENDING_REVIEW' END AS manual
FROM screening_grid g JOIN common_stock c USING (security_id)
LEFT JOIN daily_market_cap m ON m.security_id = g.security_id AND m.cap_date = g.screening_date
LEFT JOIN latest_filing b ON b.security_id = g.security_id AND b.screening_date = g.screening_date
  AND b.kind = CASE WHEN EXISTS (SELECT 1 FROM latest_filing x WHERE x.security_id = g.security_id AND x.screening_date = g.screening_date AND x.kind = 'ARQ') THEN 'ARQ' ELSE 'ARY' END
LEFT JOIN latest_filing i ON i.security_id = g.security_id AND i.screening_date = g.screening_date
  AND i.kind = CASE WHEN EXISTS (SELECT 1 FROM latest_filing x WHERE x.security_id = g.security_id AND x.screening_date = g.screening_date AND x.kind = 'ART') THEN 'ART' ELSE 'ARY' END
"""
VIEWS["screen_ratio"] = """
SELECT *,
  CASE WHEN b_ok AND mv > 0 AND debt >= 0 THEN CAST(debt AS DOUBLE) / CAST(mv AS DOUBLE) END AS debt_ratio,
  CASE WHEN b_ok AND mv > 0 AND debt >= 0 THEN debt > 0.30 * mv END AS debt_fails,
  CASE WHEN b_ok AND mv > 0 AND cash >= 0 AND inv >= 0 THEN CAST(cash + inv AS DOUBLE) / CAST(mv AS DOUBLE) END AS cash_ratio,
  CASE WHEN b_ok AND mv > 0 AND cash >= 0 AND inv >= 0 THEN cash + inv > 0.30 * mv END AS cash_fails,
  CASE WHEN i_ok AND ebit IS NOT NULL AND core IS NOT NULL AND revenue > 0 THEN CAST(greatest(ebit - core, 0) AS DOUBLE) / CAST(revenue AS DOUBLE) END AS income_ratio,
  CASE WHEN i_ok AND ebit IS NOT NULL AND core IS NOT NULL AND revenue > 0 THEN greatest(ebit - core, 0) > 0.05 * revenue END AS income_fails,
  list_filter([
    CASE WHEN mv IS NULL THEN 'market_value:missing' WHEN mv <= 0 THEN 'market_value:not_positive ' || CAST(mv AS DECIMAL(24,4)) END,
    CASE WHEN b_filed IS NULL THEN 'sheet:none' WHEN NOT b_ok THEN 'sheet:too_old ' || b_end END, CASE WHEN i_filed IS NULL THEN 'income:none' WHEN NOT i_ok THEN 'income:too_old ' || i_end END,
    CASE WHEN NOT b_ok THEN NULL WHEN debt IS NULL THEN 'debt:missing' WHEN debt < 0 THEN 'debt:negative' END,
    CASE WHEN NOT b_ok THEN NULL WHEN cash IS NULL AND inv IS NULL THEN 'sheet_values:missing cash,investments' WHEN cash IS NULL THEN 'sheet_values:missing cash' WHEN inv IS NULL THEN 'sheet_values:missing investments'
      WHEN least(cash, inv) < 0 THEN 'cash:negative' END,
    CASE WHEN i_ok AND revenue <= 0 THEN 'revenue:not_positive' END
  ], lambda x: x IS NOT NULL) AS problems
FROM screen_input
"""
VIEWS["classification"] = """
SELECT r.security_id, r.screening_date, m.effective_from, m.effective_to,
  CASE WHEN manual IS NOT NULL THEN manual WHEN business IS NOT NULL OR debt_fails OR cash_fails OR income_fails THEN 'NON_HALAL' WHEN len(problems) > 0 THEN 'UNKNOWN' ELSE 'HALAL' END AS status,
  CASE WHEN source_id = 'P13' THEN 'manual_list pork producer' WHEN manual IS NOT NULL THEN 'manual_list mixed business' WHEN business IS NOT NULL THEN 'business ' || business
    WHEN len(over) > 0 THEN 'over_limit ' || array_to_string(over, ',') WHEN len(problems) > 0 THEN array_to_string(problems, '; ') ELSE 'within_limits' END AS reason,
  CASE WHEN manual IS NOT NULL THEN 'manual_list' WHEN business IS NOT NULL THEN 'business' ELSE 'ratios' END AS rule,
  CASE WHEN manual IS NULL THEN business END AS category,
  CASE WHEN manual IS NULL AND business IS NULL THEN debt_ratio END AS debt_ratio, CASE WHEN manual IS NULL AND business IS NULL THEN cash_ratio END AS cash_ratio,
  CASE WHEN manual IS NULL AND business IS NULL THEN income_ratio END AS income_ratio, CASE WHEN manual IS NULL AND business IS NULL THEN problems END AS problems,
  b_dim, b_filed, b_end, i_dim, i_filed, i_end
FROM (SELECT *, list_filter([CASE WHEN debt_fails THEN 'debt' END, CASE WHEN cash_fails THEN 'cash' END, CASE WHEN income_fails THEN 'income' END], lambda x: x IS NOT NULL) AS over
  FROM screen_ratio) r JOIN screening_month m USING (screening_date)
"""
VIEWS["in_effect"] = """
SELECT security_id, decision_date, status, screening_date FROM (
  SELECT c.*, d.decision_date, row_number() OVER (PARTITION BY c.security_id, d.decision_date ORDER BY c.screening_date DESC) AS k
  FROM classification c JOIN decision d ON d.decision_date BETWEEN c.effective_from AND c.effective_to) x WHERE k = 1
"""

SQL = {
    "screening": """
SELECT security_id, screening_date, status, reason, rule, category, round(debt_ratio, 6) AS debt_ratio, round(cash_ratio, 6) AS cash_ratio,
  round(income_ratio, 6) AS income_ratio, array_to_string(problems, ' | ') AS problems, effective_from, effective_to FROM classification
""",
    "screening_not_stored": """
SELECT screening_date, status, count(*) AS n FROM classification WHERE month(screening_date) % 2 = 0 GROUP BY 1, 2
""",
    "screening_sources": """
SELECT security_id, screening_date, row_number() OVER (PARTITION BY security_id, screening_date ORDER BY o) - 1 AS pos, dimension, filing_date, period_end FROM (
  SELECT security_id, screening_date, 1 AS o, b_dim AS dimension, b_filed AS filing_date, b_end AS period_end FROM classification WHERE b_filed IS NOT NULL
  UNION ALL SELECT security_id, screening_date, 2, i_dim, i_filed, i_end FROM classification WHERE i_filed IS NOT NULL) x
""",
    "business_exclusions": """
SELECT security_id, try_cast(trim(sic_code) AS INT) AS sic,
  CASE WHEN sic_code = '6022' THEN 'conventional_finance' WHEN industry = 'Tobacco' THEN 'tobacco' END AS category FROM security
""",
    "classification_in_effect": "SELECT * FROM in_effect",
    "classification_on_date": """
SELECT security_id, status, effective_from, effective_to, screening_date FROM classification WHERE DATE '2000-07-31' BETWEEN effective_from AND effective_to
""",
}
SQL = {name: build(body) for name, body in SQL.items()}
SQL["wide_screening"] = build("SELECT screening_date, status, count(*) AS n FROM classification GROUP BY 1, 2", WIDE)
