from __future__ import annotations

from oracle import universe  # noqa: F401
from oracle.views import VIEWS, WIDE, build

VIEWS["sweep_date"] = "SELECT * FROM decision WHERE decision_date >= DATE '1999-07-01'"
VIEWS["momentum_window"] = """
SELECT d.decision_date, w.kind, ts.day AS start_day, te.day AS end_day
FROM (SELECT *, unnest([63, 126, 252]) AS lb FROM sweep_date) d0 JOIN (SELECT decision_date, td_index FROM sweep_date) d USING (decision_date)
JOIN (SELECT lb, sk, concat('momentum_', lb, '_', sk) AS kind FROM (VALUES (63, 0), (63, 21), (126, 0), (126, 21), (252, 0), (252, 21)) v(lb, sk)) w ON w.lb = d0.lb
JOIN td te ON te.td_index = d.td_index - w.sk JOIN td ts ON ts.td_index = d.td_index - w.sk - w.lb
"""
VIEWS["momentum"] = """
SELECT w.decision_date, w.kind, e.security_id, CAST(e.adj AS DOUBLE) / CAST(s.adj AS DOUBLE) - 1 AS score
FROM momentum_window w JOIN edge_price e ON e.day = w.end_day JOIN edge_price s ON s.day = w.start_day AND s.security_id = e.security_id WHERE s.adj > 0
"""
VIEWS["edge_price"] = """
SELECT t.day, p.security_id, max_by(p.adjusted_close, p.price_date) AS adj
FROM (SELECT *, price_date + CAST(unnest(range(7)) AS INT) AS day FROM daily_price) p JOIN td t ON t.day = p.day GROUP BY 1, 2
"""
VIEWS["calm"] = """
SELECT decision_date, 'low_volatility_126' AS kind, security_id, -stddev_pop(r) AS score FROM (
  SELECT d.decision_date, p.security_id, p.adjusted_close,
    CAST(p.adjusted_close AS DOUBLE) / lag(CAST(p.adjusted_close AS DOUBLE)) OVER (PARTITION BY d.decision_date, p.security_id ORDER BY p.price_date) - 1 AS r
  FROM sweep_date d JOIN td ts ON ts.td_index = d.td_index - 126 JOIN daily_price p ON p.price_date BETWEEN ts.day AND d.prev_td) x
GROUP BY decision_date, security_id HAVING count(*) >= 100 AND min(adjusted_close) > 0
"""
VIEWS["large"] = """
SELECT d.decision_date, 'market_cap' AS kind, m.security_id, CAST(max_by(m.market_cap_usd, m.cap_date) AS DOUBLE) AS score
FROM sweep_date d JOIN daily_market_cap m ON m.cap_date <= d.prev_td AND m.cap_date > d.prev_td - 7 GROUP BY d.decision_date, m.security_id HAVING max_by(m.market_cap_usd, m.cap_date) > 0
"""
VIEWS["score"] = "SELECT * FROM momentum UNION ALL SELECT * FROM calm UNION ALL SELECT * FROM large"
VIEWS["ranked"] = """
SELECT *, CASE WHEN tradable THEN CAST(sum(CAST(tradable AS INT)) OVER (PARTITION BY kind, decision_date ORDER BY score DESC, security_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS tradable_rank
FROM (SELECT s.*, p.security_id IS NOT NULL AS tradable, row_number() OVER (PARTITION BY s.kind, s.decision_date ORDER BY s.score DESC, s.security_id) AS rank,
    count(*) OVER (PARTITION BY s.kind, s.decision_date) AS scored
  FROM score s JOIN candidate c ON c.security_id = s.security_id AND c.as_of = s.decision_date
  LEFT JOIN trading_price p ON p.security_id = s.security_id AND p.price_date = s.decision_date) x
"""
VIEWS["reversal"] = """
SELECT decision_date, replace(kind, 'momentum', 'reversal') AS kind, security_id, 0.0 - score AS score FROM momentum WHERE kind IN ('momentum_63_0', 'momentum_126_21')
"""
VIEWS["reversal_ranked"] = VIEWS["ranked"].replace("FROM score s", "FROM reversal s")
VIEWS["market"] = """
SELECT price_date, round(CAST(sum(adjusted_close) AS DOUBLE) / count(*), 6) AS close, row_number() OVER (ORDER BY price_date) AS n FROM trading_price GROUP BY price_date
"""
VIEWS["trend"] = """
SELECT d.decision_date, k AS trend_days, CASE WHEN m.n >= k AND m.price_date >= d.prev_td - 7 THEN m.close > (SELECT avg(x.close) FROM market x WHERE x.n > m.n - k AND x.n <= m.n) END AS risk_on,
  CASE WHEN m.n IS NULL OR m.n < k OR m.price_date < d.prev_td - 7 THEN 'series too short or stale' END AS problem
FROM decision d JOIN (SELECT unnest([150, 200]) AS k) kk ON TRUE
LEFT JOIN LATERAL (SELECT * FROM market y WHERE y.price_date <= d.prev_td ORDER BY y.price_date DESC LIMIT 1) m ON TRUE
"""


def _strategies() -> str:
    """The sweep as VALUES, spelled out from its grid."""
    rows = [("momentum-v1", "momentum_126_21", 2, None), ("equal_weight_universe_v1", "momentum_126_21", None, None)]
    for lookback in (63, 126, 252):
        for skip in (0, 21):
            for n in (20, 50, 100):
                if not (lookback == 126 and skip == 21 and n == 20):
                    rows.append((f"momentum_l{lookback}_s{skip}_n{n}", f"momentum_{lookback}_{skip}", n // 10, None))
    rows += [(f"a2_ew_trend{d}", "momentum_126_21", None, d) for d in (150, 200)]
    for prefix, kind, sizes in (("a2_lowvol", "low_volatility_126", (50, 100)), ("a3_cap", "market_cap", (50, 100, 200))):
        for n in sizes:
            rows += [(f"{prefix}{n}", kind, n // 10, None), (f"{prefix}{n}_trend200", kind, n // 10, 200)]
    return ", ".join(f"('{s}', '{k}', {n or 'NULL'}, {d or 'NULL'})" for s, k, n, d in rows)


VIEWS["strategy"] = f"SELECT * FROM (VALUES {_strategies()}) v(strategy, kind, top_n, trend_days)"
VIEWS["holding"] = """
SELECT s.strategy, r.decision_date, r.security_id, r.score, r.rank, r.scored, count(*) OVER (PARTITION BY s.strategy, r.decision_date) AS held, r.kind, s.top_n
FROM ranked r JOIN strategy s ON s.kind = r.kind AND r.tradable AND (s.top_n IS NULL OR r.tradable_rank <= s.top_n)
WHERE NOT EXISTS (SELECT 1 FROM trend t WHERE t.decision_date = r.decision_date AND t.trend_days = s.trend_days AND NOT t.risk_on)
"""


def rank_report(where: str) -> str:
    return f"SELECT kind, decision_date, security_id, round(score, 6) AS score, rank, tradable_rank, scored FROM ranked WHERE {where}"


SQL = {
    "momentum_rank": rank_report("kind LIKE 'momentum%'"),
    "low_volatility_rank": rank_report("kind LIKE 'low%'"),
    "market_cap_rank": rank_report("kind = 'market_cap'"),
    "reversal_rank": rank_report("TRUE").replace("FROM ranked", "FROM reversal_ranked"),
    "trend_filter": "SELECT * FROM trend",
    "sweep_holdings": "SELECT strategy, decision_date, security_id, rank, held, round(1.0 / held, 6) AS weight FROM holding",
}
SQL = {name: build(body) for name, body in SQL.items()}
SQL["wide_momentum"] = build(rank_report("kind LIKE 'momentum%'"), WIDE)
