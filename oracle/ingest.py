from __future__ import annotations

from oracle.universe import fingerprint
from oracle.views import VIEWS, build

# open is 'N/A' and low is 'NaN' in some rows, closes are negative in others.
VIEWS["parsed_price"] = """
SELECT r.*, upper(trim(r.ticker)) AS tk, d AS price_date, t.security_id, CAST(close AS DECIMAL(30,6)) AS c, CAST(round(CAST(volume AS DECIMAL(18,2))) AS BIGINT) AS v,
  CASE WHEN lower(trim(r.ticker)) = 'n/a' THEN 'missing_ticker' WHEN low = 'NaN' OR date = '2024' THEN 'bad_value' WHEN date = '' THEN 'missing_date' WHEN open = 'N/A' THEN 'missing_value'
    WHEN t.security_id IS NULL THEN 'no_security_for_ticker_on_date' WHEN CAST(close AS DOUBLE) <= 0 THEN 'impossible_price_or_volume' END AS reason
FROM (SELECT *, CASE WHEN length(date) = 10 THEN CAST(date AS DATE) END AS d FROM raw_price) r
LEFT JOIN security_ticker t ON t.ticker = upper(trim(r.ticker)) AND d >= t.valid_from AND (t.valid_to IS NULL OR d < t.valid_to)
"""
VIEWS["fresh_price"] = """
SELECT *, count(*) OVER (PARTITION BY security_id, price_date) AS copies, row_number() OVER (PARTITION BY security_id, price_date ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, c, v) AS k
FROM parsed_price WHERE reason IS NULL QUALIFY k = 1
"""
VIEWS["stored_price"] = "SELECT security_id, price_date, close, volume FROM daily_price WHERE month(price_date) % 2 = 1"
VIEWS["action_row"] = """
SELECT r.o_orderkey, t.security_id, u.security_id AS related, r.contraname, d, v, kind,
  CASE WHEN r.action = '' OR r.ticker = 'N/A' THEN 'missing_key_field' WHEN kind IS NULL THEN concat('unmapped_action:', r.action) WHEN r.value = 'x1' OR r.date = '2001-02-30' THEN 'bad_value'
    WHEN t.security_id IS NULL THEN 'no_security_for_ticker_on_date' WHEN kind IN ('SPLIT', 'DIVIDEND') AND coalesce(v, 0) <= 0 THEN 'bad_value' END AS reason
FROM (SELECT *, try_cast(date AS DATE) AS d, try_cast(nullif(value, '') AS DOUBLE) AS v,
    CASE WHEN action = 'split' THEN 'SPLIT' WHEN action = 'dividend' THEN 'DIVIDEND' WHEN action LIKE 'acquisition%' OR action LIKE 'merger%' THEN 'MERGER' WHEN action LIKE 'tickerchange%' THEN 'SYMBOL_CHANGE'
         WHEN action LIKE '%delist%' OR action LIKE 'bankruptcy%' THEN 'DELISTING' END AS kind FROM raw_action) r
LEFT JOIN security_ticker t ON t.ticker = upper(r.ticker) AND d >= t.valid_from AND (t.valid_to IS NULL OR d < t.valid_to)
LEFT JOIN security_ticker u ON u.ticker = upper(r.contraticker) AND d >= u.valid_from AND (u.valid_to IS NULL OR d < u.valid_to)
"""
VIEWS["company_row"] = """
SELECT c_name AS nm, c.*, nullif(trim(permaticker), '') AS source_id, try_cast(nullif(firstpricedate, '') AS DATE) AS f, try_cast(nullif(lastpricedate, '') AS DATE) AS l,
  CASE WHEN trim(permaticker) = '' OR name = '' THEN 'missing_identity' WHEN isdelisted = '?' THEN 'bad_isdelisted_flag' WHEN firstpricedate = '1999-13-01' THEN 'bad_date' WHEN firstpricedate = '' THEN 'no_first_price_date'
    WHEN isdelisted = 'y' AND lastpricedate = '' THEN 'delisted_without_last_price_date' WHEN isdelisted = 'y' AND CAST(lastpricedate AS DATE) < CAST(firstpricedate AS DATE) THEN 'last_price_before_first' END AS reason
FROM raw_company c JOIN customer USING (c_custkey)
"""
SQL = {
    "price_parse": "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, CAST(coalesce(sum(CASE WHEN reason IS NULL THEN v END), 0) AS BIGINT) AS volume FROM parsed_price GROUP BY 1",
    "clean_values": """
SELECT CASE WHEN upper(trim(ticker)) IN ('', 'N/A') THEN NULL ELSE trim(ticker) END AS ticker, length(date) <> 10 AS no_date, low = 'NaN' AS no_low, open = 'N/A' AS no_open, count(*) AS n FROM raw_price GROUP BY ALL
""",
    "text_keys": """
SELECT replace(upper(concat('c', c_custkey, '.a.b')), '-', '.') AS symbol, concat(upper(c_name), ' INC') AS company_key, concat(c_custkey, ' ZZ') AS related FROM customer
""",
    "first_copies": "SELECT security_id, price_date, l_orderkey, CAST(c AS DOUBLE) AS close, v AS volume, copies FROM fresh_price",
    "price_import_summary": """
SELECT concat('skipped:', reason) AS what, count(*) AS n FROM parsed_price WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'skipped:duplicate_in_download', CAST(coalesce(sum(copies - 1), 0) AS BIGINT) FROM fresh_price
UNION ALL SELECT 'inserted', count(*) FROM fresh_price WHERE (security_id, price_date) NOT IN (SELECT (security_id, price_date) FROM stored_price)
UNION ALL SELECT 'already_present', count(*) FROM fresh_price JOIN stored_price USING (security_id, price_date)
UNION ALL SELECT 'restated', count(*) FROM fresh_price f JOIN stored_price s USING (security_id, price_date) WHERE f.c <> s.close OR f.v <> s.volume
""",
    "unmatched_tickers": "SELECT tk AS ticker, count(*) AS n FROM parsed_price WHERE reason = 'no_security_for_ticker_on_date' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "new_price_keys": "SELECT security_id, price_date FROM fresh_price f WHERE NOT EXISTS (SELECT 1 FROM stored_price s WHERE s.security_id = f.security_id AND s.price_date = f.price_date)",
    "restated_prices": """
SELECT security_id, price_date, CAST(f.c AS DOUBLE) AS close, f.v AS volume FROM fresh_price f JOIN stored_price s USING (security_id, price_date) WHERE f.c <> s.close OR f.v <> s.volume
""",
    "market_cap_parse": """
SELECT security_id, skip_reason, count(*) AS n, CAST(sum(CASE WHEN price_date IS NOT NULL OR TRUE THEN CAST(close AS DECIMAL(18,2)) * 1000000 END) AS DOUBLE) AS usd FROM (
  SELECT *, CASE WHEN lower(trim(ticker)) = 'n/a' THEN 'missing_ticker' WHEN date = '2024' THEN 'bad_value' WHEN date = '' THEN 'missing_date' WHEN security_id IS NULL THEN 'no_security_for_ticker_on_date' END AS skip_reason FROM parsed_price) m
GROUP BY 1, 2
""",
    "benchmark_parse": """
SELECT CASE WHEN upper(trim(ticker)) <> 'T7' THEN 'other_ticker' WHEN date = '2024' THEN 'bad_value' WHEN date = '' THEN 'missing_value' END AS skip_reason, count(*) AS n, CAST(sum(v) AS BIGINT) AS volume FROM parsed_price GROUP BY 1
""",
    "action_parse": """
SELECT o_orderkey, reason AS skip_reason, CASE WHEN reason IS NULL THEN security_id END AS security_id, CASE WHEN reason IS NULL THEN kind END AS action_type,
  CASE WHEN reason IS NULL AND kind IN ('SPLIT', 'DIVIDEND') THEN v END AS value, CASE WHEN reason IS NULL THEN related END AS related_security_id,
  CASE WHEN reason IS NULL AND contraname <> 'n/a' THEN contraname END AS contra_name FROM action_row
""",
    "distinct_actions": """
SELECT security_id, kind AS action_type, d AS effective_date, CASE WHEN kind IN ('SPLIT', 'DIVIDEND') THEN v END AS value, min(o_orderkey) AS o_orderkey, count(*) AS copies FROM action_row WHERE reason IS NULL GROUP BY 1, 2, 3, 4
""",
    "fundamental_parse": """
SELECT t.security_id, upper(dimension) AS dimension, CASE WHEN r.ticker = '' THEN 'missing_ticker' WHEN dimension = 'MRQ' THEN 'not_an_as_reported_dimension' WHEN o_orderkey % 19 = 0 THEN 'bad_value'
    WHEN calendardate = 'N/A' THEN 'missing_date' WHEN t.security_id IS NULL THEN 'no_security_for_ticker_on_date' END AS skip_reason, count(*) AS n, CAST(sum(total) AS DOUBLE) AS debt
FROM raw_fundamental r LEFT JOIN security_ticker t ON t.ticker = r.ticker AND filed >= t.valid_from AND (t.valid_to IS NULL OR filed < t.valid_to) GROUP BY 1, 2, 3
""",
    "company_parse": """
SELECT nm AS c_name, source_id, upper(trim(ticker)) AS ticker, concat(c_custkey, ' ZZ') AS related_tickers, f AS first_price_date, CASE WHEN isdelisted = 'y' THEN l END AS last_price_date, reason AS skip_reason FROM company_row
""",
    "membership_parse": """
SELECT o_orderkey, try_cast(date AS DATE) AS record_date, nullif(action, '') AS action, CASE WHEN ticker <> 'N/A' THEN upper(ticker) END AS ticker, CASE WHEN contraname <> 'n/a' THEN contraname END AS company_name,
  CASE WHEN contraticker <> 'N/A' THEN contraticker END AS contra_ticker, CASE WHEN action = '' OR ticker = 'N/A' THEN 'missing_key_field' WHEN date = '2001-02-30' THEN 'bad_date' END AS skip_reason FROM raw_action
""",
    "version_registry": " UNION ALL ".join(
        f"SELECT 'prices' AS dataset, sha256, 'prices@' || substr(sha256, 1, 12) AS version, '{source}' AS source, row_count FROM ("
        + fingerprint(rows, "concat('=', ticker, '|=', date, '|=', open, '|=', high, '|=', low, '|=', close, '|=', volume)")
        + ") f"
        for source, rows in (("first", "raw_price"), ("part", "(SELECT * FROM raw_price WHERE l_orderkey % 2 = 0) half"))
    ),
    "data_version": fingerprint(
        "raw_price", "concat('=', ticker, '|=', date, '|=', open, '|=', high, '|=', low, '|=', close, '|=', volume)"
    ),
}
SQL = {name: build(body) for name, body in SQL.items()}
