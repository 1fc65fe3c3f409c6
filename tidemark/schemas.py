"""Explicit schemas of the stored tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(30, 6)
ACTION_VALUE = T.DecimalType(19, 8)
AMOUNT = T.DecimalType(24, 4)
NAV = T.DecimalType(24, 8)

# The as-reported dimensions and the amount columns (stored name -> vendor column).
DIMENSIONS = ("ARQ", "ARY", "ART")
AMOUNT_COLUMNS = {
    "debt": "debt",
    "debt_current": "debtc",
    "debt_noncurrent": "debtnc",
    "cash_and_equivalents": "cashneq",
    "investments": "investments",
    "investments_current": "investmentsc",
    "investments_noncurrent": "investmentsnc",
    "receivables": "receivables",
    "assets": "assets",
    "revenue": "revenue",
    "interest_expense": "intexp",
    "ebit": "ebit",
    "ebt": "ebt",
    "operating_income": "opinc",
    "net_income": "netinc",
    "market_cap": "marketcap",
    "shares_basic": "sharesbas",
    "shares_weighted_avg": "shareswa",
    "price": "price",
}


# The table schemas are DDL text: readers and createDataFrame take it, and importing this module
# needs no session.
SECURITY = (
    "security_id bigint, source string, source_id string, company_name string, exchange string, "
    "currency string, country string, sector string, industry string, category string, "
    "sic_code string, related_tickers string, isin string, cusip string, start_date date, "
    "end_date date, delisted_flag boolean, active_flag boolean"
)
SECURITY_TICKER = "security_id bigint, ticker string, valid_from date, valid_to date"
DAILY_PRICE = (
    "security_id bigint, price_date date, open decimal(30,6), high decimal(30,6), "
    "low decimal(30,6), close decimal(30,6), adjusted_close decimal(30,6), "
    "close_unadjusted decimal(30,6), volume bigint, source string, data_version string"
)
CORPORATE_ACTION = (
    "security_id bigint, action_type string, effective_date date, value decimal(19,8), "
    "related_security_id bigint, details map<string,string>"
)
FUNDAMENTAL = (
    "security_id bigint, dimension string, calendar_date date, filing_date date, "
    "report_period date, fiscal_period string, "
    + ", ".join(f"{name} decimal(24,4)" for name in AMOUNT_COLUMNS)
)
DAILY_MARKET_CAP = "security_id bigint, cap_date date, market_cap_usd decimal(24,4)"
INDEX_MEMBERSHIP = (
    "index_name string, record_date date, action string, ticker string, company_name string, "
    "contra_ticker string, contra_name string, note string"
)
DATA_VERSION = (
    "dataset string, sha256 string, version string, source string, row_count bigint, "
    "downloaded_at timestamp"
)
PRICE_VINTAGE = (
    "vintage_id string, description string, status string, stock_rows bigint, "
    "benchmark_rows bigint, finished_at timestamp"
)
VINTAGE_PRICE = (
    "security_id bigint, price_date date, close_unadjusted decimal(30,6), "
    "adjusted_close decimal(30,6), volume bigint, vintage_id string"
)
CLASSIFICATION = (
    "security_id bigint, provider string, methodology string, status string, "
    "effective_from date, effective_to date, screening_date date, reason string"
)
FINDING = "security_id bigint, check_name string, data_date date, detail string"
AUDIT_EVENT = (
    "sequence bigint, occurred_at timestamp, actor string, action string, entity_type string, "
    "entity_id string, reason string"
)

# Vendor tables arrive as text: every cell is a string until a parse operator has looked at it.
RAW_PRICE_COLUMNS = (
    "ticker", "date", "open", "high", "low", "close", "volume", "closeadj", "closeunadj",
)
RAW_ACTION_COLUMNS = (
    "date", "action", "ticker", "name", "value", "contraticker", "contraname",
)
RAW_COMPANY_COLUMNS = (
    "permaticker", "ticker", "name", "exchange", "isdelisted", "category", "siccode", "sector",
    "industry", "currency", "location", "relatedtickers", "firstpricedate", "lastpricedate",
)
RAW_FUNDAMENTAL_COLUMNS = (
    "ticker", "dimension", "calendardate", "date", "reportperiod", "fiscalperiod",
    *AMOUNT_COLUMNS.values(),
)
RAW_MARKET_CAP_COLUMNS = ("ticker", "date", "marketcap")
RAW_MEMBERSHIP_COLUMNS = (
    "date", "action", "ticker", "name", "contraticker", "contraname", "note",
)


def all_text(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])
