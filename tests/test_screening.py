"""The ratio screen on one company with edges."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.screening import AMOUNTS, screen
from tidemark.params import Methodology

DAY = date(2020, 1, 31)
FILING = "struct<filing_date: date, dimension: string, period_end: date, " + ", ".join(
    f"{a}: decimal(24,4)" for a in AMOUNTS
) + ">"
SCHEMA = (
    "security_id int, screening_date date, industry string, sic_code string, market_value decimal(24,4), "
    f"manual_status string, manual_reason string, arq {FILING}, ary {FILING}, art {FILING}"
)


def filing(dimension, end=date(2019, 9, 30), **amounts):
    values = [None if amounts.get(a) is None else Decimal(amounts[a]) for a in AMOUNTS]
    return (date(2019, 11, 1), dimension, end, *values)


SHEET = {"debt": 2000, "cash_and_equivalents": 1500, "investments": 500}
INCOME = {"revenue": 8000, "ebit": 2300, "operating_income": 2200}


def run(spark, sheet=SHEET, income=INCOME, mv=10000, industry="Software - Application", sic="7372", manual=None, **more):
    row = (
        1, DAY, industry, sic, None if mv is None else Decimal(mv), manual, "by hand" if manual else None,
        more.get("arq", sheet and filing("ARQ", **sheet)), more.get("ary"), more.get("art", income and filing("ART", **income)),
    )
    return screen(spark.createDataFrame([row], SCHEMA), Methodology()).first()


def test_worked_example_passes(spark):
    r = run(spark)
    assert r.status == "HALAL"
    assert (round(r.debt_ratio, 6), round(r.cash_ratio, 6), round(r.income_ratio, 6)) == (0.2, 0.2, 0.0125)
    assert r.reason == "within_limits"
    assert [f.dimension for f in r.filings] == ["ARQ", "ART"]


@pytest.mark.parametrize(
    ("change", "status", "part"),
    [
        ({"sheet": {**SHEET, "debt": 3000}}, "HALAL", "within_limits"),
        ({"sheet": {**SHEET, "debt": Decimal("3000.0001")}}, "NON_HALAL", "over_limit debt"),
        ({"mv": None}, "UNKNOWN", "market_value:missing"),
        ({"mv": 0}, "UNKNOWN", "market_value:not_positive 0"),
        ({"sheet": {**SHEET, "debt": -1}}, "UNKNOWN", "debt:negative"),
        ({"sheet": {**SHEET, "debt": None}}, "UNKNOWN", "debt:missing"),
        ({"sheet": {**SHEET, "investments": None}}, "UNKNOWN", "sheet_values:missing investments"),
        ({"sheet": {**SHEET, "investments": None, "investments_current": 200, "investments_noncurrent": 300}}, "HALAL", "within_limits"),
        ({"income": {**INCOME, "revenue": 0}}, "UNKNOWN", "revenue:not_positive"),
        ({"income": {**INCOME, "operating_income": 9000}}, "HALAL", "within_limits"),
        ({"income": {"ebit": 1}}, "UNKNOWN", "income_values:missing revenue,core"),
        ({"sheet": None}, "UNKNOWN", "sheet:none"),
        ({"sheet": {**SHEET, "debt": 9000}, "income": None}, "NON_HALAL", "over_limit debt"),
        ({"industry": "Tobacco"}, "NON_HALAL", "business tobacco"),
        ({"sic": "6022"}, "NON_HALAL", "conventional_finance"),
        ({"sic": "n/a"}, "HALAL", "within_limits"),
        ({"manual": "PENDING_REVIEW", "industry": "Tobacco"}, "PENDING_REVIEW", "manual_list by hand"),
    ],
)
def test_edges(spark, change, status, part):
    r = run(spark, **change)
    assert r.status == status and part in r.reason, r.reason


def test_a_stale_quarterly_report_hides_a_fresh_annual_one(spark):
    r = run(spark, arq=filing("ARQ", date(2018, 9, 29), **SHEET), ary=filing("ARY", **SHEET))
    assert r.status == "UNKNOWN" and r.reason.startswith("sheet:too_old 2018-09-29")
    assert run(spark, arq=filing("ARQ", date(2018, 9, 30), **SHEET)).status == "HALAL"  # 16 months exactly
    assert run(spark, arq=None, ary=filing("ARY", **SHEET)).status == "HALAL"


def test_columns_are_not_rounded_before_the_test(spark):
    r = run(spark, sheet={**SHEET, "debt": Decimal("3000.0001")})
    assert r.rule == "ratios" and F is not None
