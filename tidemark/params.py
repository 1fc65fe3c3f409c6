"""Parameters of the jobs: methodology, universe, quality thresholds, strategies, costs, limits.

All of them are fixed values that decide results; changing one means a new version.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

PROVIDER = "internal_screen"
COMMON_STOCK_CATEGORIES = (
    "Domestic Common Stock",
    "Domestic Common Stock Primary Class",
    "Domestic Common Stock Secondary Class",
)


@dataclass(frozen=True)
class BusinessRule:
    category: str
    industries: tuple[str, ...] = ()
    sic_ranges: tuple[tuple[int, int], ...] = ()


# Prohibited main businesses, first match in this order wins.
EXCLUDED_BUSINESSES = (
    BusinessRule(
        "conventional_finance",
        (
            "Banks - Diversified",
            "Banks - Regional",
            "Credit Services",
            "Mortgage Finance",
            "Insurance - Diversified",
            "Insurance - Life",
            "Insurance - Property & Casualty",
            "Insurance - Specialty",
            "Insurance - Reinsurance",
            "Insurance Brokers",
            "REIT - Mortgage",
            "Capital Markets",
        ),
        ((6000, 6299), (6300, 6411)),
    ),
    BusinessRule(
        "alcohol",
        ("Beverages - Brewers", "Beverages - Wineries & Distilleries"),
        ((2082, 2082), (2084, 2085), (5180, 5182)),
    ),
    BusinessRule("tobacco", ("Tobacco",), ((2100, 2141), (5194, 5194))),
    BusinessRule("gambling", ("Gambling", "Resorts & Casinos")),
    BusinessRule("pork"),
    BusinessRule("adult_entertainment"),
)


@dataclass(frozen=True)
class Methodology:
    version: str = "AAOIFI-v1"
    max_debt: Decimal = Decimal("0.30")
    max_cash: Decimal = Decimal("0.30")
    max_income: Decimal = Decimal("0.05")
    max_report_age_months: int = 16
    businesses: tuple[BusinessRule, ...] = EXCLUDED_BUSINESSES


@dataclass(frozen=True)
class UniverseRules:
    version: str = "universe-v1"
    methodology: str = "AAOIFI-v1"
    min_price: Decimal = Decimal("5.00")
    min_median_dollar_volume: Decimal = Decimal("1000000")
    liquidity_days: int = 20
    max_price_age_trading_days: int = 5
    price_lookback_days: int = 60
    categories: tuple[str, ...] = COMMON_STOCK_CATEGORIES


@dataclass(frozen=True)
class QualityThresholds:
    max_daily_move: Decimal = Decimal("0.5")
    max_gap_trading_days: int = 5
    split_ratio: Decimal = Decimal("1.8")
    split_window_days: int = 3
    max_price_age_trading_days: int = 5
    lookback_days: int = 30


@dataclass(frozen=True)
class Strategy:
    version: str
    ranking: str = "momentum"  # momentum, low_volatility or market_cap
    lookback: int = 126
    skip: int = 0
    top_n: int | None = 100  # None: every scored member is held
    trend_days: int | None = None
    trend_symbol: str = "SPY"


def strategy_sweep() -> tuple[Strategy, ...]:
    """The 31 strategies of the study, built from its grid."""
    grid = [Strategy("momentum-v1", lookback=126, skip=21, top_n=20)]
    for lookback in (63, 126, 252):
        for skip in (0, 21):
            for top_n in (20, 50, 100):
                if (lookback, skip, top_n) != (126, 21, 20):
                    grid.append(
                        Strategy(
                            f"momentum_l{lookback}_s{skip}_n{top_n}",
                            lookback=lookback,
                            skip=skip,
                            top_n=top_n,
                        )
                    )
    equal = Strategy("equal_weight_universe_v1", lookback=126, skip=21, top_n=None)
    trends = [
        Strategy(f"a2_ew_trend{days}", lookback=126, skip=21, top_n=None, trend_days=days)
        for days in (150, 200)
    ]
    overlays = [
        Strategy(
            f"{prefix}{n}" + (f"_trend{days}" if days else ""),
            ranking=ranking,
            top_n=n,
            trend_days=days,
        )
        for prefix, ranking, sizes in (
            ("a2_lowvol", "low_volatility", (50, 100)),
            ("a3_cap", "market_cap", (50, 100, 200)),
        )
        for n in sizes
        for days in (None, 200)
    ]
    return (*grid, equal, *trends, *overlays)


@dataclass(frozen=True)
class Costs:
    per_share: Decimal = Decimal("0.005")
    minimum: Decimal = Decimal("1.00")
    max_fraction: Decimal = Decimal("0.01")
    slippage_bps: tuple[tuple[str, int], ...] = (("optimistic", 5), ("base", 10), ("stress", 25))


PURIFICATION_DRAG = Decimal("0.00015")
TRADING_DAYS_PER_YEAR = 252
DAYS_PER_YEAR = 365.25
START_NAV = 100_000
MAX_PRICE_AGE_DAYS = 7

# The research periods (name, first day, last day).
PERIODS = (
    ("burn_in", date(1998, 12, 1), date(2003, 12, 31)),
    ("in_sample", date(2004, 1, 1), date(2013, 12, 31)),
    ("validation", date(2014, 1, 1), date(2018, 12, 31)),
    ("out_of_sample", date(2019, 1, 1), date(2026, 9, 30)),
)


@dataclass(frozen=True)
class RiskLimits:
    max_position_pct: Decimal = Decimal(10)
    max_fund_position_pct: Decimal = Decimal(60)
    max_sector_pct: Decimal = Decimal(30)
    max_total_exposure_pct: Decimal = Decimal(100)
    max_daily_turnover_pct: Decimal = Decimal(60)
    max_order_value: Decimal = Decimal(50_000)
    manual_review_order_value: Decimal = Decimal(20_000)
    max_portfolio_drawdown_pct: Decimal = Decimal(25)
    max_daily_loss_pct: Decimal = Decimal(5)
    min_average_daily_volume_usd: Decimal = Decimal(1_000_000)
    max_price_age_days: int = 3
    approved_funds: tuple[str, ...] = ("SPUS", "HLAL")


# Allowed steps of the order state machine, from and to.
ORDER_STEPS = (
    ("APPROVED", "CANCELLED"), ("APPROVED", "FAILED"), ("APPROVED", "SUBMITTED"),
    ("SUBMITTED", "ACKNOWLEDGED"), ("SUBMITTED", "CANCELLED"), ("SUBMITTED", "FAILED"), ("SUBMITTED", "FILLED"),
    ("SUBMITTED", "PARTIALLY_FILLED"), ("SUBMITTED", "REJECTED_BY_BROKER"), ("SUBMITTED", "SUBMISSION_UNKNOWN"),
    ("SUBMISSION_UNKNOWN", "ACKNOWLEDGED"), ("SUBMISSION_UNKNOWN", "CANCELLED"), ("SUBMISSION_UNKNOWN", "FAILED"),
    ("SUBMISSION_UNKNOWN", "FILLED"), ("SUBMISSION_UNKNOWN", "PARTIALLY_FILLED"), ("SUBMISSION_UNKNOWN", "REJECTED_BY_BROKER"),
    ("ACKNOWLEDGED", "CANCELLED"), ("ACKNOWLEDGED", "FILLED"), ("ACKNOWLEDGED", "PARTIALLY_FILLED"), ("ACKNOWLEDGED", "REJECTED_BY_BROKER"),
    ("PARTIALLY_FILLED", "CANCELLED"), ("PARTIALLY_FILLED", "FILLED"), ("PARTIALLY_FILLED", "PARTIALLY_FILLED"),
)

# Vendor action code -> stored action type; only the last two keep a value.
ACTION_TYPES = {
    "split": "SPLIT",
    "dividend": "DIVIDEND",
    "acquisitionof": "MERGER",
    "acquisitionby": "MERGER",
    "mergerfrom": "MERGER",
    "mergerto": "MERGER",
    "tickerchangefrom": "SYMBOL_CHANGE",
    "tickerchangeto": "SYMBOL_CHANGE",
    "delisted": "DELISTING",
    "regulatorydelisting": "DELISTING",
    "voluntarydelisting": "DELISTING",
    "bankruptcyliquidation": "DELISTING",
}
VALUED_ACTIONS = ("SPLIT", "DIVIDEND")

# Legal words dropped from a company name key.
LEGAL_WORDS = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LLC", "PLC",
    "NV", "SA", "THE", "DE", "NEW",
)


@dataclass(frozen=True)
class Params:
    methodology: Methodology = field(default_factory=Methodology)
    universe: UniverseRules = field(default_factory=UniverseRules)
    quality: QualityThresholds = field(default_factory=QualityThresholds)
