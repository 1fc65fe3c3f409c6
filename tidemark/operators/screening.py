"""Ratio screen: one row per security and screening date, all months in one job.

Decision order: manual list, prohibited business, a failed ratio, a problem with the inputs, pass.
A ratio is tested as `part > limit * whole` in decimals, so a ratio exactly at its limit passes and
nothing is rounded first. Ratios reported in the result are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.functions.text import sic_number
from tidemark.operators import asof
from tidemark.params import PROVIDER, Methodology

AMOUNTS = (
    "debt",
    "cash_and_equivalents",
    "investments",
    "investments_current",
    "investments_noncurrent",
    "revenue",
    "ebit",
    "operating_income",
)
FILING_VALUES = ("dimension", "calendar_date", "report_period", *AMOUNTS)


def business_category(industry: Column, sic: Column, method: Methodology) -> Column:
    """The first prohibited category the industry name or SIC number falls in, else NULL."""
    category = None
    for rule in method.businesses:
        tests = [sic.between(lo, hi) for lo, hi in rule.sic_ranges]
        if rule.industries:
            tests.append(industry.isin(*rule.industries))
        if not tests:
            continue  # covered by the manual list only
        hit = F.lit(False)
        for test in tests:
            hit = hit | F.coalesce(test, F.lit(False))
        category = F.when(hit, rule.category) if category is None else category.when(hit, rule.category)
    return F.lit(None).cast("string") if category is None else category


def latest_filings(
    grid: DataFrame, filings: DataFrame, months: DataFrame, first_month: int
) -> DataFrame:
    """grid [security_id, screening_date] + structs arq, ary, art: latest filing before the date.

    The three dimensions share one pass: rows are reduced per (security, dimension, month), carried
    forward, and turned into columns by one small aggregation.
    """
    wanted = filings.filter(F.col("dimension").isin("ARQ", "ARY", "ART"))
    by_kind = grid.select("security_id", "screening_date").withColumn(
        "dim", F.explode(F.array(F.lit("ARQ"), F.lit("ARY"), F.lit("ART")))
    )
    tie = ["calendar_date"] + (["filing_id"] if "filing_id" in filings.columns else [])
    got = asof.asof_monthly(
        by_kind, wanted.withColumn("dim", F.col("dimension")), months, first_month,
        ["security_id", "dim"], "screening_date", "filing_date", list(FILING_VALUES), tie,
    )
    filing = F.when(
        F.col("filing_date").isNotNull(),
        F.struct(
            "filing_date", "dimension",
            F.coalesce("report_period", "calendar_date").alias("period_end"), *AMOUNTS,
        ),
    )
    columns = [
        F.max(F.when(F.col("dim") == kind, filing)).alias(kind.lower()) for kind in ("ARQ", "ARY", "ART")
    ]
    return got.groupBy("security_id", "screening_date").agg(*columns)


def _problem(failed: Column, *text: object) -> Column:
    parts = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in text]
    return F.when(failed, F.concat(*parts))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def screen(inputs: DataFrame, method: Methodology) -> DataFrame:
    """Add status, reason, the three ratios and the problems.

    `inputs`: security_id, screening_date, industry, sic_code, market_value, manual_status,
    manual_reason, and the filing structs arq, ary, art. An existing quarterly (trailing) report is
    used even when an annual one is fresher.
    """
    c = F.col
    day, mv = c("screening_date"), c("market_value")
    rows = inputs.withColumns(
        {
            "_sheet": F.coalesce("arq", "ary"),
            "_income": F.coalesce("art", "ary"),
            "_category": business_category(c("industry"), sic_number(c("sic_code")), method),
            "_oldest": F.add_months(day, -method.max_report_age_months),
        }
    )
    sheet, income = c("_sheet"), c("_income")
    sheet_ok = F.coalesce(sheet["period_end"] >= c("_oldest"), F.lit(False))
    income_ok = F.coalesce(income["period_end"] >= c("_oldest"), F.lit(False))
    usable_mv = F.when(mv > 0, mv)
    invested = F.coalesce(
        sheet["investments"], sheet["investments_current"] + sheet["investments_noncurrent"]
    )
    cash = sheet["cash_and_equivalents"]
    cash_missing = cash.isNull() | invested.isNull()
    cash_negative = F.coalesce((cash < 0) | (invested < 0), F.lit(False))
    revenue, ebit, core = income["revenue"], income["ebit"], income["operating_income"]
    income_missing = revenue.isNull() | ebit.isNull() | core.isNull()
    rows = rows.withColumns(
        {
            "_mv": usable_mv,
            "_debt": F.when(sheet_ok & (sheet["debt"] >= 0), sheet["debt"]),
            "_cash": F.when(sheet_ok & ~cash_missing & ~cash_negative, cash + invested),
            "_noncore": F.when(
                income_ok & ~income_missing & (revenue > 0),
                F.greatest(ebit - core, F.lit(0).cast("decimal(24,4)")),
            ),
            "_revenue": revenue,
            "_problems": _present(
                [
                    _problem(mv.isNull(), "market_value:missing"),
                    _problem(mv <= 0, "market_value:not_positive ", mv),
                    *_age(sheet, "sheet", sheet_ok),
                    *_age(income, "income", income_ok),
                    _problem(sheet_ok & sheet["debt"].isNull(), "debt:missing"),
                    _problem(sheet_ok & (sheet["debt"] < 0), "debt:negative"),
                    _missing(sheet_ok, "sheet", {"cash": cash, "investments": invested}),
                    _problem(
                        sheet_ok & ~cash_missing & cash_negative,
                        "cash:negative",
                    ),
                    _missing(income_ok, "income", {"revenue": revenue, "ebit": ebit, "core": core}),
                    _problem(
                        income_ok & ~income_missing & (revenue <= 0),
                        "revenue:not_positive",
                    ),
                ]
            ),
        }
    )
    tests = (
        ("debt", "_debt", "_mv", method.max_debt),
        ("cash", "_cash", "_mv", method.max_cash),
        ("income", "_noncore", "_revenue", method.max_income),
    )
    names = ("debt_ratio", "cash_ratio", "income_ratio")
    rows = rows.withColumns(
        {name: ratio(c(part), c(whole)) for name, (_, part, whole, _) in zip(names, tests, strict=True)}
    )
    over = _present([F.when(c(part) > F.lit(limit) * c(whole), F.lit(code)) for code, part, whole, limit in tests])
    rows = rows.withColumn("_failed", over)
    has_failed, has_problem = F.size("_failed") > 0, F.size("_problems") > 0
    manual, business = c("manual_status").isNotNull(), c("_category").isNotNull()
    status = (
        F.when(manual, c("manual_status"))
        .when(business | has_failed, "NON_HALAL")
        .when(has_problem, "UNKNOWN")
        .otherwise("HALAL")
    )
    # A code and what decided; the figures are columns of their own.
    reason = F.concat_ws(
        " ",
        F.when(manual, F.concat_ws(" ", F.lit("manual_list"), "manual_reason"))
        .when(business, F.concat_ws(" ", F.lit("business"), "_category"))
        .when(has_failed, F.concat_ws(" ", F.lit("over_limit"), F.array_join("_failed", ",")))
        .when(has_problem, F.array_join("_problems", "; "))
        .otherwise("within_limits"),
    )
    tested = ~manual & ~business
    return rows.select(
        *[x for x in inputs.columns if x not in ("arq", "ary", "art")],
        status.alias("status"),
        reason.alias("reason"),
        F.when(manual, "manual_list").when(business, "business").otherwise("ratios").alias("rule"),
        F.when(~manual, c("_category")).alias("category"),
        *[F.when(tested, c(n)).alias(n) for n in names],
        F.when(tested, c("_problems")).alias("problems"),
        source_reference(sheet, income).alias("filings"),
    )


def _age(filing: Column, name: str, ok: Column) -> list[Column]:
    return [
        _problem(filing.isNull(), f"{name}:none"),
        _problem(filing.isNotNull() & ~ok, f"{name}:too_old ", filing["period_end"]),
    ]


def _missing(usable: Column, name: str, values: dict[str, Column]) -> Column:
    """One problem naming every missing value, in order."""
    names = _present([F.when(value.isNull(), F.lit(code)) for code, value in values.items()])
    return F.when(usable & (F.size(names) > 0), F.concat(F.lit(f"{name}_values:missing "), F.array_join(names, ",")))


def source_reference(sheet: Column, income: Column) -> Column:
    """The filings a result used, as an array of structs."""

    def used(f: Column) -> Column:
        return F.when(
            f.isNotNull(),
            F.struct(
                f["dimension"].alias("dimension"),
                f["filing_date"].alias("filing_date"),
                f["period_end"].alias("period_end"),
            ),
        )

    return _present([used(sheet), used(income)])


def screening_inputs(
    securities: DataFrame,
    grid: DataFrame,
    filings: DataFrame,
    caps: DataFrame,
    manual: DataFrame | None,
    months: DataFrame,
    first_month: int,
) -> DataFrame:
    """Everything the screen looks at, per (security_id, screening_date) of the grid."""
    info = ["security_id", "source_id", "industry", "sic_code"]
    values = caps.select(
        "security_id",
        F.col("cap_date").alias("screening_date"),
        F.col("market_cap_usd").alias("market_value"),
    )
    rows = (
        latest_filings(grid, filings, months, first_month)
        .join(securities.select(*info), "security_id")
        .join(
            # Only month-end market values take part: the date list is calendar-sized.
            values.join(F.broadcast(months.select("screening_date")), "screening_date", "left_semi"),
            ["security_id", "screening_date"],
            "left",
        )
    )
    if manual is None:
        return rows.withColumns(
            {name: F.lit(None).cast("string") for name in ("manual_status", "manual_reason")}
        )
    return rows.join(manual.select("source_id", "manual_status", "manual_reason"), "source_id", "left")


def classify(
    spark: SparkSession,
    securities: DataFrame,
    grid: DataFrame,
    filings: DataFrame,
    caps: DataFrame,
    screening_months: DataFrame,
    first_month: int,
    method: Methodology,
    manual: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Classification records of every grid row that is not stored yet."""
    if stored is not None:
        keys = stored.filter(
            (F.col("provider") == PROVIDER) & (F.col("methodology") == method.version)
        ).select("security_id", "screening_date")
        grid = grid.join(keys, ["security_id", "screening_date"], "left_anti")
    months = screening_months.select("month_no", "screening_date")
    inputs = screening_inputs(securities, grid, filings, caps, manual, months, first_month)
    periods = F.broadcast(screening_months.select("screening_date", "effective_from", "effective_to"))
    return (
        screen(inputs, method)
        .join(periods, "screening_date")
        .withColumn("provider", F.lit(PROVIDER))
        .withColumn("methodology", F.lit(method.version))
    )
