"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is run once to warm up code generation on a small directory where one exists, then timed
once: plan building, execution and consumption of every row (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.plans import (  # noqa: E402
    analytics,
    ingest,
    orders,
    portfolio,
    quality,
    reports,
    scoring,
    screening,
    temporal,
    universe,
)
from tidemark.params import strategy_sweep  # noqa: E402
from tidemark.session import local_session  # noqa: E402

MOMENTUM = tuple(s for s in strategy_sweep() if s.ranking == "momentum")


def wide_quality(spark, sf):
    """All checks on a panel with one security per part."""
    rows = quality.all_findings(spark, sf, key="part")
    return rows.groupBy("check_name").agg(F.count("*").alias("findings"))


def wide_screening(spark, sf):
    """Every part as a security, all month ends."""
    rows = screening.classification(spark, sf, "part")
    return rows.groupBy("screening_date", "status").agg(F.count("*").alias("n"))


def wide_momentum(spark, sf):
    """All momentum windows, one security per supplier."""
    return scoring.ranked(spark, sf, MOMENTUM, "supplier")


HEADLINE = {
    "ticker_resolve": temporal.ticker_resolve,
    "price_import_summary": ingest.price_import_summary,
    "filing_asof": temporal.filing_asof,
    "filing_asof_daily": temporal.filing_asof_daily,
    "price_asof_bounded": temporal.price_asof_bounded,
    "quality_findings": quality.quality_findings,
    "screening": screening.screening_results,
    "median_dollar_volume": universe.median_dollar_volume,
    "universe_funnel": universe.universe_funnel,
    "momentum_rank": scoring.momentum_rank,
    "sweep_holdings": scoring.sweep_holdings,
    "gross_nav": portfolio.gross_nav,
    "net_nav": portfolio.net_nav,
    "performance_summary": analytics.performance_summary,
    "status_transitions": reports.status_transitions,
    "illegal_transitions": orders.illegal_transitions,
    "order_check": orders.order_check,
    "order_batch": orders.order_batch,
    "wide_quality": wide_quality,
    "wide_screening": wide_screening,
    "wide_momentum": wide_momentum,
}


def run(spark, query, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    warm = os.path.join(os.path.dirname(sf), "sf0.001")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    times = {}
    for name, query in HEADLINE.items():
        if os.path.isdir(warm):
            run(spark, query, warm)
        times[name] = round(run(spark, query, sf), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    label = os.path.basename(sf).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(label) if label.replace(".", "", 1).isdigit() else label,
            }
        )
    )


if __name__ == "__main__":
    main()
