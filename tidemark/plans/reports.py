"""Report queries over the classification history."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.memo import per_session
from tidemark.functions.numeric import out
from tidemark.operators import reports
from tidemark.plans.screening import classification
from tidemark.plans.universe import universe_table
from tidemark.sources import panel


@per_session
def span(spark: SparkSession, sf: str) -> tuple[date, date]:
    """The first and the last screening of the history; reports cover all of it."""
    first, last = classification(spark, sf).agg(F.min("screening_date"), F.max("screening_date")).first()
    return first or date.max, last or date.min


def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.transitions_by_year(classification(spark, sf), *span(spark, sf))


def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.transition_matrix(classification(spark, sf), *span(spark, sf))


def screened_by_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.screened_by_year(classification(spark, sf), *span(spark, sf))
    return rows.withColumn("unknown_share", out(F.col("unknown_share")))


def latest_changes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest_changes(
        classification(spark, sf), panel.security(spark, sf), panel.security_ticker(spark, sf), span(spark, sf)[1]
    )


def most_changes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.most_changes(classification(spark, sf), panel.security(spark, sf), *span(spark, sf), 15)


def unknown_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reports.unknown_reasons(classification(spark, sf), panel.security(spark, sf), span(spark, sf)[1])


def unknown_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return reports.unknown_streaks(classification(spark, sf), span(spark, sf)[1])


def longest_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return reports.longest_unknown(classification(spark, sf), panel.security(spark, sf), span(spark, sf)[1], 15)


def latest_screening_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest_counts(classification(spark, sf))


def latest_universe(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest_universe(universe_table(spark, sf))


QUERIES = {
    "status_transitions": status_transitions,
    "transition_matrix": transition_matrix,
    "screened_by_year": screened_by_year,
    "latest_changes": latest_changes,
    "most_changes": most_changes,
    "unknown_reasons": unknown_reasons,
    "unknown_streaks": unknown_streaks,
    "longest_unknown": longest_unknown,
    "latest_screening_counts": latest_screening_counts,
    "latest_universe": latest_universe,
}
