"""Checks and scorers of a caller's own."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, scoring
from tidemark.params import Strategy


def test_row_checks_share_the_scan_of_values(spark):
    caps = spark.createDataFrame([(1, date(2020, 1, 2), D(5)), (1, date(2020, 1, 3), D(-1)), (2, date(2020, 1, 2), None), (2, date(2021, 1, 1), D(5))], "security_id int, cap_date date, market_cap_usd decimal(20,2)")
    more = (quality.RowCheck("tiny", "values", "market_cap_usd < 10", "market_cap_usd"), quality.RowCheck("other", "prices", "no_such_column > 0"))
    found = quality.value_findings(caps, date(2020, 1, 1), date(2020, 12, 31), more)
    assert sorted(map(tuple, found.collect())) == [
        (1, "non_positive_market_value", date(2020, 1, 3), "value=-1.00"), (1, "tiny", date(2020, 1, 2), "5.00"), (1, "tiny", date(2020, 1, 3), "-1.00"),
    ]
    counted = quality.counts(spark, found, ("tiny", "non_positive_market_value", "other"))
    assert {r.check_name: r.findings for r in counted.collect()} == {"tiny": 2, "non_positive_market_value": 1, "other": 0}


def test_table_checks_get_the_tables_they_name(spark):
    tables = {"prices": spark.range(3).withColumnRenamed("id", "security_id"), "values": spark.range(1)}
    missing = quality.TableCheck("unvalued", ("prices", "values"), lambda p, v: p.join(v, p.security_id == v.id, "left_anti").select("security_id", F.lit(None).cast("date").alias("data_date"), F.lit("x").alias("detail")))
    (found,) = quality.table_findings([missing], tables)
    assert sorted((r.security_id, r.check_name) for r in found.collect()) == [(1, "unvalued"), (2, "unvalued")]
    with pytest.raises(ValueError, match="asks for unknown tables: filings"):
        quality.table_findings([quality.TableCheck("x", ("filings",), lambda f: f)], tables)


def test_a_scorer_is_asked_for_all_windows_at_once(spark):
    prices = spark.createDataFrame([(1,), (2,)], "security_id int")
    dates = spark.createDataFrame([(date(2020, 1, 2),)], "decision_date date")
    asked = []

    def constant(p, d, windows):
        asked.append(windows)
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("lookback"), F.lit(b).alias("skip")) for a, b in windows])).alias("w")
        return p.join(d).select("security_id", "decision_date", each).select("*", "w.*", F.col("security_id").alias("score"))

    strategies = [Strategy("a", "constant", 5, 0), Strategy("b", "constant", 9, 1), Strategy("c", "constant", 5, 0, top_n=1)]
    scorer = scoring.Scorer("constant", ("prices", "dates"), constant)
    rows = scoring.all_scores(spark, prices, prices, dates, strategies, [scorer]).collect()
    assert asked == [[(5, 0), (9, 1)]]
    assert sorted((r.security_id, r.kind, r.score) for r in rows) == [(s, k, float(s)) for s in (1, 2) for k in ("constant_5_0", "constant_9_1")]
    assert {scoring.score_kind(s) for s in strategies} == {r.kind for r in rows}
    with pytest.raises(ValueError, match="no scorer for constant"):
        scoring.all_scores(spark, prices, prices, dates, strategies)
