from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar


@pytest.fixture(scope="module")
def days(spark):
    return {r["day"]: r for r in calendar.calendar(spark).collect()}


@pytest.mark.parametrize(
    ("day", "name"),
    [
        (date(2000, 4, 21), "Good Friday"),
        (date(2021, 7, 5), "Independence Day"),
        (date(2022, 6, 20), "Juneteenth"),
        (date(2012, 10, 29), "Hurricane Sandy"),
        (date(2023, 1, 2), "New Year's Day"),
        (date(2021, 12, 24), "Christmas Day"),
        (date(1998, 1, 19), "Martin Luther King Jr. Day"),
        (date(2027, 11, 25), "Thanksgiving Day"),
    ],
)
def test_closed(days, day, name):
    assert not days[day]["is_trading"] and days[day]["holiday"] == name


def test_open_days_the_rules_must_not_close(days):
    # A Saturday New Year is not observed; Juneteenth starts in 2022.
    for day in (date(2021, 12, 31), date(2010, 12, 31), date(2021, 6, 18)):
        assert days[day]["is_trading"]


def test_early_closes(days):
    early = {d for d, r in days.items() if r["is_early_close"]}
    assert {date(1999, 12, 31), date(2002, 7, 5), date(2003, 12, 26), date(2024, 11, 29)} <= early
    assert not {date(2002, 7, 3), date(2020, 7, 3), date(2000, 12, 25)} & early


def test_neighbours_and_index(days):
    assert days[date(2001, 9, 17)]["prev_td"] == date(2001, 9, 10)
    assert days[date(2001, 9, 10)]["next_td"] == date(2001, 9, 17)
    a, b = days[date(2020, 1, 31)], days[date(2020, 2, 29)]
    assert b["td_index"] - a["td_index"] == 19
    assert sum(r["is_trading"] for d, r in days.items() if d.year == 2019) == 252


def test_months(spark):
    rows = calendar.screening_dates(spark, date(2019, 12, 1), date(2020, 1, 1)).orderBy("month_no").collect()
    assert [tuple(r[1:]) for r in rows] == [
        (date(2019, 12, 31), date(2020, 1, 2), date(2020, 1, 31)),
        (date(2020, 1, 31), date(2020, 2, 3), date(2020, 2, 28)),
    ]
    assert [r["decision_date"] for r in calendar.decision_dates(spark, date(2020, 1, 1), date(2020, 3, 1)).orderBy("month_no").collect()] == [
        date(2020, 1, 2), date(2020, 2, 3),
    ]


def test_windows(spark):
    one = spark.range(1).select(F.lit(date(2020, 1, 15)).alias("a"), F.lit(date(2020, 3, 2)).alias("b"))
    got = one.select(calendar.month_windows(F.col("a"), F.col("b")).alias("w")).first()["w"]
    assert [(w["start"], w["end"]) for w in got] == [
        (date(2020, 1, 1), date(2020, 1, 31)), (date(2020, 2, 1), date(2020, 2, 29)),
        (date(2020, 3, 1), date(2020, 3, 31)),
    ]
