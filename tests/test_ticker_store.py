"""The stored ticker history against a full rewrite."""

import random
from datetime import date, timedelta

from tidemark.operators.securities import ticker_history
from tidemark.sources.ticker_store import apply_ticker_events, stored_history

SCHEMA = "security_id long, kind string, ticker string, effective date"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_batches_give_the_full_history_and_leave_other_parts_alone(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path)
    start = date(2020, 1, 1)
    first = [(s, "open", f"T{s}", start) for s in range(60)] + [(s, "change", f"U{s}", start + timedelta(days=rng.randrange(1, 300))) for s in range(0, 60, 2)]
    second = [(7, "change", "NEW", date(2021, 5, 1)), (8, "close", None, date(2021, 6, 1)), (8, "change", "U8", date(2021, 1, 1)), (99, "change", "X", start), (None, "open", "N", start), (9, "open", None, None)]
    assert len(apply_ticker_events(spark.createDataFrame(first, SCHEMA), folder, 0, 16)) > 8
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("history/*/*.parquet")}
    touched = apply_ticker_events(spark.createDataFrame(second, SCHEMA), folder, 1, 16)
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("history/*/*.parquet")}
    assert 0 < len(touched) <= 3
    kept = {p for p in before if int(p.parent.name.split("=")[1]) not in touched}
    assert len(kept) > 5 and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in set(before) - kept)
    whole = spark.createDataFrame(first + second[:4], SCHEMA)
    want = rows(ticker_history(whole))
    assert rows(stored_history(spark, folder)) == want
    # Applied again, with its rows repeated: nothing changes.
    assert apply_ticker_events(spark.createDataFrame(second + second, SCHEMA), folder, 1, 16) == touched
    assert rows(stored_history(spark, folder)) == want
    assert apply_ticker_events(spark.createDataFrame([], SCHEMA), folder, 2, 16) == []
    # A later batch corrects an event: its ticker counts.
    apply_ticker_events(spark.createDataFrame([(7, "change", "OTHER", date(2021, 5, 1))], SCHEMA), folder, 3, 16)
    assert [r.ticker for r in stored_history(spark, folder).filter("security_id = 7").orderBy("valid_from").collect()] == ["T7", "OTHER"]
