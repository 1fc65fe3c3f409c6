"""The view of fills with bounded lateness."""

from datetime import datetime, timedelta

from tidemark.streaming import orders

START = datetime(2024, 1, 1, 12)
SCHEMA = "order_id long, exec_id long, symbol string, side string, quantity decimal(18,2), filled_at timestamp"


def fill(exec_id, day, symbol="A", side="BUY", quantity=1):
    from decimal import Decimal

    return (1, exec_id, symbol, side, Decimal(quantity), None if day is None else START + timedelta(days=day))


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/fills")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/fills")
    orders.count_fills(stream, f"{folder}/view", f"{folder}/state")


def positions(spark, folder):
    return {r.symbol: int(r.quantity) for r in orders.counted_positions(spark, f"{folder}/view").collect()}


def test_copies_count_once_and_late_fills_are_set_aside(spark, tmp_path):
    folder = str(tmp_path)
    deliver(spark, folder, [fill(1, 0), fill(1, 0), fill(2, 5), fill(3, 5, "B", "SELL", 4)])
    assert positions(spark, folder) == {"A": 2, "B": -4}
    # A copy in reach, one on the horizon, one before it, one without a time; symbol B is closed.
    deliver(spark, folder, [fill(2, 5), fill(4, 3), fill(1, 0), fill(5, 2), fill(6, None), fill(7, 6, "B", "BUY", 4)])
    assert positions(spark, folder) == {"A": 3}
    late = spark.read.parquet(f"{folder}/view/late").collect()
    assert sorted((r.exec_id, r.reason, r.batch) for r in late) == [(1, "before the horizon", 1), (5, "before the horizon", 1), (6, "no time", 1)]


def test_a_batch_that_died_between_its_writes_counts_once(spark, tmp_path):
    folder = str(tmp_path)
    deliver(spark, folder, [fill(1, 0), fill(2, 1)])
    deliver(spark, folder, [fill(3, 1), fill(2, 1), fill(4, -9)])
    # The commit of the last batch and all that it wrote after the counted fills are lost: the batch runs again.
    for written in ("state/commits/*1*", "view/changes/batch=1/*", "view/newest/batch=1/*"):
        for lost in tmp_path.glob(written):
            lost.unlink()
    deliver(spark, folder, [fill(5, 2)])
    assert positions(spark, folder) == {"A": 4}
    assert sorted(r.exec_id for r in spark.read.parquet(f"{folder}/view/counted").collect()) == [1, 2, 3, 5]
    assert [r.exec_id for r in spark.read.parquet(f"{folder}/view/late").collect()] == [4]


def test_what_is_read_back_stops_growing(spark, tmp_path):
    folder, read = str(tmp_path), []
    for day in range(9):
        deliver(spark, folder, [fill(10 * day + k, day) for k in range(4)] + [fill(10 * (day - 1) + k, day - 1) for k in range(4) if day])
        horizon = str(START + timedelta(days=day - 2))
        seen = orders.counted_since(spark, f"{folder}/view", horizon, day + 1)
        read.append(sum(int(r.n) for r in seen.groupBy("day").count().withColumnRenamed("count", "n").collect()))
        assert f"PartitionFilters: [isnotnull(day" in seen._jdf.queryExecution().toString()
    assert read == [4, 8, 12, 12, 12, 12, 12, 12, 12]
    assert positions(spark, folder) == {"A": 36}
