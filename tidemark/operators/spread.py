"""How many tasks share a table whose rows must meet by key."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

#: Rows that one task sorts at a time.
ROWS = 400_000


def spread(rows: DataFrame, *keys: str, each: int = ROWS) -> DataFrame:
    """rows dealt by `keys` over tasks of about `each` rows, where the session's number of tasks would leave more to one.

    Windows and joins on these keys follow without a shuffle of their own, so what a task holds does not grow with the table. The rows
    are counted first: give a table that is read from files, not a computation.
    """
    tasks = ceil(rows.count() / each)
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(tasks, *keys)
