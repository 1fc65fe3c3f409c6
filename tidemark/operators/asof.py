"""Temporal joins: as-of (strict, inclusive, bounded), interval and period checks.

Three plans, by what is known about the probe side:

* `asof_join` - any probe. Build rows are first reduced to one per (key, day) with a partially
  aggregated max_by, so the window that carries the latest value forward holds at most one build
  row per key and calendar day, however many raw rows a hot key has.
* `asof_within` - few probe dates shared by all keys and a bounded lookback. The dates are
  unrolled into the days they cover, the build side meets them in an equi-join on the day, and one
  partially aggregated max_by per (key, date) finishes the job: no sort and no window.
* `asof_monthly` - one probe date per month shared by all keys, no lookback bound. Build rows are
  reduced to one per (key, month) before anything is carried forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.calendar import month_no


def latest_per_day(
    rows: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """One row per (keys, day): the values of the row that is last by `tie`."""
    payload = F.struct(*values)
    return rows.groupBy(*keys, day).agg(
        (F.max_by(payload, F.struct(*tie)) if tie else F.max(payload)).alias("_payload")
    )


def asof_join(
    probe: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    probe_day: str,
    build_day: str,
    values: Sequence[str],
    inclusive: bool,
    tie: Sequence[str] = (),
    max_age_days: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add to every probe row the build values latest by `build_day`, before (or on) `probe_day`.

    Result: the probe columns, `build_day` and the values (NULL when there is no match, or when the
    match is `max_age_days` or more days old). `unique` states that the build side has one row per
    key and day, which saves the reduction. The probe side is reduced to distinct (keys, day) for
    the window and joined back, so repeated probes of a hot key do not pile up in one task.
    """
    if unique:
        reduced = build.select(*keys, build_day, F.struct(*values).alias("_payload"))
    else:
        reduced = latest_per_day(build, keys, build_day, values, tie)
    day = F.col(build_day)
    stacked = reduced.select(
        *keys, day.alias("_day"), F.lit(0 if inclusive else 1).alias("_side"),
        F.struct(day.alias("_at"), "_payload").alias("_hit"),
    ).unionByName(
        probe.select(*keys, F.col(probe_day).alias("_day")).distinct().select(
            *keys, "_day", F.lit(1 if inclusive else 0).alias("_side")
        ),
        allowMissingColumns=True,
    )
    w = W.partitionBy(*keys).orderBy("_day", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = F.last("_hit", ignorenulls=True)
    found = (
        stacked.withColumn("_hit2", hit.over(w))
        .filter(F.col("_side") == (1 if inclusive else 0))
        .select(*keys, F.col("_day").alias(probe_day), F.col("_hit2").alias("_hit"))
    )
    if max_age_days is not None:
        fresh = F.datediff(F.col(probe_day), F.col("_hit._at")) < max_age_days
        found = found.withColumn("_hit", F.when(fresh, F.col("_hit")))
    out = probe.join(found, [*keys, probe_day], "left")
    return out.select(
        *[F.col(c) for c in probe.columns],
        F.col("_hit._at").alias(build_day),
        *[F.col(f"_hit._payload.{v}").alias(v) for v in values],
    )


def covered_days(dates: DataFrame, date_col: str, lookback: int, inclusive: bool) -> DataFrame:
    """[date_col, _cover]: the days a probe date looks back on. Calendar-sized."""
    d = F.col(date_col)
    newest = d if inclusive else F.date_sub(d, 1)
    oldest = F.date_sub(d, lookback - 1) if inclusive else F.date_sub(d, lookback)
    return dates.select(date_col, F.explode(F.sequence(oldest, newest)).alias("_cover"))


def asof_within(
    build: DataFrame,
    dates: DataFrame,
    keys: Sequence[str],
    build_day: str,
    date_col: str,
    values: Sequence[str],
    lookback: int,
    inclusive: bool,
) -> DataFrame:
    """Per (keys, date): values of the latest build row in the lookback, where there is one.

    inclusive: date - lookback < day <= date. Strict: date - lookback <= day < date. `dates` must be
    calendar-sized; build rows must be unique per (keys, day).
    """
    cover = covered_days(dates.select(date_col).distinct(), date_col, lookback, inclusive)
    joined = build.join(F.broadcast(cover), F.col(build_day) == F.col("_cover"))
    return joined.groupBy(*keys, date_col).agg(
        F.max(build_day).alias(build_day),
        *[F.max_by(v, build_day).alias(v) for v in values],
    )


def asof_monthly(
    grid: DataFrame,
    build: DataFrame,
    months: DataFrame,
    first_month: int,
    keys: Sequence[str],
    date_col: str,
    build_day: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    inclusive: bool = False,
) -> DataFrame:
    """As `asof_join`, for a grid whose dates come one per month from `months`.

    `months` is [month_no, date_col], calendar-sized, starting at `first_month`. Each build row is
    assigned to the first probe date that may see it; one max_by per (keys, probe date) with
    map-side combine follows; only that reduced table, at most one row per key and month, is
    carried forward to later months. `grid` has one row per (keys, date_col).
    """
    steps = months.select("month_no", F.col(date_col).alias("_this")).unionByName(
        # Rows older than the grid belong to its first date: their month is clamped to this one.
        months.filter(F.col("month_no") == first_month).select(
            (F.col("month_no") - 1).alias("month_no"), F.lit(None).cast("date").alias("_this")
        )
    )
    lookup = steps.withColumn("_next", F.lead("_this").over(W.orderBy("month_no")))
    day = F.col(build_day)
    seen = (day <= F.col("_this")) if inclusive else (day < F.col("_this"))
    bucketed = (
        build.withColumn("month_no", F.greatest(month_no(day), F.lit(first_month - 1)))
        .join(F.broadcast(lookup), "month_no")
        .withColumn(date_col, F.when(seen, F.col("_this")).otherwise(F.col("_next")))
        .filter(F.col(date_col).isNotNull())
    )
    hit = F.max_by(F.struct(build_day, *values), F.struct(build_day, *tie))
    reduced = bucketed.groupBy(*keys, date_col).agg(hit.alias("_hit"))
    stacked = reduced.withColumn("_side", F.lit(0)).unionByName(
        grid.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    w = W.partitionBy(*keys).orderBy(date_col, "_side").rowsBetween(W.unboundedPreceding, 0)
    return (
        stacked.withColumn("_got", F.last("_hit", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
        .select(*grid.columns, "_got.*")
    )


def in_effect_monthly(
    records: DataFrame,
    months: DataFrame,
    keys: Sequence[str],
    date_col: str,
    start: str,
    end: str,
    values: Sequence[str],
    latest_by: str,
) -> DataFrame:
    """Per (keys, date): the record whose [start, end] (both included) holds the date.

    Several records in effect: the one latest by `latest_by` wins. Records are unrolled into the
    months they touch and meet the dates in an equi-join on the month; no range join is left.
    """
    touched = records.withColumn(
        "month_no", F.explode(F.sequence(month_no(F.col(start)), month_no(F.col(end))))
    )
    hits = touched.join(F.broadcast(months.select("month_no", date_col)), "month_no").filter(
        F.col(date_col).between(F.col(start), F.col(end))
    )
    return hits.groupBy(*keys, date_col).agg(
        *[F.max_by(v, latest_by).alias(v) for v in values], F.max(latest_by).alias(latest_by)
    )


def in_effect_on(
    records: DataFrame, keys: Sequence[str], on: Column, start: str, end: str, latest_by: str
) -> DataFrame:
    """The records in effect on one date, one per key, latest by `latest_by`."""
    row = F.struct(*records.columns)
    hits = records.filter((F.col(start) <= on) & (F.col(end) >= on))
    return hits.groupBy(*keys).agg(F.max_by(row, F.col(latest_by)).alias("_r")).select("_r.*")


def resolve_period(
    rows: DataFrame,
    periods: DataFrame,
    key: str,
    day: str,
    value: str,
    as_name: str | None = None,
) -> DataFrame:
    """Left interval join: the `value` of the period [valid_from, valid_to) of `key` on `day`.

    Used both ways: ticker -> security and security -> ticker. Periods of one key do not overlap
    (see `overlapping_periods`), so a row meets at most one. The equality on the key carries the
    join; Spark broadcasts the periods when their measured size allows and splits hot keys of
    `rows` otherwise (skew join), a hot key having only its own few periods on the other side.
    """
    name = as_name or value
    p = periods.select(
        F.col(key).alias("_key"), F.col(value).alias(name), F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"),
    )
    hit = (
        (F.col(key) == F.col("_key"))
        & (F.col(day) >= F.col("_from"))
        & (F.col("_to").isNull() | (F.col(day) < F.col("_to")))
    )
    return rows.join(p, hit, "left").drop("_key", "_from", "_to")


def overlapping_periods(periods: DataFrame, key: str) -> DataFrame:
    """Periods that start before an earlier period of the same key has ended.

    The running maximum of the earlier ends (open = far future) also finds an overlap with a period
    that is not the direct predecessor.
    """
    w = W.partitionBy(key).orderBy("valid_from", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    end = F.coalesce(F.col("valid_to"), F.lit("9999-12-31").cast("date"))
    prev_end = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return periods.withColumn("prev_end", prev_end).filter(F.col("valid_from") < F.col("prev_end"))
