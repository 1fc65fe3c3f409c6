"""Net value of portfolios: months of costs as piecewise linear maps that compose.

A month's cost depends on the value brought into it, because commissions have a minimum and a cap. Between the kinks of that rule it is
a line, so a month is a map of pieces, and maps of months compose. Bounds of the value are narrowed first, until few orders can
meet a kink; the others are summed into the month's line. Segments of months are composed in tasks of their own, chained by one
value per segment, and folded month by month from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.portfolio import CENT, cost_cases
from tidemark.params import START_NAV, Costs
from tidemark.sources.checkpoints import cut

#: Months that one row holds; rounds that narrow the bounds; relative slack of the bounds.
MONTHS, PASSES, SLACK = 12, 3, 1e-9

MONTH = ["strategy", "decision_date"]
CASE = ["strategy", "slippage", "decision_date"]


def _commission(w: Column, price: Column, costs: Costs) -> Column:
    """Commission per unit of value on the per-share line; an unknown price charges the minimum."""
    return F.coalesce(w / price * float(costs.per_share), F.lit(0.0))


def _kinks(w: Column, price: Column, costs: Costs) -> list[Column]:
    """The values from which an order of weight w is placed, is above the cap, and is charged per share; rising."""
    share = _commission(w, price, costs)
    placed = CENT / w
    uncapped = F.when(share < w * float(costs.max_fraction), F.greatest(placed, F.lit(float(costs.minimum)) / (w * float(costs.max_fraction))))
    by_share = F.when(share > 0, F.greatest(uncapped, F.lit(float(costs.minimum)) / share))
    return [placed, uncapped, by_share]


def _line(w: Column, price: Column, value: Column, costs: Costs) -> Column:
    """Which line an order is on at a value: 0 not placed, 1 capped, 2 minimum, 3 per share."""
    placed, uncapped, by_share = _kinks(w, price, costs)
    return (
        F.when(value < placed, 0)
        .when(uncapped.isNull() | (value < uncapped), 1)
        .when(by_share.isNull() | (value < by_share), 2)
        .otherwise(3)
    )


def _parts(w: Column, price: Column, line: Column, costs: Costs) -> dict[str, Column]:
    """What an order on a line adds: traded weight, commission per unit of value, commission whatever the value."""
    zero = F.lit(0.0)
    return {
        "moved": F.when(line > 0, w).otherwise(zero),
        "rate": F.when(line == 1, w * float(costs.max_fraction)).when(line == 3, _commission(w, price, costs)).otherwise(zero),
        "fixed": F.when(line == 2, float(costs.minimum)).otherwise(zero),
    }


def _ratio(w: Column, price: Column, value: Column, bps: Column, costs: Costs) -> Column:
    """An order's cost as a share of the value. From the value where it is placed on, it never rises."""
    part = _parts(w, price, _line(w, price, value, costs), costs)
    return part["moved"] * bps / 10_000 + part["rate"] + part["fixed"] / value


def _bounded(months: DataFrame, least: Column, most: Column) -> DataFrame:
    """Narrows [lo, hi], the bounds of the value brought into each month, given bounds of each month's cost as a share of it."""
    before = W.partitionBy("strategy", "slippage").orderBy("decision_date").rowsBetween(W.unboundedPreceding, -1)

    def kept(share: Column) -> Column:
        left = F.sum(F.log(F.greatest(1 - share, F.lit(1e-9)))).over(before)
        return F.col("gross") * F.exp(F.coalesce(left, F.lit(0.0)))

    return months.withColumns(
        {"lo": F.greatest("lo", kept(most) * (1 - SLACK)), "hi": F.least("hi", kept(least) * (1 + SLACK))}
    )


def refined(deltas: DataFrame, factors: DataFrame, costs: Costs, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(months, near): a row per strategy, case and month with its summed lines and value bounds, and the orders left single.

    An order is summed where its line is the same over all values the portfolio can have that month. The first bounds hold for all
    cases: at most the gross value, at least that less the highest possible costs so far. Each pass then takes the highest and
    lowest cost of each month within its bounds and sums the orders that have become certain; only what is left is read again,
    and nothing once no order is left.
    """
    w = F.abs("delta")
    top = max(b for _, b in costs.slippage_bps) / 10_000 + float(costs.max_fraction)
    before = W.partitionBy("strategy").orderBy("decision_date").rowsBetween(W.unboundedPreceding, -1)
    traded = deltas.groupBy(*MONTH).agg(F.sum(w).alias("_traded"))
    left = F.sum(F.log(F.greatest(1 - F.coalesce("_traded", F.lit(0.0)) * top, F.lit(1e-9)))).over(before)
    bounds = factors.join(traded, MONTH, "left").select(
        *MONTH, "growth_in", F.col("nav_before").alias("gross"),
        (F.col("nav_before") * F.exp(F.coalesce(left, F.lit(0.0))) * (1 - SLACK)).alias("lo"),
        (F.col("nav_before") * (1 + SLACK)).alias("hi"),
    )
    bounds = cut(bounds)

    def marked(orders: DataFrame) -> DataFrame:
        low, high = (_line(F.col("w"), F.col("price"), F.col(b), costs) for b in ("lo", "hi"))
        return orders.withColumns({"line": F.when(low == high, low)})

    parts = _parts(F.col("w"), F.col("price"), F.col("line"), costs)
    summed = [F.sum(F.when(F.col("line").isNotNull(), part)).alias(f"_{name}") for name, part in parts.items()]

    def added(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
        joined = rows.join(sums, keys, "left")
        total = {name: F.coalesce(name, F.lit(0.0)) + F.coalesce(f"_{name}", F.lit(0.0)) for name in parts}
        return joined.withColumns(total).drop(*[f"_{name}" for name in parts])

    orders = deltas.filter(w > 0).select(*MONTH, w.alias("w"), F.col("unadjusted").alias("price"))
    met = marked(orders.join(bounds.select(*MONTH, "lo", "hi"), MONTH))
    empty = bounds.withColumns({name: F.lit(None).cast("double") for name in parts})
    months = added(empty, met.groupBy(*MONTH).agg(*summed), MONTH)
    months = cut(months.withColumn("_case", F.explode(cost_cases(costs))).select("*", "_case.*").drop("_case"))
    near = met.filter("line IS NULL").withColumn("_case", F.explode(cost_cases(costs)))
    near = cut(near.select("strategy", "_case.slippage", "decision_date", "w", "price"))

    for _ in range(passes):
        if near.isEmpty():
            break
        sure = F.col("moved") * F.col("bps") / 10_000 + F.col("rate")
        order = marked(near.join(months.select(*CASE, "bps", "lo", "hi"), CASE))
        placed = F.greatest(F.col("lo"), CENT / F.col("w"))
        most = F.when(placed <= F.col("hi"), _ratio(F.col("w"), F.col("price"), placed * (1 + SLACK), F.col("bps"), costs)).otherwise(0.0)
        least = F.when(CENT / F.col("w") <= F.col("lo"), _ratio(F.col("w"), F.col("price"), F.col("hi"), F.col("bps"), costs)).otherwise(0.0)
        single = [F.sum(F.when(F.col("line").isNull(), x)).alias(n) for x, n in ((most, "_most"), (least, "_least"))]
        known = added(months, order.groupBy(*CASE).agg(*summed, *single), CASE).na.fill(0.0, ["_most", "_least"])
        near = cut(order.filter("line IS NULL").select(*CASE, "w", "price"))
        months = _bounded(known, sure + F.col("fixed") / F.col("hi") + F.col("_least"), sure + F.col("fixed") / F.col("lo") + F.col("_most") * (1 + SLACK))
        months = cut(months.drop("_most", "_least"))
    return months, near


def month_pieces(months: DataFrame, near: DataFrame, costs: Costs) -> DataFrame:
    """months with `pieces`: array<struct<at, rate, fixed>>, the cost rate * value + fixed from the value `at` on."""
    singles = near.groupBy(*CASE).agg(F.sort_array(F.collect_list(F.struct("w", "price"))).alias("near"))
    none = F.array().cast("array<struct<w:double,price:double>>")
    rows = months.join(singles, CASE, "left").withColumn("near", F.coalesce("near", none))
    kinks = F.flatten(F.transform("near", lambda o: F.array(*_kinks(o["w"], o["price"], costs))))
    inside = F.filter(kinks, lambda k: k.isNotNull() & (k > F.col("lo")) & (k < F.col("hi")))
    rows = rows.withColumn("edges", F.array_sort(F.array_distinct(F.concat(F.array("lo"), inside))))

    def piece(at: Column, i: Column) -> Column:
        # In the middle of a piece no order stands at its kink.
        middle = (at + F.coalesce(F.get("edges", i + 1), F.col("hi"))) / 2

        def total(name: str) -> Column:
            return F.aggregate("near", F.lit(0.0), lambda acc, o: acc + _parts(o["w"], o["price"], _line(o["w"], o["price"], middle, costs), costs)[name])

        rate = (F.col("moved") + total("moved")) * F.col("bps") / 10_000 + F.col("rate") + total("rate")
        return F.struct(at.alias("at"), rate.alias("rate"), (F.col("fixed") + total("fixed")).alias("fixed"))

    return rows.withColumn("pieces", F.transform("edges", piece)).drop("near", "edges")


def _at(pieces: Column, value: Column) -> Column:
    """The piece that holds a value; the first one below them all."""
    held = F.filter(pieces, lambda p: p["at"] <= value)
    return F.coalesce(F.get(held, F.size(held) - 1), F.get(pieces, F.lit(0)))


def composed(steps: Column) -> Column:
    """array<struct<at, a, b>>: the value after a segment is a * start + b from the start value `at` on.

    steps: array<struct<decision_date, growth_in, lo, hi, pieces>> in order. Maps are kept for the start values that the first month's bounds
    allow. A month's cost never grows as fast as the value, so pieces map to pieces in order.
    """
    first = F.get(steps, F.lit(0))
    end = first["hi"] / first["growth_in"]
    start = F.array(F.struct((first["lo"] / first["growth_in"]).alias("at"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")))

    def month(acc: Column, step: Column) -> Column:
        grown, pieces = step["growth_in"], step["pieces"]

        def split(p: Column, i: Column) -> Column:
            until = F.coalesce(F.get(acc, i + 1)["at"], end)
            y0, y1 = ((p["a"] * x + p["b"]) * grown for x in (p["at"], until))
            met = F.filter(
                F.transform(pieces, lambda q, j: F.struct(q.alias("q"), j.alias("j"), F.get(pieces, j + 1)["at"].alias("next"))),
                lambda m: ((m["j"] == 0) | (m["q"]["at"] <= y0) | (m["q"]["at"] < y1)) & (m["next"].isNull() | (m["next"] > y0)),
            )

            def through(m: Column) -> Column:
                q = m["q"]
                kept = (1 - q["rate"]) * grown
                at = F.when((m["j"] == 0) | (q["at"] <= y0), p["at"]).otherwise((q["at"] / grown - p["b"]) / p["a"])
                return F.struct(at.alias("at"), (kept * p["a"]).alias("a"), (kept * p["b"] - q["fixed"]).alias("b"))

            return F.transform(met, through)

        return F.flatten(F.transform(acc, split))

    return F.aggregate(steps, start, month)


def net_nav(deltas: DataFrame, factors: DataFrame, costs: Costs, passes: int = PASSES, months: int = MONTHS) -> DataFrame:
    """[strategy, slippage, decision_date, nav_before, costs, nav_after] with costs taken out.

    deltas: [strategy, decision_date, delta, unadjusted]; factors: [strategy, decision_date, growth_in, nav_before]. A row holds at
    most `months` months of a strategy, or one composed map for each of its segments; orders stand in rows of their own
    until few are left.
    """
    rows = month_pieces(*refined(deltas, factors, costs, passes), costs)
    line = W.partitionBy("strategy", "slippage").orderBy("decision_date")
    rows = rows.withColumn("segment", F.floor((F.row_number().over(line) - 1) / F.lit(months)).cast("int"))
    step = F.struct("decision_date", "growth_in", "lo", "hi", "pieces")
    segments = cut(rows.groupBy("strategy", "slippage", "segment").agg(F.array_sort(F.collect_list(step)).alias("steps")))

    maps = segments.select("strategy", "slippage", F.struct("segment", composed(F.col("steps")).alias("map")).alias("m"))
    chains = maps.groupBy("strategy", "slippage").agg(F.array_sort(F.collect_list("m")).alias("maps"))

    def link(acc: Column, m: Column) -> Column:
        held = _at(m["map"], acc["nav"])
        return F.struct((held["a"] * acc["nav"] + held["b"]).alias("nav"), F.concat(acc["starts"], F.array(acc["nav"])).alias("starts"))

    begin = F.struct(F.lit(float(START_NAV)).alias("nav"), F.array().cast("array<double>").alias("starts"))
    starts = chains.select("strategy", "slippage", F.posexplode(F.aggregate("maps", begin, link, lambda acc: acc["starts"])).alias("segment", "start"))

    def month(acc: Column, s: Column) -> Column:
        before = acc["nav"] * s["growth_in"]
        held = _at(s["pieces"], before)
        cost = before * held["rate"] + held["fixed"]
        row = F.struct(s["decision_date"].alias("decision_date"), before.alias("nav_before"), cost.alias("costs"), (before - cost).alias("nav_after"))
        return F.struct((before - cost).alias("nav"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    shape = "array<struct<decision_date:date,nav_before:double,costs:double,nav_after:double>>"
    zero = F.struct(F.col("start").alias("nav"), F.array().cast(shape).alias("rows"))
    folded = segments.join(starts, ["strategy", "slippage", "segment"]).select(
        "strategy", "slippage", F.explode(F.aggregate("steps", zero, month, lambda acc: acc["rows"])).alias("r")
    )
    return folded.select("strategy", "slippage", "r.*")
