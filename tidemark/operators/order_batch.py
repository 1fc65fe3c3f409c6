"""Orders judged in sequence per portfolio, in chunks of which each assumes what the earlier ones leave.

An allowed order counts as filled when the next one is checked, so a portfolio is one sequence. It is cut into chunks all the same: each is
judged from an assumed state, and reports what it changes and by how much the assumed sums may be off before one of its
decisions changes. What the chunks before it really change is a running sum of their reports; only chunks for which that is outside the
reported room are judged again, until none is. After n rounds at least the first n chunks of a portfolio are final, and in
general far more, since few decisions are close to a limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.risk import MONEY, first_failure, result_of, rules_of
from tidemark.params import RiskLimits
from tidemark.sources.checkpoints import cut

#: Orders of a chunk, as a power of two.
CHUNK_BITS = 13
#: Amounts are counted in ten-thousandths, the scale of MONEY, and percentages in millionths: whole numbers throughout.
SCALE, PERCENT_SCALE = 10_000, 1_000_000
#: A position of half a cent or less is closed.
CLOSED = SCALE // 200
_OPEN = 1 << 62  # no limit was close

_NEED = ["portfolio", "kind", "name"]
REPORT = (
    "chunk bigint, portfolio bigint, kind string, name string, value bigint, grp string, low bigint, high bigint, was bigint, "
    "was_grp string, order_id bigint, side string, code string"
)


class _Book:
    """A portfolio within a chunk: positions, how sums have moved since its start, and the room of their start values."""

    def __init__(self) -> None:
        self.value: dict[str, int] = {}
        self.group: dict[str, str | None] = {}  # symbol -> sector that counts it, if any
        self.was: dict[tuple[str, str], tuple[int, str | None]] = {}
        self.moved: dict[tuple[str, str], int] = {}
        self.low: dict[tuple[str, str], int] = {}
        self.high: dict[tuple[str, str], int] = {}
        self.place = 0

    def above(self, key: tuple[str, str], amount: int, limit: int) -> bool:
        """The sum and the amount are above the limit; remembers for which start values that stays so."""
        room = limit - self.moved.get(key, 0) - amount
        if self.was.get(key, (0, None))[0] > room:
            self.low[key] = max(self.low.get(key, -_OPEN), room + 1)
            return True
        self.high[key] = min(self.high.get(key, _OPEN), room)
        return False

    def _move(self, kind: str, name: str, change: int) -> None:
        self.moved[kind, name] = self.moved.get((kind, name), 0) + change

    def _put(self, symbol: str, value: int, sector: str | None) -> None:
        old, counted = self.value.pop(symbol, 0), self.group.pop(symbol, None)
        if counted is not None:
            self._move("sector", counted, -old)
        self._move("total", "invested", value - old)
        if value:
            self.value[symbol], self.group[symbol] = value, sector
            if sector is not None:
                self._move("sector", sector, value)

    def trade(self, symbol: str, side: str, amount: int, sector: str | None) -> None:
        change = amount if side == "BUY" else -amount
        left = self.value.get(symbol, 0) + change
        self._put(symbol, left if left > CLOSED else 0, sector)
        self._move("total", "spent", change)
        self._move("total", "traded", amount)


def _judge(o: dict, book: _Book, caps: dict[str, int]) -> str:
    """The first failed check from the position limit on, given what the portfolio holds by now."""
    nav, n = o["nav"], o["notional"]

    def limit(cap: str) -> int:
        return caps[cap] * nav // (100 * PERCENT_SCALE)

    if o["side"] == "BUY":
        stock = o["instrument"] == "stock"
        held = book.value.get(o["symbol"], 0) + n
        if nav > 0 and held > limit("fund" if o["instrument"] == "fund" else "stock"):
            return "POSITION_LIMIT"
        if nav > 0 and stock and o["sector"] and book.above(("sector", o["sector"]), n, limit("sector")):
            return "SECTOR_LIMIT"
        if nav > 0 and book.above(("total", "invested"), n, limit("exposure")):
            return "EXPOSURE_LIMIT"
        if book.above(("total", "spent"), n, o["cash"]):
            return "CASH_INSUFFICIENT"
    if o["ORDER_TOO_LARGE"]:
        return "ORDER_TOO_LARGE"
    if nav > 0 and book.above(("total", "traded"), n, limit("turnover") - o["traded_today"]):
        return "DAILY_TURNOVER_LIMIT"
    if o["BROKER_DISCONNECTED"]:
        return "BROKER_DISCONNECTED"
    return "MANUAL_REVIEW_ORDER_SIZE" if o["MANUAL_REVIEW_ORDER_SIZE"] else "OK"


def judged_chunk(orders: pa.Table, carried: pa.Table, caps: dict[str, int]) -> pa.Table:
    """The orders of a chunk in sequence, given the state that each portfolio brings: a row per order and per sum or position."""
    books: dict[int | None, _Book] = {}
    for portfolio, kind, name, value, group in zip(*(carried.column(c).to_pylist() for c in (*_NEED, "value", "grp")), strict=True):
        book = books.setdefault(portfolio, _Book())
        book.was[kind, name] = value, group
        if kind == "symbol" and value:
            book.value[name], book.group[name] = value, group
    names = [c for c in orders.column_names if c != "chunk"]
    sequence = orders.take(pa.array(np.argsort(orders.column("at").to_numpy(), kind="stable")))
    out: list[tuple] = []
    for values in zip(*(sequence.column(c).to_pylist() for c in names), strict=True):
        o = dict(zip(names, values, strict=True))
        book = books.setdefault(o["portfolio"], _Book())
        code = o["early"] or _judge(o, book, caps)
        book.place += 1
        out.append((o["portfolio"], "order", o["symbol"], book.place, None, None, None, None, None, o["order_id"], o["side"], code))
        if code in ("OK", "MANUAL_REVIEW_ORDER_SIZE"):
            book.trade(o["symbol"], o["side"], o["notional"], o["sector"] if o["instrument"] == "stock" and o["sector"] else None)
    for portfolio, book in books.items():
        for kind, name in book.was.keys() | book.moved.keys():
            was, was_group = book.was.get((kind, name), (0, None))
            if kind == "symbol":
                row = book.value.get(name, 0), book.group.get(name), was, was
            else:
                row = book.moved.get((kind, name), 0), None, book.low.get((kind, name), -_OPEN), book.high.get((kind, name), _OPEN)
            out.append((portfolio, kind, name, *row, was, was_group, None, None, None))
    chunk = (orders if orders.num_rows else carried).column("chunk")[0].as_py()
    columns = list(zip(*out, strict=True)) if out else [()] * 12
    kinds = [pa.int64() if t.endswith("bigint") else pa.string() for t in REPORT.split(", ")]
    fields = [f.split()[0] for f in REPORT.split(", ")]
    arrays = [pa.array([chunk] * len(out), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]]
    return pa.table(dict(zip(fields, arrays, strict=True)))


def opening_state(positions: DataFrame) -> DataFrame:
    """[portfolio, kind, name, value, grp]: what portfolios hold before the batch, by symbol, by sector and in all."""
    amount = (F.sum("market_value").cast(MONEY) * SCALE).cast("bigint")
    held = positions.groupBy("portfolio", "symbol").agg(amount.alias("value"), F.min("instrument").alias("_i"), F.min("sector").alias("_s"))
    held = held.filter("value <> 0").withColumn("grp", F.when((F.col("_i") == "stock") & (F.col("_s") != ""), F.col("_s")))
    none = F.lit(None).cast("string").alias("grp")
    each = held.select("portfolio", F.lit("symbol").alias("kind"), F.col("symbol").alias("name"), "value", "grp")
    sectors = held.filter("grp IS NOT NULL").groupBy("portfolio", F.lit("sector").alias("kind"), F.col("grp").alias("name")).agg(F.sum("value").alias("value"))
    total = held.groupBy("portfolio", F.lit("total").alias("kind"), F.lit("invested").alias("name")).agg(F.sum("value").alias("value"))
    return each.unionByName(sectors.select(*_NEED, "value", none)).unionByName(total.select(*_NEED, "value", none))


def needed(orders: DataFrame) -> DataFrame:
    """[chunk, portfolio, kind, name]: the sums and positions that a chunk's orders look at."""

    def rows(kind: str, name: str, where: str = "true") -> DataFrame:
        return orders.filter(where).select("chunk", "portfolio", F.lit(kind).alias("kind"), F.expr(name).alias("name"))

    totals = rows("total", "explode(array('spent', 'traded', 'invested'))")
    sectors = rows("sector", "sector", "instrument = 'stock' AND sector <> ''")
    return rows("symbol", "symbol", "symbol IS NOT NULL").unionByName(sectors).unionByName(totals).distinct()


def carried_in(reports: DataFrame, opening: DataFrame) -> DataFrame:
    """reports with `now` and `now_grp`: what the chunk really gets from the opening state and the chunks before it."""
    start = opening.select(*_NEED, F.col("value").alias("_v"), F.col("grp").alias("_g"))
    rows = reports.join(start, _NEED, "left")
    line = W.partitionBy(*_NEED).orderBy("chunk")
    symbol, first = F.col("kind") == "symbol", F.lag("value").over(line).isNull()
    moved = F.coalesce(F.sum("value").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    value = F.when(symbol & ~first, F.lag("value").over(line)).when(symbol, F.coalesce("_v", F.lit(0))).otherwise(F.coalesce("_v", F.lit(0)) + moved)
    group = F.when(symbol & ~first, F.lag("grp").over(line)).when(symbol, F.col("_g"))
    return rows.withColumns({"now": value, "now_grp": group}).drop("_v", "_g")


def check_batch(rows: DataFrame, positions: DataFrame, limits: RiskLimits, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Judge each portfolio's orders in sequence: sells first, then by symbol, then by order_id.

    rows: as of `risk.order_facts`. Returns [portfolio, order_id, symbol, side, reason_code, place, result]; place counts a portfolio's
    orders from 1. Orders are range-partitioned in sequence, so a portfolio with very many fills several partitions, and cut
    into chunks of 2 ** chunk_bits. Amounts are whole numbers, so the answer depends on nothing but the orders.
    """
    rules = rules_of(limits)
    before = rules[: next(i for i, r in enumerate(rules) if r[2])]
    after = [r for r in rules[len(before) :] if not r[2]]
    whole = lambda amount: (amount.cast(MONEY) * SCALE).cast("bigint")
    orders = rows.select(
        F.col("portfolio").cast("bigint").alias("portfolio"), F.col("order_id").cast("bigint").alias("order_id"), "symbol", "side",
        F.when(F.col("side") == "SELL", 0).otherwise(1).alias("turn"),
        first_failure(before).alias("early"),
        *[F.coalesce(failed, F.lit(False)).alias(code) for code, failed, _ in after],
        F.coalesce(whole(F.col("notional")), F.lit(0)).alias("notional"), "instrument", "sector",
        *[F.coalesce(whole(F.col(x)), F.lit(0)).alias(x) for x in ("nav", "cash", "traded_today")],
    )
    order = ["portfolio", "turn", "symbol", "order_id", "notional"]
    placed = cut(orders.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumn("chunk", F.shiftright("at", chunk_bits))
    caps = {
        name: round(float(limit) * PERCENT_SCALE)
        for name, limit in (
            ("stock", limits.max_position_pct), ("fund", limits.max_fund_position_pct), ("sector", limits.max_sector_pct),
            ("exposure", limits.max_total_exposure_pct), ("turnover", limits.max_daily_turnover_pct),
        )
    }

    def judged(of: DataFrame, state: DataFrame) -> DataFrame:
        def run(chunk: pa.Table, carried: pa.Table) -> pa.Table:
            return judged_chunk(chunk, carried, caps)

        # Columns of their own: both sides come from the same orders.
        own = state.select(*[F.col(c).alias(c) for c in ("chunk", *_NEED, "value", "grp")])
        return cut(of.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, REPORT))

    opening = cut(opening_state(positions.withColumn("portfolio", F.col("portfolio").cast("bigint"))))
    state = needed(placed).join(opening, _NEED, "left").withColumn("value", F.coalesce("value", F.lit(0)))
    layers = [judged(placed, state)]
    reports = layers[0].filter("kind <> 'order'")
    lasts = layers[0].select("chunk", F.lit(0).alias("round")).distinct()
    while True:
        now = cut(carried_in(reports, opening))
        off = F.when(F.col("kind") == "symbol", (F.col("now") != F.col("was")) | ~F.col("now_grp").eqNullSafe(F.col("was_grp")))
        stale = now.filter(off.otherwise((F.col("now") < F.col("low")) | (F.col("now") > F.col("high")))).select("chunk").distinct()
        stale = cut(stale)
        if stale.isEmpty():
            break
        state = now.join(stale, "chunk", "left_semi").select("chunk", *_NEED, F.col("now").alias("value"), F.col("now_grp").alias("grp"))
        layers.append(judged(placed.join(stale, "chunk", "left_semi"), state))
        kept = reports.join(stale, "chunk", "left_anti")
        reports = cut(kept.unionByName(layers[-1].filter("kind <> 'order'")))
        lasts = cut(lasts.join(stale, "chunk", "left_anti").unionByName(stale.withColumn("round", F.lit(len(layers) - 1))))

    decided = layers[0].filter("kind = 'order'").withColumn("round", F.lit(0))
    for number, layer in enumerate(layers[1:], 1):
        decided = decided.unionByName(layer.filter("kind = 'order'").withColumn("round", F.lit(number)))
    if len(layers) > 1:
        decided = decided.join(lasts, ["chunk", "round"])
    line = W.partitionBy("portfolio").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("portfolio", "chunk").agg(F.count("*").alias("_n"))
    begins = sizes.select(F.col("portfolio").alias("_p"), F.col("chunk").alias("_c"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_begin"))
    return decided.join(begins, F.expr("portfolio <=> _p AND chunk = _c")).select(
        "portfolio", "order_id", F.col("name").alias("symbol"), "side", F.col("code").alias("reason_code"),
        (F.col("_begin") + F.col("value")).alias("place"), result_of(F.col("code")).alias("result"),
    )
