"""Whitening of embeddings from exact whole-number moments, by bit-sliced counting.

Entries become whole numbers, shifted by the least of their dimension. The bits of a dimension over many rows are packed into
64-bit words, one plane per bit. The bits that two planes share, counted by AND and popcount and weighted by their powers of two, add up to the
exact sum of products of two dimensions, so nothing is lost however far the entries are from zero. Sums are centred as whole
numbers; only then doubles and the eigenvectors of the covariance follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import finite, floored, matrix

#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Words of bit planes that are held against one plane at a time.
AND_WORDS = 1 << 20
#: An eigenvalue below this share of the largest is no variance.
NO_VARIANCE = 1e-12
_LIMB = 1 << 60


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    return floored(entries, SCALE) + OFFSET


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """[planes, words]: for each dimension its bits, lowest first, packed over the rows of y (unsigned)."""
    words = -(-len(y) // 64)
    out = np.zeros((sum(bits), words * 8), np.uint8)
    at = 0
    for d, n in enumerate(bits):
        for bit in range(n):
            packed = np.packbits((y[:, d] >> np.uint64(bit)).astype(np.uint8) & 1)
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def counted(packed: np.ndarray) -> np.ndarray:
    """[planes, planes]: bits shared by two planes, in the upper triangle; a plane's own bits on the diagonal."""
    n, words = packed.shape
    out = np.zeros((n, n), np.int64)
    step = max(1, AND_WORDS // max(1, words))
    for p in range(n):
        for q in range(p, n, step):
            out[p, q : q + step] = np.bitwise_count(packed[p] & packed[q : q + step]).sum(1, dtype=np.int64)
    return out


class Scatter:
    """Sums and sums of products of whole numbers, exact, from bit planes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rows: int):
        self.low = low
        self.bits = [int(h - l).bit_length() for l, h in zip(low.tolist(), high.tolist(), strict=True)]
        d, wide = len(self.bits), 2 * max(self.bits, default=0) + int(rows).bit_length()
        self.kind = np.int64 if wide < 63 else object  # 64 bits where every sum surely fits, else Python's own whole numbers
        self.sums, self.products = np.zeros(d, self.kind), np.zeros((d, d), self.kind)
        self.held = np.array([d for d, n in enumerate(self.bits) if n], int)
        self.begins = np.concatenate([[0], np.cumsum([n for n in self.bits if n])]).astype(int)[:-1]
        self.weights = np.array([1 << bit for n in self.bits for bit in range(n)], self.kind)

    def shifted(self, x: np.ndarray) -> np.ndarray:
        return x.view(np.uint64) - self.low.view(np.uint64)

    def add(self, x: np.ndarray) -> None:
        if not len(self.held):
            return
        shared = counted(planes(self.shifted(x), self.bits)).astype(self.kind)
        weighted = shared * self.weights * self.weights[:, None]
        by_dimension = np.add.reduceat(np.add.reduceat(weighted, self.begins, axis=0), self.begins, axis=1)
        own = np.add.reduceat(np.diag(shared) * self.weights, self.begins)
        squares = np.add.reduceat(np.diag(weighted), self.begins)
        upper = np.triu(by_dimension, 1) if self.kind is not object else by_dimension * np.triu(np.ones(by_dimension.shape, int), 1)
        # Within a dimension the triangle holds each pair of different planes once; the square has it twice.
        within = np.diag(by_dimension)
        block = upper + np.diag(2 * within - squares)
        self.products[np.ix_(self.held, self.held)] += block
        self.sums[self.held] += own


def _limbs(values: list[int]) -> tuple[pa.Array, pa.Array]:
    kind = pa.decimal128(38, 0)
    return pa.array([v // _LIMB for v in values], pa.int64()).cast(kind), pa.array([v % _LIMB for v in values], pa.int64()).cast(kind)


@dataclass
class Whitening:
    """n vectors of `width` entries; least entries and sums of the shifted entries per dimension; covariance, its eigenvalues (falling) and
    eigenvectors (columns); projections: columns that whiten, zero where there is no variance."""

    n: int
    low: np.ndarray
    high: np.ndarray
    sums: list[int]
    products: list[list[int]]

    def __post_init__(self) -> None:
        n, s, d = self.n, self.sums, len(self.sums)
        self.centred = [[n * self.products[min(j, k)][max(j, k)] - s[j] * s[k] for k in range(d)] for j in range(d)]
        # One correctly rounded division of whole numbers for each entry.
        self.covariance = np.array([[v / (n * n) for v in row] for row in self.centred]).reshape(d, d)
        values, vectors = np.linalg.eigh(self.covariance)
        self.eigenvalues, self.eigenvectors = values[::-1], vectors[:, ::-1]
        self.trace = sum(self.centred[j][j] for j in range(d)) / (n * n)
        self.varies = self.eigenvalues > NO_VARIANCE * max(self.eigenvalues.max(initial=0.0), 0.0)
        self.projections = np.where(self.varies, self.eigenvectors / np.sqrt(np.where(self.varies, self.eigenvalues, 1.0)), 0.0)

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float | None]:
        return [max(float(e), 0.0) / self.trace if self.trace > 0 else None for e in self.eigenvalues]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where it fits, else Python's whole numbers. The shift by the least entry drops out."""
        most = max([self.n * int(h - l) for l, h in zip(self.low.tolist(), self.high.tolist(), strict=True)], default=0)
        y = x.view(np.uint64) - self.low.view(np.uint64)
        if most < 1 << 62:
            return y.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, offsets: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; None where one doesn't fit a long."""
        most = int(np.abs(offsets).max(initial=0)) if offsets.dtype != object else None
        if most is not None and most * most * max(1, self.width) < 1 << 63:
            return (offsets * offsets).sum(1).tolist()
        totals = (offsets.astype(object) ** 2).sum(1) if self.width else np.zeros(len(offsets), object)
        return [int(t) if t < 1 << 63 else None for t in totals]

    def whitened(self, offsets: np.ndarray, components: int) -> np.ndarray:
        return (offsets / self.n).astype(np.float64) @ self.projections[:, :components]

    def transform(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
        """[vec_id, deviation, whitened]: array<double> of the first components, null entries where a component has no variance."""
        model, kept = self, min(components, self.width)
        varies = np.broadcast_to(self.varies[:kept], (1, kept))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets = model.offsets(whole_numbers(matrix(batch.column(1), model.width)))
                values = model.whitened(offsets, kept)
                flat = pa.array(values.ravel(), mask=~np.repeat(varies, len(values), axis=0).ravel())
                places = pa.array(np.arange(0, len(values) * kept + 1, max(kept, 1)) if kept else np.zeros(len(values) + 1, int), pa.int32())
                yield pa.record_batch(
                    [batch.column(0), pa.array(model.deviations(offsets), pa.int64()), pa.ListArray.from_arrays(places, flat)],
                    ["vec_id", "deviation", "whitened"],
                )

        rows = finite(vectors, embedding).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def fit(vectors: DataFrame, embedding: str = "embedding") -> Whitening | None:
    """The whitening of all vectors; None if there are none.

    Rows whose vector is null or holds null or non-finite entries take no part; shorter vectors are filled up with zeros to the longest;
    repeated rows count as often as they are there. Entries whose scaled value doesn't fit 62 bits count as the limit.
    Two passes over the table: least and greatest entry of each dimension, then the bit planes. A task keeps one matrix and sends one
    row per pair of dimensions; Spark adds them up, and dimensions squared / 2 rows reach the driver.
    """
    rows = finite(vectors, embedding).select(F.col(embedding).cast("array<double>").alias("embedding"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            width = max(int(sizes.max(initial=0)), len(low))
            x = whole_numbers(matrix(column, width))
            inside = np.arange(width) < sizes[:, None]
            grow = (0, width - len(low))
            low = np.pad(low, grow, constant_values=np.iinfo(np.int64).max)
            high = np.pad(high, grow, constant_values=np.iinfo(np.int64).min)
            low = np.minimum(low, np.where(inside, x, np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
            high = np.maximum(high, np.where(inside, x, np.iinfo(np.int64).min).max(0, initial=np.iinfo(np.int64).min))
            held, n = np.pad(held, grow) + inside.sum(0), n + len(sizes)
        # Dimension -1 counts the rows.
        yield pa.record_batch(
            [pa.array(np.arange(-1, len(low))), pa.array(np.append(0, low)), pa.array(np.append(0, high)), pa.array(np.append(n, held))],
            ["d", "low", "high", "held"],
        )

    found = rows.mapInArrow(ranges, "d long, low long, high long, held long").groupBy("d").agg(F.min("low"), F.max("high"), F.sum("held")).collect()
    if not found or not (n := max((held for d, _, _, held in found if d < 0), default=0)):
        return None
    dims = sorted((tuple(r) for r in found if r[0] >= 0 and r[3]), key=lambda r: r[0])
    low = np.array([min(l, OFFSET) if held < n else l for _, l, _, held in dims], np.int64)
    high = np.array([max(h, OFFSET) if held < n else h for _, _, h, held in dims], np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(low, high, n)
        for batch in batches:
            total.add(whole_numbers(matrix(batch.column(0), len(low))))
        js, ks = np.triu_indices(len(low))
        values = [int(v) for v in total.products[js, ks]] + [int(v) for v in total.sums]
        left, right = np.append(js, np.arange(len(low))), np.append(ks, np.full(len(low), -1))
        upper, lower = _limbs(values)
        yield pa.record_batch([pa.array(left, pa.int32()), pa.array(right, pa.int32()), upper, lower], ["j", "k", "upper", "lower"])

    added = rows.mapInArrow(scatter, "j int, k int, upper decimal(38,0), lower decimal(38,0)").groupBy("j", "k").agg(F.sum("upper"), F.sum("lower"))
    sums, products = [0] * len(low), [[0] * len(low) for _ in low]
    for j, k, upper, lower in added.collect():
        value = int(upper) * _LIMB + int(lower)
        if k < 0:
            sums[j] = value
        else:
            products[j][k] = value
    return Whitening(n, low, high, sums, products)


def identity_error(whitened: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), over the components that vary; 0 if none does.

    Whitened rows are already centred on the exact mean; what is left of their mean is taken out as well.
    """
    kept = np.flatnonzero(model.varies[: min(components, model.width)])
    if not len(kept):
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kept) + 1, len(kept)))
        for batch in batches:
            w = np.nan_to_num(matrix(batch.column(0), min(components, model.width)))[:, kept]
            total += np.vstack([w.T @ w, w.sum(0)])
        i, k = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "k", "total"])

    rows = whitened.select("whitened").mapInArrow(moments, "i int, k int, total double").groupBy("i", "k").agg(F.sum("total")).collect()
    total = np.zeros((len(kept) + 1, len(kept)))
    for i, k, value in rows:
        total[i, k] = value / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(kept))).max())


def components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """[vec_id, component, n, deviation, whitened, explained, identity_error]: a row for each vector and component up to `most`.

    Vectors as in `fit`; null and repeated vec_ids keep their rows. A component without variance (an eigenvalue below NO_VARIANCE of the
    largest, as with fewer vectors than dimensions) has null `whitened` values and takes no part in identity_error; without any
    variance `explained` is null. A deviation beyond a long is null. No vectors, or only empty ones, give no rows.
    """
    model = fit(vectors, embedding)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = model.transform(vectors, vec_id, embedding, most)
    error = identity_error(rows, model, most)
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained[:most]]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
