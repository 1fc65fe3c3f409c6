"""Vectors as short codes: product quantisation by Lloyd's rounds on two trees.

Components become whole numbers and vectors are cut into parts. Blocks of rows keep a tree of boxes for each part position, with the count and
sum of each node, built once and stored. A round walks that tree and a tree over the codebook's entries together: the bounds
between two boxes drop combinations that can hold no nearest entry, a node left with one entry is counted whole by its stored sums, and
what stays uncertain at the leaves is compared point by point in whole numbers. Only sums per entry leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.vectors import finite, floored, matrix
from tidemark.sources.checkpoints import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Values (rows x components) of a block; points of a leaf at most; points of uncertain leaves compared at a time.
BLOCK_VALUES, LEAF, POINTS = 1 << 19, 32, 4096
#: Largest magnitude whose squared distances surely fit 64 bits, for parts of up to 1,024 components.
NARROW = 1 << 25


def _exact(values: np.ndarray, narrow: bool) -> np.ndarray:
    return values.astype(np.int64) if narrow else values.astype(object)


@dataclass
class PointTree:
    """A balanced tree of boxes over points, level by level: node i of a level has the children 2i and 2i + 1 of the next.

    order: the points' rows; starts: where a level's nodes begin; low, high, sums: per level and node.
    """

    order: np.ndarray
    points: np.ndarray
    starts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> PointTree:
        """points: whole numbers, at least one row. Nodes split in the middle of their widest dimension."""
        order, edges, levels = np.arange(len(points)), np.array([0, len(points)]), [np.array([0])]
        while np.diff(edges).max() > leaf:
            middle = (edges[:-1] + edges[1:]) // 2
            for first, mid, last in zip(edges[:-1].tolist(), middle.tolist(), edges[1:].tolist(), strict=True):
                mine = points[order[first:last]]
                widest = int(np.argmax(mine.max(0) - mine.min(0)))
                order[first:last] = order[first:last][np.argpartition(mine[:, widest], mid - first)]
            edges = np.sort(np.concatenate([edges, middle]))
            levels.append(edges[:-1])
        placed = points[order]
        return cls(
            order, placed, levels,
            [np.minimum.reduceat(placed, s) for s in levels], [np.maximum.reduceat(placed, s) for s in levels], [np.add.reduceat(placed, s) for s in levels],
        )

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.starts[level][1:], len(self.order))

    def packed(self) -> bytes:
        """Everything as 64-bit whole numbers in one string of bytes."""
        sums, wide = [s.ravel() for s in self.sums], self.points.dtype == object
        arrays = [self.order, self.points.ravel(), *self.starts, *[a.ravel() for a in (*self.low, *self.high)], *([] if wide else sums)]
        head = np.array([len(self.order), self.points.shape[1], len(self.starts), *map(len, self.starts)], np.int64)
        return b"".join([head.tobytes(), *[a.astype(np.int64).tobytes() for a in arrays]])

    @classmethod
    def unpacked(cls, data: bytes, narrow: bool) -> PointTree:
        values = np.frombuffer(data, np.int64)
        n, width, depth = values[:3].tolist()
        sizes, at = values[3 : 3 + depth].tolist(), 3 + depth

        def take(count: int, columns: int = 0) -> np.ndarray:
            nonlocal at
            found = values[at : at + count * max(columns, 1)]
            at += len(found)
            return _exact(found.reshape(count, columns), narrow) if columns else found

        order, points = take(n), take(n, width)
        starts = [take(m) for m in sizes]
        low, high = [take(m, width) for m in sizes], [take(m, width) for m in sizes]
        # Sums of wide numbers can outgrow 64 bits, so they are added up again.
        sums = [take(m, width) for m in sizes] if narrow else [np.add.reduceat(points, s) for s in starts]
        return cls(order, points, starts, low, high, sums)


@dataclass
class EntryTree:
    """Boxes over a codebook's distinct entries: low, high per node, children (-1 at a leaf) and the entry of a leaf. Node 0 is the root."""

    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    entry: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> EntryTree:
        first: dict[tuple, int] = {}
        for at, e in enumerate(entries.tolist()):
            first.setdefault(tuple(e), at)  # of equal entries the first takes all points
        low, high, children, entry = [], [], [], []

        def add(ids: list[int]) -> int:
            node, mine = len(low), entries[ids]
            low.append(mine.min(0))
            high.append(mine.max(0))
            children.append((-1, -1))
            entry.append(ids[0] if len(ids) == 1 else -1)
            if len(ids) > 1:
                widest = int(np.argmax(high[node] - low[node]))
                ids = sorted(ids, key=lambda i: entries[i][widest])
                children[node] = add(ids[: len(ids) // 2]), add(ids[len(ids) // 2 :])
            return node

        add(sorted(first.values()))
        return cls(np.array(low, entries.dtype), np.array(high, entries.dtype), np.array(children), np.array(entry))


def _squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(-1)


def assigned(tree: PointTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each point in tree order, points per entry, their sums per entry, points whose distances were computed one by one).

    The nearest entry by squared distance in whole numbers, ties to the lower index.
    """
    books = EntryTree.of(entries)
    code = np.zeros(len(tree.order), np.int64)
    counts, sums, single = np.zeros(len(entries), np.int64), np.zeros(entries.shape, entries.dtype), 0
    # Pairs (point node of this level, entry node), ordered by point node.
    nodes, pairs, level = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while len(nodes):
        low, high, ends = tree.low[level], tree.high[level], tree.ends(level)
        while True:
            gap = np.maximum(np.maximum(books.low[pairs] - high[nodes], low[nodes] - books.high[pairs]), 0)
            span = np.maximum(books.high[pairs] - low[nodes], high[nodes] - books.low[pairs])
            nearest, farthest = _squares(gap), _squares(span)
            begins = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
            sizes = np.diff(np.append(begins, len(nodes)))
            # Some entry is at most this far from every point of the node; entries farther from all of them drop out, equal ones stay.
            keep = (nearest <= np.repeat(np.minimum.reduceat(farthest, begins), sizes)).astype(bool)
            nodes, pairs, nearest = nodes[keep], pairs[keep], nearest[keep]
            inner = books.entry[pairs] < 0
            if not inner.any():
                break
            nodes = np.concatenate([nodes[~inner], np.repeat(nodes[inner], 2)])
            pairs = np.concatenate([pairs[~inner], books.children[pairs[inner]].ravel()])
            order = np.argsort(nodes, kind="stable")
            nodes, pairs = nodes[order], pairs[order]
        entry = books.entry[pairs]
        order = np.lexsort((entry, nodes))
        nodes, pairs, entry = nodes[order], pairs[order], entry[order]
        begins = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        sizes = np.diff(np.append(begins, len(nodes)))
        heads = nodes[begins]
        # Equal points are as far from an entry as their box: what is left of them ties, and the lower index wins.
        whole = (sizes == 1) | (high[heads] == low[heads]).all(1)
        for node, e in zip(heads[whole].tolist(), entry[begins[whole]].tolist(), strict=True):
            code[tree.starts[level][node] : ends[node]] = e
            counts[e] += ends[node] - tree.starts[level][node]
            sums[e] += tree.sums[level][node]
        open_ = ~np.repeat(whole, sizes)
        nodes, pairs, entry = nodes[open_], pairs[open_], entry[open_]
        if level + 1 < len(tree.starts):
            # Both children meet what is left of the parent.
            nodes, pairs = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([pairs, pairs])
            order = np.argsort(nodes, kind="stable")
            nodes, pairs, level = nodes[order], pairs[order], level + 1
            continue
        left, row = np.unique(nodes, return_inverse=True)
        possible = np.zeros((len(left), len(entries)), bool)
        possible[row, entry] = True
        sizes = ends[left] - tree.starts[level][left]
        points = np.repeat(tree.starts[level][left] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(left)), sizes)
        for at in range(0, len(points), POINTS):
            chosen, mine = points[at : at + POINTS], possible[owner[at : at + POINTS]]
            away = _squares(tree.points[chosen][:, None, :] - entries[None, :, :])
            code[chosen] = np.where(mine, away, away.max() + 1).argmin(1)
            np.add.at(counts, code[chosen], 1)
            np.add.at(sums, code[chosen], tree.points[chosen])
        single += len(points)
        break
    return code, counts, sums, single


def whole_numbers(components: np.ndarray) -> np.ndarray:
    return floored(components, SCALE)


def stored_blocks(rows: DataFrame, width: int, parts: int, narrow: bool) -> DataFrame:
    """[ids, labels, trees]: blocks of rows with a packed tree for each part position. rows: [vec_id, label, embedding]."""
    label = rows.schema["label"].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("trees", T.ArrayType(T.BinaryType()))]
    )
    most = max(1, BLOCK_VALUES // width)

    def listed(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                x = _exact(whole_numbers(matrix(batch.column(2), width)), narrow)
                trees = [PointTree.of(part).packed() for part in np.split(x, parts, axis=1)]
                yield pa.record_batch([listed(batch.column(0)), listed(batch.column(1)), listed(pa.array(trees, pa.binary()))], ["ids", "labels", "trees"])

    return cut(rows.mapInArrow(run, schema))


def codebook_sums(blocks: DataFrame, books: np.ndarray, narrow: bool) -> DataFrame:
    """[part, entry, at, total]: points of each entry (at -1) and the sums of their components. books: [part, entry, component]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.shape[:2], object)
        sums = np.zeros(books.shape, object)
        for batch in batches:
            for trees in batch.column(0):
                for part, data in enumerate(trees.values):
                    _, n, s, _ = assigned(PointTree.unpacked(data.as_buffer(), narrow), books[part])
                    counts[part] += n
                    sums[part] += s
        total = np.concatenate([counts[:, :, None], sums], axis=2)
        part, entry, at = np.indices(total.shape)
        # In two halves: a task's sum of 64-bit components can outgrow a long.
        values = [int(v) for v in total.ravel()]
        upper, lower = pa.array([v >> 40 for v in values], pa.int64()), pa.array([v & ((1 << 40) - 1) for v in values], pa.int64())
        yield pa.record_batch(
            [pa.array(part.ravel(), pa.int32()), pa.array(entry.ravel(), pa.int32()), pa.array(at.ravel() - 1, pa.int32()), upper, lower],
            ["part", "entry", "at", "upper", "lower"],
        )

    added = blocks.select("trees").mapInArrow(run, "part int, entry int, at int, upper long, lower long")
    wide = "decimal(38,0)"
    total = F.sum(F.col("upper").cast(wide)) * F.lit(1 << 40).cast("decimal(14,0)") + F.sum(F.col("lower").cast(wide))
    return added.groupBy("part", "entry", "at").agg(total.alias("total"))


def moved(books: np.ndarray, totals: list) -> np.ndarray:
    """The entries replaced by floor(sum / count) of their points; those without points stay."""
    out, found = books.copy(), {(part, entry, at): int(total) for part, entry, at, total in totals}
    for part, entry in np.ndindex(books.shape[:2]):
        if count := found.get((part, entry, -1), 0):
            for at in range(books.shape[2]):
                out[part, entry, at] = found[part, entry, at] // count
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def coded(blocks: DataFrame, books: np.ndarray, narrow: bool) -> DataFrame:
    """[vec_id, label, code, error] of stored blocks."""
    label = blocks.schema["labels"].dataType.elementType
    schema = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*map(batch.column, range(3)), strict=True):
                n = len(ids.values)
                codes, errors = np.zeros((n, len(books)), np.uint8), np.zeros(n, object)
                for part, data in enumerate(trees.values):
                    tree = PointTree.unpacked(data.as_buffer(), narrow)
                    code, *_ = assigned(tree, books[part])
                    codes[tree.order, part] = code
                    errors[tree.order] += _squares(tree.points - books[part][code]).astype(object)
                held = pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())
                yield pa.record_batch([ids.values, labels.values, pa.array([row.tobytes() for row in codes], pa.binary()), held], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """([vec_id, label, code, error], codebooks [part, entry, component]): each vector's entries as one byte a part, and its squared error.

    Rows whose vector is null or holds null or non-finite components take no part. Shorter vectors are filled up with zeros to the longest, and that to a
    multiple of the parts. Codebooks begin as the parts of the vectors with the least ids (nulls last, equal ids by vector), fewer where there are
    fewer rows; equal entries stay, the first takes the points. Repeated rows and null ids are coded like others; an error beyond a long is null.
    Scaled components beyond 62 bits count as that limit; beyond 25 bits they are computed as Python's whole numbers. No vectors
    give no rows and empty codebooks. Each round reads the stored blocks and brings parts x entries sums to the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a byte holds 1 to 256 entries")
    rows = finite(vectors, embedding).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    size = rows.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not first:
        schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = -(-max(1, size[0]) // parts) * parts
    narrow = (size[1] or 0.0) * SCALE < NARROW - 1
    start = _exact(whole_numbers(matrix(pa.array([r.embedding for r in first], pa.list_(pa.float64())), width)), narrow)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = stored_blocks(rows, width, parts, narrow)
    for _ in range(rounds):
        books = moved(books, codebook_sums(blocks, books, narrow).collect())
    return coded(blocks, books, narrow), books


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """[vec_id, code, error, label_error, codebooks_sha256]: compress with codes in hex and the errors summed over equal labels.

    Null labels are one label; a sum beyond a long, or with a null error, is null. Other cases as in `compress`.
    """
    rows, books = compress(vectors, vec_id, embedding, label, **options)
    rows = cut(rows)
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.count("error") == F.count("*")
    per = rows.groupBy("label").agg(F.when(whole & (wide < F.lit(str(1 << 63)).cast("decimal(38,0)")), wide).cast("long").alias("label_error"))
    # A row per label, stored: the join has two plain sides, of which Spark can send the small one or split a hot label.
    per = cut(per).withColumnRenamed("label", "_label")
    return rows.join(per, F.expr("label <=> _label")).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
