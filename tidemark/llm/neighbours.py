"""Approximate nearest neighbours by largest inner product: several shifted Hilbert orderings.

Vectors are lifted by one coordinate so that the largest inner product becomes the nearest point, projected by a random rotation,
shifted at random, and put on a Hilbert curve: one ordering per rotation. Spark range-partitions the orderings and
numbers their rows. A query is compared with the blocks of rows around its own place in every ordering; what the
orderings find is merged and ranked by the exact inner product.

Equal vectors stand in the orderings once, as candidates and as queries, and only candidates count as places: neither copies of
a vector nor many queries at one place push candidates out of a window.

How far around is not a constant: for a bounded sample of queries the true neighbours are found by brute
force over all rows, and the window is as wide as their distance along the nearest ordering demands for the wanted recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ranks import numbered
from tidemark.llm.vectors import finite, matrix
from tidemark.sources.checkpoints import cut

NEAREST, QUERY_EVERY = 20, 20
ORDERINGS, DIMENSIONS, BITS, SEED = 8, 8, 7, 42
#: Candidates of a block; blocks that neighbouring queries are compared with at a time, and how many such queries.
BLOCK, STRIP, QUERIES = 2048, 8, 2048
#: Queries whose products are held at a time.
PART = 256
#: Recall the window is fitted for, queries it is fitted on, and rows that fix the range of the projections.
RECALL, SAMPLE_QUERIES, SAMPLE_ROWS = 0.96, 128, 5000
#: Copies of a vector are dealt over so many groups before the least ids are taken.
SALTS = 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points [n, dimensions] with `bits` bits a coordinate.

    From the highest bit down, the cube's sub-cube is reflected or turned so that the next one begins where the
    last ended (Skilling 2004); the coordinates' bits, Gray-decoded and interleaved, are the place.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            set_ = (x[i] & high) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << bit)) != 0, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> bit) & 1
    return place


@dataclass
class Curves:
    """Rotations, shifts and ranges of the orderings. `norm`: the largest norm of all vectors."""

    norm: float
    rotations: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    shift: list[np.ndarray]

    @classmethod
    def of(cls, sample: np.ndarray, norm: float, orderings: int = ORDERINGS, seed: int = SEED) -> Curves:
        random = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        p = min(DIMENSIONS, d)
        lifted = lift(sample, norm)
        curves = cls(norm, [], [], [], [])
        for _ in range(orderings):
            rotation = np.linalg.qr(random.normal(size=(d, d)))[0][:, :p]
            low, high = np.quantile(lifted @ rotation, [0.002, 0.998], axis=0)
            curves.rotations.append(rotation)
            curves.low.append(low)
            curves.width.append(np.maximum(high - low, 1e-12))
            curves.shift.append(random.random(p) / 2)
        return curves

    def keys(self, points: np.ndarray, k: int) -> np.ndarray:
        """Keys of lifted points in ordering k: half of the cube is the data's range, the shift moves it about."""
        inside = np.clip((points @ self.rotations[k] - self.low[k]) / self.width[k], 0, 1) / 2 + self.shift[k]
        return hilbert(np.minimum((inside * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Candidates on the sphere of radius `norm`: nearness to a lifted query is the order of inner products."""
    rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
    return np.hstack([vectors, rest[:, None]])


def lift_queries(vectors: np.ndarray, norm: float) -> np.ndarray:
    scaled = vectors * (norm / np.sqrt((vectors**2).sum(1)))[:, None]
    return np.hstack([scaled, np.zeros((len(vectors), 1))])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """[vec_id, embedding]: the rows that take part, each of them, repeated and null ids too."""
    rows = finite(vectors, embedding).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.filter(F.exists("embedding", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """[vid, ids, asks, embedding]: each distinct vector, numbered by its least id, with the `keep` least ids of its rows (nulls
    last) and whether a row of it is a query (`asks`).

    Copies are thinned in salted groups first, so a vector that very many rows share meets in no one task.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for group in (["embedding", "_salt"], ["embedding"]):
        each = Window.partitionBy(*group)
        nth = F.row_number().over(each.orderBy(F.col("vec_id").asc_nulls_last()))
        salted = salted.withColumn("asks", F.max("asks").over(each)).withColumn("_nth", nth).filter(F.col("_nth") <= keep).drop("_nth")
    listed = F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")))
    grouped = salted.groupBy("embedding").agg(F.transform(listed, lambda s: s["vec_id"]).alias("ids"), F.max("asks").alias("asks"))
    return numbered(grouped, F.col("ids")[0].asc_nulls_last(), F.col("embedding"), name="vid").select("vid", "ids", "asks", "embedding")


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` largest scores, ties to the smaller id."""
    if len(scores) > keep:
        least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        among = np.flatnonzero(scores >= least - 1e-12 * max(1.0, abs(least)))
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:keep]]


def _compared(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, keep: int) -> Iterator[tuple]:
    """query id, vector ids and scores of the best `keep` of a block for each query; PART queries at a time."""
    for at in range(0, len(queries), PART):
        products = queries[at : at + PART] @ vectors.T
        for q, row in enumerate(products, at):
            best = _best(ids, row, keep)
            # One fixed way of adding up: a pair has the same score in whichever block it is found.
            yield query_ids[q], ids[best], (queries[q] * vectors[best]).sum(1)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    sizes = [len(ids) for _, ids, _ in rows]
    return pa.record_batch(
        [
            pa.array(np.repeat(np.array([q for q, _, _ in rows], np.int64), sizes)),
            pa.array(np.concatenate([i for _, i, _ in rows]) if rows else np.zeros(0, np.int64)),
            pa.array(np.concatenate([s for _, _, s in rows]) if rows else np.zeros(0)),
        ],
        ["query_id", "vid", "score"],
    )


_FOUND = "query_id long, vid long, score double"


def _top(found: DataFrame, keep: int, then: str | Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), then))
    return found.withColumn("_nth", nth).filter(F.col("_nth") <= keep)


def brute_force(distinct: DataFrame, queries: list, d: int, keep: int) -> DataFrame:
    """[query_id, vid, score]: the nearest distinct vectors of a few queries, over all rows."""
    shared = distinct.sparkSession.sparkContext.broadcast((np.array([q.embedding + [0.0] * (d - len(q.embedding)) for q in queries]), np.array([q.vid for q in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, ids = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _found(list(_compared(points, ids, matrix(batch.column(1), d), batch.column(0).to_numpy(), keep)))

    return _top(distinct.select("vid", "embedding").mapInArrow(run, _FOUND), keep, "vid").drop("_nth")


def orderings(distinct: DataFrame, curves: Curves, d: int) -> DataFrame:
    """[ordering, id, is_query, at, group]: places from 0 in every ordering. `at`: the candidates before the row; `group`: runs of
    QUERIES queries in order, over all orderings (candidates carry one as well, without a meaning)."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vids, asks, points = batch.column(0), batch.column(2), matrix(batch.column(1), d)
            asking = asks.to_numpy(zero_copy_only=False).astype(bool)
            for ids, lifted, is_query in (
                (vids, lift(points, shared.value.norm), False),
                (vids.filter(asks), lift_queries(points[asking], shared.value.norm), True),
            ):
                for k in range(len(shared.value.rotations)):
                    columns = [np.full(len(ids), k, np.int32), shared.value.keys(lifted, k), ids, np.full(len(ids), is_query)]
                    yield pa.record_batch([pa.array(c) for c in columns], ["ordering", "key", "id", "is_query"])

    rows = distinct.select("vid", "embedding", "asks").mapInArrow(keyed, "ordering int, key long, id long, is_query boolean")
    order = [F.col(c) for c in ("ordering", "key", "id", "is_query")]
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    queries = F.sum(F.col("is_query").cast("long"))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), queries.alias("queries")).orderBy("part").collect()  # a row per partition
    begins, candidates, asked = {}, 0, 0
    for r in sizes:
        begins[r.part] = (candidates, asked)
        candidates, asked = candidates + r.n - r.queries, asked + r.queries
    shared_begins = spark.sparkContext.broadcast(begins)
    each = candidates // len(curves.rotations)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            candidates, asked = before or shared_begins.value[batch.column("part")[0].as_py()]
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            asks, all_ = np.cumsum(is_query), np.arange(1, len(is_query) + 1)
            at = candidates + (all_ - asks) - ~is_query
            group = (asked + asks - is_query) // QUERIES
            before = (candidates + int(all_[-1] - asks[-1]), asked + int(asks[-1]))
            at = at - batch.column("ordering").to_numpy().astype(np.int64) * each
            yield pa.record_batch([*(batch.column(c) for c in ("ordering", "id", "is_query")), pa.array(at), pa.array(group)], ["ordering", "id", "is_query", "at", "group"])

    return cut(ordered.mapInArrow(count, "ordering int, id long, is_query boolean, at long, group long"))


def fitted_window(placed: DataFrame, truth: DataFrame, recall: float) -> int:
    """Places around a query that hold, in at least one ordering, the wanted share of the true neighbours."""
    mine = placed.filter("is_query").select("ordering", F.col("id").alias("query_id"), F.col("at").alias("_mine"))
    theirs = placed.filter("NOT is_query").select("ordering", F.col("id").alias("vid"), F.col("at").alias("_theirs"))
    away = truth.join(theirs, "vid").join(mine, ["ordering", "query_id"]).groupBy("query_id", "vid").agg(F.min(F.abs(F.col("_mine") - F.col("_theirs"))).alias("away"))
    return int(np.quantile([r.away for r in away.collect()], recall, method="higher"))  # sample queries x neighbours


def _strips(first: Column, final: Column) -> Column:
    return F.sequence(F.floor(first / STRIP), F.floor(final / STRIP))


def nearest(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    is_query: Column | None = None,
    nearest_: int = NEAREST,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """[query_id, rank, vec_id, score]: for every query row the `nearest_` best other rows found, ties to the smaller id.

    Queries are the rows for which `is_query` holds (default: ids divisible by QUERY_EVERY). Null, zero and empty vectors and vectors
    with null or non-finite components take no part. Every other row does: shorter vectors count as filled up with zeros, a row
    without an id is a candidate (vec_id null, last among ties), and rows that repeat an id are candidates each; a query row leaves out
    itself alone, and an id that several query rows have gets one list for each of them. A query with fewer other rows gets all of them that are
    found (all, if they fit into a block). An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    asks = F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query
    rows = cut(usable(vectors, vec_id, embedding).withColumn("asks", F.coalesce(asks, F.lit(False))))
    keep = nearest_ + 1  # one more: the query's own row is among its nearest
    distinct = cut(distinct_vectors(rows, keep))
    order = [F.xxhash64("vid"), F.col("vid")]
    sample = distinct.filter("asks").orderBy(*order).limit(SAMPLE_QUERIES).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x))
    norm, d = distinct.agg(F.max(length), F.max(F.size("embedding"))).first()
    fixed = [r.embedding for r in distinct.orderBy(*order).limit(SAMPLE_ROWS).select("embedding").collect()]
    placed = orderings(distinct, Curves.of(np.array([v + [0.0] * (d - len(v)) for v in fixed]), norm), d)
    window = fitted_window(placed, brute_force(distinct, sample, d, keep), recall)
    around = -(-window // block)

    # A group of queries meets the blocks from `around` before its first query to `around` behind its last, a strip of blocks at a time.
    queries = placed.filter("is_query")
    at = F.floor(F.col("at") / block)
    reach = queries.groupBy("ordering", "group").agg((F.min(at) - around).alias("first"), (F.max(at) + around).alias("final"))
    covered = reach.select("*", F.explode(_strips(F.col("first"), F.col("final"))).alias("strip"))
    candidates = (
        placed.filter("NOT is_query")
        .select("ordering", at.alias("block"), F.floor(at / STRIP).alias("strip"), F.col("id").alias("vid"))
        .join(covered, ["ordering", "strip"])
        .filter("block BETWEEN first AND final")
        .join(distinct.select("vid", "embedding"), "vid")
        .select("ordering", "strip", "group", "block", F.lit(False).alias("is_query"), F.col("vid").alias("id"), "embedding")
    )
    asking = (
        queries.select("ordering", F.explode(_strips(at - around, at + around)).alias("strip"), "group", at.alias("block"), F.col("id").alias("vid"))
        .join(distinct.select("vid", "embedding"), "vid")
        .select("ordering", "strip", "group", "block", F.lit(True).alias("is_query"), F.col("vid").alias("id"), "embedding")
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        asks, blocks = table.column("is_query").to_numpy(), table.column("block").to_numpy()
        ids, points = table.column("id").to_numpy(), matrix(table.column("embedding"), d)
        query_ids, query_points, query_blocks = ids[asks], points[asks], blocks[asks]
        ids, points, blocks = ids[~asks], points[~asks], blocks[~asks]
        found = []
        for k in range(0, len(query_ids), PART):
            mine = slice(k, k + PART)
            low, high = np.searchsorted(blocks, query_blocks[mine][0] - around), np.searchsorted(blocks, query_blocks[mine][-1] + around, "right")
            if low < high:
                found += _compared(query_points[mine], query_ids[mine], points[low:high], ids[low:high], keep)
        return pa.Table.from_batches([_found(found)])

    met = candidates.unionByName(asking).groupBy("ordering", "strip", "group").applyInArrow(compare, _FOUND)
    merged = met.groupBy("query_id", "vid").agg(F.max("score").alias("score"))
    best = _top(merged, keep, "vid").drop("_nth").join(distinct.select("vid", "ids"), "vid")
    spread = best.select("query_id", "vid", F.explode("ids").alias("vec_id"), "score")
    hit = F.struct(F.col("_nth"), F.col("vec_id"), F.col("score"), (F.col("vid") == F.col("query_id")).alias("same"))
    hits = _top(spread, keep, F.col("vec_id").asc_nulls_last()).groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))

    # The lists of vectors go to the query rows that hold them, where the row itself is taken out.
    vids = distinct.filter("asks").select(F.col("vid").alias("query_id"), "embedding")
    lists = rows.filter("asks").join(vids, "embedding").select("query_id", F.col("vec_id").alias("asked")).join(hits, "query_id")
    own = F.array_min(F.transform(F.filter("hits", lambda h: h["same"] & h["vec_id"].eqNullSafe(F.col("asked"))), lambda h: h["_nth"]))
    others = F.slice(F.filter("hits", lambda h: F.col("own").isNull() | (h["_nth"] != F.col("own"))), 1, nearest_)
    each = lists.withColumn("own", own).select("asked", F.posexplode(others).alias("nth", "hit"))
    return each.select(F.col("asked").alias("query_id"), (F.col("nth") + 1).alias("rank"), "hit.vec_id", "hit.score")
