"""SimHash near-duplicates found with the general pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits. With thresholds t_i whose
sum of (t_i + 1) is `distance` + 1, two fingerprints that differ in at most `distance` bits differ in at
most t_i bits of some partition i (t_i = -1 leaves a partition out). The thresholds come from a dynamic
programme over estimated costs: rows to probe plus candidates to verify, from counts over all
fingerprints. Probes and index rows meet in an equality join; every candidate is verified.

Texts of Jaccard similarity 0.8 differ in about 15 of 100 bits, too many for thresholds on 64 of them. For these there are wide
fingerprints, whose parts must agree entirely: their number is planned from the chance that similar texts agree in none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, comb, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import unused
from tidemark.llm.texts import LOWER_AZ, mix, signed, utf8
from tidemark.operators.graph import connected_components
from tidemark.sources.checkpoints import cut

BITS = 64
SEED = 42
#: Words of a shingle, and fingerprint bits in which linked documents may differ.
SHINGLE_WORDS, DISTANCE = 4, 4
#: Members of a bucket that one task compares at once; larger buckets are cut into blocks of this size.
BLOCK = 1024
#: Cost of verifying a candidate, where writing one probe row costs 1.
VERIFY_COST = 0.05


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: a bit is 1 if it is 1 in over half of the shingles' hashes; 0 without words."""
    words = text.translate(LOWER_AZ).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = n - shingle_words + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, last, 65_536):
        to = min(last, at + 65_536)
        spans = zip(starts[at:to].tolist(), ends[at + shingle_words - 1 : to + shingle_words - 1].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """[doc_id, fp]: one row per input row. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle_words) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(signed(fps))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- plan: partitions and thresholds ------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Bits that are compared together; `threshold` of them may differ."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how often both are 1. 4,096 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())
            both += bits.T @ bits
        yield pa.record_batch([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(both.ravel().astype(np.int64))], ["cell", "n"])

    cells = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in cells.collect():
        both[row.cell] = row.n
    return distinct.count(), both.reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(packed, axis=1, bitorder="little").astype(np.float64)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """All bits in `parts` groups of nearly equal width; each group takes the bits most correlated with it."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    strength = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        free = sorted(left)
        first = free[int(np.argmax(strength[np.ix_(free, free)].max(1)))]
        group = [first]
        left.remove(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: strength[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(tuple(sorted(group)))
    return groups


def collisions(distinct: DataFrame, groupings: list[list[tuple[int, ...]]]) -> dict[tuple[int, ...], float]:
    """For each group of bits, the pairs of fingerprints that agree in all of them, counted over all rows."""
    groups = sorted({g for grouping in groupings for g in grouping})
    masks = [_signed(Part(g, 0).mask) for g in groups]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    sizes = distinct.select(keys.alias("k")).groupBy("k.g", "k.key").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("g").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    found = {row.g: row.pairs for row in pairs.collect()}
    return {g: found.get(i, 0.0) for i, g in enumerate(groups)}


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def within(mismatch: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of independent bits differ), t = 0..most, from each bit's chance to differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for p in mismatch:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.cumsum(chance)


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1 = leave out) with sum of (t + 1) = distance + 1 and the least total cost.

    costs[i][t] is the cost of threshold t in partition i. Dynamic programme over partitions and the
    units given out so far.
    """
    best: list[tuple[float, list[int]] | None] = [None] * (distance + 2)
    best[0] = (0.0, [])
    for cost in costs:
        after: list[tuple[float, list[int]] | None] = [None] * (distance + 2)
        for spent, known in enumerate(best):
            if known is None:
                continue
            for t in range(-1, distance - spent + 1):
                total = known[0] + (cost[t] if t >= 0 else 0.0)
                held = after[spent + t + 1]
                if held is None or total < held[0]:
                    after[spent + t + 1] = (total, [*known[1], t])
        best = after
    assert best[distance + 1] is not None
    return best[distance + 1]


def plan_parts(distinct: DataFrame, distance: int = DISTANCE) -> list[Part]:
    """The cheapest partitions and thresholds for these fingerprints, over 2 to distance + 1 partitions."""
    n, both = bit_counts(distinct)
    groupings = [correlated_groups(n, both, parts) for parts in range(2, distance + 2)]
    agree = collisions(distinct, groupings)
    mean = np.diag(both) / max(n, 1)
    mismatch = 2 * mean * (1 - mean)
    plans = []
    for groups in groupings:
        costs = []
        for g in groups:
            chance = within(mismatch[list(g)], distance)
            seen = max(agree[g], n * (n - 1) / 2 * chance[0])
            probes = np.cumsum([comb(len(g), t) for t in range(distance + 1)])
            costs.append([n * (1 + probes[t] / 2) + VERIFY_COST * seen * chance[t] / max(chance[0], 1e-300) for t in range(distance + 1)])
        total, thresholds = allocate(costs, distance)
        plans.append((total, [Part(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


# --- probe and verify ---------------------------------------------------------------------------


def probe_rows(distinct: DataFrame, parts: list[Part]) -> DataFrame:
    """[part, key, fp, probe]: each fingerprint under its own key in every partition (probe false), and
    under the keys within the partition's threshold (probe true).

    Of two fingerprints that differ, only the one with a 0 at the lowest differing bit probes: each
    pair meets once, and half of the probes suffice.
    """
    flips = {
        i: [(sum(1 << b for b in chosen), 1 << min(chosen)) for t in range(1, p.threshold + 1) for chosen in itertools.combinations(p.bits, t)]
        for i, p in enumerate(parts)
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part, keys, fps, probe):
            n = len(fps)
            return pa.record_batch(
                [pa.array(np.full(n, part, np.int8)), pa.array(signed(keys)), pa.array(signed(fps)), pa.array(np.full(n, probe))],
                ["part", "key", "fp", "probe"],
            )

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i, p in enumerate(parts):
                mask = np.uint64(p.mask)
                yield rows(i, fps & mask, fps, False)
                for flip, lowest in flips[i]:
                    own = fps[(fps & np.uint64(lowest)) == 0]
                    if len(own):
                        yield rows(i, (own ^ np.uint64(flip)) & mask, own, True)

    return distinct.select("fp").mapInArrow(run, "part byte, key long, fp long, probe boolean")


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> np.ndarray:
    """Links between two blocks (or within one: right None) that join whatever all their links join.

    Every pair of the blocks is compared; at most one link per member is returned.
    """
    near = np.bitwise_count(left[:, None] ^ (left if right is None else right)[None, :]) <= distance
    if right is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    ends = np.stack([left[i], (left if right is None else right)[j]], axis=1)
    return ends if len(ends) <= len(left) else spanning(ends)


def spanning(ends: np.ndarray) -> np.ndarray:
    """Links [n, 2] of which at most one per node is kept, joining whatever all of them join."""
    nodes, place = np.unique(ends.ravel(), return_inverse=True)
    a, b = place.reshape(-1, 2).T
    label, kept = np.arange(len(nodes)), [ends[:0]]
    while len(a):  # each round hooks every label to its least neighbour, then follows the hooks
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        if not len(a):
            break
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        kept.append(np.stack([nodes[a[first]], nodes[b[first]]], axis=1))
        hook = np.arange(len(nodes))
        hook[high[first]] = low[first]
        while (hook != hook[hook]).any():
            hook = hook[hook]
        label = hook[label]
    return np.concatenate(kept)


def links(distinct: DataFrame, parts: list[Part], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """[a, b]: verified pairs of fingerprints that connect exactly what all pairs within `distance` connect.

    A bucket (partition, key) with more than `block` members is cut into blocks that are compared two by
    two, each in its own row, so no task holds a whole bucket and no list of all its pairs is written.
    """
    rows = probe_rows(distinct, parts)
    keys = ["part", "key"]
    sizes = rows.groupBy(*keys).agg(F.count_if(~F.col("probe")).alias("indexed"), F.count_if("probe").alias("probing"))
    live = sizes.filter("indexed > 0 AND indexed + probing > 1")
    members = F.when(F.col("probe"), F.col("probing")).otherwise(F.col("indexed"))
    blocks = (
        rows.join(live, keys)
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(members / F.lit(block))).cast("int"))
        .groupBy(*keys, "probe", "block")
        .agg(F.collect_list("fp").alias("fps"))
    )
    index = blocks.filter("NOT probe").select(*keys, F.col("block").alias("at"), F.col("fps").alias("indexed"))
    met = index.join(blocks, keys).filter("probe OR at <= block")
    checked = met.select("indexed", "fps", (~F.col("probe") & (F.col("at") == F.col("block"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right, own in zip(*map(_views, (batch.column(0), batch.column(1))), batch.column(2).to_pylist(), strict=True):
                if own and len(left) < 2:
                    continue
                got = forest(left, None if own else right, distance)
                if len(got):
                    found.append(got)
            if found:
                ends = np.concatenate(found)
                yield pa.record_batch([pa.array(signed(ends[:, k].copy())) for k in (0, 1)], ["a", "b"])

    return checked.mapInArrow(run, "a long, b long").distinct()


def _views(column: pa.Array) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    at = np.r_[0, np.cumsum(np.asarray(column.value_lengths()))]
    return (flat[a:b] for a, b in itertools.pairwise(at.tolist()))


# --- wide fingerprints --------------------------------------------------------------------------


@dataclass(frozen=True)
class Wide:
    """Fingerprints of `check` bits and `parts` parts of `width` bits; `distance` of the check bits may differ."""

    width: int
    parts: int
    check: int
    distance: int

    @property
    def words(self) -> int:
        return -(-(self.check + self.parts * self.width) // BITS)


def plan_wide(rows: int, similarity: float, check: int = 128, miss: float = 1e-4) -> Wide:
    """Parts of which two sets of this Jaccard similarity miss all with a chance of at most `miss`, and the same for the check bits.

    A bit differs with a chance of (angle of the sets) / pi, which is greatest for sets of equal size. A part grows with the number of rows,
    so that about 2 ** 8 unrelated rows share it; the number of parts then grows as about the fourth root of the rows.
    """
    differ = acos(2 * similarity / (1 + similarity)) / pi
    width = min(24, max(8, ceil(log2(max(rows, 1))) - 8))
    parts = ceil(log(miss) / log1p(-((1 - differ) ** width)))
    return Wide(width, parts, check, int(np.searchsorted(within(np.full(check, differ), check), 1 - miss)))


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """SimHash of `words` * 64 bits from the hashes of a text's shingles: a bit is 1 if it is 1 in over half of them."""
    counts = np.zeros(words * BITS, np.int64)
    salts = _salts(words)
    for at in range(0, len(hashes), 255):  # so many fit into a byte
        mixed = mix(hashes[at : at + 255, None] ^ salts)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


@lru_cache
def _salts(words: int) -> np.ndarray:
    return mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def wide_keys(prints: list[bytes], wide: Wide) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint the check bits as 64-bit words, and the value of every part."""
    flat = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), wide.words * 8)
    bits = np.unpackbits(flat, axis=1, bitorder="little")[:, wide.check : wide.check + wide.parts * wide.width]
    values = bits.reshape(-1, wide.parts, wide.width) @ (np.int32(1) << np.arange(wide.width, dtype=np.int32))
    return np.ascontiguousarray(flat[:, : wide.check // 8]).view(np.uint64), values


# --- groups -------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """[doc_id, fp, component_id]: one row per input row with its SimHash and its group.

    component_id is the least doc_id reachable over links (fingerprints that differ in at most
    `distance` bits), the row's own included. Copies share a fingerprint and meet as one, so a group of
    copies is never compared with itself. Null or wordless texts have fingerprint 0 and link like others.
    Rows with a null doc_id keep their row; they count in links, never as the least id (null if there is
    no other). Repeated rows stay repeated. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, doc_id, text, shingle_words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if distinct.isEmpty():
        return marked.withColumn("component_id", F.lit(None).cast("long"))
    near = cut(links(distinct, plan_parts(distinct, distance), distance))
    groups = connected_components(near, [], "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("_group"))
    named = distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("_group", "fp").alias("_group"))
    least = named.groupBy("_group").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "_group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group: the row whose id is the group's least; its columns are unchanged.

    Rows that repeat an id with texts of one fingerprint are one document, of which one row stays. Rows
    without an id all stay.
    """
    groups = near_duplicates(docs, doc_id, text, distance, shingle_words).filter("doc_id <> component_id")
    id_, fp_ = unused(docs, "_id", "_fp")
    gone = groups.select(F.col("doc_id").alias(id_), F.col("fp").alias(fp_)).distinct()

    @F.pandas_udf("long")
    def marked(texts):
        import pandas as pd

        fps = np.fromiter((fingerprint((t or "").encode(), shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(signed(fps))

    named = docs.filter(F.col(doc_id).isNotNull()).withColumn(id_, F.col(doc_id).cast("long")).withColumn(fp_, marked(F.col(text)))
    kept = named.join(gone, [id_, fp_], "left_anti").dropDuplicates([id_, fp_])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))
