"""Connected components of an edge table, by alternating large-star and small-star rounds with salted hubs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.checkpoints import stored

#: Links of a node that one task may get. More make it a hub, whose links are dealt over several tasks.
HUB = 500
#: A hub has more than 1 / MOST_HUBS of all link ends, so there are fewer hubs than this and their table can be sent to all tasks.
MOST_HUBS = 100_000


def salted(links: DataFrame, keys: Sequence[str], node: str, other: str, least: DataFrame, ends: int) -> DataFrame:
    """links with the columns of `least` (a row per [*keys, node] with `degree`, its links), no task getting all links of a hub.

    The links of a hub are dealt over slots by their other end, and its row of `least` is repeated for each slot. ends: links' ends in
    all; it fixes from which degree on a node is a hub, and so bounds the broadcast table of hubs.
    """
    by, limit = [*keys, node], max(HUB, ends // MOST_HUBS)
    hubs = least.filter(F.col("degree") > limit).select(*by, F.ceil(F.col("degree") / limit).cast("int").alias("_slots"))
    dealt = links.join(F.broadcast(hubs), by, "left").withColumn(
        "_slot", F.when(F.col("_slots").isNotNull(), F.pmod(F.xxhash64(other), "_slots").cast("int")).otherwise(0)
    )
    slots = F.when(F.col("degree") > limit, F.ceil(F.col("degree") / limit).cast("int")).otherwise(1)
    each = least.withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    return dealt.drop("_slots").join(each, [*by, "_slot"]).drop("_slot", "degree")


def _large_star(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours. links: [*keys, high, low]."""
    up = links.select(*keys, F.col("low").alias("node"), F.col("low").alias("near"))
    down = links.select(*keys, F.col("high").alias("node"), F.col("low").alias("near"))
    # Both a node itself (where it is a lower end) and its lower neighbours count; higher neighbours never are the least.
    least = up.unionByName(down).groupBy(*keys, "node").agg(F.min("near").alias("least"), F.count("*").alias("degree"))
    met = salted(links.withColumnRenamed("low", "node"), keys, "node", "high", least, 2 * links.count())
    moved = (F.col("least") < F.col("node")).alias("moved")
    return met.select(*keys, "high", F.col("least").alias("low"), moved).groupBy(*keys, "high", "low").agg(F.max("moved").alias("moved"))


def _small_star(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these. links: [*keys, high, low, moved]."""
    least = links.groupBy(*keys, F.col("high").alias("node")).agg(F.min("low").alias("least"), F.count("*").alias("degree"))
    met = salted(links.withColumnRenamed("high", "node"), keys, "node", "low", least, 2 * links.count())
    inner = met.filter(F.col("low") > F.col("least")).select(*keys, F.col("low").alias("high"), F.col("least").alias("low"), F.lit(True).alias("moved"))
    outer = met.groupBy(*keys, F.col("node").alias("high"), F.col("least").alias("low")).agg(F.max("moved").alias("moved"))
    return inner.unionByName(outer).groupBy(*keys, "high", "low").agg(F.max("moved").alias("moved"))


def connected_components(edges: DataFrame, scope: Sequence[str], a: str, b: str) -> DataFrame:
    """[*scope, node, component]: the smallest node id of each component, per scope value.

    Links are kept as pairs of a higher and a lower node. A round first hangs every node's larger neighbours, then its smaller ones, on
    the least node in sight, until each component is a star around its least node. Least nodes are partially aggregated; the
    joins that hand them out deal a hub's links over several tasks, so neither a star's centre nor a large component's label
    meets in one task. Each half round is stored, so a lost executor costs half a round. Only nodes with an edge appear; loops,
    repeated edges and edges with a null end count for nothing.
    """
    keys = list(scope)
    high, low = F.greatest(a, b).alias("high"), F.least(a, b).alias("low")
    links = stored(edges.filter(F.col(a) != F.col(b)).select(*keys, high, low).distinct())
    while not links.isEmpty():
        larger = stored(_large_star(links, keys))
        step = stored(_small_star(larger, keys))
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    roots = links.select(*keys, F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return links.select(*keys, F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
