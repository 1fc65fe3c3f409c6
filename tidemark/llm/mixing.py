"""Mixing sources to target weights by systematic sampling.

A source that is to give `target` of its `size` words takes every document target / size times on average. Along the
source's documents, ordered by size, these expected copies are summed from one random start, and a document is taken
once for each whole number its step crosses. The sum is a product (place in the source x copies per document),
so it needs places only, no running total; ordered by size, what a source takes differs from its target by
less than about its largest document.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import unused
from tidemark.llm.ranks import numbered
from tidemark.sources.checkpoints import cut

#: Weights of the sources in their order, repeating; the words of the mix as a share of all words; copies at most.
WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), Fraction(3, 2), 2, 42


def size(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """[source, source_size, target]: sizes [source, size] shared among sources by weight.

    No source gets more than `most` times its size; what it can't take is shared among the rest by weight, until none is above.
    Each round sends one row of exact sums to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(totals, F.col("source").asc_nulls_last(), name="_rank")
    weight = F.array(*map(F.lit, weights))[F.pmod("_rank", F.lit(len(weights))).cast("int")]
    sources = cut(ordered.withColumn("weight", weight.cast("long")))

    def exact(value: int) -> Column:
        return F.lit(str(value)).cast("decimal(38,0)")

    def above(left: Fraction, weight: int) -> Column:
        """weight / total weight of `left` words is more than `most` times the size."""
        return F.col("weight") * exact(left.numerator) > F.col("source_size") * exact(most * weight * left.denominator)

    wide = F.col("source_size").cast("decimal(38,0)")
    whole = sources.agg(F.sum(wide).alias("size"), F.sum("weight").alias("weight")).first()
    words, heavy = share * int(whole["size"] or 0), int(whole["weight"] or 0)
    left, open_ = words, heavy
    while True:
        full = sources.filter(above(left, open_)).agg(F.sum(wide).alias("size"), F.sum("weight").alias("weight")).first()
        now = words - most * int(full["size"] or 0), heavy - int(full["weight"] or 0)
        if now == (left, open_) or not now[1]:
            break
        left, open_ = now
    shared = (F.col("weight") * exact(left.numerator)).cast("double") / F.lit(float(max(1, open_ * left.denominator)))
    target = F.when(above(left, open_), (F.col("source_size") * most).cast("double")).otherwise(shared)
    return sources.select("source", "source_size", target.alias("target"))


def start(source: Column, seed: int = SEED) -> Column:
    """The source's random start in [0, 1): the same in every run."""
    name = F.concat(F.lit(f"{seed}"), F.coalesce(F.concat(F.lit("="), source), F.lit("-")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rows: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """rows [doc_id, source, size, ...] with source_size, target and copies (0 to `most`)."""
    targets = source_targets(rows, weights, share, most)
    placed = numbered(rows, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), name="_place")
    first = placed.groupBy("source").agg(F.min("_place").alias("_first"))
    # A row per source, stored: the join below then has two plain sides, of which Spark can send the small one or split a hot source.
    per = cut(targets.join(first.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).drop("_source"))
    joined = placed.join(per.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).drop("_source")
    each = F.try_divide("target", F.col("source_size").cast("double"))
    at = (F.col("_place") - F.col("_first")).cast("double")

    def crossed(place: Column) -> Column:
        return F.floor(place * each + start(F.col("source"), seed))

    taken = F.coalesce(crossed(at + 1) - crossed(at), F.lit(0)).cast("long")
    return joined.withColumn("copies", F.least(taken, F.lit(most).cast("long"))).drop("_place", "_first")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with a number for each copy (copy: from 1; copy_ where the documents
    have a column of that name; their own columns are unchanged).

    Null texts have size 0 and, like empty ones, take no words; null sources are one source, last in order. Repeated rows and rows with
    a null doc_id are documents of their own. A source without words has target 0 and gives no documents; an empty table gives
    none. `docs` must give the same rows when read again (a stored table): its rows are matched by place.
    """
    row, copies_, copy = unused(docs, "_row", "_copies", "copy")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    small = rows.select(F.col(row).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size(F.col(text)).alias("size"))
    taken = copies(cut(small), **options).filter("copies > 0").select(F.col("_row").alias(row), F.col("copies").alias(copies_))
    return rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies_))).drop(row, copies_)


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """[doc_id, size, source_size, target, taken], one row per document; cases as in mix."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size(F.col(text)).alias("size"))
    return copies(cut(rows), **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
