"""Incremental ingest of price drops: every file once, every key once, safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.schemas import RAW_PRICE_COLUMNS
from tidemark.sources.checkpoints import cut
from tidemark.sources.readers import csv_layouts, lacking, scan_layouts
from tidemark.sources.sinks import append_new

KEYS = ("security_id", "price_date")
COLUMNS = (*RAW_PRICE_COLUMNS, "position")
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_price_drops(
    spark: SparkSession, drops: str, periods: DataFrame, table: str, rejects: str, checkpoint: str
) -> None:
    """Read new CSV files of a folder, parse, and add the keys the table does not hold yet.

    A drop carries the vendor's columns, in any order and by name, and `position`, a text that orders the rows of all drops: of a
    key's copies the first stays, whether they are in one drop or in several. The stream lists new files without reading
    them; a micro-batch looks at their headers and reads them by name. A file that lacks a column is not read: it is listed in the
    rejects with that reason, like rows that are rejected and lines with too few or too many cells. A drop's rows are read, parsed and
    reduced to one per key in one pass, whose result both writes use.

    Runs until the folder is read and stops. Of a batch that dies between its two writes, the table has the rows and the rejects
    have nothing; when it is repeated, only unknown keys are appended and the batch's folder of rejects is written anew, so
    both hold it once. `batch` in the table tells which batch brought a row. One writer at a time.
    """
    new = spark.readStream.format("binaryFile").schema(_FILE).load(drops).select("path")

    def store(batch: DataFrame, batch_id: int) -> None:
        files = [r.path for r in batch.collect()]  # names of new files only
        bad, good = [], {}
        for columns, held in (csv_layouts(spark, files) if files else {}).items():
            if missing := lacking(columns, COLUMNS):
                bad += [(f, f"missing columns: {', '.join(missing)}") for f in held]
            else:
                good[columns] = held
        refused = spark.createDataFrame(bad, "file string, skip_reason string")
        if good:
            judged = cut(_judged(scan_layouts(spark, good, COLUMNS, "line"), periods))
            fresh = ingest.accepted(judged).drop("copies", "position", "_broken")
            append_new(fresh.withColumn("batch", F.lit(batch_id)), table, KEYS, "price_date")
            refused = _rejects(judged.filter("skip_reason IS NOT NULL")).unionByName(refused, allowMissingColumns=True)
        refused.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    query = (
        new.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _judged(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Accepted rows, one per key, and all rejected ones, from one scan: text is read and parsed once per drop.

    Cells of a malformed line are not parsed; they go along in `_broken`.
    """
    whole = F.col("line").isNull()
    broken = F.when(~whole, F.struct(*COLUMNS, "line"))
    cells = rows.withColumns({"_broken": broken, **{c: F.when(whole, F.col(c)) for c in RAW_PRICE_COLUMNS}})
    parsed = ingest.parse_prices(cells, periods, ("position", "_broken"))
    reason = F.when(F.col("_broken").isNotNull(), "malformed line").otherwise(F.col("skip_reason"))
    # Days before securities: the sort before the partial aggregation compares its first column fastest.
    return ingest.first_or_rejected(parsed.withColumn("skip_reason", reason), KEYS[::-1], ("position", "close", "volume"))


def _rejects(judged: DataFrame) -> DataFrame:
    """Rejected rows with their typed columns; of a malformed line its cells, where they can be read, and the line."""
    prices = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_broken.{c}").try_cast("double")) for c in ("open", "high", "low", "close")}
    volume = F.coalesce("volume", F.col("_broken.volume").try_cast("bigint"))
    texts = {c: F.col(f"_broken.{c}") for c in ("date", "closeadj", "closeunadj", "line")}
    ticker = F.coalesce("_broken.ticker", "ticker")
    return judged.withColumns({"ticker": ticker, **prices, "volume": volume, **texts}).drop("copies", "_broken")
