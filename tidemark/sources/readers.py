"""Scans of the external formats. Cells stay text until a parse operator has judged them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.schemas import all_text

REPORT_STATUSES = ("COMPLIANT", "NON_COMPLIANT", "QUESTIONABLE", "UNRATED")
HEADERS_AT_ONCE = 16
HOLDING_FORM = "NPORT-P"  # fixed value: the form that lists a fund's holdings


class MissingColumns(Exception):
    """A vendor table lacks columns the import needs."""


def csv_layouts(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Columns in their order -> the CSV files that begin with that header. Empty files have none and are left out.

    Spark applies one header to all files of a scan, so each file's first line is read on its own, several at a time; of the
    data only these lines reach the driver.
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]

    def header(file: str) -> tuple[str, ...]:
        return tuple(spark.read.option("header", True).csv(file).columns)

    layouts: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        for file, columns in zip(files, pool.map(header, files), strict=True):
            if columns:
                layouts.setdefault(columns, []).append(file)
    return layouts


def lacking(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in columns]


def read_vendor_csv(
    spark: SparkSession, path: str | Sequence[str], required: Sequence[str], malformed: str | None = None
) -> DataFrame:
    """All-text scan of the required columns of a vendor table, cells by column name in every file.

    Files may have their columns in any order and more of them; each layout gets a scan of its own and the scans are united. A file
    that lacks a required column fails the import. A line with too few or too many cells keeps the cells it has; with
    `malformed` a column of that name holds the whole line (null for good ones). File splits take the place of paging.
    """
    layouts = csv_layouts(spark, path)
    for columns, files in layouts.items():
        if missing := lacking(columns, required):
            raise MissingColumns(f"missing columns: {', '.join(missing)} in {files[0]}")
    return scan_layouts(spark, layouts, required, malformed)


def scan_layouts(
    spark: SparkSession, layouts: dict[tuple[str, ...], list[str]], required: Sequence[str], malformed: str | None = None
) -> DataFrame:
    """`read_vendor_csv` for files whose layouts are known and have all required columns."""
    wanted = [*required, *([malformed] if malformed else [])]
    rows = spark.createDataFrame([], all_text(tuple(wanted)))
    for columns, files in layouts.items():
        scan = spark.read.schema(all_text((*columns, *wanted[len(required) :]))).option("header", True).option("mode", "PERMISSIVE")
        if malformed:
            # Judged by all cells of a line, so none may be skipped.
            scan = scan.option("columnNameOfCorruptRecord", malformed).option("columnPruning", False)
        part = scan.csv(files).select(*wanted)
        rows = part if len(layouts) == 1 else rows.unionByName(part)
    return rows


def read_fund_holdings(spark: SparkSession, path: str) -> DataFrame:
    """[file, name, ticker, value_usd, asset_category] of a folder of holding filings."""
    schema = "name string, valUSD string, assetCat string, identifiers struct<ticker: struct<_value: string>>"
    rows = spark.read.format("xml").option("rowTag", "invstOrSec").schema(schema).load(path)
    return rows.select(
        F.input_file_name().alias("file"), F.trim(F.coalesce("name", F.lit(""))).alias("name"),
        F.nullif(F.col("identifiers.ticker._value"), F.lit("")).alias("ticker"),
        F.coalesce(F.nullif(F.trim("valUSD"), F.lit("")), F.lit("0")).cast("decimal(24,2)").alias("value_usd"),
        F.trim(F.coalesce("assetCat", F.lit(""))).alias("asset_category"),
    )


REPORT_SCHEMA = (
    "symbol string, name string, exchange string, status string, purificationRatio string, reportDate string"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Compliance reports (one JSON object per line) with skip_reason for malformed ones."""
    raw = spark.read.schema(REPORT_SCHEMA).json(path)
    day = F.when(
        F.substring("reportDate", 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.substring("reportDate", 1, 10).try_cast("date"),
    )
    ratio = F.col("purificationRatio").try_cast("decimal(18,8)")
    has_day = F.coalesce(F.col("reportDate"), F.lit("")) != ""
    reason = (
        F.when(F.col("status").isNull() | F.col("symbol").isNull(), "malformed")
        .when(~F.col("status").isin(*REPORT_STATUSES), "unknown_status")
        .when((has_day & day.isNull()) | (F.col("purificationRatio").isNotNull() & ratio.isNull()), "malformed")
    )
    return raw.select(
        F.upper(F.trim("symbol")).alias("symbol"), F.coalesce("name", F.lit("")).alias("name"), "exchange",
        "status", ratio.alias("purification_ratio"), day.alias("report_date"), reason.alias("skip_reason"),
    )


FILING_INDEX = (
    "cik bigint, filings struct<recent: struct<form: array<string>, reportDate: array<string>, "
    "accessionNumber: array<string>>>"
)


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """[cik, form, report_date, accession]: the parallel arrays of the index as rows."""
    raw = spark.read.schema(FILING_INDEX).json(path)
    recent = F.col("filings.recent")
    zipped = F.arrays_zip(
        recent["form"].alias("form"), recent["reportDate"].alias("reported"),
        recent["accessionNumber"].alias("accession"),
    )
    rows = raw.select("cik", F.explode(zipped).alias("f")).select("cik", "f.*")
    day = F.when(F.col("reported") != "", F.col("reported").try_cast("date"))
    return rows.select("cik", "form", day.alias("report_date"), "accession")


def month_end_filings(index: DataFrame, since: object) -> DataFrame:
    """Holding filings of month ends since a date, each accession once."""
    wanted = (
        (F.col("form") == HOLDING_FORM)
        & (F.dayofmonth("report_date") >= 28)
        & (F.col("report_date") >= F.lit(since))
    )
    return index.filter(wanted).groupBy("cik", "accession").agg(F.max("report_date").alias("report_date"))


def filings_of_series(filings: DataFrame, series_of: DataFrame, series: str) -> DataFrame:
    """One filing per report date of the wanted fund series. series_of: [accession, series]."""
    own = filings.join(series_of.filter(F.col("series") == series), "accession", "left_semi")
    w = W.partitionBy("cik", "report_date").orderBy("accession")
    return own.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
