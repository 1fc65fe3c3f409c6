"""Files, add-only sinks and vintages."""

import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import crosscheck, reports, scoring
from tidemark.sources import panel, readers, sinks
from tidemark.streaming import prices


@pytest.fixture
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("run") / uuid.uuid4().hex)


def test_missing_column_is_refused(spark, folder):
    spark.createDataFrame([("A", "1")], "ticker string, open string").write.option("header", True).csv(folder)
    with pytest.raises(readers.MissingColumns, match="close"):
        readers.read_vendor_csv(spark, folder, ("ticker", "close"))
    rows = readers.read_vendor_csv(spark, folder, ("open", "ticker"))
    assert rows.dtypes == [("open", "string"), ("ticker", "string")]


def test_cells_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,date,close\nA,2020-01-02,1\n")
    (tmp_path / "b.csv").write_text('date,note,ticker,close\n2020-01-03,"x, y",B,2\n2020-01-04,n,C\n2020-01-05,n,D,4,5\n')
    (tmp_path / "with space.csv").write_text("close,ticker,date\n")
    (tmp_path / "empty.csv").write_text("")
    columns = ("ticker", "date", "close")
    assert sorted(map(tuple, readers.read_vendor_csv(spark, str(tmp_path), columns).filter("ticker < 'C'").collect())) == [("A", "2020-01-02", "1"), ("B", "2020-01-03", "2")]
    got = {r.ticker: (r.date, r.close, r.bad) for r in readers.read_vendor_csv(spark, str(tmp_path), columns, "bad").collect()}
    assert got == {
        "A": ("2020-01-02", "1", None), "B": ("2020-01-03", "2", None), "C": ("2020-01-04", None, "2020-01-04,n,C"), "D": ("2020-01-05", "4", "2020-01-05,n,D,4,5"),
    }
    (tmp_path / "c.csv").write_text("ticker,close\nE,5\n")
    with pytest.raises(readers.MissingColumns, match=r"date in .*c\.csv"):
        readers.read_vendor_csv(spark, str(tmp_path), columns)


DROP = "ticker,date,open,high,low,close,volume,closeadj,closeunadj,position"


def drop(folder, name, rows, header=DROP):
    """A drop of (ticker, day, close, position) with its columns in the header's order."""
    folder.mkdir(exist_ok=True)
    lines = [header]
    for ticker, day, close, position in rows:
        cells = {**dict.fromkeys(("open", "high", "low", "close", "closeadj", "closeunadj"), close), "ticker": ticker, "date": day, "volume": "10", "position": position}
        lines.append(",".join(cells.get(c, "?") for c in header.split(",")))
    (folder / name).write_text("\n".join(lines) + "\n")


def test_price_drops_by_name_and_after_a_failure(spark, tmp_path, monkeypatch):
    periods = spark.createDataFrame([(1, "A", date(2000, 1, 1), None), (2, "B", date(2000, 1, 1), None)], "security_id bigint, ticker string, valid_from date, valid_to date")
    drops, table, rejects = tmp_path / "drops", str(tmp_path / "table"), str(tmp_path / "rejects")
    run = lambda: prices.ingest_price_drops(spark, str(drops), periods, table, rejects, str(tmp_path / "state"))
    stored = lambda: sorted((r.security_id, r.price_date.day, float(r.close), r.batch) for r in spark.read.parquet(table).collect())
    drop(drops, "1.csv", [("A", "2020-01-02", "5", "1"), ("A", "2020-01-03", "6", "2"), ("Z", "2020-01-03", "6", "3")])
    run()
    assert stored() == [(1, 2, 5.0, 0), (1, 3, 6.0, 0)]
    # The next batch dies after its rows are in the table: permuted columns, an extra one, a file without `close`, a short line.
    drop(drops, "2.csv", [("B", "2020-01-02", "7", "4"), ("A", "2020-01-03", "9", "5")], ",".join(["extra", *reversed(DROP.split(","))]))
    drop(drops, "3.csv", [("B", "2020-01-06", "8", "6")], DROP.replace("close,", ""))
    drop(drops, "4.csv", [("B", "2020-01-07", "8", "7")])
    (drops / "4.csv").write_text((drops / "4.csv").read_text() + "B,2020-01-08\n")
    real = prices.append_new

    def dying(*args):
        real(*args)
        raise RuntimeError("killed between the two writes")

    monkeypatch.setattr(prices, "append_new", dying)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(prices, "append_new", real)
    run()
    run()
    assert stored() == [(1, 2, 5.0, 0), (1, 3, 6.0, 0), (2, 2, 7.0, 1), (2, 7, 8.0, 1)]
    refused = spark.read.option("mergeSchema", True).parquet(rejects).filter("batch = 1").collect()
    by_reason = {r.skip_reason: r for r in refused}
    assert len(refused) == 2 and by_reason["malformed line"].line == "B,2020-01-08"
    assert by_reason["missing columns: close"].file.endswith("3.csv")


def test_a_drop_is_parsed_once_and_malformed_cells_do_not_stop_it(spark, tmp_path, monkeypatch):
    periods = spark.createDataFrame([(1, "A", date(2000, 1, 1), None)], "security_id bigint, ticker string, valid_from date, valid_to date")
    drops, table, rejects = tmp_path / "drops", str(tmp_path / "table"), str(tmp_path / "rejects")
    same = ("Z", "2020-01-03", "6", "3")
    drop(drops, "1.csv", [("A", "2020-01-02", "5", "2"), ("A", "2020-01-02", "4", "1"), same, same, ("A", "2020-01-03", "N/A", "4")])
    (drops / "1.csv").write_text((drops / "1.csv").read_text() + f"A,2020-01-06,N/A,1,1,{10**30},10.5\n")
    real, plans = prices.append_new, []

    def watched(fresh, *args):
        plans.append(fresh._jdf.queryExecution().toString())
        real(fresh, *args)

    monkeypatch.setattr(prices, "append_new", watched)
    prices.ingest_price_drops(spark, str(drops), periods, table, rejects, str(tmp_path / "state"))
    assert len(plans) == 1 and "csv" not in plans[0]  # both writes start from stored rows, not from the files
    assert [(r.price_date.day, int(r.close)) for r in spark.read.parquet(table).collect()] == [(2, 4)]
    refused = [(r.skip_reason, r.position, r.line) for r in spark.read.parquet(rejects).collect()]
    assert sorted(refused, key=str) == [
        ("malformed line", None, f"A,2020-01-06,N/A,1,1,{10**30},10.5"), ("missing_value", "4", None),
        ("no_security_for_ticker_on_date", "3", None), ("no_security_for_ticker_on_date", "3", None),
    ]


def test_xml_with_a_default_namespace(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><formData><invstOrSecs>'
        "<invstOrSec><name>Apple Inc</name><identifiers><ticker value='AAPL'/></identifiers>"
        "<valUSD>100.50</valUSD><assetCat>EC</assetCat></invstOrSec>"
        "<invstOrSec><name> Cash </name><assetCat>STIV</assetCat></invstOrSec>"
        "</invstOrSecs></formData></edgarSubmission>"
    )
    rows = readers.read_fund_holdings(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.ticker, float(r.value_usd), r.asset_category) for r in rows] == [
        ("Apple Inc", "AAPL", 100.5, "EC"), ("Cash", None, 0.0, "STIV"),
    ]


def test_append_new_is_idempotent(spark, folder):
    rows = spark.createDataFrame([(1, date(2020, 1, 2), 5), (1, date(2020, 2, 3), 6)], "security_id int, d date, v int")
    sinks.append_new(rows, folder, ("security_id", "d"), "d")
    sinks.append_new(rows.withColumn("v", F.lit(9)), folder, ("security_id", "d"), "d")
    more = rows.unionByName(spark.createDataFrame([(2, date(2020, 2, 3), 7)], rows.schema))
    sinks.append_new(more, folder, ("security_id", "d"), "d")
    got = sorted((r.security_id, r.d, r.v) for r in spark.read.parquet(folder).collect())
    assert got == [(1, date(2020, 1, 2), 5), (1, date(2020, 2, 3), 6), (2, date(2020, 2, 3), 7)]


def test_vintage_gate(spark, folder):
    rows = spark.createDataFrame([(1, date(2020, 1, 2))], "security_id int, price_date date")
    registry, path, keys = f"{folder}/registry", f"{folder}/prices", ("security_id", "price_date")
    with pytest.raises(sinks.VintageClosed):
        sinks.add_to_vintage(rows, path, registry, "v1", keys)
    assert sinks.start_vintage(spark, registry, "v1", "first")
    assert not sinks.start_vintage(spark, registry, "v1", "again")
    sinks.add_to_vintage(rows, path, registry, "v1", keys)
    sinks.finish_vintage(spark, path, registry, "v1")
    for action in (
        lambda: sinks.add_to_vintage(rows, path, registry, "v1", keys),
        lambda: sinks.start_vintage(spark, registry, "v1", "x"),
        lambda: sinks.finish_vintage(spark, path, registry, "v1"),
    ):
        with pytest.raises(sinks.VintageClosed):
            action()


def test_first_record_of_identical_data_stays(spark, folder):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string")
    text = F.concat_ws("|", "n", "s")
    label = sinks.register_version(a, text, "prices", "vendor", folder)
    shuffled = a.orderBy(F.desc("n")).repartition(3)
    assert sinks.register_version(shuffled, text, "prices", "vendor", folder) == label
    assert sinks.register_version(a.limit(1), text, "prices", "vendor", folder) != label
    assert spark.read.parquet(folder).count() == 2


def test_trend_problem_is_raised_not_hidden(spark):
    signal = spark.createDataFrame(
        [(date(2020, 1, 2), 150, None, "series too short or stale")],
        "decision_date date, trend_days int, risk_on boolean, problem string",
    )
    with pytest.raises(scoring.TrendError, match="2020-01-02"):
        scoring.require_signal(signal)


def test_stored_runs_listing(spark):
    runs = spark.createDataFrame(
        [(1, "momentum-v1", "base", "in_sample", "a" * 64, (0.1, 0.2, 0.5, -0.3)), (2, "a3_cap50", "base", "in_sample", "b" * 64, (0.1, 0.2, 0.5, -0.3)),
         (3, "momentum_l63", "stress", "in_sample", "c" * 64, (0.2, 0.2, 1.0, -0.2))],
        "id int, strategy_version string, slippage_case string, period_name string, result_sha256 string, "
        "metrics struct<cagr: double, volatility: double, sharpe: double, max_drawdown: double>",
    )
    got = reports.stored_runs(runs, "in_sample", "momentum", 10).collect()
    assert [(r.id, r.result, r.sharpe) for r in got] == [(3, "c" * 12, 1.0), (1, "a" * 12, 0.5)]


def test_every_order_line_becomes_part_of_a_price(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    taken = panel.daily_price(spark, sf).agg({"volume": "sum"}).first()[0]
    assert taken == lines.selectExpr("sum(CAST(l_quantity AS BIGINT))").first()[0]


def test_the_last_report_of_a_spelling_counts(spark):
    ours = spark.createDataFrame([("AB", "HALAL", 1, "")], "symbol string, status string, security_id int, reason string")
    reports = spark.createDataFrame([("ab", "UNRATED", 1), (" AB", "COMPLIANT", 2), ("Ab ", "NON_COMPLIANT", 0)], "symbol string, status string, position int")
    assert [r.their_status for r in crosscheck.pair_up(ours, reports).collect()] == ["COMPLIANT"]
