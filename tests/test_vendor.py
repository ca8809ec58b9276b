"""The data source of vendor files: a partition a file, its own header and clock, pushed filters, stable row numbers."""

import gzip
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import ingest, vendor

HEADER = "UTCDate,UTCTime,LocalDate,LocalTime,Ticker,SecurityID,TypeMask,Type,Price,Quantity,Orders,Flags\n"


def put(top, dataset, root, expiry, day, text):
    f = ingest.locate(dataset, root, expiry, day, str(top))
    os.makedirs(os.path.dirname(f.path), exist_ok=True)
    with gzip.open(f.path, "wt") as out:
        out.write(text)


def taq_rows(day, rows):
    return HEADER + "".join(f"{day},{t},{day},0,X,1,1,{k},{p},{q},1,{fl}\n" for t, k, p, q, fl in rows)


@pytest.fixture()
def files(spark, tmp_path):
    vendor.register(spark)
    put(tmp_path, "taq", "ES", "ESH4", date(2024, 1, 3), taq_rows(20240103, [("93000000000123", "TRADE AGRESSOR ON BUY", 5000.25, 2, 0), ("143000123456789", "TRADE", "n/a", 0, 0), ("5123000000", "QUOTE BID", 5000, 7, 8)]))
    put(tmp_path, "taq", "ES", "ESM4", date(2024, 1, 4), taq_rows(20240104, [("93000123", "QUOTE SELL", 1, 2, 0)]))
    put(tmp_path, "taq", "NQ", "NQH4", date(2024, 1, 3), HEADER)
    put(tmp_path, "vix", "VX", "VXF4", date(2024, 1, 3), taq_rows(20240103, [("100000500", "TRADE", 13.5, 2, 0)]))
    names = [n for n, _ in ingest.depth_fields()]
    put(tmp_path, "depth", "ES", "ESH4", date(2023, 1, 3), ",".join(n.replace("L10Size", "Leve101Size") for n in names) + "\n20230103,143000000000000,B,0," + ",".join(["100.5,7,1"] * 10) + "\n")
    put(tmp_path, "depth", "ES", "ESH4", date(2024, 1, 3), ",".join(names[:-1]) + "\n20240103,143000000000000,S,0," + ",".join(["100.5,7,1"] * 9) + ",101,9\n")
    return tmp_path


def load(spark, top, dataset):
    return spark.read.format("vendor_daily").option("dataset", dataset).load(str(top))


def test_clock_digits_numbers_and_row_places_are_the_files_own(spark, files):
    rows = {(r.expiry, r.seq): r for r in load(spark, files, "taq").collect()}
    assert {k: r.ts for k, r in rows.items()} == {("ESH4", 0): datetime(2024, 1, 3, 9, 30), ("ESH4", 1): datetime(2024, 1, 3, 14, 30, 0, 123456), ("ESH4", 2): datetime(2024, 1, 3, 0, 0, 5, 123000), ("ESM4", 0): datetime(2024, 1, 4, 9, 30, 0, 123000)}
    assert rows["ESH4", 1].Price is None and rows["ESH4", 2].Flags == 8 and rows["ESH4", 0].Type == "TRADE AGRESSOR ON BUY"
    vix = load(spark, files, "vix").first()
    assert (vix.root, vix.ts) == ("VX", datetime(2024, 1, 3, 10, 0, 0, 500000))


def test_headers_are_the_files_own(spark, files):
    rows = {r.day.year: r for r in load(spark, files, "depth").collect()}
    assert (rows[2023].L10Size, rows[2023].L10Orders, rows[2024].L10Size, rows[2024].L10Orders) == (7, 1, 9, None)


def test_filters_choose_files_and_rows(spark, files):
    taq = load(spark, files, "taq")
    assert taq.rdd.getNumPartitions() == 3
    late = taq.where("day > date'2024-01-03' and root in ('ES', 'NQ')")
    assert [r.expiry for r in late.collect()] == ["ESM4"] and late.rdd.getNumPartitions() == 1
    trades = taq.where(F.col("Type").isin(*ingest.TRADE_TYPES) & (F.col("Price") > 1))
    assert [(r.expiry, r.seq) for r in trades.collect()] == [("ESH4", 0)]
    assert taq.where("root = 'ZZ'").count() == 0
    reader = vendor.VendorReader({"path": str(files), "dataset": "taq"})
    kept = list(reader.pushFilters([vendor.EqualTo(("Type",), "TRADE"), vendor.GreaterThan(("Price",), 1.0), vendor.LessThan(("day",), date(2024, 1, 4))]))
    assert kept == [vendor.GreaterThan(("Price",), 1.0)] and [p.expiry for p in reader.partitions()] == ["ESH4", "NQH4"]


def test_it_feeds_trades_and_quotes(spark, files):
    trades, quotes = ingest.split_taq(load(spark, files, "taq"), ["root", "expiry"])
    assert [(r.expiry, r.quantity, r.aggressor_sign) for r in trades.collect()] == [("ESH4", 2, 1)]
    assert sorted((r.expiry, r.side) for r in quotes.collect()) == [("ESH4", "bid"), ("ESM4", "ask")]


def test_wrong_options(spark, files):
    with pytest.raises(Exception, match="none of"):
        load(spark, files, "news").count()
    with pytest.raises(ValueError):
        vendor.VendorReader({"dataset": "taq"})
