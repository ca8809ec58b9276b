"""Files: parsing, catalogues, panels, streaming; and the registered queries against their SQL."""

import gzip
import importlib
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import ingest, tables
from tapeloom.streaming.bars import streaming_ohlcv
from tests.conftest import SF, needs_tables

HEADER = "UTCDate,UTCTime,LocalDate,LocalTime,Ticker,SecurityID,TypeMask,Type,Price,Quantity,Orders,Flags\n"


@pytest.fixture()
def raw(tmp_path):
    f = ingest.locate("taq", "ES", "ESH4", date(2024, 1, 3), str(tmp_path))
    os.makedirs(os.path.dirname(f.path))
    with gzip.open(f.path, "wt") as out:
        out.write(HEADER + "".join(f"20240103,{t},20240103,0,ESH4,1,1,{k},{p},{q},1,{fl}\n" for t, k, p, q, fl in [("93000123", "TRADE AGRESSOR ON BUY", 5000.25, 2, 0), ("143000123", "TRADE", 5000.5, 0, 0), ("143000124", "TRADE AGRESSOR ON SELL", 5000.5, 3, 9), ("143000125", "TRADE", 5000.5, 4, 1), ("143000126", "QUOTE BID", 5000, 7, 8), ("143000127", "QUOTE SELL", 5001, 7, 0)]))
    return tmp_path, f


def test_read_and_route(spark, raw):
    top, f = raw
    assert f.exists(spark) and not ingest.locate("taq", "ES", "ESM4", date(2024, 1, 3), str(top)).exists(spark)
    taq = ingest.read_taq(spark, f.path)
    assert taq.orderBy("seq").first().ts == datetime(2024, 1, 3, 9, 30, 0, 123000)
    trades, quotes = ingest.split_taq(taq)
    assert [(r.quantity, r.aggressor_sign, r.is_implied) for r in trades.orderBy("seq").collect()] == [(2, 1, False), (4, 0, True)]
    assert [r.side for r in quotes.orderBy("seq").collect()] == ["bid", "ask"]
    assert ingest.file_catalog(spark, str(top)).select("dataset", "root", "day", "expiry").collect() == [("taq", "ES", date(2024, 1, 3), "ESH4")]
    with pytest.raises(ValueError):
        ingest.locate("news", "ES", "ESH4", date(2024, 1, 3))


def test_clock_digits(spark):
    df = spark.createDataFrame([(20240103, "93000")], "d long, t string")
    one = lambda t, w: df.select(ingest.timestamp_of(F.col("d"), F.lit(t), w)).first()[0]
    assert one("93000", 6) == datetime(2024, 1, 3, 9, 30)
    assert one("93000000001", 12) == datetime(2024, 1, 3, 9, 30, 0, 1)
    assert one("143000000001999", 15) == datetime(2024, 1, 3, 14, 30, 0, 1)


def test_depth_header_is_mended(spark, tmp_path):
    names = [n for n, _ in ingest.depth_fields()]
    path = tmp_path / "d.csv"
    path.write_text(",".join(n.replace("L10Size", "Leve101Size") for n in names) + "\n20240103,143000000,B,0," + ",".join(["100.5,7,1"] * 10) + "\n")
    row = ingest.read_depth(spark, str(path)).first()
    assert row.L10Size == 7 and row.L1Price == 100.5 and row.Side == "B"


def test_panels_round_trip(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame([("ES", 2023, 1, 1.0), ("ES", 2024, 2, 2.0), ("NQ", 2024, 3, 3.0)], "instrument string, year int, ts int, x double")
    tables.write_panel(df, path)
    tables.write_panel(df.where("year = 2024").withColumn("x", F.col("x") * 10), path)  # replaces its partitions alone
    assert sorted(r.x for r in tables.scan(spark, path).collect()) == [1.0, 20.0, 30.0]
    pruned = tables.scan(spark, path, ["ts", "x"], ["ES"], [2024])
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(instrument" in pruned._jdf.queryExecution().executedPlan().toString()
    todo = tables.not_yet_built(df.unionByName(df.limit(1).withColumn("year", F.lit(2025))), tables.scan(spark, path), ["instrument", "year"])
    assert todo.select("year").collect() == [(2025,)]
    more = str(tmp_path / "more")
    spark.createDataFrame([(1, 5)], "ts int, y int").write.parquet(more)
    whole = tables.stitch(spark, tables.existing(spark, [path, more, str(tmp_path / "none")]))
    assert whole.count() == 4 and "y" in whole.columns
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "instrument string, year int, ts int, x double").count() == 3


def test_option_chain_parses_or_drops(spark):
    raw = spark.createDataFrame([("2024-01-02", "5000000", "2024-02-01", "C", "10", "0.1"), ("2024-01-02", "x", "2024-02-01", "C", "10", "0.1")], "date string, strike_price string, exdate string, cp_flag string, open_interest string, gamma string")
    assert [r.strike_price for r in tables.option_chain(raw).collect()] == [5000.0]


def test_streamed_bars_equal_batch(spark, tmp_path):
    from tapeloom.operators.bars import ohlcv

    rows = [("ES", datetime(2024, 1, 1, 0, 0, s), s, 100.0 + s, 1, 1 if s % 2 else -1) for s in range(0, 50, 3)]
    df = spark.createDataFrame(rows, "instr string, ts timestamp, seq long, price double, quantity long, aggressor_sign int")
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    late = df.limit(1).withColumn("ts", F.lit(datetime(2024, 1, 2)).cast("timestamp"))
    late.coalesce(1).write.mode("append").parquet(src)  # moves the watermark on
    stream = streaming_ohlcv(spark.readStream.schema(df.schema).parquet(src), "10 seconds", "1 second")
    q = stream.writeStream.outputMode("append").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ts, r.open, r.close, r.volume, r.buys_qty) for r in spark.table("streamed").collect()}
    want = {(r.ts, r.open, r.close, r.volume, r.buys_qty) for r in ohlcv(df, "10 seconds").collect()}
    assert got == want


def test_entry_registers_queries_with_and_without_text(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert entry.market.FLAGSHIP in entry.queries()
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    registers = (entry.market, entry.edges)
    assert set(entry.queries()) == {n for r in registers for n in r.QUERIES} and set(entry.oracle_sql()) == {n for r in registers for n in r.ORACLES}
    assert len(entry.queries()) == sum(len(r.QUERIES) for r in registers)


@needs_tables
@pytest.mark.parametrize("name", ["bars_core", "exec_bars", "overnight", "roll_front_n", "ingest_trades", "class_metrics", "boosted_split_gains", "sql_asof", "cross_interactions_all", "greedy_choice"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    con.sql("set timezone = 'UTC'")
    theirs = con.sql(entry.oracle_sql()[name]).project(", ".join(f'"{n}"' for n in names)).fetchall()
    ours = [tuple(r) for r in df.select(*names).collect()]
    close = lambda x: round(float(x), 5) if isinstance(x, float) else x
    key = lambda rows: sorted(repr(tuple(close(x) for x in r)) for r in rows)
    assert key(ours) == key(theirs)


def test_a_remote_database_is_read_in_ranges(spark, tmp_path):
    """Spark's own embedded database stands for a warehouse."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d}", 5_000_000 + i, "C" if i % 2 else "P") for i in range(60)], "id int, date string, strike_price int, cp_flag string")
    rows.write.format("jdbc").option("url", url).option("dbtable", "chain").option("createTableColumnTypes", "date varchar(10), cp_flag varchar(1)").options(**driver).save()
    whole = tables.read_jdbc(spark, url, 'select * from chain where "id" < 50', **driver)
    parts = tables.read_jdbc(spark, url, 'select * from chain where "id" < 50', "id", "0", "50", 5, **driver)
    assert whole.count() == parts.count() == 50 and parts.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    catalog = "(select cast(s.schemaname as varchar(128)) as table_schema, cast(t.tablename as varchar(128)) as table_name, cast(c.columnname as varchar(128)) as column_name from sys.systables t join sys.sysschemas s on t.schemaid = s.schemaid join sys.syscolumns c on c.referenceid = t.tableid) cat"
    found = tables.remote_tables(spark, url, "CHA%", catalog, **driver)
    assert [(r.table_name, r["columns"]) for r in found.collect()] == [("CHAIN", ["cp_flag", "date", "id", "strike_price"])]
    assert tables.remote_tables(spark, url, "x' or '1' = '1", catalog, **driver).count() == 0
    chain = tables.option_chain(whole.withColumns({"exdate": F.lit("2024-03-15"), "open_interest": F.lit("7"), "gamma": F.lit("n/a")}))
    assert chain.agg(F.min("strike_price")).first()[0] == 5000.0 and chain.where("gamma is not null").count() == 0
