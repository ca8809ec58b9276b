"""Views and table functions give what the operators give."""

from pyspark.sql import functions as F

from tapeloom import adapters as ad
from tapeloom import sql
from tapeloom.operators import bars
from tests.conftest import SF, needs_tables


@needs_tables
def test_functions_equal_operators(spark):
    names = sql.register(spark, ad.trades(spark, SF), ad.quotes(spark, SF), ad.depth(spark, SF))
    assert set(names) == {"trades", "quotes", "depth", "quote_stream", "trade_mids", "bar_books", *sql.FUNCTIONS}
    got = spark.sql("select * from ohlcv_bars(21600) where instr = 1")
    want = bars.ohlcv(ad.trades(spark, SF), "6 hours").where("instr = 1").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    one = spark.sql("select t.seq, t.mid, b.mid_close from trades_asof(1e9) t join quote_bars(86400) b using (instr) where t.mid is not null")
    assert one.count() > 0
    assert spark.sql("select count(mid) as n from trades_asof(600)").first().n < spark.sql("select count(mid) as n from trades_asof(1e9)").first().n
    assert spark.sql("select * from bar_books").where(F.col("bid_px_L1").isNotNull()).count() > 0


@needs_tables
def test_filters_reach_the_tables(spark):
    sql.register(spark, ad.trades(spark, SF))
    plan = spark.sql("select ts, volume from ohlcv_bars(3600) where instr = 1")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "user_id" in scan and "props" not in scan.split("ReadSchema")[-1] and "IsNotNull" in scan


def test_only_what_is_given_is_registered(spark):
    trades = spark.createDataFrame([], "instr int, ts timestamp_ntz, seq long, price double, quantity long, aggressor_sign int, is_implied boolean")
    assert sql.register(spark, trades) == ["trades", "ohlcv_bars"]
    assert spark.sql("select * from ohlcv_bars(60)").count() == 0
