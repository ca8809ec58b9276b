"""Bars, as-of joins and execution on rows small enough to reckon by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars, execution
from tapeloom.operators.asof import asof

T0 = datetime(2024, 3, 4, 14, 30)
TRADES = "instr string, ts timestamp_ntz, seq long, price double, quantity long, aggressor_sign int, is_implied boolean"
QUOTES = "instr string, ts timestamp_ntz, seq long, side string, price double, size long"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def trades(spark, rows):
    return spark.createDataFrame([("ES", at(s), i, p, q, a, False) for i, (s, p, q, a) in enumerate(rows)], TRADES)


def quotes(spark, rows):
    return spark.createDataFrame([("ES", at(s), i, side, p, 10) for i, (s, side, p) in enumerate(rows)], QUOTES)


def depth(spark, rows):
    cols = ["instr string, ts timestamp_ntz, seq long, Side string, Flags long"] + [f"L{k}Price double, L{k}Size long, L{k}Orders long" for k in range(1, 11)]
    out = []
    for i, (s, side, px, sz) in enumerate(rows):
        levels = [v for k in range(10) for v in (px, sz + k, 1)]
        out.append(("ES", at(s), i, side, 0, *levels))
    return spark.createDataFrame(out, ", ".join(cols))


def test_one_bar_of_buys(spark):
    t = trades(spark, [(0, 5000.0, 10, 1), (1, 5000.25, 5, 1), (2, 5000.5, 3, 1)])
    q = quotes(spark, [(0, "bid", 4999.75), (0, "ask", 5000.25)])
    row = bars.core_bars(t, q, "5 seconds").first()
    assert (row.open, row.high, row.low, row.close, row.volume, row.buys_qty, row.sells_qty, row.trades_count) == (5000, 5000.5, 5000, 5000.5, 18, 18, 0, 3)
    assert row.ts == at(5) and row.mid_close == 5000.0 and row.is_rth and row.cvd_rth == 18.0


def test_bar_without_trades_stands_at_carried_mid(spark):
    t = trades(spark, [(0, 100.0, 1, -1)])
    q = quotes(spark, [(0, "bid", 99.0), (1, "ask", 101.0), (12, "bid", 100.0)])
    rows = bars.core_bars(t, q, "5 seconds").orderBy("ts").collect()
    assert [r.ts for r in rows] == [at(5), at(15)]  # no bar for the empty interval
    assert (rows[1].open, rows[1].close, rows[1].volume, rows[1].trades_count) == (100.5, 100.5, 0, 0)


def test_ties_in_time_go_by_seq_whatever_the_row_order(spark):
    t = trades(spark, [(0, 1.0, 1, 0), (0, 2.0, 1, 0), (0, 3.0, 1, 0)])
    for rows in (t, t.orderBy(F.desc("seq")), t.repartition(3)):
        r = bars.ohlcv(rows, "5 seconds").first()
        assert (r.open, r.close) == (1.0, 3.0)


def test_fold_deals_by_right_label_or_by_start(spark):
    rows = spark.createDataFrame([("ES", at(s), float(s), s) for s in (5, 895, 900, 905)], "instr string, ts timestamp_ntz, close double, volume long")
    by_end = {r.ts: (r.close, r.volume) for r in bars.fold_bars(rows, "15 minutes").collect()}
    assert by_end == {at(900): (895.0, 900), at(1800): (905.0, 1805)}
    by_start = {r.ts: r.volume for r in bars.fold_bars(rows, "15 minutes", sub_bar="5 seconds").collect()}
    assert by_start == {at(900): 1800, at(1800): 905}
    with pytest.raises(ValueError):
        bars.fold_bars(rows, rules={"close": "median"})


def test_rth_bounded_counts_from_the_session(spark):
    rows = spark.createDataFrame([("ES", datetime(2024, 3, 4, 14, 29) + timedelta(minutes=i), float(i)) for i in range(6)], "instr string, ts timestamp_ntz, close double")
    out = [r.close_rth_max_w3 for r in bars.rth_bounded(rows, "close", 3, 2).orderBy("ts").collect()]
    assert out == [None, None, 2.0, 3.0, 4.0, 5.0]


def test_asof_strict_skips_equal_times_and_null_rows_cover(spark):
    left = spark.createDataFrame([("a", 5, 0), ("a", 10, 1), ("b", 5, 2)], "k string, ts int, seq long")
    right = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 5, 1, None), ("a", 10, 2, 3.0)], "k string, ts int, seq long, v double")
    strict = {(r.k, r.ts): r.v for r in asof(left, right, ["k"], strict=True).collect()}
    loose = {(r.k, r.ts): r.v for r in asof(left, right, ["k"]).collect()}
    assert strict == {("a", 5): 1.0, ("a", 10): None, ("b", 5): None}
    assert loose == {("a", 5): None, ("a", 10): 3.0, ("b", 5): None}
    with pytest.raises(ValueError):
        asof(left, right.withColumnRenamed("v", "k2").withColumn("x", F.lit(1)).withColumnRenamed("x", "seq2").withColumn("k3", F.lit(1)).select("k", "ts", F.col("k2").alias("seq2")).withColumnRenamed("seq2", "seq"), ["k"], right_seq="none")


def test_quote_at_the_trades_time_isnt_used(spark):
    q = quotes(spark, [(0, "bid", 4999.0), (0, "ask", 5001.0), (1, "bid", 4999.9), (1, "ask", 5000.1)])
    row = execution.effective_spreads(trades(spark, [(1, 5000.0, 10, -1)]), q, "5 seconds").first()
    assert row.eff_spread_sum == 0.0 and row.eff_spread_count == 1


def test_large_trades_are_beyond_the_nearest_quantile(spark):
    t = trades(spark, [(i % 5, 1.0, 1, 0) for i in range(99)] + [(4, 1.0, 100, 0)])
    row = execution.large_trades(t, "5 seconds").first()
    assert (row.n_large_trades, row.large_trade_volume) == (1, 100)
    assert execution.large_trades(t.limit(0), "5 seconds").count() == 0


def test_hidden_size_and_cancels(spark):
    d = depth(spark, [(0, "S", 100.0, 5), (0, "B", 99.0, 8), (3, "B", 99.0, 2)])
    t = trades(spark, [(1, 100.0, 12, 1), (2, 99.0, 1, -1)])
    h = execution.hidden_absorption(t, d, "5 seconds").first()
    assert (h.hidden_absorption_volume, h.hidden_absorption_trades) == (7, 1)
    c = execution.cancel_proxy(t, d, "5 seconds").first()
    assert (c.net_bid_decrement_no_trade_L1, c.net_ask_decrement_no_trade_L1, c.bid_sz_L1_delta_signed, c.hit_bid_vol, c.lift_ask_vol) == (5, 0, -6, 1, 12)


def test_snapshot_takes_a_side_whole(spark):
    d = depth(spark, [(0, "S", 100.0, 5), (0, "B", 99.0, 8), (5, "B", 98.0, 1)])
    rows = spark.createDataFrame([("ES", at(0), 0), ("ES", at(5), 0), ("ES", at(6), 0)], "instr string, ts timestamp_ntz, seq long")
    out = execution.book_snapshot(rows, d).orderBy("ts").collect()
    assert [r.bid_px_L1 for r in out] == [None, 99.0, 98.0] and out[2].bid_sz_L10 == 10
    assert [r.book_ts_close for r in out] == [None, at(0), at(5)]


def test_plan_has_no_single_partition(spark):
    t = trades(spark, [(0, 1.0, 1, 0)])
    q = quotes(spark, [(0, "bid", 1.0)])
    assert "SinglePartition" not in bars.core_bars(t, q)._jdf.queryExecution().executedPlan().toString()
