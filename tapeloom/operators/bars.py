"""Time bars of trades and quotes. Bars hold [start, end) and carry their end as `ts`; empty intervals have no bar.

Trades: instr, ts, seq, price, quantity, aggressor_sign, is_implied. Quotes: instr, ts, seq, side, price, size. `seq` breaks
ties of time, so that first and last are the same in every run. Hot instruments: aggregations combine before the shuffle;
the windows that carry quotes forward are one partition an instrument, so pass `by` with the day where days don't connect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import session
from ..functions.along import Along

KEY = ["instr"]


def bar_end(every: str, ts: str = "ts") -> Column:
    return F.window(ts, every)["end"]


def in_bars(rows: DataFrame, every: str, by: list[str] | None = None):
    """Rows grouped by instrument and bar."""
    return rows.withColumn("_bar", bar_end(every)).groupBy(*(by or KEY), F.col("_bar").alias("ts"))


def first_by(x: str, order: Column) -> Column:
    return F.min_by(x, order)


def last_by(x: str, order: Column) -> Column:
    return F.max_by(x, order)


def quote_stream(quotes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bid, ask, mid and spread after every quote."""
    a = Along(by or KEY)
    side = lambda s: a.fill(F.when(F.col("side") == s, F.col("price")))
    out = quotes.select(*(by or KEY), "ts", "seq", side("bid").alias("bid"), side("ask").alias("ask"))
    return out.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def ohlcv(trades: DataFrame, every: str, by: list[str] | None = None) -> DataFrame:
    """Trades alone: no quotes and no empty bars."""
    at, q = F.struct("ts", "seq"), F.col("quantity")
    when = lambda sign: F.coalesce(F.sum(F.when(F.col("aggressor_sign") == sign, q)), F.lit(0))
    return in_bars(trades, every, by).agg(first_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last_by("price", at).alias("close"), F.sum(q).alias("volume"), when(1).alias("buys_qty"), when(-1).alias("sells_qty"), F.count(F.lit(1)).alias("trades_count"))


def _flow(trades: DataFrame, every: str, by: list[str] | None) -> DataFrame:
    at, q, sign, implied = F.struct("ts", "seq"), F.col("quantity"), F.col("aggressor_sign"), F.col("is_implied")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, q)), F.lit(0))
    return in_bars(trades, every, by).agg(
        first_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        last_by("price", at).alias("close"),
        F.sum(q).alias("volume"),
        F.sum(F.col("price") * q).alias("dollar_volume"),
        total(sign == 1).alias("buys_qty"),
        total(sign == -1).alias("sells_qty"),
        F.count(F.lit(1)).alias("trades_count"),
        F.count(F.when(sign == 0, 1)).alias("unclassified_count"),
        total(implied).alias("implied_volume"),
        total(implied & (sign == 1)).alias("implied_buys"),
        total(implied & (sign == -1)).alias("implied_sells"),
    )


ZEROS = ("volume", "dollar_volume", "buys_qty", "sells_qty", "trades_count", "unclassified_count", "implied_volume", "implied_buys", "implied_sells")


def _joined(flow: DataFrame, quote_bars: DataFrame, by: list[str]) -> DataFrame:
    """Full join; quotes carried forward; bars without trades stand at the mid."""
    a = Along(by, ["ts"])
    carried = [c for c in ("bid_close", "ask_close", "mid_close", "spread_abs_close") if c in quote_bars.columns]
    both = flow.join(quote_bars, [*by, "ts"], "full")
    both = both.withColumns({c: a.fill(F.col(c)) for c in carried})
    both = both.withColumns({c: F.coalesce(c, "mid_close") for c in ("open", "high", "low", "close")})
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ZEROS if c in flow.columns})


def trade_quote_bars(trades: DataFrame, quotes: DataFrame, every: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """OHLCV, signed flow and last quotes."""
    by, at = by or KEY, F.struct("ts", "seq")
    last = in_bars(quote_stream(quotes, by), every, by).agg(*[last_by(c, at).alias(f"{c}_close") for c in ("bid", "ask", "mid")])
    return _joined(ohlcv(trades, every, by), last, by)


def core_bars(trades: DataFrame, quotes: DataFrame, every: str = "5 seconds", by: list[str] | None = None) -> DataFrame:
    """The full bar: OHLCV, dollar volume, signed, unclassified and implied flow, last quotes, spread statistics, session
    flags and cumulative flows."""
    by, at = by or KEY, F.struct("ts", "seq")
    quote_bars = in_bars(quote_stream(quotes, by), every, by).agg(
        *[last_by(c, at).alias(f"{c}_close") for c in ("bid", "ask", "mid")],
        last_by("spread", at).alias("spread_abs_close"),
        F.avg("spread").alias("spread_mean_sub"),
        F.stddev_samp("spread").alias("spread_std_sub"),
        F.max("spread").alias("spread_max_sub"),
        F.min("spread").alias("spread_min_sub"),
    )
    bars = _joined(_flow(trades, every, by), quote_bars, by)
    et = session.eastern(F.col("ts"))
    bars = bars.withColumns({"is_rth": session.is_rth_bar(et), "is_session_warm": session.is_warm(et)})
    return cumulative_flow(bars, by)


def cumulative_flow(bars: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Signed volume since the week began and since the last 09:30, and the bars since then: windows that reset by partition."""
    by = by or KEY
    et = session.eastern(F.col("ts"))
    rows = bars.withColumns({"_week": F.date_trunc("week", et), "_rth": session.rth_date(et), "_signed": F.col("buys_qty") - F.col("sells_qty")})
    week, day = Along([*by, "_week"], ["ts"]), Along([*by, "_rth"], ["ts"])
    out = rows.withColumns({"cvd_globex": week.total(F.col("_signed")).cast("double"), "cvd_rth": day.total(F.col("_signed")).cast("double"), "bars_since_rth_reset": (F.row_number().over(day.window) - 1).cast("long")})
    return out.drop("_week", "_rth", "_signed")


def rth_bounded(bars: DataFrame, value: str, n: int, least: int = 5, how: str = "max", by: list[str] | None = None) -> DataFrame:
    """A rolling extreme, mean or population deviation that never looks behind the last 09:30."""
    functions: dict[str, Callable] = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop}
    if how not in functions:
        raise ValueError(f"{how!r} is none of {sorted(functions)}")
    rows = bars.withColumn("_rth", session.rth_date(session.eastern(F.col("ts"))))
    a = Along([*(by or KEY), "_rth"], ["ts"])
    frame = a.window.rowsBetween(-(n - 1), 0)
    return rows.withColumn(f"{value}_rth_{how}_w{n}", F.when(F.count(F.lit(1)).over(frame) >= least, functions[how](value).over(frame))).drop("_rth")


#: How columns of bars fold into longer bars; others take their last value.
FOLD = {
    "open": "first", "high": "max", "low": "min", "close": "last",
    **dict.fromkeys(ZEROS, "sum"),
    "spread_mean_sub": "mean", "spread_std_sub": "mean", "spread_max_sub": "max", "spread_min_sub": "min",
    **dict.fromkeys(("eff_spread_sum", "eff_spread_weight", "eff_spread_count", "eff_spread_buy_sum", "eff_spread_buy_weight", "eff_spread_sell_sum", "eff_spread_sell_weight", "n_large_trades", "large_trade_volume", "hidden_absorption_volume", "hidden_absorption_trades", "net_bid_decrement_no_trade_L1", "net_ask_decrement_no_trade_L1"), "sum"),
}


def fold_bars(bars: DataFrame, every: str = "15 minutes", rules: dict[str, str] | None = None, otherwise: str = "last", by: list[str] | None = None, sub_bar: str | None = None) -> DataFrame:
    """Longer bars by a rule a column. Bars are dealt by their end, so the bar that ends at an edge falls into the next long
    bar; `sub_bar` (its length) deals by the start instead."""
    by, rules = by or KEY, FOLD if rules is None else rules
    at = F.col("ts") if sub_bar is None else F.col("ts") - F.expr(f"interval {sub_bar}")
    make = {"first": lambda c: first_by(c, F.col("ts")), "last": lambda c: last_by(c, F.col("ts")), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "max": F.max, "min": F.min}
    aggregates = []
    for c in bars.columns:
        if c not in (*by, "ts"):
            rule = rules.get(c, otherwise)
            if rule not in make:
                raise ValueError(f"no rule {rule!r} for {c}")
            aggregates.append(make[rule](c).alias(c))
    return bars.withColumn("_at", at).groupBy(*by, F.window("_at", every)["end"].alias("_end")).agg(*aggregates).withColumnRenamed("_end", "ts")


def realized_moments(bars: DataFrame, every: str = "15 minutes", by: list[str] | None = None) -> DataFrame:
    """Realised variance, bipower variation, skewness, excess kurtosis and quarticity of the log returns of short bars."""
    by = by or KEY
    a = Along(by, ["ts"])
    r = F.col("_r")
    rows = bars.select(*by, "ts", F.ln(F.col("close") / a.lag(F.col("close"))).alias("_r"))
    rows = rows.withColumn("_b", F.abs(r) * F.abs(a.lag(r)))
    some = F.stddev_pop("_r") > 0
    return in_bars(rows, every, by).agg(
        F.coalesce(F.sum(r * r), F.lit(0.0)).alias("rv_5s"),
        (F.pi() / 2 * F.coalesce(F.sum("_b"), F.lit(0.0))).alias("rv_bipower_5s"),
        F.when(some, F.skewness("_r")).alias("realized_skew_5s"),
        F.when(some, F.kurtosis("_r")).alias("realized_kurt_5s"),
        (F.coalesce(F.sum(F.pow("_r", F.lit(4))), F.lit(0.0)) * F.count(F.lit(1)) / 3.0).alias("realized_quarticity_5s"),
        F.count(F.lit(1)).alias("n_subbars"),
    )


def fold_with_moments(bars: DataFrame, every: str = "15 minutes", by: list[str] | None = None, **options) -> DataFrame:
    by = by or KEY
    return fold_bars(bars, every, by=by, **options).join(realized_moments(bars, every, by), [*by, "ts"], "left")
