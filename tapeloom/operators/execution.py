"""Execution-quality bars: spreads paid, large trades, hidden size, quote moves, cancelled size; and book snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof, asof_kinds
from .bars import KEY, first_by, in_bars, last_by, quote_stream
from .slices import time_slice
from ..functions.along import Along

LEVELS = 10


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def split_sides(depth: DataFrame, only_regular: bool = True, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bid and ask snapshots with their level columns named by side."""
    rows = depth.where("Flags = 0") if only_regular else depth
    part = {"Price": "px", "Size": "sz", "Orders": "ord"}
    one = lambda side, tag: rows.where(F.col("Side") == tag).select(*(by or KEY), "ts", "seq", *[F.col(f"L{k}{x}").alias(f"{side}_{y}_L{k}") for k in range(1, LEVELS + 1) for x, y in part.items()])
    return one("bid", "B"), one("ask", "S")


def effective_spreads(trades: DataFrame, quotes: DataFrame, every: str, by: list[str] | None = None) -> DataFrame:
    """Twice the signed distance of trades from the mid just before them, summed by size."""
    by = by or KEY
    mids = quote_stream(quotes, by).select(*by, "ts", "seq", "mid")
    sign, q = F.col("aggressor_sign"), F.col("quantity")
    off = F.col("price") - F.col("mid")
    rows = asof(trades, mids, by, strict=True).where("mid is not null").withColumn("_eff", F.when(sign == 0, 2.0 * F.abs(off)).otherwise(2.0 * sign * off))
    of = lambda s, x: _sum(F.when(sign == s, x))
    return in_bars(rows, every, by).agg(
        _sum(F.col("_eff") * q).alias("eff_spread_sum"), _sum(q).alias("eff_spread_weight"), F.count(F.lit(1)).alias("eff_spread_count"),
        of(1, F.col("_eff") * q).alias("eff_spread_buy_sum"), of(1, q).alias("eff_spread_buy_weight"), of(-1, F.col("_eff") * q).alias("eff_spread_sell_sum"), of(-1, q).alias("eff_spread_sell_weight"),
    )


def nearest_quantile(rows: DataFrame, value: str, q: float, by: list[str], name: str) -> DataFrame:
    """The value at sorted place round(q (n - 1)) of each group, from counts of distinct values: no group is sorted whole."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    return upto.where(F.col("_upto") > F.round(F.lit(q) * (F.col("_all") - 1))).groupBy(*by).agg(F.min(value).alias(name))


def large_trades(trades: DataFrame, every: str, q: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Trades larger than their day's quantile of sizes: how many and how much."""
    by = by or KEY
    rows = trades.withColumn("_day", F.to_date("ts"))
    edge = nearest_quantile(rows, "quantity", q, [*by, "_day"], "_edge")
    tagged = rows.join(edge, [*by, "_day"])
    large = F.col("quantity") > F.col("_edge")
    return in_bars(tagged, every, by).agg(F.count(F.when(large, 1)).alias("n_large_trades"), _sum(F.when(large, F.col("quantity"))).alias("large_trade_volume"))


def hidden_absorption(trades: DataFrame, depth: DataFrame, every: str, only_regular: bool = True, by: list[str] | None = None) -> DataFrame:
    """Size of trades at the touch beyond what the touch showed just before."""
    by = by or KEY
    book = (depth.where("Flags = 0") if only_regular else depth).select(*by, "ts", "seq", "Side", "L1Price", "L1Size")
    touch = lambda side: ({f"{side}_px_L1": "L1Price", f"{side}_sz_L1": "L1Size"}, None)
    rows = asof_kinds(trades, book, by, {"B": touch("bid"), "S": touch("ask")}, "Side", strict=True)
    over = lambda s, side: (F.col("aggressor_sign") == s) & (F.col("price") == F.col(f"{side}_px_L1")) & (F.col("quantity") > F.col(f"{side}_sz_L1"))
    hidden = F.when(over(1, "ask"), F.col("quantity") - F.col("ask_sz_L1")).when(over(-1, "bid"), F.col("quantity") - F.col("bid_sz_L1")).otherwise(0)
    return in_bars(rows.withColumn("_h", hidden), every, by).agg(_sum(F.col("_h")).alias("hidden_absorption_volume"), F.count(F.when(F.col("_h") > 0, 1)).alias("hidden_absorption_trades"))


def quote_directions(quotes: DataFrame, every: str, by: list[str] | None = None) -> DataFrame:
    """How often each side's price moved up and down. A side without quotes in a bar has nulls there."""
    by = by or KEY
    rows = quotes.withColumn("_d", F.signum(F.col("price") - Along([*by, "side"]).lag(F.col("price"))))
    count = lambda side, d: F.when(F.count(F.when(F.col("side") == side, 1)) > 0, F.count(F.when((F.col("side") == side) & (F.col("_d") == d), 1)))
    return in_bars(rows, every, by).agg(*[count(s, d).alias(f"{s}_{n}_count") for s in ("bid", "ask") for n, d in (("up", 1), ("down", -1))])


def quote_counts(quotes: DataFrame, every: str, by: list[str] | None = None) -> DataFrame:
    return in_bars(quotes, every, by or KEY).agg(F.count(F.lit(1)).alias("quote_update_count"))


def cancel_proxy(trades: DataFrame, depth: DataFrame, every: str, only_regular: bool = True, by: list[str] | None = None) -> DataFrame:
    """Touch size that went without trades to explain it, signed changes of touch size, and signed volume. One tagged union
    and one aggregation stand for three joined frames."""
    by = by or KEY
    rows = depth.where("Flags = 0") if only_regular else depth
    d = rows.select(*by, "ts", "seq", F.col("Side").alias("_side"), F.col("L1Size").alias("_size"), F.lit(None).cast("long").alias("_hit"), F.lit(None).cast("long").alias("_lift"))
    q = lambda s: F.when(F.col("aggressor_sign") == s, F.col("quantity")).otherwise(0).cast("long")
    t = trades.select(*by, "ts", "seq", F.lit("T").alias("_side"), F.lit(None).cast("long").alias("_size"), q(-1).alias("_hit"), q(1).alias("_lift"))
    at = F.struct("ts", "seq")
    edge = lambda f, s: f(F.when(F.col("_side") == s, F.col("_size")), F.when(F.col("_side") == s, at))
    out = in_bars(d.unionByName(t), every, by).agg(
        edge(F.min_by, "B").alias("_b0"), edge(F.max_by, "B").alias("_b1"), edge(F.min_by, "S").alias("_a0"), edge(F.max_by, "S").alias("_a1"),
        _sum(F.col("_hit")).alias("hit_bid_vol"), _sum(F.col("_lift")).alias("lift_ask_vol"),
    )
    gone = lambda x, v: F.greatest(F.lit(0).cast("long"), F.col(f"_{x}0") - F.col(f"_{x}1") - F.col(v))
    return out.select(*by, "ts", gone("b", "hit_bid_vol").alias("net_bid_decrement_no_trade_L1"), gone("a", "lift_ask_vol").alias("net_ask_decrement_no_trade_L1"), (F.col("_b1") - F.col("_b0")).alias("bid_sz_L1_delta_signed"), (F.col("_a1") - F.col("_a0")).alias("ask_sz_L1_delta_signed"), "hit_bid_vol", "lift_ask_vol")


def execution_bars(trades: DataFrame, quotes: DataFrame, depth: DataFrame, every: str = "5 seconds", by: list[str] | None = None, q: float = 0.99) -> DataFrame:
    """All six families side by side; what a bar has none of is 0.

    One tagged union, dealt by instrument and day: one window carries the last bid and ask quoted and both touches of the book to trades
    and to quotes, each day's last ones are handed on to the days after it (a row a day), and one aggregation makes the bars. At equal
    times trades come first, so that what they see is strictly older.
    """
    by = by or KEY
    long, double = (lambda c: F.col(c).cast("long")), (lambda c: F.col(c).cast("double"))
    names = {"_kind": "string", "_side": "string", "_price": "double", "_size": "long", "_sign": "int"}

    def tagged(df: DataFrame, **given) -> DataFrame:
        return df.select(*by, "ts", F.col("seq").cast("long").alias("seq"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])

    rows = tagged(trades, _kind=F.lit("0"), _price=double("price"), _size=long("quantity"), _sign=F.col("aggressor_sign"))
    rows = rows.unionByName(tagged(quotes, _kind=F.lit("1"), _side=F.col("side"), _price=double("price"), _size=long("size")))
    rows = rows.unionByName(tagged(depth.where("Flags = 0"), _kind=F.lit("2"), _side=F.col("Side"), _price=double("L1Price"), _size=long("L1Size")))
    # A day is a slice, so that the day's quantile of sizes is at hand where the day's rows are.
    rows = rows.withColumn("_slice", time_slice(F.col("ts"), 24))
    keys = [*by, "_slice"]
    order = ["ts", "_kind", "seq"]
    is_trade, is_quote, is_book = (F.col("_kind") == k for k in "012")
    sources = {"_bid": (is_quote & (F.col("_side") == "bid"), "_price"), "_ask": (is_quote & (F.col("_side") == "ask"), "_price"), "_book_bid": (is_book & (F.col("_side") == "B"), None), "_book_ask": (is_book & (F.col("_side") == "S"), None)}
    value = {n: F.when(cond, F.col(c) if c else F.struct("_price", "_size")) for n, (cond, c) in sources.items()}

    ends = rows.groupBy(*keys).agg(*[F.max_by(v, F.when(sources[n][0], F.struct(*order))).alias(n) for n, v in value.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *[F.last(n, ignorenulls=True).over(before).alias(f"_was{n}") for n in value])
    trade_sizes = trades.select(*by, time_slice(F.col("ts"), 24).alias("_slice"), long("quantity").alias("_quantity")).repartition(*keys)
    carried = carried.join(nearest_quantile(trade_sizes, "_quantity", q, keys, "_edge"), keys, "left")

    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumns({n: F.last(v, ignorenulls=True).over(so_far) for n, v in value.items()}).join(carried, keys, "left")
    seen = seen.withColumns({n: F.coalesce(n, f"_was{n}") for n in value})

    size, sign, price = F.col("_size"), F.col("_sign"), F.col("_price")
    off = price - (F.col("_bid") + F.col("_ask")) / 2
    paid = F.when(is_trade, F.when(sign == 0, 2.0 * F.abs(off)).otherwise(2.0 * sign * off))
    over = lambda s, c: is_trade & (sign == s) & (price == F.col(f"{c}._price")) & (size > F.col(f"{c}._size"))
    hidden = F.when(over(1, "_book_ask"), size - F.col("_book_ask._size")).when(over(-1, "_book_bid"), size - F.col("_book_bid._size"))
    moved = lambda side: F.when(is_quote & (F.col("_side") == side), F.signum(price - F.col(f"_{side}")))
    seen = seen.withColumns({"_paid": paid, "_hidden": hidden, "_large": is_trade & (size > F.col("_edge")), "_bid_move": moved("bid"), "_ask_move": moved("ask")})

    spread = F.col("_paid").isNotNull()
    of = lambda s, x: _sum(F.when(spread & (sign == s), x))
    count = lambda cond: F.count(F.when(cond, 1))
    at = F.struct("ts", "seq")
    edge = lambda f, s: f(F.when(is_book & (F.col("_side") == s), size), F.when(is_book & (F.col("_side") == s), at))
    volume = lambda s: _sum(F.when(is_trade & (sign == s), size))
    out = in_bars(seen, every, by).agg(
        _sum(F.col("_paid") * size).alias("eff_spread_sum"), _sum(F.when(spread, size)).alias("eff_spread_weight"), count(spread).alias("eff_spread_count"),
        of(1, F.col("_paid") * size).alias("eff_spread_buy_sum"), of(1, size).alias("eff_spread_buy_weight"), of(-1, F.col("_paid") * size).alias("eff_spread_sell_sum"), of(-1, size).alias("eff_spread_sell_weight"),
        count(F.col("_large")).alias("n_large_trades"), _sum(F.when(F.col("_large"), size)).alias("large_trade_volume"),
        _sum(F.col("_hidden")).alias("hidden_absorption_volume"), count(F.col("_hidden") > 0).alias("hidden_absorption_trades"),
        edge(F.min_by, "B").alias("_b0"), edge(F.max_by, "B").alias("_b1"), edge(F.min_by, "S").alias("_a0"), edge(F.max_by, "S").alias("_a1"), volume(-1).alias("hit_bid_vol"), volume(1).alias("lift_ask_vol"),
        *[count(F.col(f"_{s}_move") == m).alias(f"{s}_{n}_count") for s in ("bid", "ask") for n, m in (("up", 1), ("down", -1))],
        count(is_quote).alias("quote_update_count"),
    )
    none = F.lit(0).cast("long")
    gone = lambda x, v: F.greatest(none, F.coalesce(F.col(f"_{x}0") - F.col(f"_{x}1") - F.col(v), none))
    new = {"net_bid_decrement_no_trade_L1": gone("b", "hit_bid_vol"), "net_ask_decrement_no_trade_L1": gone("a", "lift_ask_vol"), "bid_sz_L1_delta_signed": F.coalesce(F.col("_b1") - F.col("_b0"), none), "ask_sz_L1_delta_signed": F.coalesce(F.col("_a1") - F.col("_a0"), none)}
    return out.withColumns(new).drop("_b0", "_b1", "_a0", "_a1")


def book_snapshot(bars: DataFrame, depth: DataFrame, only_regular: bool = True, by: list[str] | None = None) -> DataFrame:
    """Adds the last bid and ask levels before each bar's end, each side whole, and the later of their times."""
    by = by or KEY
    rows = depth.where("Flags = 0") if only_regular else depth
    part = {"Price": "px", "Size": "sz", "Orders": "ord"}
    levels = lambda side: {f"{side}_{y}_L{k}": f"L{k}{x}" for k in range(1, LEVELS + 1) for x, y in part.items()}
    out = asof_kinds(bars, rows.select(*by, "ts", "seq", "Side", *[f"L{k}{x}" for k in range(1, LEVELS + 1) for x in part]), by, {"B": (levels("bid"), "_bid_ts"), "S": (levels("ask"), "_ask_ts")}, "Side", strict=True)
    return out.withColumn("book_ts_close", F.greatest("_bid_ts", "_ask_ts")).drop("_bid_ts", "_ask_ts")


__all__ = ["first_by", "last_by", "asof", "book_snapshot", "cancel_proxy", "effective_spreads", "execution_bars", "hidden_absorption", "large_trades", "nearest_quantile", "quote_counts", "quote_directions", "split_sides"]
