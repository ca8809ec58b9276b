"""Registered market queries over the driver's tables, each with the same in DuckDB's SQL. Doubles are rounded to six places."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import adapters as ad
from .functions import bar, book, patterns, session
from .functions.along import Along, share
from .operators import asof as asof_op
from .operators import bars as bars_op
from .operators import cross_section as cs
from .operators import boosting, daily, execution, labels, rolls, scoring, sequential
from .plans import panel
from .sources import ingest

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "bars_ohlcv"
EVERY = ad.EVERY
A = Along("instr", ["ts", "seq"])


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a query, and its SQL where there is some."""

    def query(name: str, sql: str | None = None):
        def register(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return register

    return query


query = registrar(QUERIES, ORACLES)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{n}`"), places) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


# --- SQL parts -------------------------------------------------------------------------------------------------------

BAR = "time_bucket(interval '6 hours', ts) + interval '6 hours'"
ET = "timezone('America/New_York', timezone('UTC', ts))"
TRADES = "trades as (select user_id % 4 as instr, ts, event_id as seq, 100 + value as price, 1 + event_id % 50 as quantity, case event_type when 'purchase' then 1 when 'click' then -1 else 0 end as aggressor_sign, event_id % 5 = 0 as is_implied from events where event_type in ('purchase', 'click', 'signup'))"
QUOTES = "quotes as (select user_id % 4 as instr, ts, event_id as seq, case event_type when 'view' then 'bid' else 'ask' end as side, case event_type when 'view' then 100 else 101 end + value as price, 1 + event_id % 40 as size from events where event_type in ('view', 'error'))"
L1 = "l1 as (select *, (bid + ask) / 2 as mid, ask - bid as spread from (select instr, ts, seq, last_value(case when side = 'bid' then price end ignore nulls) over w as bid, last_value(case when side = 'ask' then price end ignore nulls) over w as ask from quotes window w as (partition by instr order by ts, seq rows unbounded preceding)))"
DEPTH = "depth as (select instr, ts, seq, case side when 'bid' then 'B' else 'S' end as side, case when seq % 7 = 0 then 1 else 0 end as flags, " + ", ".join(f"price + (case side when 'bid' then -0.25 else 0.25 end) * {k - 1} as l{k}price, 1 + (seq * 7 + {k * 13}) % 50 as l{k}size, 1 + (seq + {k}) % 9 as l{k}orders" for k in range(1, 11)) + " from quotes)"
FLOW = f"""flow as (select instr, {BAR} as bar, arg_min(price, (ts, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, seq)) as close,
    cast(sum(quantity) as bigint) as volume, sum(price * quantity) as dollar_volume,
    cast(sum(case when aggressor_sign = 1 then quantity else 0 end) as bigint) as buys_qty, cast(sum(case when aggressor_sign = -1 then quantity else 0 end) as bigint) as sells_qty,
    count(*) as trades_count, count(*) filter (aggressor_sign = 0) as unclassified_count,
    cast(sum(case when is_implied then quantity else 0 end) as bigint) as implied_volume, cast(sum(case when is_implied and aggressor_sign = 1 then quantity else 0 end) as bigint) as implied_buys,
    cast(sum(case when is_implied and aggressor_sign = -1 then quantity else 0 end) as bigint) as implied_sells from trades group by 1, 2)"""
QUOTE_BARS = f"""qbars as (select instr, {BAR} as bar, arg_max_null(bid, (ts, seq)) as bid_close, arg_max_null(ask, (ts, seq)) as ask_close, arg_max_null(mid, (ts, seq)) as mid_close, arg_max_null(spread, (ts, seq)) as spread_abs_close,
    avg(spread) as spread_mean_sub, stddev_samp(spread) as spread_std_sub, max(spread) as spread_max_sub, min(spread) as spread_min_sub from l1 group by 1, 2)"""
ZEROS = bars_op.ZEROS
JOINED = f"""joined as (select coalesce(f.instr, q.instr) as instr, coalesce(f.bar, q.bar) as ts, open, high, low, close, {', '.join(f'coalesce({z}, 0) as {z}' for z in ZEROS)}, bid_close, ask_close, mid_close, spread_abs_close, spread_mean_sub, spread_std_sub, spread_max_sub, spread_min_sub
    from flow f full join qbars q on f.instr = q.instr and f.bar = q.bar),
filled as (select * replace ({', '.join(f'last_value({c} ignore nulls) over w as {c}' for c in ('bid_close', 'ask_close', 'mid_close', 'spread_abs_close'))}) from joined window w as (partition by instr order by ts rows unbounded preceding)),
flagged as (select * replace ({', '.join(f'coalesce({c}, mid_close) as {c}' for c in ('open', 'high', 'low', 'close'))}), {ET} as et from filled),
bars as (select * exclude (et),
    hour(et) * 60 + minute(et) between 570 and 960 as is_rth, not (hour(et) = 17 and minute(et) = 0 and second(et) <= 30) as is_session_warm,
    cast(sum(buys_qty - sells_qty) over (partition by instr, date_trunc('week', et) order by ts) as double) as cvd_globex,
    cast(sum(buys_qty - sells_qty) over (partition by instr, rthd order by ts) as double) as cvd_rth,
    row_number() over (partition by instr, rthd order by ts) - 1 as bars_since_rth_reset
    from (select *, case when hour(et) * 60 + minute(et) >= 570 then cast(et as date) else cast(et as date) - 1 end as rthd from flagged))"""
TO_BARS = f"{TRADES}, {QUOTES}, {L1}, {FLOW}, {QUOTE_BARS}, {JOINED}"


def win(n: int, shift: int = 0, by: str = "instr") -> str:
    end = "current row" if shift == 0 else f"{shift} preceding" if shift > 0 else f"{-shift} following"
    a = n - 1 + shift
    start = f"{a} preceding" if a > 0 else "current row" if a == 0 else f"{-a} following"
    return f"over (partition by {by} order by ts rows between {start} and {end})"


def roll(f: str, x: str, n: int, shift: int = 0, least: int | None = None, by: str = "instr") -> str:
    w = win(n, shift, by)
    return f"(case when count({x}) {w} >= {n if least is None else least} then {f}({x}) {w} end)"


def lag(x: str, k: int = 1, by: str = "instr") -> str:
    return f"(lag({x}, {k}) over (partition by {by} order by ts))" if k > 0 else f"(lead({x}, {-k}) over (partition by {by} order by ts))"


def final(columns: dict[str, str], source: str, keys: str = "instr, ts") -> str:
    """select keys and rounded doubles (r:), or other columns as they are."""
    parts = [f"round({e[2:]}, 6) + 0.0 as {n}" if e.startswith("r:") else f"{e} as {n}" for n, e in columns.items()]
    return f"select {keys}, {', '.join(parts)} from {source}"


def r(*names: str) -> dict[str, str]:
    return {n: f"r:{n}" for n in names}


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


EPS = "1e-9"

# --- Bars ------------------------------------------------------------------------------------------------------------

OHLCV = ("open", "high", "low", "close")


@query("bars_ohlcv", f"with {TRADES}, {FLOW} " + final(r(*OHLCV) | same("volume", "buys_qty", "sells_qty", "trades_count"), "flow", "instr, bar as ts"))
def _ohlcv(spark, d):
    return rounded(bars_op.ohlcv(ad.trades(spark, d), EVERY))


CORE_DOUBLES = (*OHLCV, "dollar_volume", "bid_close", "ask_close", "mid_close", "spread_abs_close", "spread_mean_sub", "spread_std_sub", "spread_max_sub", "spread_min_sub", "cvd_globex", "cvd_rth")
CORE_OTHERS = ("volume", "buys_qty", "sells_qty", "trades_count", "unclassified_count", "implied_volume", "implied_buys", "implied_sells", "is_rth", "is_session_warm", "bars_since_rth_reset")


@query("bars_core", f"with {TO_BARS} " + final(r(*CORE_DOUBLES) | same(*CORE_OTHERS), "bars"))
def _core(spark, d):
    return rounded(ad.bars(spark, d).drop("seq"))


@query("bars_trade_quote", f"with {TO_BARS} " + final(r(*OHLCV, "bid_close", "ask_close", "mid_close") | same("volume", "buys_qty", "sells_qty", "trades_count"), "bars"))
def _trade_quote(spark, d):
    return rounded(bars_op.trade_quote_bars(ad.trades(spark, d), ad.quotes(spark, d), EVERY))


@query("quote_stream", f"with {QUOTES}, {L1} " + final(r("bid", "ask", "mid", "spread") | same("seq"), "l1"))
def _stream(spark, d):
    return rounded(bars_op.quote_stream(ad.quotes(spark, d)))


DAY = "time_bucket(interval '1 day', ts) + interval '1 day'"
MOMENTS = f"""moved as (select instr, ts, ln(close / {lag('close')}) as r from bars),
terms as (select *, abs(r) * abs({lag('r')}) as b from moved),
moments as (select instr, {DAY} as day, coalesce(sum(r * r), 0) as rv_5s, pi() / 2 * coalesce(sum(b), 0) as rv_bipower_5s,
    case when stddev_pop(r) > 0 then (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ** 3) / (var_pop(r) ** 1.5) end as realized_skew_5s,
    case when stddev_pop(r) > 0 then (avg(r * r * r * r) - 4 * avg(r) * avg(r * r * r) + 6 * avg(r) ** 2 * avg(r * r) - 3 * avg(r) ** 4) / (var_pop(r) ** 2) - 3 end as realized_kurt_5s,
    coalesce(sum(r * r * r * r), 0) * count(*) / 3.0 as realized_quarticity_5s, count(*) as n_subbars from terms group by 1, 2)"""
FOLDED = f"""folded as (select instr, {DAY} as day, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, {', '.join(f'sum({z}) as {z}' for z in ZEROS)},
    {', '.join(f'arg_max_null({c}, ts) as {c}' for c in ('bid_close', 'ask_close', 'mid_close', 'spread_abs_close', 'cvd_globex', 'cvd_rth', 'bars_since_rth_reset', 'is_rth', 'is_session_warm'))},
    avg(spread_mean_sub) as spread_mean_sub, avg(spread_std_sub) as spread_std_sub, max(spread_max_sub) as spread_max_sub, min(spread_min_sub) as spread_min_sub from bars group by 1, 2)"""
MOMENT_COLUMNS = ("rv_5s", "rv_bipower_5s", "realized_skew_5s", "realized_kurt_5s", "realized_quarticity_5s")


@query("bars_folded_moments", f"with {TO_BARS}, {MOMENTS}, {FOLDED} " + final(r(*CORE_DOUBLES, *MOMENT_COLUMNS) | {z: f"cast({z} as bigint)" for z in ZEROS if z != "dollar_volume"} | same("is_rth", "is_session_warm", "bars_since_rth_reset", "n_subbars"), "folded join moments using (instr, day)", "instr, day as ts"))
def _folded(spark, d):
    return rounded(bars_op.fold_with_moments(ad.bars(spark, d).drop("seq"), "1 day"))


@query("rth_bounded_windows", f"with {TO_BARS}, x as (select *, case when hour({ET}) * 60 + minute({ET}) >= 570 then cast({ET} as date) else cast({ET} as date) - 1 end as rthd from bars) select instr, ts, " + ", ".join(f"round(case when count(*) over w >= 2 then {f}(close) over w end, 6) + 0.0 as close_rth_{n}_w3" for n, f in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_pop"))) + " from x window w as (partition by instr, rthd order by ts rows between 2 preceding and current row)")
def _rth(spark, d):
    rows = ad.bars(spark, d).select("instr", "ts", "close")
    for how in ("max", "min", "mean", "std"):
        rows = bars_op.rth_bounded(rows, "close", 3, 2, how)
    return rounded(rows.drop("close"))


# --- As-of joins and execution ---------------------------------------------------------------------------------------

ASOF_MID = "hit as (select t.*, m.mid, m.ts as mid_ts from trades t asof left join l1 m on t.instr = m.instr and t.ts > m.ts)"


@query("asof_strict_tolerance", f"with {TRADES}, {QUOTES}, {L1}, {ASOF_MID} select instr, ts, seq, round(case when ts - mid_ts <= interval '1800 seconds' then mid end, 6) + 0.0 as mid, case when ts - mid_ts <= interval '1800 seconds' then mid_ts end as mid_ts from hit")
def _tolerance(spark, d):
    mids = bars_op.quote_stream(ad.quotes(spark, d)).select("instr", "ts", "seq", "mid")
    return rounded(asof_op.asof(ad.trades(spark, d), mids, ["instr"], strict=True, within=1800, carry="mid_ts").select("instr", "ts", "seq", "mid", "mid_ts"))


@query("asof_inclusive", f"with {TO_BARS}, e as (select user_id % 4 as instr, ts, value from events where event_type = 'view' union all select instr, ts, -1.0 from bars where hour(ts) = 12) select b.instr, b.ts, round(e.value, 6) + 0.0 as value from bars b asof left join e on b.instr = e.instr and b.ts >= e.ts")
def _inclusive(spark, d):
    b = ad.bars(spark, d).select("instr", "ts", "seq")
    e = ad.table(spark, d, "events").where("event_type = 'view'").select((F.col("user_id") % 4).alias("instr"), "ts", "value")
    e = e.unionByName(b.where(F.hour("ts") == 12).select("instr", "ts", F.lit(-1.0).alias("value")))
    return rounded(asof_op.asof(b, e, ["instr"]).drop("seq"))


EFF = f"""{ASOF_MID}, eff as (select *, case aggressor_sign when 0 then 2 * abs(price - mid) else 2.0 * aggressor_sign * (price - mid) end as e from hit where mid is not null),
effective as (select instr, {BAR} as bar, sum(e * quantity) as eff_spread_sum, cast(sum(quantity) as bigint) as eff_spread_weight, count(*) as eff_spread_count,
    sum(case when aggressor_sign = 1 then e * quantity else 0 end) as eff_spread_buy_sum, cast(sum(case when aggressor_sign = 1 then quantity else 0 end) as bigint) as eff_spread_buy_weight,
    sum(case when aggressor_sign = -1 then e * quantity else 0 end) as eff_spread_sell_sum, cast(sum(case when aggressor_sign = -1 then quantity else 0 end) as bigint) as eff_spread_sell_weight from eff group by 1, 2)"""
EFF_DOUBLES, EFF_COUNTS = ("eff_spread_sum", "eff_spread_buy_sum", "eff_spread_sell_sum"), ("eff_spread_weight", "eff_spread_count", "eff_spread_buy_weight", "eff_spread_sell_weight")


@query("exec_effective_spread", f"with {TRADES}, {QUOTES}, {L1}, {EFF} " + final(r(*EFF_DOUBLES) | same(*EFF_COUNTS), "effective", "instr, bar as ts"))
def _effective(spark, d):
    return rounded(execution.effective_spreads(ad.trades(spark, d), ad.quotes(spark, d), EVERY))


LARGE = f"""ranked as (select *, row_number() over (partition by instr, cast(ts as date) order by quantity) as k, count(*) over (partition by instr, cast(ts as date)) as n from trades),
edges as (select instr, cast(ts as date) as day, quantity as edge from ranked where k = 1 + round(0.9 * (n - 1))),
large as (select t.instr, {BAR.replace('ts', 't.ts')} as bar, count(*) filter (quantity > edge) as n_large_trades, cast(sum(case when quantity > edge then quantity else 0 end) as bigint) as large_trade_volume from trades t join edges e on t.instr = e.instr and cast(t.ts as date) = e.day group by 1, 2)"""


@query("exec_large_trades", f"with {TRADES}, {LARGE} select instr, bar as ts, n_large_trades, large_trade_volume from large")
def _large(spark, d):
    return execution.large_trades(ad.trades(spark, d), EVERY, 0.9)


HIDDEN = f"""regular as (select * from depth where flags = 0), bids as (select * from regular where side = 'B'), asks as (select * from regular where side = 'S'),
touch as (select t.*, a.l1price as apx, a.l1size as asz, b.l1price as bpx, b.l1size as bsz from trades t asof left join asks a on t.instr = a.instr and t.ts > a.ts asof left join bids b on t.instr = b.instr and t.ts > b.ts),
over_ as (select *, case when aggressor_sign = 1 and price = apx and quantity > asz then quantity - asz when aggressor_sign = -1 and price = bpx and quantity > bsz then quantity - bsz else 0 end as h from touch),
hidden as (select instr, {BAR} as bar, cast(sum(h) as bigint) as hidden_absorption_volume, count(*) filter (h > 0) as hidden_absorption_trades from over_ group by 1, 2)"""


def _at_touch(spark, d):
    """Trades moved to the touch just before them, so that hidden size occurs: the tables' prices seldom meet."""
    t, depth = ad.trades(spark, d), ad.depth(spark, d)
    bid, ask = execution.split_sides(depth)
    rows = asof_op.asof(t, ask.select("instr", "ts", "seq", F.col("ask_px_L1").alias("_a")), ["instr"], strict=True)
    rows = asof_op.asof(rows, bid.select("instr", "ts", "seq", F.col("bid_px_L1").alias("_b")), ["instr"], strict=True)
    return rows.withColumn("price", F.when(F.col("aggressor_sign") == 1, F.coalesce("_a", "price")).when(F.col("aggressor_sign") == -1, F.coalesce("_b", "price")).otherwise(F.col("price"))).drop("_a", "_b")


@query("exec_hidden_absorption", f"with {TRADES}, {QUOTES}, {DEPTH}, " + HIDDEN.replace("price = apx and", "apx is not null and").replace("price = bpx and", "bpx is not null and") + " select instr, bar as ts, hidden_absorption_volume, hidden_absorption_trades from hidden")
def _hidden(spark, d):
    return execution.hidden_absorption(_at_touch(spark, d), ad.depth(spark, d), EVERY)


CANCEL = f"""reg as (select * from depth where flags = 0),
b0 as (select instr, {BAR} as bar, arg_min(l1size, (ts, seq)) as f, arg_max(l1size, (ts, seq)) as l from reg where side = 'B' group by 1, 2),
a0 as (select instr, {BAR} as bar, arg_min(l1size, (ts, seq)) as f, arg_max(l1size, (ts, seq)) as l from reg where side = 'S' group by 1, 2),
t0 as (select instr, {BAR} as bar, cast(sum(case when aggressor_sign = -1 then quantity else 0 end) as bigint) as hit, cast(sum(case when aggressor_sign = 1 then quantity else 0 end) as bigint) as lift from trades group by 1, 2),
cancel as (select coalesce(b0.instr, a0.instr, t0.instr) as instr, coalesce(b0.bar, a0.bar, t0.bar) as bar, greatest(0, b0.f - b0.l - coalesce(hit, 0)) as net_bid_decrement_no_trade_L1, greatest(0, a0.f - a0.l - coalesce(lift, 0)) as net_ask_decrement_no_trade_L1,
    b0.l - b0.f as bid_sz_L1_delta_signed, a0.l - a0.f as ask_sz_L1_delta_signed, coalesce(hit, 0) as hit_bid_vol, coalesce(lift, 0) as lift_ask_vol
    from b0 full join a0 on b0.instr = a0.instr and b0.bar = a0.bar full join t0 on coalesce(b0.instr, a0.instr) = t0.instr and coalesce(b0.bar, a0.bar) = t0.bar)"""
CANCEL_COLUMNS = ("net_bid_decrement_no_trade_L1", "net_ask_decrement_no_trade_L1", "bid_sz_L1_delta_signed", "ask_sz_L1_delta_signed", "hit_bid_vol", "lift_ask_vol")


@query("exec_cancel_proxy", f"with {TRADES}, {QUOTES}, {DEPTH}, {CANCEL} select instr, bar as ts, {', '.join(CANCEL_COLUMNS)} from cancel")
def _cancel(spark, d):
    return execution.cancel_proxy(ad.trades(spark, d), ad.depth(spark, d), EVERY)


DIRECTION = f"""dirs as (select *, sign(price - lag(price) over (partition by instr, side order by ts, seq)) as m from quotes),
direction as (select instr, {BAR} as bar, {', '.join(f"case when count(*) filter (side = '{s}') > 0 then count(*) filter (side = '{s}' and m = {v}) end as {s}_{n}_count" for s in ('bid', 'ask') for n, v in (('up', 1), ('down', -1)))}, count(*) as quote_update_count from dirs group by 1, 2)"""
DIRECTION_COLUMNS = ("bid_up_count", "bid_down_count", "ask_up_count", "ask_down_count")


@query("exec_quote_direction", f"with {QUOTES}, {DIRECTION} select instr, bar as ts, {', '.join(DIRECTION_COLUMNS)}, quote_update_count from direction")
def _direction(spark, d):
    q = ad.quotes(spark, d)
    return execution.quote_directions(q, EVERY).join(execution.quote_counts(q, EVERY), ["instr", "ts"])


EXEC_KEYS = ("effective", "large", "hidden", "cancel", "direction")
EXEC_SQL = f"{TRADES}, {QUOTES}, {L1}, {DEPTH}, {EFF}, {LARGE.replace('0.9 *', '0.99 *')}, {HIDDEN}, {CANCEL}, {DIRECTION}, keys as ({' union '.join(f'select instr, bar from {k}' for k in EXEC_KEYS)}), exec as (select * from keys {' '.join(f'left join {k} using (instr, bar)' for k in EXEC_KEYS)})"
EXEC_COUNTS = (*EFF_COUNTS, "n_large_trades", "large_trade_volume", "hidden_absorption_volume", "hidden_absorption_trades", *CANCEL_COLUMNS, *DIRECTION_COLUMNS, "quote_update_count")


@query("exec_bars", f"with {EXEC_SQL} " + final({c: f"r:coalesce({c}, 0.0)" for c in EFF_DOUBLES} | {c: f"cast(coalesce({c}, 0) as bigint)" for c in EXEC_COUNTS}, "exec", "instr, bar as ts"))
def _exec(spark, d):
    return rounded(execution.execution_bars(ad.trades(spark, d), ad.quotes(spark, d), ad.depth(spark, d), EVERY))


@query("exec_bars_folded", f"with {EXEC_SQL}, e2 as (select *, bar as ts from exec) select instr, {DAY} as ts, " + ", ".join([f"round(sum(coalesce({c}, 0.0)), 6) + 0.0 as {c}" for c in EFF_DOUBLES] + [f"cast(sum(coalesce({c}, 0)) as bigint) as {c}" for c in EXEC_COUNTS]) + " from e2 group by 1, 2")
def _exec_folded(spark, d):
    return rounded(bars_op.fold_bars(execution.execution_bars(ad.trades(spark, d), ad.quotes(spark, d), ad.depth(spark, d), EVERY), "1 day", rules={}, otherwise="sum"))


LEVEL_SQL = {f"{s}_{x}_L{k}": f"{s}s_.l{k}{y}" for s in ("bid", "ask") for x, y in (("px", "price"), ("sz", "size"), ("ord", "orders")) for k in range(1, 11)}
SNAP = f"reg as (select * from depth where flags = 0), bids_ as (select * from reg where side = 'B'), asks_ as (select * from reg where side = 'S'), snap as (select b.*, {', '.join(f'{e} as {n}' for n, e in LEVEL_SQL.items())}, greatest(bids_.ts, asks_.ts) as book_ts_close from bars b asof left join bids_ on b.instr = bids_.instr and b.ts > bids_.ts asof left join asks_ on b.instr = asks_.instr and b.ts > asks_.ts)"


def _snapshot(spark, d):
    return execution.book_snapshot(ad.bars(spark, d), ad.depth(spark, d))


@query("book_snapshot", f"with {TO_BARS}, {DEPTH}, {SNAP} " + final({n: f"r:{n}" if "_px_" in n else n for n in LEVEL_SQL} | same("book_ts_close"), "snap"))
def _snap(spark, d):
    return rounded(_snapshot(spark, d).select("instr", "ts", *LEVEL_SQL, "book_ts_close"))


# --- Features --------------------------------------------------------------------------------------------------------

N = 5


def corr_sql(x: str, y: str, n: int, name: str) -> tuple[str, str, str]:
    """Columns of three stacked selects for a deviation correlation."""
    return f"{x} - {roll('avg', x, n)} as dx_{name}, {y} - {roll('avg', y, n)} as dy_{name}", f"{roll('avg', f'dx_{name} * dy_{name}', n)} as c_{name}, {roll('avg', f'dx_{name} * dx_{name}', n)} as vx_{name}, {roll('avg', f'dy_{name} * dy_{name}', n)} as vy_{name}", f"case when sqrt(vx_{name} * vy_{name}) > 0 then c_{name} / sqrt(vx_{name} * vy_{name}) end"


_AC, _PV = corr_sql("log_return", "lr1", N, "ac"), corr_sql("log_return", "log_volume", N, "pv")
SKEW = f"case when count(log_return) {win(N)} >= {N} then (avg(log_return ** 3) {win(N)} - 3 * avg(log_return) {win(N)} * avg(log_return ** 2) {win(N)} + 2 * (avg(log_return) {win(N)}) ** 3) / (var_pop(log_return) {win(N)} ** 1.5) * sqrt({N} * ({N} - 1)) / ({N} - 2) end"
KURT = f"case when count(log_return) {win(N)} >= {N} then (avg(log_return ** 4) {win(N)} - 4 * avg(log_return) {win(N)} * avg(log_return ** 3) {win(N)} + 6 * (avg(log_return) {win(N)}) ** 2 * avg(log_return ** 2) {win(N)} - 3 * (avg(log_return) {win(N)}) ** 4) / (var_pop(log_return) {win(N)} ** 2) - 3 end"
BASE = f"""f1 as (select *, ln(close / {lag('close')}) as log_return, ln(1 + volume) as log_volume, (buys_qty - sells_qty) / (buys_qty + sells_qty + {EPS}) as ofi, buys_qty / (buys_qty + sells_qty + {EPS}) as aggressor_ratio, buys_qty - sells_qty as net_aggressor_volume,
    cvd_globex - {lag('cvd_globex')} as cvd_change, spread_abs_close / (mid_close + {EPS}) * 10000 as spread_to_mid_bps, {roll('sum', 'volume', N)} as rolling_volume_sum_w5, {roll('stddev_samp', 'volume', N)} as rolling_volume_std_w5,
    volume / (trades_count + {EPS}) as average_trade_size, ln(1 + trades_count) as trades_count_log, {roll('avg', 'trades_count', N)} as rolling_trade_count_mean_w5, spread_std_sub / (spread_mean_sub + {EPS}) as spread_sub_var_ratio,
    implied_volume / (volume + {EPS}) as implied_volume_share, (implied_buys - implied_sells) / (implied_volume + {EPS}) as implied_aggressor_skew from bars),
f2 as (select *, {lag('log_return')} as lr1, abs(log_return) as abs_log_return, ln(high / low) ** 2 as hl2, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 as gk, abs(log_return) / (volume * close + {EPS}) as ill, case when log_return > 0 then log_return end as up, case when log_return < 0 then log_return end as dn from f1),
f3 as (select *, {roll('stddev_pop', 'log_return', N)} as realized_vol_w5, {roll('stddev_pop', 'log_return', 10)} as realized_vol_w10, log_volume - {roll('avg', 'log_volume', N)} as vol_surprise_w5, sqrt(greatest(0, {roll('avg', 'hl2', N)} / (4 * ln(2)))) as pk0, {roll('avg', 'gk', N)} as gk0,
    coalesce({roll('stddev_samp', 'up', N)}, 0) as up_vol_w5, coalesce({roll('stddev_samp', 'dn', N)}, 0) as down_vol_w5, {SKEW} as rolling_skew_w5, {KURT} as rolling_kurt_w5, {roll('avg', 'ill', N)} as amihud_illiq_w5,
    {roll('sum', '(high + low + close) / 3 * volume', N)} / ({roll('sum', 'volume', N)} + {EPS}) as vwap, {roll('sum', 'volume', N)} as vsum, {_AC[0]}, {_PV[0]},
    close - sum((high + low + close) / 3.0 * volume) over (partition by instr, cast({ET} as date) order by ts) / (sum(volume) over (partition by instr, cast({ET} as date) order by ts) + {EPS}) as vwap_deviation from f2),
f4 as (select *, {_AC[1]}, {_PV[1]}, case when vsum > {EPS} and {lag('vsum')} > {EPS} and vwap / {lag('vwap')} > 0 then ln(vwap / {lag('vwap')}) end as vwap_return_w5,
    down_vol_w5 / (up_vol_w5 + {EPS}) as vol_direction_ratio_w5, {roll('stddev_samp', 'realized_vol_w5', 10)} as vol_of_vol_w10, log_return / ({lag('realized_vol_w5')} + {EPS}) as jump_indicator_w5, realized_vol_w5 / (realized_vol_w10 + {EPS}) as vol_ratio_short_long from f3),
base as (select *, case when pk0 is not null and {roll('avg', 'hl2', N)} is not null then pk0 end as range_vol_parkinson_w5, case when gk0 is not null then sqrt(greatest(0, gk0)) end as range_vol_gk_w5, {_AC[2]} as return_autocorr_lag1_w5, {_PV[2]} as price_volume_corr_w5, case when vy_pv > 0 then c_pv / vy_pv end as price_impact_slope_w5 from f4)"""
BASE_DOUBLES = ("log_return", "abs_log_return", "log_volume", "ofi", "aggressor_ratio", "cvd_change", "spread_to_mid_bps", "rolling_volume_std_w5", "average_trade_size", "trades_count_log", "rolling_trade_count_mean_w5", "spread_sub_var_ratio", "implied_volume_share", "implied_aggressor_skew", "realized_vol_w5", "realized_vol_w10", "vol_surprise_w5", "range_vol_parkinson_w5", "range_vol_gk_w5", "up_vol_w5", "down_vol_w5", "rolling_skew_w5", "rolling_kurt_w5", "amihud_illiq_w5", "return_autocorr_lag1_w5", "vwap_return_w5", "price_volume_corr_w5", "price_impact_slope_w5", "vol_direction_ratio_w5", "vol_of_vol_w10", "jump_indicator_w5", "vol_ratio_short_long", "vwap_deviation")


def _base(spark, d):
    return panel.base_features(ad.bars(spark, d), rv=(5, 10), ranges=(5,), surprise=(5,), moments=5, asymmetry=5, auto=5, short=5, long=10, roll=5)


@query("features_base", f"with {TO_BARS}, {BASE} " + final(r(*BASE_DOUBLES) | {"net_aggressor_volume": "net_aggressor_volume", "rolling_volume_sum_w5": "cast(rolling_volume_sum_w5 as bigint)"}, "base"))
def _features(spark, d):
    return rounded(_base(spark, d).select("instr", "ts", *BASE_DOUBLES, "net_aggressor_volume", "rolling_volume_sum_w5"))


MORE = f"""g1 as (select *, ln(close / {lag('close')}) as lr, ln(1 + volume) as lv, ln(close / {lag('close', 3)}) as log_return_h3, ln(close / first_value(close) over (partition by instr order by ts)) as cumulative_return, {roll('sum', 'volume', N)} / (1000 + {EPS}) as turnover, hour({ET}) as hh from bars),
g2 as (select *, {roll('stddev_pop', 'lr', N)} as rv, (lv - {roll('avg', 'lv', N, 1)}) / ({roll('stddev_pop', 'lv', N, 1)} + {EPS}) as volume_surprise_z, lv - {roll('avg', 'lv', 4, by='instr, hh')} as seasonal_deviation, buys_qty / (volume + {EPS}) as large_share, spread_abs_close * (buys_qty - sells_qty) / (buys_qty + sells_qty + {EPS}) as side_spread, dollar_volume / (volume + {EPS}) as at_price from g1)"""


@query(
    "features_bar_more",
    f"with {TO_BARS}, {MORE}, g3 as (select *, case when abs(lr / ({lag('rv')} + {EPS})) > 3 then 1 when lr is null or {lag('rv')} is null then null else 0 end as jump_flag, case when abs(lr) > 1.5 * {lag('rv')} then 1 when lr is null or {lag('rv')} is null then null else 0 end as jj from g2) "
    + final(r("log_return_h3", "cumulative_return", "turnover", "volume_surprise_z", "seasonal_deviation", "large_share", "side_spread", "at_price") | {"jump_flag": "jump_flag", "jump_intensity": f"cast(sum(jj) {win(N)} as bigint)"}, "g3"),
)
def _more(spark, d):
    c = F.col
    rows = ad.bars(spark, d).withColumns({"lr": bar.log_return(A, F.col("close")), "lv": bar.log_volume(F.col("volume")), "hh": F.hour(session.eastern(F.col("ts")))})
    rows = rows.withColumn("rv", bar.realized_volatility(A, c("lr"), N))
    return rounded(rows.select(
        "instr", "ts",
        bar.log_return(A, c("close"), 3).alias("log_return_h3"), bar.cumulative_return(A, c("close")).alias("cumulative_return"), bar.turnover(A, c("volume"), F.lit(1000), N).alias("turnover"),
        bar.volume_surprise(A, c("lv"), N).alias("volume_surprise_z"), bar.seasonal_deviation(Along(["instr", "hh"], ["ts", "seq"]), c("lv"), 4).alias("seasonal_deviation"),
        share(c("buys_qty"), c("volume")).alias("large_share"), bar.topbook_side_spread(c("buys_qty"), c("sells_qty"), c("spread_abs_close")).alias("side_spread"), share(c("dollar_volume"), c("volume")).alias("at_price"),
        bar.jump(A, c("lr"), c("rv")).alias("jump_flag"), bar.jump_intensity(A, c("lr"), c("rv"), N, 1.5).alias("jump_intensity"),
    ))


@query(
    "features_calendar",
    f"with {TO_BARS}, e as (select *, {ET} as et from bars), h as (select *, hour(et) as h from e) select instr, ts, case when dayofweek(ts) = 1 then 1 else 0 end as is_monday, case when dayofweek(ts) = 5 then 1 else 0 end as is_friday, case when day(ts) = 1 then 1 else 0 end as is_month_start, case when cast(ts as date) = last_day(ts) then 1 else 0 end as is_month_end, cast(hour(ts) * 60 + minute(ts) as integer) as minute_of_day, case when h * 60 + minute(et) between 945 and 960 then 1 else 0 end as settlement_window, cast(h as integer) as hour_et, case when h >= 18 or h < 3 then 1 else 0 end as is_asia, case when h >= 3 and h < 9 then 1 else 0 end as is_eu, case when h >= 9 and h < 16 then 1 else 0 end as is_rth, case when h >= 16 and h < 18 then 1 else 0 end as is_eth, case when h >= 18 or h < 3 then 'ASIA' when h < 9 then 'EU' when h < 16 then 'RTH' else 'ETH' end as session, round(sin((h * 60 + minute(et)) / 1440.0 * 2 * pi()), 6) + 0.0 as minute_of_day_sin, round(cos((h * 60 + minute(et)) / 1440.0 * 2 * pi()), 6) + 0.0 as minute_of_day_cos from h",
)
def _calendar(spark, d):
    rows = session.cyclic_minute(session.session_flags(ad.bars(spark, d)))
    ts = F.col("ts")
    return rounded(rows.select("instr", "ts", bar.is_weekday(ts, 0).alias("is_monday"), bar.is_weekday(ts, 4).alias("is_friday"), bar.is_month_start(ts).alias("is_month_start"), bar.is_month_end(ts).alias("is_month_end"), bar.minute_of_day(ts).alias("minute_of_day"), bar.settlement_window(session.eastern(ts)).alias("settlement_window"), "hour_et", "is_asia", "is_eu", "is_rth", "is_eth", session.session_name(F.col("hour_et")).alias("session"), "minute_of_day_sin", "minute_of_day_cos"))


TOP = f"""t1 as (select *, (bid_px_L1 + ask_px_L1) / 2 as mid, (bid_px_L1 * ask_sz_L1 + ask_px_L1 * bid_sz_L1) / (bid_sz_L1 + ask_sz_L1 + {EPS}) as mp, (bid_sz_L1 - ask_sz_L1) / (bid_sz_L1 + ask_sz_L1 + {EPS}) as oi, ask_px_L1 - bid_px_L1 as sp, sum(0) over () as z from snap),
t2 as (select *, last_value(mp ignore nulls) over (partition by instr order by ts rows unbounded preceding) as mpf, ln(mid / {lag('mid')}) as mid_return, sp / (mid + {EPS}) * 10000 as bps from t1),
t3 as (select *, {roll('stddev_samp', 'mid_return', N)} as tick_volatility from t2)"""


@query("features_top_of_book", f"with {TO_BARS}, {DEPTH}, {SNAP}, {TOP} " + final(r("mid", "mid_return", "tick_volatility") | {"microprice": "r:mp", "microprice_drift": f"r:ln(mpf / {lag('mpf')})", "order_imbalance": "r:oi", "order_imbalance_w5": f"r:{roll('avg', 'oi', N)}", "spread_abs": "r:sp", "spread_rel_bps": "r:bps", "spread_volatility_ratio": f"r:case when tick_volatility > 1e-6 then bps / (tick_volatility + {EPS}) end", "quote_slope_proxy": f"r:sp / (bid_sz_L1 + ask_sz_L1 + {EPS})", "vol_of_vol": f"r:{roll('stddev_samp', 'tick_volatility', N)}"}, "t3"))
def _top(spark, d):
    b, c = book.Book(), F.col
    rows = _snapshot(spark, d).withColumns({"mid": b.mid(), "mp": bar.microprice(b("bid_px"), b("ask_px"), b("bid_sz"), b("ask_sz")), "sp": b.spread()})
    rows = rows.withColumns({"mpf": A.fill(c("mp")), "mid_return": F.ln(c("mid") / A.lag(c("mid"))), "bps": bar.spread_bps(c("sp"), c("mid"))}).withColumn("tick_volatility", A.std(c("mid_return"), N))
    return rounded(rows.select("instr", "ts", "mid", "mid_return", "tick_volatility", c("mp").alias("microprice"), bar.microprice_drift(A, c("mpf")).alias("microprice_drift"), bar.order_imbalance(A, b("bid_sz"), b("ask_sz")).alias("order_imbalance"), bar.order_imbalance(A, b("bid_sz"), b("ask_sz"), N).alias("order_imbalance_w5"), c("sp").alias("spread_abs"), c("bps").alias("spread_rel_bps"), F.when(c("tick_volatility") > 1e-6, share(c("bps"), c("tick_volatility"))).alias("spread_volatility_ratio"), share(c("sp"), b("bid_sz") + b("ask_sz")).alias("quote_slope_proxy"), A.std(c("tick_volatility"), N).alias("vol_of_vol")))


def ofi_sql(k: int, p: str = "") -> str:
    b, bs, a, s = (f"{p}{x}_L{k}" for x in ("bid_px", "bid_sz", "ask_px", "ask_sz"))
    return f"((case when {b} > {lag(b)} then {bs} when {b} = {lag(b)} then {bs} - {lag(bs)} else -{lag(bs)} end) + (case when {a} < {lag(a)} then -{s} when {a} = {lag(a)} then {lag(s)} - {s} else {lag(s)} end))"


def imb_sql(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / (({a}) + ({b}) + {EPS})"


D = 10
_sum = lambda f, n=D: "(" + " + ".join(f(k) for k in range(1, n + 1)) + ")"
_sz = lambda s, n=D: _sum(lambda k: f"{s}_sz_L{k}", n)
DEEP = {
    "cum_imbalance_d10": _sum(lambda k: imb_sql(f"bid_sz_L{k}", f"ask_sz_L{k}")),
    "dw_imbalance_d10": imb_sql(*[_sum(lambda k, s=s: f"{s}_sz_L{k} / (1 + abs({s}_px_L{k} - (bid_px_L1 + ask_px_L1) / 2))") for s in ("bid", "ask")]),
    "depth_weighted_spread_d10": f"{_sum(lambda k: f'(ask_px_L{k} - bid_px_L{k}) * ({_sz(chr(98) + chr(105) + chr(100), k)} + {_sz(chr(97) + chr(115) + chr(107), k)})')} / ({_sz('bid')} + {_sz('ask')} + {EPS})",
    "liquidity_adjusted_spread_d10": f"{_sum(lambda k: f'(ask_px_L{k} - bid_px_L{k}) / (bid_sz_L{k} + ask_sz_L{k} + {EPS})')} / 10",
    "spread_acceleration": "(ask_px_L3 - bid_px_L3) - 2 * (ask_px_L2 - bid_px_L2) + (ask_px_L1 - bid_px_L1)",
    "hhi_bid_d10": _sum(lambda k: f"(bid_sz_L{k} / ({_sz('bid')} + {EPS})) ** 2"),
    "hhi_ask_d10": _sum(lambda k: f"(ask_sz_L{k} / ({_sz('ask')} + {EPS})) ** 2"),
    "deep_ofi_d10_decay0": f"cast({_sum(ofi_sql)} as double)",
    "deep_ofi_d10_decay03": _sum(lambda k: f"exp(-0.3 * {k - 1}) * {ofi_sql(k)}"),
    "spread_zscore_w5": f"((ask_px_L1 - bid_px_L1) - {roll('avg', '(ask_px_L1 - bid_px_L1)', N)}) / ({roll('stddev_samp', '(ask_px_L1 - bid_px_L1)', N)} + {EPS})",
    **{f"volume_imbalance_L{k}": imb_sql(f"bid_sz_L{k}", f"ask_sz_L{k}") for k in range(1, 11)},
    **{f"basic_spread_L{k}": f"ask_px_L{k} - bid_px_L{k}" for k in range(1, 11)},
    **{f"ofi_at_L{k}": f"cast({ofi_sql(k)} as double)" for k in range(1, 11)},
    **{f"order_count_imbalance_L{k}": imb_sql(f"bid_ord_L{k}", f"ask_ord_L{k}") for k in range(1, 6)},
    **{f"order_size_imbalance_L{k}": imb_sql(f"bid_sz_L{k} / (bid_ord_L{k} + {EPS})", f"ask_sz_L{k} / (ask_ord_L{k} + {EPS})") for k in range(1, 6)},
}
MIGRATION = {f"{s}_migration_L1_to_L{k}": f"-({s}_sz_L1 - {lag(f'{s}_sz_L1')}) + ({s}_sz_L{k} - {lag(f'{s}_sz_L{k}')})" for s in ("bid", "ask") for k in (2, 3)}


@query("features_deep_book", f"with {TO_BARS}, {DEPTH}, {SNAP} " + final({n: f"r:{e}" for n, e in DEEP.items()} | MIGRATION, "snap"))
def _deep(spark, d):
    return rounded(panel.book_features(_snapshot(spark, d), 10, N).select("instr", "ts", *DEEP, *MIGRATION))


PAT = f"""p1 as (select *, range_vol_parkinson_w5 * close as x, case when ofi > 0 then 1 when ofi < 0 then -1 else 0 end as so from base),
p2 as (select *, {roll('max', 'high', 4, 1)} as ph, {roll('min', 'low', 4, 1)} as pl, {roll('avg', 'volume', 4, 1)} as pv, {roll('max', 'cvd_globex', 4, 1)} as pcx, {roll('min', 'cvd_globex', 4, 1)} as pcn from p1),
p3 as (select *, case when high > ph then (high - ph) / (x + {EPS}) else 0.0 end as bmu, case when low < pl then (pl - low) / (x + {EPS}) else 0.0 end as bmd,
    cast((high > ph and close < ph - 0.5 * x) as integer) as bru, cast((low < pl and close > pl + 0.5 * x) as integer) as brd, cast((volume > 3 * pv and {lag('volume', -1)} < pv / 3) as integer) as saf, {roll('sum', 'so', 4)} as runl,
    cast((high > ph and cvd_globex <= pcx) as integer) as du, cast((low < pl and cvd_globex >= pcn) as integer) as dd, {roll('stddev_samp', '(high - low)', 5)} / (x + {EPS}) as rc,
    {roll('sum', 'abs((buys_qty - sells_qty) * close)', 5)} / ({roll('avg', f'(realized_vol_w10 * (close * volume) + {EPS})', 5)} * 5 + {EPS}) as ab from p2)"""


@query("features_patterns", f"with {TO_BARS}, {BASE}, {PAT} " + final({"breakout_magnitude_up": "r:bmu", "breakout_magnitude_down": "r:bmd", "breakout_reversal_up": "bru", "breakout_reversal_down": "brd", "spike_and_fade": "saf", "run_length": "cast(runl as bigint)", "divergence_up": "du", "divergence_down": "dd", "range_compression": "r:rc", "absorption": "r:ab", "flow_after_up": f"r:case when bru > 0 then {roll('sum', 'ofi', 3, -3)} else 0.0 end", "flow_after_down": f"r:case when brd > 0 then {roll('sum', 'ofi', 3, -3)} else 0.0 end", "hidden_ratio": f"r:{roll('sum', 'implied_volume', 4)} / ({roll('sum', 'volume', 4)} + {EPS})"}, "p3"))
def _patterns(spark, d):
    c = F.col
    rows = _base(spark, d).withColumn("x", F.col("range_vol_parkinson_w5") * F.col("close"))
    rows = rows.withColumns({"breakout_reversal_up": patterns.breakout_reversal(A, c("high"), c("close"), c("x"), 4), "breakout_reversal_down": patterns.breakout_reversal(A, c("low"), c("close"), c("x"), 4, up=False)})
    return rounded(rows.select("instr", "ts", patterns.breakout_magnitude(A, c("high"), c("x"), 4).alias("breakout_magnitude_up"), patterns.breakout_magnitude(A, c("low"), c("x"), 4, up=False).alias("breakout_magnitude_down"), "breakout_reversal_up", "breakout_reversal_down", patterns.spike_and_fade(A, c("volume"), 4).alias("spike_and_fade"), patterns.run_length(A, c("ofi"), 4).alias("run_length"), patterns.flow_divergence(A, c("cvd_globex"), c("high"), 4).alias("divergence_up"), patterns.flow_divergence(A, c("cvd_globex"), c("low"), 4, up=False).alias("divergence_down"), patterns.range_compression(A, c("high"), c("low"), c("x"), 5).alias("range_compression"), patterns.absorption(A, (c("buys_qty") - c("sells_qty")) * c("close"), c("realized_vol_w10"), c("close") * c("volume"), 5).alias("absorption"), patterns.flow_after(A, c("breakout_reversal_up"), c("ofi")).alias("flow_after_up"), patterns.flow_after(A, c("breakout_reversal_down"), c("ofi")).alias("flow_after_down"), patterns.rolling_ratio(A, c("implied_volume"), c("volume"), 4).alias("hidden_ratio")))


# Two books side by side: instruments 0 and 1 at the same times.
PAIR = "pair as (select a.ts, 0 as instr, " + ", ".join(f"{t}.{x}_L{k} as {p}_{x}_L{k}" for t, p in (("a", "P"), ("b", "Q")) for x in ("bid_px", "ask_px", "bid_sz", "ask_sz") for k in (1, 2, 3)) + " from snap a join snap b on a.ts = b.ts and a.instr = 0 and b.instr = 1)"
_PX, _LL1, _LL2, _OC = corr_sql("ra", "rb", N, "px"), corr_sql("ra", "rb1", N, "l1"), corr_sql("ra1", "rb", N, "l2"), corr_sql("oa", "ob", N, "oc")
PAIRS = f"""{PAIR}, q1 as (select *, (P_bid_px_L1 + P_ask_px_L1) / 2 as ma, (Q_bid_px_L1 + Q_ask_px_L1) / 2 as mb, P_bid_sz_L1 - P_ask_sz_L1 as oa, Q_bid_sz_L1 - Q_ask_sz_L1 as ob from pair),
q2 as (select *, ln(ma / {lag('ma')}) as ra, ln(mb / {lag('mb')}) as rb, ma - mb as ms from q1), q3 as (select *, {lag('ra')} as ra1, {lag('rb')} as rb1 from q2),
q4 as (select *, {_PX[0]}, {_LL1[0]}, {_LL2[0]}, {_OC[0]} from q3), q5 as (select *, {_PX[1]}, {_LL1[1]}, {_LL2[1]}, {_OC[1]} from q4)"""
_mp = lambda p: f"({p}_bid_px_L1 * {p}_ask_sz_L1 + {p}_ask_px_L1 * {p}_bid_sz_L1) / ({p}_bid_sz_L1 + {p}_ask_sz_L1 + {EPS})"
_di = lambda p: imb_sql(*[" + ".join(f"{p}_{s}_sz_L{k}" for k in (1, 2, 3)) for s in ("bid", "ask")])
_rs = lambda p, m: f"({p}_ask_px_L1 - {p}_bid_px_L1) / ({m} + {EPS})"
PAIR_COLUMNS = {
    "cross_correlation": _PX[2], "lead_lag_asymmetry": f"({_LL1[2]}) - ({_LL2[2]})", "ofi_correlation": _OC[2], "microprice_diff": f"{_mp('P')} - {_mp('Q')}", "depth_imbalance_diff": f"{_di('P')} - {_di('Q')}",
    "pairs_spread_zscore": f"(ms - {roll('avg', 'ms', N)}) / ({roll('stddev_samp', 'ms', N)} + {EPS})", "relative_quoted_spread_diff": f"{_rs('P', 'ma')} - {_rs('Q', 'mb')}", "realized_volatility_ratio": f"{roll('stddev_samp', 'ra', N)} / ({roll('stddev_samp', 'rb', N)} + {EPS})",
    "price_lead_lag": "ra * rb1", "leader_return": "rb1", "cross_market_ofi": "cast(" + " + ".join(f"exp(-0.3 * {k - 1}) * {ofi_sql(k, 'Q_')}" for k in (1, 2, 3)) + " as double)",
}


@query("features_pairs", f"with {TO_BARS}, {DEPTH}, {SNAP}, {PAIRS} " + final({n: f"r:{e}" for n, e in PAIR_COLUMNS.items()}, "q5", "ts"))
def _pairs(spark, d):
    snap = _snapshot(spark, d)
    cols = [f"{x}_L{k}" for x in ("bid_px", "ask_px", "bid_sz", "ask_sz") for k in (1, 2, 3)]
    one = lambda i, p: snap.where(F.col("instr") == i).select("ts", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    rows = one(0, "P").join(one(1, "Q"), "ts").withColumns({"instr": F.lit(0), "seq": F.lit(0)})
    p, q, c = book.Book("P"), book.Book("Q"), F.col
    rows = rows.withColumns({"ra": book.mid_return(A, p), "rb": book.mid_return(A, q), "oa": book.size_flow(p), "ob": book.size_flow(q), "ms": p.mid() - q.mid()}).withColumns({"ra1": A.lag(c("ra")), "rb1": A.lag(c("rb"))})
    return rounded(rows.select("ts", A.deviation_corr(c("ra"), c("rb"), N).alias("cross_correlation"), (A.deviation_corr(c("ra"), c("rb1"), N) - A.deviation_corr(c("ra1"), c("rb"), N)).alias("lead_lag_asymmetry"), A.deviation_corr(c("oa"), c("ob"), N).alias("ofi_correlation"), (book.micro(p) - book.micro(q)).alias("microprice_diff"), (book.depth_imbalance(p, 3) - book.depth_imbalance(q, 3)).alias("depth_imbalance_diff"), A.zscore(c("ms"), N).alias("pairs_spread_zscore"), (book.relative_spread(p) - book.relative_spread(q)).alias("relative_quoted_spread_diff"), share(A.std(c("ra"), N), A.std(c("rb"), N)).alias("realized_volatility_ratio"), (c("ra") * c("rb1")).alias("price_lead_lag"), c("rb1").alias("leader_return"), book.deep_flow(A, q, 3, 0.3).alias("cross_market_ofi")))


VX = "slots as (select *, (VX1_bid_px_L1 + VX1_ask_px_L1) / 2 as m1, (VX2_bid_px_L1 + VX2_ask_px_L1) / 2 as m2, (VX3_bid_px_L1 + VX3_ask_px_L1) / 2 as m3, VX1_ask_px_L1 - VX1_bid_px_L1 as s1 from (select t.instr, t.ts, " + ", ".join(f"v{k}.bid_close as VX{k}_bid_px_L1, v{k}.ask_close as VX{k}_ask_px_L1" for k in (1, 2, 3)) + " from (select * from bars where instr = 0) t " + " ".join(f"asof left join (select * from bars where instr = {k}) v{k} on t.ts >= v{k}.ts" for k in (1, 2, 3)) + "))"


@query("features_vx", f"with {TO_BARS}, {VX} " + final({"vx1_mid": "r:m1", "vx2_mid": "r:m2", "vx3_mid": "r:m3", "vx1_zscore_w5": f"r:(m1 - {roll('avg', 'm1', N)}) / ({roll('stddev_samp', 'm1', N)} + {EPS})", "vx_spread_zscore_w5": f"r:(s1 - {roll('avg', 's1', N)}) / ({roll('stddev_samp', 's1', N)} + {EPS})", "vx_calendar_spread": "r:m1 - m2", "vx_calendar_ratio": f"r:m1 / (m2 + {EPS})", "vx_term_curvature": "r:m3 - 2 * m2 + m1"}, "slots"))
def _vx(spark, d):
    b = ad.bars(spark, d)
    out = panel.vx_features(b.where("instr = 0").select("instr", "ts", "seq"), [b.where(F.col("instr") == k).drop("instr") for k in (1, 2, 3)], N, N, instruments=[0])
    return rounded(out.select("instr", "ts", "vx1_mid", "vx2_mid", "vx3_mid", "vx1_zscore_w5", "vx_spread_zscore_w5", "vx_calendar_spread", "vx_calendar_ratio", "vx_term_curvature"))


TC = f"tc as (select *, ln(1 + volume) as lv, hour({ET}) * 4 + minute({ET}) // 15 as bod from bars), tc2 as (select *, (lv - {roll('avg', 'lv', N, by='instr, bod')}) / ({roll('stddev_samp', 'lv', N, by='instr, bod')} + {EPS}) as lv_tc_z, {roll('median', 'lv', N, by='instr, bod')} as med from tc), tc3 as (select *, abs(lv - med) as dev from tc2), tc4 as (select *, {roll('median', 'dev', N, least=2, by='instr, bod')} as mad from tc3)"


@query("features_time_of_day", f"with {TO_BARS}, {TC} " + final({"lv_tc_z": "r:lv_tc_z", "lv_tc_madz": f"r:case when mad > 1e-3 then (lv - med) / (1.4826 * mad + {EPS}) end"}, "tc4"))
def _time_of_day(spark, d):
    rows = panel.normalised(ad.bars(spark, d).withColumn("lv", bar.log_volume(F.col("volume"))), ["lv"], (N,))
    a = session.time_of_day()
    dev = rows.withColumn("bod", session.bar_of_day(F.col("ts"), 15)).withColumn("_m", a.median(F.col("lv"), N)).withColumn("_d", F.abs(F.col("lv") - F.col("_m"))).withColumn("_mad", a.median(F.col("_d"), N, 2))
    return rounded(dev.select("instr", "ts", F.col("lv_tc_z_w5").alias("lv_tc_z"), F.when(F.col("_mad") > 1e-3, F.col("lv_tc_madz_w5")).alias("lv_tc_madz")))


# --- Days ------------------------------------------------------------------------------------------------------------

NIGHT = f"""n1 as (select *, hour({ET}) as h, cast({ET} as date) + case when hour({ET}) >= 16 then 1 else 0 end as tday, ln(close / {lag('close')}) as lr from bars),
n2 as (select *, case when h >= 9 and h < 16 then 1 else 0 end as rth from n1),
n3 as (select instr, tday, arg_min(open, ts) filter (rth = 1) as o, arg_max(close, ts) filter (rth = 1) as c, count(*) filter (rth = 1) as k, sum(lr * lr) filter (rth = 0) as v, sum(volume) filter (rth = 0) as vol, count(*) filter (rth = 0) as nb from n2 group by 1, 2),
n4 as (select instr, tday, ln(o / lag(c) over (partition by instr order by tday)) as gap, case when nb > 0 then sqrt(coalesce(v, 0)) end as rv, vol, case when nb > 0 then nb end as nb from n3 where k > 0)"""


@query("overnight", f"with {TO_BARS}, {NIGHT} select n2.instr, n2.ts, round(gap, 6) + 0.0 as overnight_log_return, round(rv, 6) + 0.0 as overnight_realized_vol, cast(vol as bigint) as overnight_volume_total, nb as overnight_n_bars from n2 left join n4 on n2.instr = n4.instr and n2.tday = n4.tday")
def _overnight(spark, d):
    return rounded(daily.overnight(session.session_flags(ad.bars(spark, d))).select("instr", "ts", "overnight_log_return", "overnight_realized_vol", "overnight_volume_total", "overnight_n_bars"))


CHAIN = "chain as (select cast(date_trunc('month', l_shipdate) as date) as date, cast(p_size * 100 as double) as strike_price, case when l_linenumber = 1 then cast(date_trunc('month', l_shipdate) as date) else cast(date_trunc('month', l_shipdate) as date) + 30 end as exdate, case when l_linestatus = 'O' then 'C' else 'P' end as cp_flag, l_quantity as open_interest, l_discount as gamma from lineitem join part on l_partkey = p_partkey)"
SPOT = "spot as (select date, sum(strike_price * (gamma * open_interest)) / sum(gamma * open_interest) as spot from chain where gamma * open_interest > 0 group by 1)"
GEX = f"""o1 as (select c.*, spot, open_interest * gamma * spot * spot * 100.0 as g, exdate = c.date as today from chain c join spot s on c.date = s.date),
o2 as (select *, row_number() over (partition by date order by g) as k, count(g) over (partition by date) as n from o1), caps as (select date, g as cap from o2 where k = 1 + round(0.99 * (n - 1))),
o3 as (select o1.*, least(g, cap) as gc, case when cp_flag = 'P' then least(g, cap) else -least(g, cap) end as sg from o1 join caps using (date)),
o4 as (select date, strike_price, sum(sg) as gs from o3 group by 1, 2), o5 as (select *, sum(gs) over (partition by date order by strike_price) as cum from o4),
flips as (select date, min(strike_price) filter (cum >= 0) as flip from o5 group by 1),
tot as (select date, sum(sg) as total_gex, coalesce(sum(sg) filter (today), 0) as g0, coalesce(sum(gc) filter (today), 0) / (sum(gc) + {EPS}) as sh from o3 group by 1),
oi as (select date, cp_flag, strike_price, sum(open_interest) as oi from chain group by 1, 2, 3), top as (select date, arg_max(strike_price, (oi, -strike_price)) filter (cp_flag = 'C') as mc, arg_max(strike_price, (oi, -strike_price)) filter (cp_flag = 'P') as mp from oi group by 1),
gex as (select t.date, total_gex, sign(total_gex) * 1.0 as gex_sign, coalesce(flip, spot) as zero_gamma_strike, mc as max_call_oi_strike, mp as max_put_oi_strike, sh as gex_0dte_share, g0 as gex_0dte_only, total_gex - g0 as gex_without_0dte from tot t join spot using (date) join flips using (date) join top using (date))"""
GEX_COLUMNS = ("zero_gamma_strike", "max_call_oi_strike", "max_put_oi_strike", "gex_0dte_share")
GEX_LARGE = ("total_gex", "gex_0dte_only", "gex_without_0dte")


@query("gamma_profile", f"with {CHAIN}, {SPOT}, {GEX} select date, cast(gex_sign as double) as gex_sign, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in GEX_COLUMNS)}, {', '.join(f'round({c} / 1e9, 6) + 0.0 as {c}' for c in GEX_LARGE)} from gex")
def _gamma(spark, d):
    chain = ad.chain(spark, d)
    return rounded(daily.gamma_profile(chain, daily.spot_proxy(chain)).withColumns({c: F.col(c) / 1e9 for c in GEX_LARGE}))


ATTACH = "lbars as (select cast(l_shipdate as date) as day, l_suppkey % 30 as instr, avg(l_extendedprice / l_quantity) + 1e-8 as close from lineitem group by 1, 2), hits as (select b.*, g.* exclude (date), g.date as gdate from lbars b asof left join prof g on b.day >= g.date + 1), near as (select instr, day, close, " + ", ".join(f"case when day - (gdate + 1) <= 5 then {c} end as {c}" for c in ("total_gex", "gex_sign", "zero_gamma_strike", "max_call_oi_strike", "max_put_oi_strike", "basis")) + " from hits)"


@query(
    "gamma_attached",
    f"with {CHAIN}, {SPOT}, {GEX}, basis as (select date, case when month(date) % 2 = 0 then 0.5 else -0.5 end as basis from gex), prof as (select * from gex join basis using (date)), {ATTACH}, dist as (select *, close - (zero_gamma_strike + basis) as dz from near) select instr, day, round(gex_sign * ln(1 + abs(total_gex)), 6) + 0.0 as gex_log_signed, round(dz, 6) + 0.0 as distance_to_zero_gamma_flip, round(dz / close * 10000, 6) + 0.0 as distance_to_zero_gamma_flip_bp, round(close - (max_call_oi_strike + basis), 6) + 0.0 as distance_to_max_call_oi, round(close - (max_put_oi_strike + basis), 6) + 0.0 as distance_to_max_put_oi, cast(case when count(dz) over w >= 4 then min(dz) over w * max(dz) over w < 0 end as integer) as zero_cross, round(gex_sign * close, 6) + 0.0 as gex_close from dist window w as (partition by instr order by day rows between 3 preceding and current row)",
)
def _gamma_attached(spark, d):
    chain = ad.chain(spark, d)
    profile = daily.gamma_profile(chain, daily.spot_proxy(chain))
    l = ad.table(spark, d, "lineitem")
    rows = l.groupBy((F.col("l_suppkey") % 30).alias("instr"), F.col("l_shipdate").alias("ts")).agg((F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-8).alias("close"))  # off the ties of rounding
    basis = profile.select("date", F.when(F.month("date") % 2 == 0, 0.5).otherwise(-0.5).alias("basis"))
    out = daily.attach_gamma_profiles(rows, [profile], basis)
    a = Along("instr", ["ts"])
    return rounded(out.select("instr", F.to_date("ts").alias("day"), "gex_log_signed", "distance_to_zero_gamma_flip", "distance_to_zero_gamma_flip_bp", "distance_to_max_call_oi", "distance_to_max_put_oi", book.crosses_zero(a, F.col("distance_to_zero_gamma_flip"), 4).alias("zero_cross"), (F.col("gex_sign") * F.col("close")).alias("gex_close")))


# --- Cross-section ---------------------------------------------------------------------------------------------------

MONTHLY = "monthly as (select l_suppkey % 30 as instr, cast(date_trunc('month', l_shipdate) as timestamp) as ts, avg(l_extendedprice / l_quantity) as close, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low, cast(sum(l_quantity) as bigint) as volume, cast(sum(l_quantity * case l_returnflag when 'A' then 1 when 'R' then -1 else 0 end) as bigint) as net from lineitem group by 1, 2), moved as (select *, ln(close / lag(close) over (partition by instr order by ts)) as log_return from monthly)"


def _monthly(spark, d):
    rows = ad.monthly(spark, d)
    return rows.withColumn("log_return", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("instr").orderBy("ts"))))


@query("cross_peers", f"with {MONTHLY}, x as (select ts, stddev_pop(log_return) as dispersion, sum(case when log_return > 0 then 1.0 else 0 end) / count(*) as breadth, max(log_return) - min(log_return) as leader_laggard_spread, coalesce(sum(log_return * log_return), 0) / (coalesce(sum(abs(log_return)), 0) ** 2 + {EPS}) as return_concentration from moved group by 1) select ts, round(dispersion, 6) + 0.0 as dispersion, round(breadth, 6) + 0.0 as breadth, round(leader_laggard_spread, 6) + 0.0 as leader_laggard_spread, round(return_concentration, 6) + 0.0 as return_concentration, round(case when count(dispersion) over w >= 5 then avg(dispersion) over w end, 6) + 0.0 as dispersion_w5 from x window w as (order by ts rows between 4 preceding and current row)")
def _peers(spark, d):
    return rounded(cs.over_times(cs.peers(_monthly(spark, d)), {"dispersion_w5": lambda a: a.mean(F.col("dispersion"), 5)}, 5, 16))


@query("cross_return_zscore", f"with {MONTHLY} select instr, ts, round((log_return - avg(log_return) over (partition by ts)) / (stddev_pop(log_return) over (partition by ts) + {EPS}), 6) + 0.0 as z from moved")
def _cross_z(spark, d):
    return rounded(_monthly(spark, d).select("instr", "ts", cs.return_zscore(F.col("log_return")).alias("z")))


_GAUSS = [[NormalDist().inv_cdf((k + 1) / (n + 1)) if n > 1 else None for k in range(n)] for n in range(31)]
GAUSS_VALUES = ", ".join(f"({n}, {k + 1}, cast({z!r} as double))" for n, row in enumerate(_GAUSS) for k, z in enumerate(row) if z is not None)


@query("cross_gauss_ranks", f"with {MONTHLY}, g(n, k, z) as (values {GAUSS_VALUES}), x as (select *, instr % 6 as class, count(log_return) over (partition by ts) as n, row_number() over (partition by ts order by log_return nulls last, instr) as k, count(log_return) over (partition by ts, instr % 6) as nc, row_number() over (partition by ts, instr % 6 order by log_return nulls last, instr) as kc from moved) select instr, ts, round(case when log_return is not null then g.z end, 6) + 0.0 as cs_universe_log_return, round(case when log_return is not null then h.z end, 6) + 0.0 as cs_class_log_return from x left join g on g.n = x.n and g.k = x.k left join g h on h.n = x.nc and h.k = x.kc")
def _gauss(spark, d):
    rows = _monthly(spark, d).select("instr", "ts", "log_return", (F.col("instr") % 6).alias("class"))
    rows = cs.gauss_ranks(cs.gauss_ranks(rows, ["log_return"], prefix="cs_universe_"), ["log_return"], ["class"], "cs_class_")
    return rounded(rows.drop("log_return", "class"))


WIDE_NAMES = ("6E", "6J", "6B", "6C", "ZT", "ZF", "ZN", "ZB", "GC", "CL", "ES", "NQ")
WIDE = f"""{MONTHLY}, wide as (select ts, {', '.join(f'min(log_return) filter (instr = {k}) as "{n}_log_return"' for k, n in enumerate(WIDE_NAMES))} from moved group by 1)"""
DXY = """(-(5.76e-1 * "6E_log_return" + 1.36e-1 * "6J_log_return" + 1.19e-1 * "6B_log_return" + 9.1e-2 * "6C_log_return") / 9.22e-1)"""


def pearson_sql(x: str, y: str, n: int) -> str:
    w = f"over (order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({x} * {y}) {w} >= {n} then corr({x}, {y}) {w} end"


@query("cross_wide_composites", f"with {WIDE}, c as (select *, {DXY} as dxy from wide) select ts, {', '.join(f'round({chr(34)}{n}_log_return{chr(34)}, 6) + 0.0 as {chr(34)}{n}_log_return{chr(34)}' for n in WIDE_NAMES)}, round(dxy, 6) + 0.0 as synthetic_dxy_logret, round(\"ZF_log_return\" - \"ZT_log_return\", 6) + 0.0 as slope_2s5s_logret, round(\"ZN_log_return\" - \"ZF_log_return\", 6) + 0.0 as slope_5s10s_logret, round(\"ZN_log_return\" - \"ZT_log_return\", 6) + 0.0 as slope_2s10s_logret, round(\"ZB_log_return\" - \"ZN_log_return\", 6) + 0.0 as slope_10s30s_logret, round(\"ZN_log_return\" - 2 * \"ZF_log_return\" + \"ZT_log_return\", 6) + 0.0 as butterfly_2s5s10s, {', '.join(f'round({pearson_sql(chr(34) + t + chr(95) + chr(108) + chr(111) + chr(103) + chr(95) + chr(114) + chr(101) + chr(116) + chr(117) + chr(114) + chr(110) + chr(34), o, 6)}, 6) + 0.0 as corr_{t}_vs_{l}_w6' for t in ('ES', 'NQ') for l, o in (('gold', chr(34) + 'GC_log_return' + chr(34)), ('oil', chr(34) + 'CL_log_return' + chr(34)), ('ZN', chr(34) + 'ZN_log_return' + chr(34)), ('DXY', 'dxy')))}, round(\"GC_log_return\" + (coalesce(\"ZN_log_return\", 0) + coalesce(\"ZB_log_return\", 0)) / nullif((case when \"ZN_log_return\" is null then 0 else 1 end) + (case when \"ZB_log_return\" is null then 0 else 1 end), 0) + dxy - \"ES_log_return\", 6) + 0.0 as risk_off_score from c")
def _wide(spark, d):
    rows = _monthly(spark, d)
    name = F.element_at(F.array(*[F.lit(n) for n in WIDE_NAMES]), (F.col("instr") + 1).cast("int"))
    wide = cs.widen(rows.where(F.col("instr") < len(WIDE_NAMES)).select("ts", name.alias("instr"), "log_return"), ["log_return"], list(WIDE_NAMES))
    times = rows.select("ts").distinct()
    out = cs.composites(times.join(wide, "ts", "left"), 6)
    c = lambda n: F.col(f"`{n}_log_return`")
    return rounded(out.withColumn("risk_off_score", cs.risk_off(c("GC"), F.col("synthetic_dxy_logret"), [c("ZN"), c("ZB")], [c("ES")])))


@query("cross_interactions", f"with {TO_BARS}, {BASE} select instr, ts, round(vol_of_vol_w10 * jump_indicator_w5, 6) + 0.0 as ix_vol_of_vol_w60_x_jump_indicator, round(rolling_kurt_w5 * jump_indicator_w5, 6) + 0.0 as ix_rolling_kurt_x_jump_indicator from base where vol_of_vol_w10 is null or abs(jump_indicator_w5) < 1000")
def _interactions(spark, d):
    rows = _base(spark, d).where("vol_of_vol_w10 is null or abs(jump_indicator_w5) < 1000").select("instr", "ts", F.col("vol_of_vol_w10").alias("vol_of_vol_w60"), F.col("jump_indicator_w5").alias("jump_indicator_w20"), F.col("rolling_kurt_w5").alias("rolling_kurt_w60"))
    return rounded(cs.interactions(rows, "ES").drop("vol_of_vol_w60", "jump_indicator_w20", "rolling_kurt_w60"))


# --- Recursions ------------------------------------------------------------------------------------------------------

VPIN = """numbered as (select *, row_number() over (partition by instr order by ts) as k from bars),
vp(instr, k, ts, tot, sg, n, done) as (select instr, k, ts, buys_qty + sells_qty, buys_qty - sells_qty, 1, buys_qty + sells_qty >= 800 from numbered where k = 1
    union all select b.instr, b.k, b.ts, case when v.done then 0 else v.tot end + b.buys_qty + b.sells_qty, case when v.done then 0 else v.sg end + b.buys_qty - b.sells_qty, case when v.done then 0 else v.n end + 1, case when v.done then 0 else v.tot end + b.buys_qty + b.sells_qty >= 800 from vp v join numbered b on b.instr = v.instr and b.k = v.k + 1)"""


@query("volume_buckets", f"with recursive {TO_BARS}, {VPIN} select instr, ts, round(abs(sg) / tot, 6) + 0.0 as vpin, cast(tot as bigint) as bucket_volume, cast(n as bigint) as n_sub_bars from vp where done")
def _buckets(spark, d):
    return rounded(sequential.volume_buckets(ad.bars(spark, d), 800))


HAWKES = "hk as (select b.instr, b.ts, {0} from bars b join bars p on p.instr = b.instr and p.ts <= b.ts group by 1, 2)"
_decay = lambda x, h: f"sum(p.{x} * exp(-ln(2) / {h} * (epoch(b.ts) - epoch(p.ts))))"


@query("decaying_intensity", f"with {TO_BARS}, " + HAWKES.format(", ".join(f"{_decay(x, h)} as {n}_{h}" for n, x in (("b", "buys_qty"), ("s", "sells_qty")) for h in (43200, 172800))) + " select instr, ts, round(b_43200, 6) + 0.0 as fast_buy, round(s_43200, 6) + 0.0 as fast_sell, round(b_43200 - s_43200, 6) + 0.0 as hawkes_imbalance_hl43200, round(b_172800 - s_172800, 6) + 0.0 as hawkes_imbalance_hl172800, round((b_43200 - s_43200) - (b_172800 - s_172800), 6) + 0.0 as hawkes_acceleration from hk")
def _hawkes(spark, d):
    b = ad.bars(spark, d)
    one = sequential.decaying_intensity(b.select("instr", "ts", "buys_qty", "sells_qty"), 43200, "fast")
    both = sequential.intensities(b, 43200.0, 172800.0)
    return rounded(one.select("instr", "ts", "fast_buy", "fast_sell").join(both, ["instr", "ts"]))


HOLES = "case when day(ts) % 3 = 0 and hour(ts) in (6, 12) then null else ln(close) end"
# A null row leaves the mean and multiplies its weight; the next value restores the weight to one.
_mean = lambda e, w, a: f"case when b.x is null then e.{e} when e.{e} is null then b.x else (e.{w} * (1 - {a}) * e.{e} + {a} * b.x) / (e.{w} * (1 - {a}) + {a}) end, case when b.x is null and e.{e} is not null then e.{w} * (1 - {a}) else cast(1 as double) end"
EMA = f"nb as (select *, {HOLES} as x, row_number() over (partition by instr order by ts) as k from bars), em(instr, k, ts, x, e3, w3, e8, w8) as (select instr, k, ts, x, x, cast(1 as double), x, cast(1 as double) from nb where k = 1 union all select b.instr, b.k, b.ts, b.x, {_mean('e3', 'w3', '5e-1')}, {_mean('e8', 'w8', '(2e0 / 9e0)')} from em e join nb b on b.instr = e.instr and b.k = e.k + 1)"


@query("ema", f"with recursive {TO_BARS}, {EMA} select instr, ts, case when x is not null then round(e3, 6) + 0.0 end as close_ema_s3, case when x is not null then round(e8, 6) + 0.0 end as close_ema_s8 from em")
def _ema(spark, d):
    holes = F.when((F.day("ts") % 3 == 0) & F.hour("ts").isin(6, 12), None).otherwise(F.ln("close"))
    return rounded(sequential.ema(ad.bars(spark, d).select("instr", "ts", holes.alias("close")), ["close"], (3, 8)).drop("close"))


#: The weights of order 0.4 down to 0.01: each is the one before times (k - 1 - 0.4) / k.
_FD = (1.0, -0.4, -0.12, -0.064, -0.0416, -0.029952, -0.0229632, -0.01837056, -0.015155712, -0.0127981568, -0.011006414848)


@query("fracdiff", f"with {TO_BARS}, x as (select instr, ts, ln(close) as lc from bars) select instr, ts, round({' + '.join(f'{float(w)!r} * {lag(chr(108) + chr(99), k) if k else chr(108) + chr(99)}' for k, w in enumerate(_FD))}, 6) + 0.0 as fd from x")
def _fracdiff(spark, d):
    return rounded(sequential.fracdiff(ad.bars(spark, d).select("instr", "ts", F.ln("close").alias("lc")), "lc", 0.4, "fd", 1e-2).drop("lc"))


@query("pin_distance", f"with {TO_BARS} select instr, ts, " + ", ".join(f"round(least(close % {n}, {n} - close % {n}), 6) + 0.0 as round_pin_{n}" for n in (10, 25, 50)) + " from bars")
def _pin(spark, d):
    return rounded(ad.bars(spark, d).select("instr", "ts", *[panel.pin_distance(F.col("close"), float(n)).alias(f"round_pin_{n}") for n in (10, 25, 50)]))


@query("fracdiff_auto")
def _fracdiff_auto(spark, d):
    """A unit-root search: no SQL; the tests hold it against known series."""
    return rounded(sequential.fracdiff_auto(ad.bars(spark, d).select("instr", "ts", F.ln("close").alias("lc")), "lc", "fd", tau=1e-3).drop("lc"))


@query("sub_bar_engines", f"with recursive {TO_BARS}, {VPIN}, bk as (select instr, ts, abs(sg) / tot as vpin from vp where done), cnt as (select instr, {DAY} as day, count(*) as n from bk group by 1, 2), daybars as (select instr, {DAY} as ts, 1 as one from bars group by 1, 2), " + HAWKES.format(", ".join(f"{_decay(x, h)} as {n}_{h}" for n, x in (("b", "buys_qty"), ("s", "sells_qty")) for h in (43200, 172800))) + " select b.instr, b.ts, round(h.b_43200 - h.s_43200, 6) + 0.0 as hawkes_imbalance_hl43200, round(h.b_172800 - h.s_172800, 6) + 0.0 as hawkes_imbalance_hl172800, round((h.b_43200 - h.s_43200) - (h.b_172800 - h.s_172800), 6) + 0.0 as hawkes_acceleration, round(k.vpin, 6) + 0.0 as vpin, round(epoch(b.ts) - epoch(k.ts), 6) + 0.0 as vpin_staleness_seconds, coalesce(cnt.n, 0) as vpin_buckets_velocity_w15m from daybars b asof left join bk k on b.instr = k.instr and b.ts >= k.ts left join cnt on cnt.instr = b.instr and cnt.day = b.ts asof left join hk h on h.instr = b.instr and b.ts >= h.ts")
def _sub_bar(spark, d):
    short = ad.bars(spark, d)
    long = bars_op.in_bars(short, "1 day").agg(F.lit(0).alias("seq"))
    return rounded(panel.sub_bar_features(long, short, 800, 43200.0, 172800.0, "1 day").select("instr", "ts", "vpin", "vpin_staleness_seconds", "vpin_buckets_velocity_w15m", "hawkes_imbalance_hl43200", "hawkes_imbalance_hl172800", "hawkes_acceleration"))


@query("execution_features", f"with {TO_BARS}, {DEPTH}, {EXEC_SQL.split(DEPTH + ', ')[1]}, e3 as (select instr, bar as ts, {', '.join(f'coalesce({c}, 0) as {c}' for c in (*EFF_DOUBLES, *EXEC_COUNTS))} from exec), j as (select b.*, {', '.join('e3.' + c for c in (*EFF_DOUBLES, *EXEC_COUNTS))} from bars b asof left join e3 on b.instr = e3.instr and b.ts >= e3.ts), j2 as (select *, eff_spread_buy_sum / (eff_spread_buy_weight + {EPS}) as vb, eff_spread_sell_sum / (eff_spread_sell_weight + {EPS}) as vs, bid_up_count + ask_down_count as imp, bid_down_count + ask_up_count as wor from j) " + final({"vwap_eff_spread": f"r:eff_spread_sum / (eff_spread_weight + {EPS})", "vwap_eff_spread_buy": "r:vb", "vwap_eff_spread_sell": "r:vs", "eff_spread_asymmetry": "r:vb - vs", "large_trade_volume_share": f"r:large_trade_volume / (volume + {EPS})", "n_large_trades_log": "r:ln(1 + n_large_trades)", "cancel_to_trade_ratio": f"r:case when volume > 0 then (net_bid_decrement_no_trade_L1 + net_ask_decrement_no_trade_L1) / (volume + {EPS}) end", "quote_to_trade_ratio": f"r:case when trades_count > 0 then quote_update_count / (trades_count + {EPS}) end", "quote_movement_directionality": f"r:(imp - wor) / (imp + wor + {EPS})", "hidden_absorption_ratio_w4": f"r:{roll('sum', 'hidden_absorption_volume', 4)} / ({roll('sum', 'volume', 4)} + {EPS})", "side_cond_ask_resilience_buy": f"r:case when lift_ask_vol > 0 then (ask_sz_L1_delta_signed + lift_ask_vol) / (lift_ask_vol + {EPS}) end", "side_cond_bid_resilience_sell": f"r:case when hit_bid_vol > 0 then (bid_sz_L1_delta_signed + hit_bid_vol) / (hit_bid_vol + {EPS}) end"}, "j2"))
def _execution_features(spark, d):
    b = ad.bars(spark, d)
    e = execution.execution_bars(ad.trades(spark, d), ad.quotes(spark, d), ad.depth(spark, d), EVERY)
    out = panel.execution_features(b, e, 4)
    guard = {"cancel_to_trade_ratio": "volume", "quote_to_trade_ratio": "trades_count", "side_cond_ask_resilience_buy": "lift_ask_vol", "side_cond_bid_resilience_sell": "hit_bid_vol"}
    out = out.withColumns({k: F.when(F.col(v) > 0, F.col(k)) for k, v in guard.items()})
    return rounded(out.select("instr", "ts", "vwap_eff_spread", "vwap_eff_spread_buy", "vwap_eff_spread_sell", "eff_spread_asymmetry", "large_trade_volume_share", "n_large_trades_log", "quote_movement_directionality", "hidden_absorption_ratio_w4", *guard))


# --- Labels ----------------------------------------------------------------------------------------------------------

TR = f"tr as (select *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) as x, row_number() over (partition by instr order by ts) as k, epoch(ts) - epoch({lag('ts')}) as gap, hour({ET}) as bod from bars)"


def label_sql(horizon: int, gap: int, mode: str, least: int, up: float = 1.0, down: float = 1.0, atr: str = "") -> str:
    """Common tables that end in `lab`."""
    drop = "h.hj is not null" + ("" if mode == "drop" else f" and h.hj - 1 < {least}")
    return f"""{TR}, atb as (select *, {atr or roll('avg', 'x', N)} as atr from tr),
    nx as (select a.instr, a.k, b.k - a.k as j, b.gap, b.open as o, b.high as h, b.low as l, b.close as c, a.close + {up} * a.atr as top, a.close - {down} * a.atr as bot from atb a join atb b on a.instr = b.instr and b.k > a.k and b.k <= a.k + {horizon}),
    ha as (select instr, k, min(j) filter (gap > {gap}) as hj, max(j) as mj from nx group by 1, 2),
    ht as (select nx.instr, nx.k, min(j) filter (h >= top or l <= bot) as hit from nx join ha on ha.instr = nx.instr and ha.k = nx.k where ha.hj is null or j < ha.hj group by 1, 2),
    jn as (select a.*, h.hj, coalesce(h.hj - 1, h.mj, 0) as span, ht.hit, coalesce({drop}, false) as dropped, a.close + {up} * a.atr as top, a.close - {down} * a.atr as bot from atb a left join ha h on a.instr = h.instr and a.k = h.k left join ht on a.instr = ht.instr and a.k = ht.k),
    ex as (select jn.*, n.o, n.h, n.l, n.c, e.c as last_close, case when n.h >= jn.top and n.l <= jn.bot then case when n.c > n.o then 1 else -1 end when n.h >= jn.top then 1 else -1 end as side from jn left join nx n on n.instr = jn.instr and n.k = jn.k and n.j = jn.hit left join nx e on e.instr = jn.instr and e.k = jn.k and e.j = jn.span),
    lb as (select *, case when atr is not null and not dropped and hit is not null then side else 0 end as label, case when atr is null then 0 when dropped then -1 else coalesce(hit, span) end as hit_offset, case when atr is not null and not dropped then case when hit is not null then case when side = 1 then top else bot end when span > 0 then last_close end end as exit_, atr is not null and hj is not null and not dropped as truncated from ex),
    lab as (select *, ln(exit_ / close) as realized_ret, exit_ - close as realized_ret_pts from lb)"""


LABEL_OUT = r("atr", "realized_ret", "realized_ret_pts") | {"label": "label", "hit_offset": "cast(hit_offset as integer)", "halt_truncated": "truncated"}


def _label_bars(spark, d):
    return ad.bars(spark, d).drop("seq")


@query("labels_drop", f"with {TO_BARS}, {label_sql(4, 21600, 'drop', 2, 1.0, 0.8)} " + final(LABEL_OUT, "lab"))
def _labels_drop(spark, d):
    out = labels.first_touch(labels.with_atr(_label_bars(spark, d), N), 1.0, 0.8, 4, gap_seconds=21600)
    return rounded(out.select("instr", "ts", "atr", *labels.LABELS))


@query("labels_truncate_time_of_day", f"with {TO_BARS}, {label_sql(4, 21600, 'truncate', 2, 0.5, 0.5, roll('avg', 'x', N, by='instr, bod'))} " + final(LABEL_OUT, "lab"))
def _labels_truncate(spark, d):
    out = labels.first_touch(labels.with_atr(_label_bars(spark, d), N, mode="time_conditional", minutes=60), 0.5, 0.5, 4, gap_seconds=21600, halt_mode="truncate")
    return rounded(out.select("instr", "ts", "atr", *labels.LABELS))


STAT_NAMES = {"pos": 1, "neg": -1, "zero": 0}


def stats_sql(group: str, source: str) -> str:
    parts = [f"round(avg(case when label = {v} then 1.0 else 0 end), 6) + 0.0 as frac_{n}" for n, v in STAT_NAMES.items()]
    for name, x in (("mean_ret", "realized_ret"), ("mean_ret_pts", "realized_ret_pts"), ("mean_ret_bps", "realized_ret_pts / close * 10000"), ("mean_hit_offset", "cast(hit_offset as double)")):
        parts += [f"round(avg({x}) filter (label = {v}), 6) + 0.0 as {name}_{n}" for n, v in STAT_NAMES.items()]
    parts += [f"round(abs(avg(realized_ret_pts) filter (label = {v})) / 0.5, 6) + 0.0 as pts_over_cost_{n}" for n, v in (("pos", 1), ("neg", -1))]
    share_ = lambda v: f"avg(case when label = {v} then 1.0 else 0 end)"
    parts += ["count(*) as n_total", "round(corr(label, realized_ret), 6) + 0.0 as label_forward_return_corr", "round(" + " + ".join(f"-{share_(v)} * ln({share_(v)} + 1e-12)" for v in (1, -1, 0)).join(("(", ")")) + " / ln(3), 6) + 0.0 as balance_score"]
    return f"select {group}{', ' if group else ''}{', '.join(parts)} from {source} where atr is not null and realized_ret is not null" + (f" group by {group.split(' as ')[-1]}" if group else "")


TUNE_GRID = [(u, dn, t) for t in (2, 4) for u in (0.5, 1.0) for dn in (0.5, 1.0)]


@query("labels_tuned", " union all ".join(f"select cast({u} as double) as k_up, cast({dn} as double) as k_dn, {t} as T, 5 as atr_window, * from (with {TO_BARS}, {label_sql(t, 90000, 'drop', 2, u, dn)} {stats_sql('', 'lab')})" for u, dn, t in TUNE_GRID))
def _tuned(spark, d):
    return rounded(labels.tune_labels(_label_bars(spark, d), (0.5, 1.0), (0.5, 1.0), (2, 4), (N,), gap_seconds=90000))


def _labeled(spark, d):
    return labels.first_touch(labels.with_atr(_label_bars(spark, d), N), 0.5, 0.5, 4, gap_seconds=90000)


@query("labels_hourly", f"with {TO_BARS}, {label_sql(4, 90000, 'drop', 2, 0.5, 0.5)}, hl as (select *, cast(bod as integer) as hour_et from lab) {stats_sql('hour_et', 'hl')}")
def _hourly(spark, d):
    return rounded(labels.hourly_statistics(_labeled(spark, d))[0])


@query("labels_sessions", f"with {TO_BARS}, {label_sql(4, 90000, 'drop', 2, 0.5, 0.5)}, hl as (select *, cast(bod as integer) as hour_et from lab), hs as (select hour_et, count(*) as n, avg(case when label = 1 then 1.0 else 0 end) as p, avg(case when label = -1 then 1.0 else 0 end) as m, avg(case when label = 0 then 1.0 else 0 end) as z from hl where atr is not null and realized_ret is not null group by 1), bs as (select *, (-p * ln(p + 1e-12) - m * ln(m + 1e-12) - z * ln(z + 1e-12)) / ln(3) as b, case when hour_et >= 18 or hour_et < 3 then 'ASIA' when hour_et < 9 then 'EU' when hour_et < 16 then 'US_RTH' else 'US_ETH' end as session from hs) select session, cast(sum(n) as bigint) as n_total, round(sum(p * n) / sum(n), 6) + 0.0 as frac_pos, round(sum(m * n) / sum(n), 6) + 0.0 as frac_neg, round(sum(z * n) / sum(n), 6) + 0.0 as frac_zero, round(sum(b * n) / sum(n), 6) + 0.0 as balance_score from bs group by 1")
def _sessions(spark, d):
    return rounded(labels.hourly_statistics(_labeled(spark, d))[1])


@query("labels_by_year", f"with {TO_BARS}, {label_sql(4, 90000, 'drop', 2, 0.5, 0.5)}, y as (select *, month(ts) as period from lab), s as (select period, avg(case when label = 1 then 1.0 else 0 end) as fp, corr(label, realized_ret) as c from y where atr is not null and realized_ret is not null group by 1) select round(min(fp), 6) + 0.0 as frac_pos_min, round(avg(fp), 6) + 0.0 as frac_pos_mean, round(min(c), 6) + 0.0 as label_forward_return_corr_min, round(avg(c), 6) + 0.0 as label_forward_return_corr_mean from s")
def _by_year(spark, d):
    stats = labels.label_statistics(_labeled(spark, d).withColumn("period", F.month("ts")), ["period"])
    return rounded(scoring.robustness(stats, [], ["frac_pos", "label_forward_return_corr"]))


@query("labels_counts", f"with {TO_BARS}, {label_sql(4, 90000, 'drop', 2, 0.5, 0.5)} select label, count(*) as n, round(avg(realized_ret), 6) + 0.0 as mean_ret from lab group by 1")
def _label_counts(spark, d):
    return rounded(_labeled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("realized_ret").alias("mean_ret")))


# --- Scoring ---------------------------------------------------------------------------------------------------------

IC_FEATURES = ("log_return", "ofi", "log_volume", "cvd_change", "average_trade_size")
PANEL = f"{BASE}, pan as (select *, {lag('log_return', -1)} as y, month(ts) as year from base)"


def _panel(spark, d):
    return _base(spark, d).withColumns({"y": A.lag(F.col("log_return"), -1), "year": F.month("ts")})


def ic_sql(by: str) -> str:
    melt = " union all ".join(f"select '{f}' as feature, year, cast({f} as double) as x, y from pan where {f} is not null and y is not null" for f in IC_FEATURES)
    keys = f"feature{', ' + by if by else ''}"
    return f"melt as ({melt}), rk as (select *, rank() over (partition by {keys} order by x) + (count(*) over (partition by {keys}, x) - 1) / 2.0 as rx, rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0 as ry from melt), ics as (select {keys}, count(*) as n, case when count(*) >= 20 then corr(x, y) end as ic, case when count(*) >= 20 then corr(rx, ry) end as rank_ic from rk group by {keys})"


def _t(x: str) -> str:
    return f"{x} * sqrt(n - 2) / sqrt(1 - {x} * {x})"


@query("ic_pooled", f"with {TO_BARS}, {PANEL}, {ic_sql('')} select feature, n, round(ic, 6) + 0.0 as ic, round(rank_ic, 6) + 0.0 as rank_ic, round({_t('ic')}, 6) + 0.0 as ic_t, round({_t('rank_ic')}, 6) + 0.0 as rank_ic_t from ics")
def _ic(spark, d):
    return rounded(scoring.information_coefficients(_panel(spark, d), list(IC_FEATURES), "y", least=20))


@query("ic_dashboard", f"with {TO_BARS}, {PANEL}, {ic_sql('')}, {ic_sql('year').replace('melt as', 'melt2 as').replace('from melt)', 'from melt2)').replace('rk as', 'rk2 as').replace('from rk ', 'from rk2 ').replace('ics as', 'ics2 as')}, yr as (select feature, avg(ic) as ic_mean, stddev_pop(ic) as ic_std, min(ic) as ic_min, max(ic) as ic_max, count(*) as n_years, greatest(avg(case when ic > 0 then 1.0 else 0 end), avg(case when ic < 0 then 1.0 else 0 end)) as sign_stability from ics2 where ic is not null group by 1) select feature, n, round(ic, 6) + 0.0 as ic, round(rank_ic, 6) + 0.0 as rank_ic, round({_t('ic')}, 6) + 0.0 as ic_t, round({_t('rank_ic')}, 6) + 0.0 as rank_ic_t, round(ic_mean, 6) + 0.0 as ic_mean, round(ic_std, 6) + 0.0 as ic_std, round(ic_min, 6) + 0.0 as ic_min, round(ic_max, 6) + 0.0 as ic_max, n_years, round(sign_stability, 6) + 0.0 as sign_stability, round(abs(ic), 6) + 0.0 as abs_ic from ics left join yr using (feature) order by abs(ic) desc nulls last limit 4")
def _dashboard(spark, d):
    return rounded(scoring.dashboard(_panel(spark, d), list(IC_FEATURES), "y", top=4, least=20))


@query("target_residuals", f"with {TO_BARS}, {PANEL}, h as (select *, hour({ET}) as hh from pan where y is not null), fit as (select regr_slope(y, ofi) as b, regr_intercept(y, ofi) as a from h where ofi is not null) select instr, ts, round(y - avg(y) over (partition by hh), 6) + 0.0 as hour_residual, round(y - (a + b * ofi), 6) + 0.0 as residual from h, fit")
def _residuals(spark, d):
    rows = _panel(spark, d).where("y is not null").withColumn("hour_et", F.hour(session.eastern(F.col("ts"))))
    return rounded(scoring.linear_residual(rows, "y", ["ofi"]).select("instr", "ts", scoring.hour_residual(rows, "y").alias("hour_residual"), "residual"))


_PAIRS = [(x, y) for i, x in enumerate(IC_FEATURES) for y in IC_FEATURES[i + 1 :]]


@query("feature_correlations", f"with {TO_BARS}, {PANEL} " + " union all ".join(f"select '{x}' as feature_a, '{y}' as feature_b, round(corr({x}, {y}), 6) + 0.0 as corr from pan" for x, y in _PAIRS))
def _correlations(spark, d):
    return rounded(scoring.correlation_matrix(_panel(spark, d), list(IC_FEATURES)))


@query("greedy_selection")
def _greedy(spark, d):
    """Walks a short list on the driver; the tests hold it against a plain loop."""
    rows = _panel(spark, d)
    taken = scoring.greedy_select(scoring.information_coefficients(rows, list(IC_FEATURES), "y", least=20), scoring.correlation_matrix(rows, list(IC_FEATURES)), 4, 0.5)
    return spark.createDataFrame([(i, f) for i, f in enumerate(taken)], "place int, feature string")


#: Three folds with an embargo and a purge of 4 rows, 20 training, 20 fold and 10 test rows at least, as the rule has them.
_fold = lambda k, then: f"case when least({k} * size + 4 + size, n) - ({k} * size + 4) >= 10 and greatest(20, {k} * size - 4) <= n and {then} end"


@query("walk_forward_folds", f"with {TO_BARS}, a as (select instr, ts, row_number() over (partition by instr order by ts) - 1 as row_no, count(*) over (partition by instr) as n, count(*) over (partition by instr) // 4 as size from bars) select instr, ts, row_no, coalesce({', '.join(_fold(k, f'row_no >= {k} * size + 4 and row_no < least({k} * size + 4 + size, n) then {k - 1}') for k in (1, 2, 3))}, -1) as test_fold, cast({' + '.join('coalesce(' + _fold(k, f'row_no < greatest(20, {k} * size - 4) then 1') + ', 0)' for k in (1, 2, 3))} as integer) as n_train_folds from a")
def _folds(spark, d):
    rows = scoring.with_folds(ad.bars(spark, d).select("instr", "ts"), ["ts"], ["instr"], 3, 4, 4, 20, 20, 10)
    return rows.select("instr", "ts", F.col("row_no").cast("long").alias("row_no"), "test_fold", F.size("train_folds").alias("n_train_folds"))


#: Some probabilities are 0, and some tie.
PROBS = "pr as (select label, k % 3 as a, 1 + (k % 4) as b, (k + abs(label)) % 2 * (1 + k % 5) as c from lab), pn as (select label, a / (a + b + c) as p1, b / (a + b + c) as p0, c / (a + b + c) as pm from pr), best as (select *, case when pm >= p0 and pm >= p1 then -1 when p0 >= p1 then 0 else 1 end as x, greatest(case label when 1 then p1 when 0 then p0 else pm end, 1e-12) as p from pn)"


@query("class_metrics", f"with {TO_BARS}, {label_sql(4, 90000, 'drop', 2, 0.5, 0.5)}, {PROBS} select round(avg(-ln(p)), 6) + 0.0 as log_loss, round(avg(case when x = label then 1.0 else 0 end), 6) + 0.0 as accuracy, (select round(avg(q), 6) + 0.0 from (select avg(case when x = label then 1.0 else 0 end) as q from best group by label)) as balanced_accuracy, count(*) as n from best")
def _metrics(spark, d):
    k = F.row_number().over(Window.partitionBy("instr").orderBy("ts"))
    rows = _labeled(spark, d).withColumn("k", k).withColumns({"a": F.col("k") % 3, "b": 1 + F.col("k") % 4, "c": (F.col("k") + F.abs("label")) % 2 * (1 + F.col("k") % 5)})
    total = F.col("a") + F.col("b") + F.col("c")
    rows = rows.select("label", (F.col("c") / total).alias("pm"), (F.col("b") / total).alias("p0"), (F.col("a") / total).alias("p1"))
    return rounded(scoring.class_metrics(rows, "label", {-1: "pm", 0: "p0", 1: "p1"}))


BOOSTED = ("ofi", "log_return", "log_volume", "spread_to_mid_bps", "average_trade_size")
_GROWTH = {"rounds": 8, "patience": 3, "depth": 3, "bins": 32, "rate": 0.1, "least_rows": 10}


def _training_rows(spark, d):
    rows = _base(spark, d)
    marks = _labeled(spark, d).select("instr", "ts", "label")
    rows = rows.join(marks, ["instr", "ts"]).select("instr", "ts", "label", *BOOSTED)
    return scoring.with_folds(rows, ["ts"], ["instr"], 3, 4, 4, 20, 20, 10)


@query("boosted_folds")
def _boosted_folds(spark, d):
    """Trees have no SQL: the tests hold them against a plain loop, and `boosted_split_gains` has the first node's."""
    return rounded(scoring.train_classes(_training_rows(spark, d), list(BOOSTED), **_GROWTH)[1])


#: Fixed edges of bins for the comparison with SQL.
CUTS = {"ofi": (-0.4, -0.1, 0.1, 0.4), "log_return": (-0.5, -0.1, 0.0, 0.1, 0.5), "log_volume": (3.0, 4.0, 5.0)}
_WHOLE = " and ".join(f"isfinite({f})" for f in CUTS)
GAINS = f"""lb2 as (select label, {', '.join(CUTS)} from base join (select instr, ts, label from lab) using (instr, ts) where {_WHOLE}),
    pri as (select {', '.join(f"avg(case when label = {c} then 1.0 else 0 end) as q{k}" for k, c in enumerate((-1, 0, 1)))} from lb2),
    gh as (select {', '.join(f"{' + '.join(f'(case when {f} > {e} then 1 else 0 end)' for e in es)} as b_{f}" for f, es in CUTS.items())}, {', '.join(f"q{k} - case when label = {c} then 1.0 else 0 end as g{k}, 1.5 * q{k} * (1 - q{k}) as h{k}" for k, c in enumerate((-1, 0, 1)))} from lb2, pri),
    long as ({' union all '.join(f"select {k} as class, {i} as feature, b_{f} as bin, g{k} as g, h{k} as h from gh" for k in range(3) for i, f in enumerate(CUTS))}),
    sums as (select class, feature, bin, sum(g) as g, sum(h) as h, count(*) as n from long group by all),
    ran as (select *, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over v as ga, sum(h) over v as ha, sum(n) over v as na from sums window w as (partition by class, feature order by bin), v as (partition by class, feature))"""


@query("boosted_split_gains", f"with {TO_BARS}, {BASE}, {label_sql(4, 90000, 'drop', 2, 0.5, 0.5)}, {GAINS} select cast(class as integer) as class, cast(feature as integer) as feature, cast(bin as integer) as bin, cast(nl as bigint) as n_left, case when nl >= 10 and na - nl >= 10 then round(gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha, 6) + 0.0 end as gain from ran")
def _boosted_split_gains(spark, d):
    rows = _base(spark, d).join(_labeled(spark, d).select("instr", "ts", "label"), ["instr", "ts"])
    return rounded(boosting.first_split_gains(rows, {f: list(e) for f, e in CUTS.items()}, "label", (-1, 0, 1), 10, 1e-3).select(F.col("model").alias("class"), "feature", "bin", F.col("nl").alias("n_left"), "gain"))


@query("label_top_combinations", "select * from (" + ORACLES["labels_tuned"].replace("* from (with", "* from (with") + ") order by balance_score * abs(label_forward_return_corr) desc limit 3")
def _top_combinations(spark, d):
    return rounded(scoring.top_combinations(labels.tune_labels(_label_bars(spark, d), (0.5, 1.0), (0.5, 1.0), (2, 4), (N,), gap_seconds=90000), 3).drop("score"))


@query("target_consistency", f"with {TO_BARS}, {PANEL}, {ic_sql('instr').replace('select ' + chr(39), 'select instr, ' + chr(39))}, rr as (select *, row_number() over (partition by instr order by abs(ic) desc nulls last, feature) as rk from ics), bb as (select * from rr where rk <= 3), st as (select feature, count(*) as n_targets, min(ic) as lo, max(ic) as hi from bb group by 1) select feature, n_targets, round(lo, 6) + 0.0 as ic_min, round(hi, 6) + 0.0 as ic_max, sign(lo) = sign(hi) as sign_stable from st where n_targets = (select count(distinct instr) from ics)")
def _consistency(spark, d):
    scores = scoring.information_coefficients(_panel(spark, d), list(IC_FEATURES), "y", ["instr"], 20).withColumnRenamed("instr", "target")
    return rounded(scoring.consistency(scores, 3)[0])


@query("target_overlap", f"with {TO_BARS}, {PANEL}, {ic_sql('instr').replace('select ' + chr(39), 'select instr, ' + chr(39))}, rr as (select *, row_number() over (partition by instr order by abs(ic) desc nulls last, feature) as rk from ics), bb as (select * from rr where rk <= 3) select a.instr as target_a, b.instr as target_b, count(*) as overlap from bb a join bb b using (feature) group by 1, 2")
def _overlap(spark, d):
    scores = scoring.information_coefficients(_panel(spark, d), list(IC_FEATURES), "y", ["instr"], 20).withColumnRenamed("instr", "target")
    return scoring.consistency(scores, 3)[1]


NAMES = (
    "ES_log_return", "NQ_ofi", "6E_ofi", "ZN_log_return", "SR3_x", "cs_universe_ofi", "cs_class_ofi", "cs_other", "corr_ES_vs_gold_w60", "ix_gex_sign_x_log_return", "ix_corr_ES_vs_oil_w60_x_ofi_tc_z",
    "slope_2s5s_logret", "slope_x", "butterfly_2s5s10s", "butterfly_x", "synthetic_dxy_logret", "synthetic_x", "risk_off_score", "ofi", "hour_et", "is_rth", "log_volume", "spread_to_mid_bps", "hhi_bid_d10",
    "amihud_illiq_w20", "large_trade_volume_share", "side_cond_ask_resilience_buy", "average_trade_size", "rolling_volume_sum_w20", "kyle_lambda_w60", "vwap_eff_spread", "volume_imbalance_L3", "order_count_imbalance_L1", "cum_imbalance_d10",
    "microprice", "hidden_absorption_ratio_w30", "volume", "cvd_globex", "implied_volume", "mid_close", "spread_max_sub", "bid_px_L3", "ask_ord_L10", "ask_sz_L11", "book_ts_close", "halt_truncated", "atr", "instr", "seq",
)
_CROSS = "feature in ('synthetic_dxy_logret', 'risk_off_score', 'butterfly_2s5s10s') or regexp_matches(feature, '^(cs_universe_|cs_class_|ix_|corr_|slope_2s5s_|slope_5s10s_|slope_2s10s_|slope_10s30s_)') or regexp_matches(feature, '^(NQ|RTY|YM|6A|6B|6C|6E|6J|BZ|CL|HO|NG|RB|GC|HG|PA|PL|SI|SR3|TN|ZB|ZF|ZN|ZT|ZC|ZL|ZM|ZS|ZW)_')"
_LIQUID = "regexp_matches(feature, 'eff_spread|depth_weighted_spread|amihud_illiq|volume_imbalance_L|order_count_imbalance_L|order_size_imbalance_L|large_trade|hhi_|dw_imbalance|cum_imbalance|side_cond_|spread|kyle_lambda|average_trade_size|rolling_volume|log_volume')"
_RAW = "feature in ('ts', 'root', 'expiry', 'open', 'high', 'low', 'close', 'volume', 'dollar_volume', 'buys_qty', 'sells_qty', 'trades_count', 'unclassified_count', 'implied_volume', 'implied_buys', 'implied_sells', 'bid_close', 'ask_close', 'mid_close', 'spread_abs_close', 'spread_mean_sub', 'spread_std_sub', 'spread_max_sub', 'spread_min_sub', 'cvd_globex', 'cvd_rth', 'bars_since_rth_reset', 'is_session_warm', 'book_ts_close', 'book_ts_close_bid', 'book_ts_close_ask', 'label', 'realized_ret', 'realized_ret_pts', 'hit_offset', 'atr', 'halt_truncated') or regexp_full_match(feature, '(bid|ask)_(px|sz|ord)_L([1-9]|10)') or feature in ('instr', 'seq', 'year')"


@query("feature_names", f"select feature, {_CROSS} as is_cross_asset, {_LIQUID} as is_liquidity, not ({_RAW}) as is_feature from (values " + ", ".join(f"('{n}')" for n in NAMES) + ") t(feature)")
def _names(spark, d):
    rows = spark.createDataFrame([(n,) for n in NAMES], "feature string")
    panel_ = spark.createDataFrame([], ", ".join(f"`{n}` double" for n in NAMES))
    return rows.select("feature", scoring.is_cross_asset(F.col("feature"), "ES").alias("is_cross_asset"), scoring.is_liquidity(F.col("feature")).alias("is_liquidity"), F.col("feature").isin(scoring.feature_columns(panel_)).alias("is_feature"))


_SPEARMAN = "rk2 as (select *, row_number() over (order by abs(rank_ic) desc, feature) as rank from ics where rank_ic is not null)"


@query("liquidity_ranks", f"with {TO_BARS}, {PANEL}, {ic_sql('')}, {_SPEARMAN} select feature, cast(rank as integer) as rank, round(rank_ic, 6) + 0.0 as rank_ic from rk2 where {_LIQUID}")
def _liquidity_ranks(spark, d):
    return rounded(scoring.liquidity_ranks(scoring.information_coefficients(_panel(spark, d), list(IC_FEATURES), "y", least=20)).select("feature", "rank", "rank_ic"))


# --- Files, rolls, ingest --------------------------------------------------------------------------------------------

FILES = "files as (select case when o_custkey % 2 = 0 then 'VX' else 'ES' end as root, cast(o_orderdate as date) as day, case when o_custkey % 2 = 0 then 'VX' || substr('FGHJKMNQUVXZ', cast(1 + o_orderkey % 12 as integer), 1) || ((year(o_orderdate) + o_custkey % 3) % 10) else 'ES' || substr('HMUZ', cast(1 + o_orderkey % 4 as integer), 1) || (year(o_orderdate) % 10) end as expiry, cast(max(o_totalprice) as bigint) as bytes from orders group by 1, 2, 3)"


def _files(spark, d):
    o = ad.table(spark, d, "orders")
    vx = F.col("o_custkey") % 2 == 0
    year = F.year("o_orderdate")
    letter = lambda s, n: F.element_at(F.array(*[F.lit(c) for c in s]), (1 + F.col("o_orderkey") % n).cast("int"))
    expiry = F.when(vx, F.concat(F.lit("VX"), letter("FGHJKMNQUVXZ", 12), ((year + F.col("o_custkey") % 3) % 10).cast("string"))).otherwise(F.concat(F.lit("ES"), letter("HMUZ", 4), (year % 10).cast("string")))
    return o.select(F.when(vx, "VX").otherwise("ES").alias("root"), F.to_date("o_orderdate").alias("day"), expiry.alias("expiry"), "o_totalprice").groupBy("root", "day", "expiry").agg(F.round(F.max("o_totalprice")).cast("long").alias("bytes"))


FILES = FILES.replace("cast(max(o_totalprice) as bigint)", "cast(round(max(o_totalprice)) as bigint)")
FRONT = "front as (select root, day, arg_min(expiry, (-bytes, expiry)) as expiry, max(bytes) as bytes from files where bytes >= 1000 group by 1, 2)"


@query("roll_front_month", f"with {FILES}, {FRONT} select * from front")
def _front(spark, d):
    return rolls.front_month(_files(spark, d))


VXM = "vm as (select *, instr('FGHJKMNQUVXZ', substr(expiry, 3, 1)) as m, cast(substr(expiry, 4, 1) as integer) as dg from files where bytes >= 1000), vy as (select *, case when root = 'VX' then case when (year(day) // 10) * 10 + dg < year(day) - 6 then (year(day) // 10) * 10 + dg + 10 else (year(day) // 10) * 10 + dg end * 12 + m - 1 end as ym from vm)"


@query("roll_front_n", f"with {FILES}, {VXM}, ok as (select * from vy where root <> 'VX' or ym >= year(day) * 12 + month(day) - 1), rk as (select *, row_number() over (partition by root, day order by ym, case when root <> 'VX' then -bytes end, expiry) as slot from ok) select root, day, cast(slot as integer) as slot, expiry, bytes from rk where slot <= 3")
def _front_n(spark, d):
    return rolls.front_n(_files(spark, d), 3)


@query("roll_detect", f"with {FILES}, {FRONT}, wk as (select * from front where dayofweek(day) between 1 and 5), s as (select *, lag(expiry) over (partition by root order by day) as f from wk) select root, day, f as from_expiry, expiry as to_expiry from s where f is not null and f <> expiry")
def _rolls(spark, d):
    return rolls.detect_rolls(rolls.front_series(_files(spark, d)))


@query("catalog_gaps", f"with {FILES}, here as (select root, day, expiry, case when bytes % 3 = 0 then bytes // 2 else bytes end as bytes from files where bytes % 5 <> 0) select 'taq' as dataset, f.day, f.root, cast(sum(greatest(0, f.bytes - coalesce(h.bytes, 0))) as bigint) as missing_bytes, count(*) filter (h.bytes is null) as missing_files from files f left join here h on f.root = h.root and f.day = h.day and f.expiry = h.expiry group by 2, 3")
def _gaps(spark, d):
    f = _files(spark, d).withColumn("dataset", F.lit("taq"))
    here = f.where("bytes % 5 <> 0").withColumn("bytes", F.when(F.col("bytes") % 3 == 0, F.expr("bytes div 2")).otherwise(F.col("bytes")))
    return ingest.catalog_gaps(f, here)


RAW = "raw as (select event_id, user_id % 4 as instr, cast(strftime(ts, '%Y%m%d') as bigint) as UTCDate, strftime(ts, '%H%M%S') || lpad(cast(microsecond(ts) % 1000000 // 1000 as varchar), 3, '0') as UTCTime, case event_type when 'purchase' then 'TRADE AGRESSOR ON BUY' when 'click' then 'TRADE AGRESSOR ON SELL' when 'signup' then 'TRADE' when 'view' then 'QUOTE BID' else 'QUOTE SELL' end as Type, value as Price, event_id % 50 as Quantity, event_id % 16 as Flags, ts from events)"


def _raw(spark, d):
    e = ad.table(spark, d, "events")
    kinds = {"purchase": "TRADE AGRESSOR ON BUY", "click": "TRADE AGRESSOR ON SELL", "signup": "TRADE", "view": "QUOTE BID"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("QUOTE SELL"))
    # A leading zero of the time is dropped, as in files that hold it as a number.
    raw = e.select((F.col("user_id") % 4).alias("instr"), F.date_format("ts", "yyyyMMdd").cast("long").alias("UTCDate"), F.regexp_replace(F.date_format("ts", "HHmmssSSS"), "^0", "").alias("UTCTime"), kind.alias("Type"), F.col("value").alias("Price"), (F.col("event_id") % 50).alias("Quantity"), F.lit(1).cast("long").alias("Orders"), (F.col("event_id") % 16).alias("Flags"), F.col("event_id").alias("seq"))
    return raw.withColumn("ts", ingest.timestamp_of(F.col("UTCDate"), F.col("UTCTime"), 9))


@query("ingest_trades", f"with {RAW} select instr, date_trunc('millisecond', ts) as ts, event_id as seq, round(Price, 6) + 0.0 as price, Quantity as quantity, case Type when 'TRADE AGRESSOR ON BUY' then 1 when 'TRADE AGRESSOR ON SELL' then -1 else 0 end as aggressor_sign, Flags & 1 <> 0 as is_implied from raw where Type like 'TRADE%' and Quantity > 0 and Flags & 8 = 0".replace("Flags & 1 <> 0", "(Flags & 1) <> 0").replace("Flags & 8 = 0", "(Flags & 8) = 0"))
def _ingest_trades(spark, d):
    return rounded(ingest.trades_of(_raw(spark, d), ["instr"]))


@query("ingest_quotes", f"with {RAW} select instr, date_trunc('millisecond', ts) as ts, event_id as seq, case Type when 'QUOTE BID' then 'bid' else 'ask' end as side, round(Price, 6) + 0.0 as price, Quantity as size, cast(1 as bigint) as orders, (Flags & 1) <> 0 as is_implied from raw where Type like 'QUOTE%'")
def _ingest_quotes(spark, d):
    return rounded(ingest.quotes_of(_raw(spark, d), ["instr"]))


@query("ingest_type_counts", f"with {RAW} select Type, count(*) as n from raw group by 1")
def _type_counts(spark, d):
    return ingest.type_counts(_raw(spark, d))


# --- Whole panels ----------------------------------------------------------------------------------------------------


@query("panel_instrument")
def _instrument(spark, d):
    """The whole feature panel: its parts have SQL of their own above; here only that they fit together."""
    small = dict(rv=(20, 60), ranges=(20,), surprise=(20,), moments=20, asymmetry=20, auto=20)
    return rounded(panel.instrument_features(ad.bars(spark, d), days=(N,), **small))


@query("panel_target")
def _target(spark, d):
    small = dict(rv=(20, 60), ranges=(20,), surprise=(20,), moments=20, asymmetry=20, auto=20)
    features = panel.base_features(ad.bars(spark, d), **small)
    wide = cs.widen(features.withColumn("instr", F.concat(F.lit("I"), F.col("instr"))).select("ts", "instr", "log_return", "ofi"), ["log_return", "ofi"], ["I0", "I1", "I2", "I3"])
    return rounded(panel.target_panel("I0", features.where("instr = 0"), wide, days=N, minutes=60, horizon=4, least=2, gap_seconds=90000))
