"""Feature panels: passes over bars in the order of what they need. Each level is one select, so that features over one
window share its shuffle and sort."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bar, book, patterns, session
from ..functions.along import EPS, Along, share
from ..operators import bars as bars_op
from ..operators import cross_section, daily, labels, sequential
from ..operators.asof import asof
from ..operators.scans import by_group

#: Columns that are normalised by time of day, and those that are smoothed, where a panel has them.
NORMALISED = (
    "log_return", "abs_log_return", "log_volume",
    "ofi", "aggressor_ratio", "cvd_change", "net_aggressor_volume",
    "average_trade_size", "trades_count_log",
    "implied_volume_share", "implied_aggressor_skew",
    "spread_to_mid_bps", "spread_sub_var_ratio",
    "realized_vol_w20", "realized_vol_w60", "realized_vol_w120",
    "vol_surprise_w20", "vol_surprise_w60", "vol_surprise_w120",
    "range_vol_parkinson_w20", "range_vol_parkinson_w60", "range_vol_gk_w20",
    "up_vol_w60", "down_vol_w60", "vol_direction_ratio_w60",
    "vol_ratio_short_long",
    "rolling_skew_w60", "rolling_kurt_w60", "vol_of_vol_w60",
    "amihud_illiq_w20", "return_autocorr_lag1_w60",
    "vwap_return_w20", "price_volume_corr_w60", "price_impact_slope_w60",
    "jump_indicator_w20", "vwap_deviation",
)
SMOOTHED = ("abs_log_return", "ofi", "cvd_change", "spread_to_mid_bps", "vol_surprise_w20", "vol_surprise_w60", "realized_vol_w20", "log_volume")


def base_features(bars: DataFrame, rv: tuple = (20, 60, 120), ranges: tuple = (20, 60), surprise: tuple = (20, 60, 120), moments: int = 60, asymmetry: int = 60, auto: int = 60, short: int = 20, long: int = 60, roll: int = 20, by: str = "instr") -> DataFrame:
    """Returns, flow, volatility, moments, illiquidity and their ratios, in three levels, and the session VWAP."""
    a, c, have = Along([by], ["ts", "seq"]), F.col, set(bars.columns)
    first = {
        "log_return": bar.log_return(a, c("close")),
        "log_volume": bar.log_volume(c("volume")),
        "ofi": bar.order_flow_imbalance(c("buys_qty"), c("sells_qty")),
        "aggressor_ratio": bar.aggressor_ratio(c("buys_qty"), c("sells_qty")),
        "net_aggressor_volume": c("buys_qty") - c("sells_qty"),
        "cvd_change": c("cvd_globex") - a.lag(c("cvd_globex")),
        "spread_to_mid_bps": bar.spread_bps(c("spread_abs_close"), c("mid_close")),
        f"rolling_volume_sum_w{roll}": a.sum(c("volume"), roll),
        f"rolling_volume_std_w{roll}": a.std(c("volume"), roll),
    }
    if "trades_count" in have:
        first |= {"average_trade_size": share(c("volume"), c("trades_count")), "trades_count_log": F.ln(1 + c("trades_count")), f"rolling_trade_count_mean_w{roll}": a.mean(c("trades_count"), roll)}
    if {"spread_std_sub", "spread_mean_sub"} <= have:
        first["spread_sub_var_ratio"] = share(c("spread_std_sub"), c("spread_mean_sub"))
    if {"implied_volume", "implied_buys", "implied_sells"} <= have:
        first |= {"implied_volume_share": share(c("implied_volume"), c("volume")), "implied_aggressor_skew": share(c("implied_buys") - c("implied_sells"), c("implied_volume"))}
    rows = bars.withColumns(first).withColumn("abs_log_return", F.abs("log_return"))
    r, v = c("log_return"), c("log_volume")
    second = {f"realized_vol_w{n}": bar.realized_volatility(a, r, n) for n in rv}
    second |= {f"vol_surprise_w{n}": v - a.mean(v, n) for n in surprise}
    second |= {f"range_vol_parkinson_w{n}": bar.parkinson(a, c("high"), c("low"), n) for n in ranges}
    second |= {
        f"range_vol_gk_w{roll}": bar.garman_klass(a, c("open"), c("high"), c("low"), c("close"), roll),
        f"up_vol_w{asymmetry}": bar.one_sided_volatility(a, r, asymmetry, True),
        f"down_vol_w{asymmetry}": bar.one_sided_volatility(a, r, asymmetry, False),
        f"rolling_skew_w{moments}": a.skew(r, moments),
        f"rolling_kurt_w{moments}": a.kurtosis(r, moments),
        f"amihud_illiq_w{roll}": bar.amihud(a, r, c("volume"), c("close"), roll),
        f"return_autocorr_lag1_w{auto}": bar.autocorrelation(a, r, 1, auto),
        f"price_volume_corr_w{auto}": a.deviation_corr(r, v, auto),
        f"price_impact_slope_w{auto}": a.deviation_slope(v, r, auto),
        "_vwap": bar.rolling_vwap(a, c("high"), c("low"), c("close"), c("volume"), roll),
        "_vsum": a.sum(c("volume"), roll),
    }
    rows = rows.withColumns(second)
    third = {f"vwap_return_w{roll}": bar.vwap_return(a, c("_vwap"), c("_vsum")), f"vol_direction_ratio_w{asymmetry}": share(c(f"down_vol_w{asymmetry}"), c(f"up_vol_w{asymmetry}"))}
    if short in rv:
        third |= {f"vol_of_vol_w{long}": a.std(c(f"realized_vol_w{short}"), long), f"jump_indicator_w{short}": bar.jump(a, r, c(f"realized_vol_w{short}"), output="zscore")}
    if short in rv and long in rv:
        third["vol_ratio_short_long"] = share(c(f"realized_vol_w{short}"), c(f"realized_vol_w{long}"))
    rows = rows.withColumns(third).drop("_vwap", "_vsum").withColumn("_et_date", F.to_date(session.eastern(c("ts"))))
    return rows.withColumn("vwap_deviation", c("close") - session.session_vwap(rows, by)).drop("_et_date")


def normalised(bars: DataFrame, values: list[str], days: tuple = (30, 60), minutes: int = 15, by: str = "instr") -> DataFrame:
    """Plain and robust deviations by time of day of all columns: windows share one shuffle, medians are one pass over the values."""
    rows = bars.withColumn("bod", session.bar_of_day(F.col("ts"), minutes))
    a = session.time_of_day(by)
    rows = rows.withColumns({f"{v}_tc_z_w{n}": session.tc_zscore(a, F.col(v), n) for n in days for v in values})
    robust = {f"{v}_tc_madz_w{n}": (v, n) for n in days for v in values}
    if robust:
        rows = by_group(rows, [by, "bod"], values, list(robust), lambda f: {name: session.robust_deviation(f[v], n) for name, (v, n) in robust.items()})
    return rows.drop("bod")


def book_features(bars: DataFrame, depth: int = 10, n: int = 60, by: str = "instr") -> DataFrame:
    """Composites over the levels that the frame has (named by the depth asked for), features of single levels, migration."""
    a, b, have = Along([by], ["ts", "seq"]), book.Book(), set(bars.columns)
    d = book.effective_depth(bars.columns, depth)
    # The levels' flows stand in columns of their own, so that each is worked out once.
    flow = {k: f"_flow_L{k}" for k in range(1, depth + 1) if {f"{s}_{x}_L{k}" for s in ("bid", "ask") for x in ("px", "sz")} <= have}
    bars = bars.withColumns({c: book.flow_at_level(a, b, k) for k, c in flow.items()})
    flows = [F.col(flow[k]) for k in range(1, d + 1)] if all(k in flow for k in range(1, d + 1)) else None
    new = {
        f"cum_imbalance_d{depth}": book.cumulative_imbalance(b, d),
        f"dw_imbalance_d{depth}": book.distance_weighted_imbalance(b, d),
        f"depth_weighted_spread_d{depth}": book.depth_weighted_spread(b, d),
        f"liquidity_adjusted_spread_d{depth}": book.liquidity_adjusted_spread(b, d),
        f"hhi_bid_d{depth}": book.concentration(b, "bid", d),
        f"hhi_ask_d{depth}": book.concentration(b, "ask", d),
        f"deep_ofi_d{depth}_decay0": book.deep_flow(a, b, d, flows=flows),
        f"deep_ofi_d{depth}_decay03": book.deep_flow(a, b, d, 0.3, flows=flows),
        f"spread_zscore_w{n}": book.spread_zscore(a, b, 1, n),
    }
    if d >= 3:
        new["spread_acceleration"] = book.spread_acceleration(b)
    for k in range(1, depth + 1):
        level = lambda *names, k=k: {f"{s}_{x}_L{k}" for s in ("bid", "ask") for x in names} <= have
        if level("sz"):
            new[f"volume_imbalance_L{k}"] = book.volume_imbalance(b, k)
        if level("px"):
            new[f"basic_spread_L{k}"] = b.spread(k)
        if level("px", "sz"):
            new[f"ofi_at_L{k}"] = F.col(flow[k])
        if k <= 5 and level("ord"):
            new[f"order_count_imbalance_L{k}"] = book.order_count_imbalance(b, k)
            if level("sz"):
                new[f"order_size_imbalance_L{k}"] = book.order_size_imbalance(b, k)
    for side in ("bid", "ask"):
        for to in (2, 3):
            if {f"{side}_sz_L1", f"{side}_sz_L{to}"} <= have:
                new[f"{side}_migration_L1_to_L{to}"] = book.migration(a, b, side, to)
    return bars.withColumns(new).drop(*flow.values())


def pattern_features(rows: DataFrame, n: int = 30, spike: int = 20, atr: int = 20, by: str = "instr") -> DataFrame:
    """Detectors over base features; the two that look behind a breakout look ahead."""
    a, c = Along([by], ["ts", "seq"]), F.col
    vol = c(f"range_vol_parkinson_w{atr}") if f"range_vol_parkinson_w{atr}" in rows.columns else a.mean(F.ln(c("high") / c("low")), atr)
    rows = rows.withColumn("atr_proxy", vol * c("close"))
    x = c("atr_proxy")
    rv = c("realized_vol_w20") if "realized_vol_w20" in rows.columns else a.std(c("log_return"), 20)
    rows = rows.withColumn("_rv", rv).withColumns({
        f"breakout_magnitude_up_w{n}": patterns.breakout_magnitude(a, c("high"), x, n),
        f"breakout_magnitude_down_w{n}": patterns.breakout_magnitude(a, c("low"), x, n, up=False),
        f"breakout_reversal_up_w{n}": patterns.breakout_reversal(a, c("high"), c("close"), x, n),
        f"breakout_reversal_down_w{n}": patterns.breakout_reversal(a, c("low"), c("close"), x, n, up=False),
        f"spike_and_fade_volume_w{spike}": patterns.spike_and_fade(a, c("volume"), spike),
        f"imbalance_persistence_runlength_w{n}": patterns.run_length(a, c("ofi"), n),
        f"cvd_price_divergence_up_w{n}": patterns.flow_divergence(a, c("cvd_globex"), c("high"), n),
        f"cvd_price_divergence_down_w{n}": patterns.flow_divergence(a, c("cvd_globex"), c("low"), n, up=False),
        f"range_compression_ratio_w{spike}": patterns.range_compression(a, c("high"), c("low"), x, spike),
        f"absorption_score_w{spike}": patterns.absorption(a, (c("buys_qty") - c("sells_qty")) * c("close"), c("_rv"), c("close") * c("volume"), spike),
    })
    return rows.withColumns({f"post_breakout_flow_reversal_{d}": patterns.flow_after(a, c(f"breakout_reversal_{d}_w{n}"), c("ofi")) for d in ("up", "down")}).drop("_rv")


def engine_features(rows: DataFrame, order: float = 0.4, tau: float = 1e-5, pins: tuple = (10.0, 25.0, 50.0), by: str = "instr") -> DataFrame:
    """Fractional difference of the log close, and the distance to round numbers."""
    name = f"fracdiff_close_d{int(round(order * 10)):02d}"
    rows = sequential.fracdiff(rows.withColumn("_log", F.ln("close")), "_log", order, name, tau, [by]).drop("_log")
    return rows.withColumns({f"round_pin_{int(n)}": pin_distance(F.col("close"), n) for n in pins})


def pin_distance(close, n: float):
    return F.least(F.pmod(close, F.lit(n)), F.lit(n) - F.pmod(close, F.lit(n)))


def execution_features(bars: DataFrame, execution: DataFrame, n: int = 30, by: str = "instr") -> DataFrame:
    """Execution bars as of each bar (equal times count), and ratios of them, as far as the columns are there."""
    have = set(execution.columns)
    rows = asof(bars, execution, [by])
    c, a = F.col, Along([by], ["ts", "seq"])
    new = {}
    for tag, x in (("", ""), ("_buy", "_buy"), ("_sell", "_sell")):
        if {f"eff_spread{x}_sum", f"eff_spread{x}_weight"} <= have:
            new[f"vwap_eff_spread{tag}"] = share(c(f"eff_spread{x}_sum"), c(f"eff_spread{x}_weight"))
    if "large_trade_volume" in have:
        new["large_trade_volume_share"] = share(c("large_trade_volume"), c("volume"))
    if "n_large_trades" in have:
        new["n_large_trades_log"] = F.ln(1 + c("n_large_trades"))
    if {"net_bid_decrement_no_trade_L1", "net_ask_decrement_no_trade_L1"} <= have:
        new["cancel_to_trade_ratio"] = share(c("net_bid_decrement_no_trade_L1") + c("net_ask_decrement_no_trade_L1"), c("volume"))
    if "quote_update_count" in have and "trades_count" in bars.columns:
        new["quote_to_trade_ratio"] = share(c("quote_update_count"), c("trades_count"))
    if {"bid_up_count", "bid_down_count", "ask_up_count", "ask_down_count"} <= have:
        up, down = c("bid_up_count") + c("ask_down_count"), c("bid_down_count") + c("ask_up_count")
        new["quote_movement_directionality"] = share(up - down, up + down)
    for side, vol, name in (("ask", "lift_ask_vol", "side_cond_ask_resilience_buy"), ("bid", "hit_bid_vol", "side_cond_bid_resilience_sell")):
        if {f"{side}_sz_L1_delta_signed", vol} <= have:
            new[name] = share(c(f"{side}_sz_L1_delta_signed") + c(vol), c(vol))
    if "hidden_absorption_volume" in have:
        new[f"hidden_absorption_ratio_w{n}"] = patterns.rolling_ratio(a, c("hidden_absorption_volume"), c("volume"), n)
    rows = rows.withColumns(new)
    if {"vwap_eff_spread_buy", "vwap_eff_spread_sell"} <= set(rows.columns):
        rows = rows.withColumn("eff_spread_asymmetry", c("vwap_eff_spread_buy") - c("vwap_eff_spread_sell"))
    return rows


def sub_bar_features(bars: DataFrame, short_bars: DataFrame, bucket: int = 25_000, fast: float = 5.0, slow: float = 60.0, every: str = "15 minutes", by: str = "instr") -> DataFrame:
    """Volume buckets and decaying intensities of short bars as of each bar: value, age in seconds, buckets that closed in
    the window before, intensities."""
    buckets = sequential.volume_buckets(short_bars, bucket, by=[by])
    out = asof(bars, buckets.select(by, "ts", "vpin"), [by], carry="_closed")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_closed").cast("timestamp"))) / 1e6
    out = out.withColumn("vpin_staleness_seconds", age).drop("_closed")
    counts = bars_op.in_bars(buckets.select(by, "ts"), every, [by]).agg(F.count(F.lit(1)).alias("vpin_buckets_velocity_w15m"))
    out = out.join(counts, [by, "ts"], "left").withColumn("vpin_buckets_velocity_w15m", F.coalesce("vpin_buckets_velocity_w15m", F.lit(0)))
    return asof(out, sequential.intensities(short_bars, fast, slow, [by]), [by])


#: Columns of a book's levels.
_LEVEL = re.compile("(bid|ask)_(px|sz)_L[0-9]+")


def vx_features(target: DataFrame, slots: list[DataFrame], n: int = 20, spread_n: int = 60, by: str = "instr", instruments: list | None = None) -> DataFrame:
    """Volatility futures of up to three slots as of each bar: mids, deviation, calendar spread and ratio, curvature, and the
    deep flow of the first slot's book where it has sizes. Slots without an instrument column stand for all of `instruments`."""
    if not 1 <= len(slots) <= 3:
        raise ValueError("one to three slots")
    out = target
    keys = [by]
    for k, s in enumerate(slots, 1):
        named = s.select(*[x for x in keys if x in s.columns], "ts", *[F.col(x).alias(f"VX{k}_{y}") for x, y in (("bid_close", "bid_px_L1"), ("ask_close", "ask_px_L1"), ("mid_close", "mid_close"), ("spread_abs_close", "spread_abs_close"))], *[F.col(x).alias(f"VX{k}_{x}") for x in s.columns if _LEVEL.fullmatch(x) and x not in ("bid_px_L1", "ask_px_L1")])
        if by not in named.columns:
            if not instruments:
                raise ValueError("slots without instruments need a list of them")
            named = named.withColumn(by, F.explode(F.array(*[F.lit(i) for i in instruments])))
        out = asof(out, named, [by])
    a, books = Along([by], ["ts", "seq"]), [book.Book(f"VX{k}") for k in range(1, len(slots) + 1)]
    new = {"vx1_mid": books[0].mid(), f"vx1_zscore_w{n}": a.zscore(books[0].mid(), n), f"vx_spread_zscore_w{spread_n}": a.zscore(books[0].spread(), spread_n)}
    if {"VX1_bid_sz_L1", "VX1_ask_sz_L1"} <= set(out.columns):
        new["vx_ofi_weighted"] = book.deep_flow(a, books[0], book.effective_depth(out.columns, 10, "VX1_"))
    if len(slots) > 1:
        new |= {"vx2_mid": books[1].mid(), "vx_calendar_spread": books[0].mid() - books[1].mid(), "vx_calendar_ratio": share(books[0].mid(), books[1].mid())}
    if len(slots) > 2:
        new |= {"vx3_mid": books[2].mid(), "vx_term_curvature": book.curvature(*[b.mid() for b in books])}
    return out.withColumns(new)


def instrument_features(bars: DataFrame, days: tuple = (30, 60), overnight: bool = True, with_patterns: bool = True, engines: bool = True, smoothed: bool = True, cyclic: bool = True, minutes: int = 15, **windows) -> DataFrame:
    """The whole panel of an instrument."""
    rows = session.session_flags(base_features(bars, **windows))
    if cyclic:
        rows = session.cyclic_minute(rows)
    if overnight:
        rows = daily.overnight(rows)
    if with_patterns:
        rows = pattern_features(rows)
    if engines:
        rows = engine_features(rows)
    rows = normalised(rows, [v for v in NORMALISED if v in rows.columns], days, minutes)
    return sequential.ema(rows, [v for v in SMOOTHED if v in rows.columns]) if smoothed else rows


def with_options(panel: DataFrame, options: DataFrame, on: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The panel with the columns of an options panel that it hasn't itself: the panel decides rows and shared columns. Times
    that the options repeat repeat the panel's rows, as a left join does."""
    return panel.join(options.select(*on, *[c for c in options.columns if c not in on and c not in panel.columns]), list(on), "left")


def target_panel(target: str, features: DataFrame, wide: DataFrame | None = None, up: float = 1.5, down: float = 1.0, horizon: int = 8, days: int = 30, minutes: int = 15, least: int = 5, drop_invalid: bool = True, **options) -> DataFrame:
    """A target's features beside the wide frame (without the target's own columns), with labels over ranges by time of day."""
    rows = features
    if wide is not None:
        own = [c for c in wide.columns if c.startswith(f"{target}_")]
        more = wide.drop(*own)
        rows = rows.join(more.select("ts", *[c for c in more.columns if c != "ts" and c not in rows.columns]), "ts", "left")
    rows = labels.first_touch(labels.with_atr(rows, days, mode="time_conditional", minutes=minutes), up, down, horizon, halt_mode="truncate", least=least, **options)
    return rows.where(labels.finite("atr") & labels.finite("realized_ret")) if drop_invalid else rows


def column_groups(columns: list[str]) -> dict[str, int]:
    """How many columns a panel has of each kind, by name."""
    kinds = {"cross-section": ("cs_", "corr_", "ix_", "slope_", "butterfly_", "synthetic_"), "book": ("cum_imb", "dw_imb", "volume_imb", "ofi_at", "deep_ofi", "hhi", "order_", "basic_spread", "depth_weighted", "liquidity"), "gamma": ("gex", "total_gex", "distance_to"), "volatility futures": ("vx",), "overnight": ("overnight",)}
    out: dict[str, int] = {}
    for c in columns:
        kind = next((k for k, starts in kinds.items() if c.startswith(starts)), "normalised" if "_tc_" in c else "smoothed" if "_ema_" in c else "bar")
        out[kind] = out.get(kind, 0) + 1
    return out


__all__ = ["EPS", "base_features", "book_features", "column_groups", "cross_section", "engine_features", "execution_features", "instrument_features", "normalised", "pattern_features", "sub_bar_features", "target_panel", "vx_features", "with_options"]
