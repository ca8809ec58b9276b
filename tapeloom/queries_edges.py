"""Registered queries over what the first ones leave out: undivided by guards, other options of operators, SQL functions, builds, training.

Values behind a tiny denominator are compared as signed logarithms, so that size and sign count at any magnitude.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters as ad
from . import queries as q
from . import sql
from .functions import bar, book
from .functions.along import share
from .operators import bars as bars_op
from .operators import cross_section as cs
from .operators import execution, scoring, sequential
from .plans import panel
from .queries import BASE, DEPTH, EPS, ET, EVERY, N, SNAP, TO_BARS, TRADES, A, final, lag, ofi_sql, roll, rounded
from .sources import builds
from .sources.scratch import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}
query = q.registrar(QUERIES, ORACLES)


def slog(x):
    """Sign times the logarithm of one more than the size."""
    return F.signum(x) * F.ln(1 + F.abs(x))


def slog_sql(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


# --- SQL surface -----------------------------------------------------------------------------------------------------


@query("sql_bars", q.ORACLES["bars_ohlcv"])
def _sql_bars(spark, d):
    sql.register(spark, ad.trades(spark, d))
    return rounded(spark.sql("select * from ohlcv_bars(21600)"))


@query("sql_asof", q.ORACLES["asof_strict_tolerance"])
def _sql_asof(spark, d):
    sql.register(spark, ad.trades(spark, d), ad.quotes(spark, d))
    return rounded(spark.sql("select instr, ts, seq, mid, mid_ts from trades_asof(1800)"))


# --- Without guards --------------------------------------------------------------------------------------------------


@query("features_time_of_day_all", f"with {TO_BARS}, {q.TC} " + final({"lv_tc_madz_log": f"r:{slog_sql(f'((lv - med) / (1.4826 * mad + {EPS}))')}"}, "tc4"))
def _time_of_day_all(spark, d):
    rows = panel.normalised(ad.bars(spark, d).withColumn("lv", bar.log_volume(F.col("volume"))), ["lv"], (N,))
    return rounded(rows.select("instr", "ts", slog(F.col("lv_tc_madz_w5")).alias("lv_tc_madz_log")))


@query("features_spread_ratio_all", f"with {TO_BARS}, {DEPTH}, {SNAP}, {q.TOP} " + final({"spread_volatility_ratio_log": f"r:{slog_sql(f'(bps / (tick_volatility + {EPS}))')}"}, "t3"))
def _spread_ratio_all(spark, d):
    b, c = book.Book(), F.col
    rows = q._snapshot(spark, d).withColumns({"mid": b.mid(), "sp": b.spread()})
    rows = rows.withColumns({"mid_return": F.ln(c("mid") / A.lag(c("mid"))), "bps": bar.spread_bps(c("sp"), c("mid"))}).withColumn("tv", A.std(c("mid_return"), N))
    return rounded(rows.select("instr", "ts", slog(share(c("bps"), c("tv"))).alias("spread_volatility_ratio_log")))


_RATIOS = {
    "cancel_to_trade_ratio": ("net_bid_decrement_no_trade_L1 + net_ask_decrement_no_trade_L1", "volume"), "quote_to_trade_ratio": ("quote_update_count", "trades_count"),
    "side_cond_ask_resilience_buy": ("ask_sz_L1_delta_signed + lift_ask_vol", "lift_ask_vol"), "side_cond_bid_resilience_sell": ("bid_sz_L1_delta_signed + hit_bid_vol", "hit_bid_vol"),
}
_EXEC_JOINED = q.ORACLES["execution_features"].split(", j2 as")[0]


@query("execution_ratios_all", f"{_EXEC_JOINED} " + final({f"{n}_log": f"r:{slog_sql(f'(({a}) / ({b} + {EPS}))')}" for n, (a, b) in _RATIOS.items()}, "j"))
def _execution_ratios_all(spark, d):
    e = execution.execution_bars(ad.trades(spark, d), ad.quotes(spark, d), ad.depth(spark, d), EVERY)
    out = panel.execution_features(ad.bars(spark, d), e, 4)
    return rounded(out.select("instr", "ts", *[slog(F.col(n)).alias(f"{n}_log") for n in _RATIOS]))


# --- Interactions: every product, over columns of the base panel that stand for the named ones -----------------------

STANDS_FOR = {
    "gex_sign": "ofi", "distance_to_zero_gamma_flip_bp": "spread_to_mid_bps", "vx1_zscore_w20": "vol_surprise_w5", "vx_calendar_ratio": "vol_ratio_short_long", "cvd_change": "cvd_change",
    "vol_ratio_short_long": "vol_direction_ratio_w5", "ofi_tc_z_w30": "aggressor_ratio", "log_return": "log_return", "vol_surprise_w20": "log_volume", "vol_of_vol_w60": "vol_of_vol_w10", "jump_indicator_w20": "jump_indicator_w5",
    "synthetic_dxy_logret": "vwap_return_w5", "rolling_kurt_w60": "rolling_kurt_w5", "range_compression_ratio_w20": "range_vol_parkinson_w5",
    **{f"corr_ES_vs_{m}_w60": c for m, c in (("gold", "price_volume_corr_w5"), ("oil", "return_autocorr_lag1_w5"), ("ZN", "rolling_skew_w5"), ("DXY", "price_impact_slope_w5"))},
}
_PRODUCTS = {
    "ix_gex_sign_x_ofi_tc_z_w30": ("gex_sign", "ofi_tc_z_w30"), "ix_gex_sign_x_log_return": ("gex_sign", "log_return"),
    "ix_dist_zero_gamma_x_ofi_tc_z": ("distance_to_zero_gamma_flip_bp", "ofi_tc_z_w30"), "ix_dist_zero_gamma_x_log_return": ("distance_to_zero_gamma_flip_bp", "log_return"),
    "ix_vx1_zscore_x_vol_surprise_w20": ("vx1_zscore_w20", "vol_surprise_w20"), "ix_vx1_zscore_x_ofi_tc_z_w30": ("vx1_zscore_w20", "ofi_tc_z_w30"),
    "ix_vx_calendar_ratio_x_cvd_change": ("vx_calendar_ratio", "cvd_change"), "ix_vol_ratio_short_long_x_ofi_tc_z": ("vol_ratio_short_long", "ofi_tc_z_w30"),
    "ix_vol_of_vol_w60_x_jump_indicator": ("vol_of_vol_w60", "jump_indicator_w20"), "ix_dxy_logret_x_log_return": ("synthetic_dxy_logret", "log_return"),
    "ix_corr_ES_vs_gold_w60_x_ofi_tc_z": ("corr_ES_vs_gold_w60", "ofi_tc_z_w30"), "ix_corr_ES_vs_oil_w60_x_ofi_tc_z": ("corr_ES_vs_oil_w60", "ofi_tc_z_w30"),
    "ix_corr_ES_vs_ZN_w60_x_ofi_tc_z": ("corr_ES_vs_ZN_w60", "ofi_tc_z_w30"), "ix_corr_ES_vs_DXY_w60_x_ofi_tc_z": ("corr_ES_vs_DXY_w60", "ofi_tc_z_w30"),
    "ix_rolling_kurt_x_jump_indicator": ("rolling_kurt_w60", "jump_indicator_w20"), "ix_range_compression_x_log_return": ("range_compression_ratio_w20", "log_return"),
}


@query("cross_interactions_all", f"with {TO_BARS}, {BASE} select instr, ts, " + ", ".join(f"round({slog_sql(f'({STANDS_FOR[x]} * {STANDS_FOR[y]})')}, 6) + 0.0 as {n}" for n, (x, y) in _PRODUCTS.items()) + " from base")
def _interactions_all(spark, d):
    rows = q._base(spark, d).select("instr", "ts", *[F.col(c).alias(n) for n, c in STANDS_FOR.items()])
    made = cs.interactions(rows, "ES")
    return rounded(made.select("instr", "ts", *[slog(F.col(n)).alias(n) for n in made.columns if n.startswith("ix_")]))


# --- Options of operators that no query reached ----------------------------------------------------------------------

_VX_BOOK = "vxb as (select t.instr, t.ts, " + ", ".join(f"v.{x}_L{k} as VX1_{x}_L{k}" for k in (1, 2, 3) for x in ("bid_px", "ask_px", "bid_sz", "ask_sz")) + " from (select * from bars where instr = 0) t asof left join (select * from snap where instr = 1) v on t.ts >= v.ts)"


@query("features_vx_flow", f"with {TO_BARS}, {DEPTH}, {SNAP}, {_VX_BOOK} " + final({"vx_ofi_weighted": "r:cast(" + " + ".join(ofi_sql(k, "VX1_") for k in (1, 2, 3)) + " as double)"}, "vxb"))
def _vx_flow(spark, d):
    snap = q._snapshot(spark, d).where("instr = 1")
    levels = [f"{s}_{x}_L{k}" for k in (1, 2, 3) for s in ("bid", "ask") for x in ("px", "sz")]
    slot = snap.select("ts", "seq", F.col("bid_px_L1").alias("bid_close"), F.col("ask_px_L1").alias("ask_close"), "mid_close", "spread_abs_close", *levels)
    out = panel.vx_features(ad.bars(spark, d).where("instr = 0").select("instr", "ts", "seq"), [slot], N, N, instruments=[0])
    return rounded(out.select("instr", "ts", F.col("vx_ofi_weighted").cast("double").alias("vx_ofi_weighted")))


@query("features_depth_ratio", f"with {TO_BARS}, {DEPTH}, {SNAP} " + final({f"depth_ratio_{n}": "r:(" + " + ".join(f"bid_sz_L{k}" for k in range(1, n + 1)) + ") / (" + " + ".join(f"ask_sz_L{k}" for k in range(1, n + 1)) + f" + {EPS})" for n in (1, 5, 10)}, "snap"))
def _depth_ratio(spark, d):
    rows = q._snapshot(spark, d)
    side = lambda s: F.array(*[F.col(f"{s}_sz_L{k}").cast("double") for k in range(1, 11)]).alias(f"{s}_sz")
    levels = F.struct(side("bid"), side("ask"))
    return rounded(rows.select("instr", "ts", *[bar.depth_ratio(levels, n).alias(f"depth_ratio_{n}") for n in (1, 5, 10)]))


@query("panel_with_options", f"with {TO_BARS} select a.ts, round(a.close, 6) + 0.0 as close, a.volume, round(b.spread_abs_close, 6) + 0.0 as spread_abs_close, b.trades_count from bars a left join bars b on a.ts = b.ts and b.instr = 1 where a.instr = 0")
def _with_options(spark, d):
    b = ad.bars(spark, d)
    return rounded(panel.with_options(b.where("instr = 0").select("ts", "close", "volume"), b.where("instr = 1").select("ts", "close", "spread_abs_close", "trades_count")))


_EW = f"nb as (select *, ln(close / {lag('close')}) as lr, row_number() over (partition by instr order by ts) as k from bars), em(instr, k, ts, x, e) as (select instr, k, ts, lr, lr * lr from nb where k = 2 union all select b.instr, b.k, b.ts, b.lr, (1 - 2e0 / 6e0) * e.e + 2e0 / 6e0 * b.lr * b.lr from em e join nb b on b.instr = e.instr and b.k = e.k + 1)"


@query("realized_volatility_ewma", f"with recursive {TO_BARS}, {_EW} select n.instr, n.ts, round(sqrt(e), 6) + 0.0 as realized_vol_w5 from nb n left join em on em.instr = n.instr and em.k = n.k")
def _ewma(spark, d):
    rows = ad.bars(spark, d).withColumn("lr", bar.log_return(A, F.col("close")))
    return rounded(sequential.realized_volatility(rows, "lr", 5, "ewma").select("instr", "ts", "realized_vol_w5"))


_RANKS = "ab as (select feature, instr, abs(ic) as x from ics where ic is not null), full_ as (select feature from ab group by 1 having count(*) = (select count(distinct instr) from ics)), rk3 as (select *, rank() over (partition by instr order by x) + (count(*) over (partition by instr, x) - 1) / 2.0 as rx from ab where feature in (select feature from full_))"


@query("target_rank_correlation", f"with {TO_BARS}, {q.PANEL}, {q.ic_sql('instr').replace('select ' + chr(39), 'select instr, ' + chr(39))}, {_RANKS} select a.instr as target_a, b.instr as target_b, round(corr(a.rx, b.rx), 6) + 0.0 as rho, count(*) as n from rk3 a join rk3 b using (feature) group by 1, 2")
def _rank_correlation(spark, d):
    scores = scoring.information_coefficients(q._panel(spark, d), list(q.IC_FEATURES), "y", ["instr"], 20).withColumnRenamed("instr", "target")
    return rounded(scoring.rank_correlation(scores))


# --- Columns of a panel by kind: the names come from the panel's own schema ------------------------------------------

_ALL = (*q.BASE_DOUBLES, "net_aggressor_volume", "rolling_volume_sum_w5", *q.CORE_DOUBLES, *q.CORE_OTHERS)


@query(
    "panel_columns",
    f"with {TO_BARS}, {BASE}, u as (unpivot (select {', '.join(f'cast({c} as double) as {c}' for c in _ALL if c not in ('is_rth', 'is_session_warm'))} from base) on columns(*) into name feature value x) select feature, count(*) as n, {q._CROSS} as is_cross_asset, {q._LIQUID} as is_liquidity from u where not ({q._RAW}) group by feature",
)
def _panel_columns(spark, d):
    rows = q._base(spark, d).select("instr", "ts", *_ALL)
    names = scoring.feature_columns(rows)
    out = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names]))).where("x is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return out.select("feature", "n", scoring.is_cross_asset(F.col("feature"), "ES").alias("is_cross_asset"), scoring.is_liquidity(F.col("feature")).alias("is_liquidity"))


# --- Incremental builds ----------------------------------------------------------------------------------------------


@query("build_resumed", f"with {TRADES}, c as (select instr, cast(date_trunc('month', ts) as date) as month, count(*) as n from trades group by 1, 2), b as (select instr, cast(date_trunc('month', ts) as date) as month, count(distinct time_bucket(interval '6 hours', ts)) as n_rows from trades group by 1, 2) select instr, cast(month as varchar) as month, 'ok' as status, n_rows, instr = 1 as failed_first from b join c using (instr, month)")
def _build_resumed(spark, d):
    """Monthly partitions of bars: instrument 1 fails at first; a second run makes what is missing and nothing else."""
    trades = ad.trades(spark, d).withColumn("month", F.date_trunc("month", "ts").cast("date").cast("string"))
    catalog = trades.groupBy("instr", "month").agg(F.count(F.lit(1)).alias("n")).select("instr", "month", builds.signature(F.col("n")).alias("signature"))
    build = builds.Build(spark, f"{shared_folder(spark)}/tapeloom/build-{uuid.uuid4().hex}", ["instr", "month"])

    def make(broken: bool):
        def made(rows) -> DataFrame:
            if broken and any(x["instr"] == 1 for x in rows):
                raise OSError("broken file")
            keys = spark.createDataFrame([(x["instr"], x["month"]) for x in rows], "instr long, month string")
            mine = trades.join(F.broadcast(keys), ["instr", "month"], "left_semi")  # a batch's keys
            return bars_op.ohlcv(mine, EVERY, ["instr", "month"])

        return made

    build.run(catalog, make(True))
    build.run(catalog, make(False))
    entries = build.manifest()
    failed = entries.groupBy("instr", "month").agg(F.max((F.col("status") == "failed").cast("int")).alias("f"))
    return builds.latest(entries, build.keys).join(failed, build.keys).select("instr", "month", "status", "n_rows", (F.col("f") == 1).alias("failed_first"))



# --- A whole instrument's panel: base features, nights, deviations by time of day and smoothing, joined as one -------

_VALUES = ("log_return", "abs_log_return", "log_volume", "ofi", "aggressor_ratio", "cvd_change", "net_aggressor_volume", "average_trade_size", "trades_count_log", "implied_volume_share", "implied_aggressor_skew", "spread_to_mid_bps", "spread_sub_var_ratio", "vol_ratio_short_long", "vwap_deviation")
_SMOOTH = ("abs_log_return", "ofi", "cvd_change", "spread_to_mid_bps", "log_volume")
_BY = "instr, bod"


def _ema_columns() -> tuple[str, str, str]:
    """Names, first values and steps of the means and their weights, as recursive SQL has them."""
    names, first, steps = [], [], []
    for v in _SMOOTH:
        for s in (10, 30):
            e, w, a = f"e_{v}_{s}", f"w_{v}_{s}", f"(2e0 / {s + 1}e0)"
            names += [e, w]
            first += [f"cast({v} as double)", "cast(1 as double)"]
            steps.append(f"case when b.{v} is null then e.{e} when e.{e} is null then b.{v} else (e.{w} * (1 - {a}) * e.{e} + {a} * b.{v}) / (e.{w} * (1 - {a}) + {a}) end")
            steps.append(f"case when b.{v} is null and e.{e} is not null then e.{w} * (1 - {a}) else cast(1 as double) end")
    return ", ".join(names), ", ".join(first), ", ".join(steps)


_NAMES, _FIRST, _STEPS = _ema_columns()
_PANEL = f"""tod as (select *, hour({ET}) * 4 + minute({ET}) // 15 as bod from base),
    tz1 as (select *, {', '.join(f"({v} - {roll('avg', v, N, by=_BY)}) / ({roll('stddev_samp', v, N, by=_BY)} + {EPS}) as z_{v}, {roll('median', v, N, by=_BY)} as med_{v}" for v in _VALUES)} from tod),
    tz2 as (select *, {', '.join(f"abs({v} - med_{v}) as dev_{v}" for v in _VALUES)} from tz1),
    tz3 as (select *, {', '.join(f"({v} - med_{v}) / (1.4826 * {roll('median', f'dev_{v}', N, least=2, by=_BY)} + {EPS}) as mz_{v}" for v in _VALUES)} from tz2),
    nb as (select *, row_number() over (partition by instr order by ts) as k from base),
    em(instr, k, ts, {_NAMES}) as (select instr, k, ts, {_FIRST} from nb where k = 1 union all select b.instr, b.k, b.ts, {_STEPS} from em e join nb b on b.instr = e.instr and b.k = e.k + 1)"""


@query(
    "panel_instrument_whole",
    f"with recursive {TO_BARS}, {BASE}, {q.NIGHT}, {_PANEL} select t.instr, t.ts, "
    + ", ".join([f"round(t.{c}, 6) + 0.0 as {c}" for c in q.BASE_DOUBLES if c != "jump_indicator_w5"] + [f"round({slog_sql(f't.z_{v}')}, 5) + 0.0 as {v}_tc_z_w5" for v in _VALUES] + [f"round({slog_sql(f't.mz_{v}')}, 5) + 0.0 as {v}_tc_madz_w5" for v in _VALUES] + [f"case when t.{v} is not null then round(em.e_{v}_{s}, 6) + 0.0 end as {v}_ema_s{s}" for v in _SMOOTH for s in (10, 30)])
    + ", round(gap, 6) + 0.0 as overnight_log_return, round(rv, 6) + 0.0 as overnight_realized_vol, cast(vol as bigint) as overnight_volume_total, n4.nb as overnight_n_bars from tz3 t join em on em.instr = t.instr and em.ts = t.ts join n2 on n2.instr = t.instr and n2.ts = t.ts left join n4 on n2.instr = n4.instr and n2.tday = n4.tday",
)
def _panel_whole(spark, d):
    out = panel.instrument_features(ad.bars(spark, d), days=(N,), with_patterns=False, engines=False, rv=(5, 10), ranges=(5,), surprise=(5,), moments=5, asymmetry=5, auto=5, short=5, long=10, roll=5)
    night = ("overnight_log_return", "overnight_realized_vol", "overnight_volume_total", "overnight_n_bars")
    deviations = [F.round(slog(F.col(f"{v}_{kind}_w5")), 5).alias(f"{v}_{kind}_w5") for kind in ("tc_z", "tc_madz") for v in _VALUES]
    return rounded(out.select("instr", "ts", *[c for c in q.BASE_DOUBLES if c != "jump_indicator_w5"], *deviations, *[f"{v}_ema_s{s}" for v in _SMOOTH for s in (10, 30)], *night))


_OTHERS = [f"I{k}_{v}" for k in (1, 2, 3) for v in ("log_return", "ofi")]
_TARGET = "w as (select ts, " + ", ".join(f"min({v}) filter (instr = {k}) as I{k}_{v}" for k in (1, 2, 3) for v in ("log_return", "ofi")) + " from base group by 1)"
_BY_TIME = roll("avg", "x", N, by=_BY)


@query(
    "panel_target_whole",
    f"with {TO_BARS}, {BASE}, {q.label_sql(4, 90000, 'truncate', 2, 1.5, 1.0, _BY_TIME)}, {_TARGET} select lab.ts, "
    + ", ".join([f"round(b.{c}, 6) + 0.0 as {c}" for c in ("close", "log_return", "ofi", "cvd_change")] + [f"round({c}, 6) + 0.0 as {c}" for c in (*_OTHERS, "atr", "realized_ret", "realized_ret_pts")])
    + ", label, cast(hit_offset as integer) as hit_offset, truncated as halt_truncated from lab join base b on b.instr = lab.instr and b.ts = lab.ts left join w on w.ts = lab.ts where lab.instr = 0 and isfinite(atr) and isfinite(realized_ret)",
)
def _target_whole(spark, d):
    features = q._base(spark, d)
    wide = cs.widen(features.withColumn("instr", F.concat(F.lit("I"), F.col("instr"))).select("ts", "instr", "log_return", "ofi"), ["log_return", "ofi"], ["I0", "I1", "I2", "I3"])
    out = panel.target_panel("I0", features.where("instr = 0"), wide, days=N, minutes=60, horizon=4, least=2, gap_seconds=90000)
    return rounded(out.select("ts", "close", "log_return", "ofi", "cvd_change", *_OTHERS, "atr", "realized_ret", "realized_ret_pts", "label", "hit_offset", "halt_truncated"))


# --- Greedy choice: the order is a recursion over the features by score ----------------------------------------------


@query(
    "greedy_choice",
    f"with recursive {TO_BARS}, {q.PANEL}, {q.ic_sql('')}, cor as (" + " union all ".join(f"select '{x}' as a, '{y}' as b, abs(corr({x}, {y})) as c from pan" for x in q.IC_FEATURES for y in q.IC_FEATURES if x != y)
    + "), o as (select feature, row_number() over (order by abs(ic) desc, feature) as k from ics where ic is not null), walk(k, taken) as (select 0, cast([] as varchar[]) union all select o.k, case when len(w.taken) < 4 and not exists (select 1 from cor where cor.a = o.feature and list_contains(w.taken, cor.b) and cor.c >= 0.2) then list_append(w.taken, o.feature) else w.taken end from walk w join o on o.k = w.k + 1)"
    + " select cast(i - 1 as integer) as place, taken[i] as feature from (select taken from walk order by k desc limit 1), range(1, 5) r(i) where i <= len(taken)",
)
def _greedy_choice(spark, d):
    rows = q._panel(spark, d)
    taken = scoring.greedy_select(scoring.information_coefficients(rows, list(q.IC_FEATURES), "y", least=20), scoring.correlation_matrix(rows, list(q.IC_FEATURES)), 4, 0.2)
    return spark.createDataFrame(list(enumerate(taken)), "place int, feature string")
