"""Cross-sections: instruments side by side at each time, kept long (one row an instrument and time) and widened at the edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.along import EPS, Along
from ..functions.normal import depth, quantile_at
from .slices import HOURS, numbered, with_halo

#: Asset classes and their instruments; weights of the currency basket before they are scaled to 1.
CLASSES = {
    "EQUITY_INDEX": ("ES", "NQ", "RTY", "YM"),
    "FX": ("6A", "6B", "6C", "6E", "6J"),
    "ENERGY": ("BZ", "CL", "HO", "NG", "RB"),
    "METALS": ("GC", "HG", "PA", "PL", "SI"),
    "RATES": ("SR3", "TN", "ZB", "ZF", "ZN", "ZT"),
    "AGS": ("ZC", "ZL", "ZM", "ZS", "ZW"),
}
BASKET = {"EUR": 0.576, "JPY": 0.136, "GBP": 0.119, "CAD": 0.091}
TARGETS = CLASSES["EQUITY_INDEX"]


def at_time(*more: str) -> Window:
    return Window.partitionBy("ts", *more)


def peers(rows: DataFrame, ret: str = "log_return") -> DataFrame:
    """One row a time: dispersion, breadth (over all instruments, null or not), leader-laggard spread, concentration."""
    r = F.col(ret)
    return rows.groupBy("ts").agg(
        F.stddev_pop(r).alias("dispersion"),
        (F.coalesce(F.sum((r > 0).cast("double")), F.lit(0.0)) / F.count(F.lit(1))).alias("breadth"),
        (F.max(r) - F.min(r)).alias("leader_laggard_spread"),
        (F.coalesce(F.sum(r * r), F.lit(0.0)) / (F.pow(F.coalesce(F.sum(F.abs(r)), F.lit(0.0)), 2) + EPS)).alias("return_concentration"),
    )


def return_zscore(ret: Column) -> Column:
    """An instrument's return against the mean and population deviation of all at its time."""
    return (ret - F.avg(ret).over(at_time())) / (F.stddev_pop(ret).over(at_time()) + EPS)


def gauss_ranks(rows: DataFrame, values: list[str], scope: list[str] | None = None, prefix: str = "gauss_rank_", tie: str = "instr") -> DataFrame:
    """Adds the normal quantile of (rank + 1) / (n + 1), rank from 0, among the non-null values at a time (and scope); ties by
    instrument; null where fewer than two have a value. All values share one shuffle by time."""
    part = scope or []
    shares, depths, out = {}, {}, {}
    for i, v in enumerate(values):
        n = F.count(v).over(at_time(*part))
        rank = F.row_number().over(at_time(*part).orderBy(F.col(v).asc_nulls_last(), F.col(tie)))
        shares[f"_p{i}"] = F.when(F.col(v).isNotNull() & (n > 1), rank / (n + 1))
        depths[f"_r{i}"] = depth(F.col(f"_p{i}"))
        out[f"{prefix}{v}"] = quantile_at(F.col(f"_p{i}"), F.col(f"_r{i}"))
    # In steps, so that each share and depth is worked out once.
    return rows.withColumns(shares).withColumns(depths).withColumns(out).drop(*shares, *depths)


def widen(rows: DataFrame, values: list[str], instruments: list[str]) -> DataFrame:
    """A row a time with {instrument}_{value} columns; repeated times of an instrument keep the first by the values' order."""
    if not instruments or not values:
        raise ValueError("no usable frame")
    first = [F.min(F.struct(*values))[v] if len(values) > 1 else F.min(v) for v in values]
    pivoted = rows.groupBy("ts").pivot("instr", instruments).agg(*[f.alias(v) for f, v in zip(first, values, strict=True)])
    return pivoted.toDF("ts", *[f"{i}_{v}" for i in instruments for v in values])


def union_long(frames: dict[str, DataFrame], values: list[str]) -> DataFrame:
    """Per-instrument frames as one long frame, a row an instrument and time; missing values are null."""
    parts = [f.select("ts", F.lit(i).alias("instr"), *[F.col(v).cast("double").alias(v) if v in f.columns else F.lit(None).cast("double").alias(v) for v in values]) for i, f in frames.items()]
    if not parts:
        raise ValueError("no usable frame")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("instr", "ts").agg(*[F.min(v).alias(v) for v in values])


def basket_return(eur: Column, jpy: Column, gbp: Column, cad: Column) -> Column:
    """Minus the weighted sum of the currencies' returns."""
    total = sum(BASKET.values())
    return -(BASKET["EUR"] / total) * eur - (BASKET["JPY"] / total) * jpy - (BASKET["GBP"] / total) * gbp - (BASKET["CAD"] / total) * cad


def curve_spreads(two: Column, five: Column, ten: Column, thirty: Column) -> dict[str, Column]:
    return {"slope_2s5s_logret": five - two, "slope_5s10s_logret": ten - five, "slope_2s10s_logret": ten - two, "slope_10s30s_logret": thirty - ten, "butterfly_2s5s10s": ten - 2 * five + two}


def horizontal_mean(columns: list[Column]) -> Column:
    """The mean of the non-null ones."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + F.when(c.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, total / F.when(n > 0, n))


def risk_off(gold: Column, dollar: Column, bonds: list[Column], equities: list[Column]) -> Column:
    return gold + horizontal_mean(bonds) + dollar - horizontal_mean(equities)


#: Rows of a block of all times.
BLOCK = 65_536


def over_times(frame: DataFrame, new: dict[str, Callable[[Along], Column]], n: int, block: int = BLOCK, hours: int = HOURS) -> DataFrame:
    """Adds columns that look back over n rows of a frame with a row a time: blocks of rows, each with the n - 1 rows before it."""
    columns = frame.columns
    rows = with_halo(numbered(frame, [], "ts", [], "_no", hours), "_no", block, n - 1)
    a = Along(["_block"], ["_no"])
    return rows.withColumns({name: f(a) for name, f in new.items()}).where("_own").select(*[f"`{c}`" for c in columns], *new)


def composites(wide: DataFrame, n: int = 60, block: int = BLOCK) -> DataFrame:
    """Currency basket, curve spreads and rolling correlations of the targets with gold, oil, notes and the basket, as far
    as the wide frame has their returns."""
    r = lambda i: F.col(f"`{i}_log_return`")
    have = lambda *names: all(f"{i}_log_return" in wide.columns for i in names)
    out = wide
    if have("6E", "6J", "6B", "6C"):
        out = out.withColumn("synthetic_dxy_logret", basket_return(r("6E"), r("6J"), r("6B"), r("6C")))
    if have("ZT", "ZF", "ZN", "ZB"):
        out = out.withColumns(curve_spreads(r("ZT"), r("ZF"), r("ZN"), r("ZB")))
    new = {}
    for target in TARGETS:
        for label, other in (("gold", "GC"), ("oil", "CL"), ("ZN", "ZN"), ("DXY", None)):
            if have(target) and (have(other) if other else "synthetic_dxy_logret" in out.columns) and other != target:
                x, y = r(target), r(other) if other else F.col("synthetic_dxy_logret")
                new[f"corr_{target}_vs_{label}_w{n}"] = lambda a, x=x, y=y: a.pearson(x, y, n)
    return over_times(out, new, n, block) if new else out


#: Pairs whose products are interactions, by name; {t} is the target and {w} the window.
INTERACTIONS = {
    "ix_gex_sign_x_ofi_tc_z_w30": ("gex_sign", "ofi_tc_z_w30"),
    "ix_gex_sign_x_log_return": ("gex_sign", "log_return"),
    "ix_dist_zero_gamma_x_ofi_tc_z": ("distance_to_zero_gamma_flip_bp", "ofi_tc_z_w30"),
    "ix_dist_zero_gamma_x_log_return": ("distance_to_zero_gamma_flip_bp", "log_return"),
    "ix_vx1_zscore_x_vol_surprise_w20": ("vx1_zscore_w20", "vol_surprise_w20"),
    "ix_vx1_zscore_x_ofi_tc_z_w30": ("vx1_zscore_w20", "ofi_tc_z_w30"),
    "ix_vx_calendar_ratio_x_cvd_change": ("vx_calendar_ratio", "cvd_change"),
    "ix_vol_ratio_short_long_x_ofi_tc_z": ("vol_ratio_short_long", "ofi_tc_z_w30"),
    "ix_vol_of_vol_w60_x_jump_indicator": ("vol_of_vol_w60", "jump_indicator_w20"),
    "ix_dxy_logret_x_log_return": ("synthetic_dxy_logret", "log_return"),
    **{f"ix_corr_{{t}}_vs_{m}_w{{w}}_x_ofi_tc_z": (f"corr_{{t}}_vs_{m}_w{{w}}", "ofi_tc_z_w30") for m in ("gold", "oil", "ZN", "DXY")},
    "ix_rolling_kurt_x_jump_indicator": ("rolling_kurt_w60", "jump_indicator_w20"),
    "ix_range_compression_x_log_return": ("range_compression_ratio_w20", "log_return"),
}


def interactions(panel: DataFrame, target: str, n: int = 60) -> DataFrame:
    """Products of regime and direction columns, where both are there."""
    new = {}
    for name, pair in INTERACTIONS.items():
        x, y = (c.format(t=target, w=n) for c in pair)
        if x in panel.columns and y in panel.columns:
            new[name.format(t=target, w=n)] = F.col(x) * F.col(y)
    return panel.withColumns(new) if new else panel
