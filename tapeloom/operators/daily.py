"""Operators on the scale of days: overnight statistics and option gamma profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.along import EPS, Along
from ..functions.session import eastern
from .asof import asof_days
from .execution import nearest_quantile

CONTRACT_SIZE = 100.0


def overnight(bars: DataFrame, by: str = "instr") -> DataFrame:
    """Adds the gap from the last session's close, and the realised volatility, volume and bars outside the session.

    Bars from 16:00 on belong to the next date (so Friday evenings to Saturdays, which have no session and stay null).
    """
    if "is_rth" not in bars.columns:
        raise ValueError("bars need is_rth; call session_flags first")
    et = eastern(F.col("ts"))
    day = F.when(F.hour(et) >= 16, F.date_add(F.to_date(et), 1)).otherwise(F.to_date(et))
    a = Along([by], ["ts"])
    rows = bars.withColumns({"_day": day, "_r": F.ln(F.col("close") / a.lag(F.col("close")))})
    inside, outside = F.col("is_rth") == 1, F.col("is_rth") == 0
    daily = rows.groupBy(by, "_day").agg(
        F.min_by(F.when(inside, F.col("open")), F.when(inside, F.col("ts"))).alias("_open"),
        F.max_by(F.when(inside, F.col("close")), F.when(inside, F.col("ts"))).alias("_close"),
        F.count(F.when(inside, 1)).alias("_n"),
        F.when(F.count(F.when(outside, 1)) > 0, F.coalesce(F.sum(F.when(outside, F.col("_r") * F.col("_r"))), F.lit(0.0))).alias("_var"),
        F.sum(F.when(outside, F.col("volume"))).alias("overnight_volume_total"),
        F.when(F.count(F.when(outside, 1)) > 0, F.count(F.when(outside, 1))).alias("overnight_n_bars"),
    )
    days = Along([by], ["_day"])
    daily = daily.where("_n > 0").select(by, "_day", F.ln(F.col("_open") / days.lag(F.col("_close"))).alias("overnight_log_return"), F.sqrt("_var").alias("overnight_realized_vol"), "overnight_volume_total", "overnight_n_bars")
    return rows.join(daily, [by, "_day"], "left").drop("_day", "_r")


def gamma_profile(chain: DataFrame, spot: DataFrame, dealer_sign: str = "naive_call_short", cap: float = 0.99) -> DataFrame:
    """A row a date: signed gamma in dollars, capped at a quantile of the date; where its sum over strikes turns; strikes of
    the most open interest (ties: the lowest); the part of options that expire the same day."""
    if dealer_sign != "naive_call_short":
        raise NotImplementedError(dealer_sign)
    size = F.col("open_interest") * F.col("gamma") * F.col("spot") * F.col("spot") * CONTRACT_SIZE
    rows = chain.join(spot, "date").withColumns({"_size": size, "_today": F.col("exdate") == F.col("date")})
    rows = rows.join(nearest_quantile(rows, "_size", cap, ["date"], "_cap"), "date", "left").withColumn("_capped", F.least("_size", "_cap"))
    rows = rows.withColumn("_signed", F.when(F.col("cp_flag") == "P", F.col("_capped")).otherwise(-F.col("_capped")))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    by_strike = rows.groupBy("date", "strike_price").agg(
        zero(F.col("_signed")).alias("_g"), zero(F.when(F.col("_today"), F.col("_signed"))).alias("_g0"), zero(F.when(F.col("_today"), F.col("_capped"))).alias("_abs0"), zero(F.col("_capped")).alias("_abs"),
    )
    by_strike = by_strike.withColumn("_cum", F.sum("_g").over(Window.partitionBy("date").orderBy("strike_price")))
    totals = by_strike.groupBy("date").agg(F.sum("_g").alias("total_gex"), F.sum("_g0").alias("gex_0dte_only"), (F.sum("_abs0") / (F.sum("_abs") + EPS)).alias("gex_0dte_share"), F.min(F.when(F.col("_cum") >= 0, F.col("strike_price"))).alias("_flip"))
    interest = chain.groupBy("date", "cp_flag", "strike_price").agg(F.sum("open_interest").alias("_oi"))
    most = lambda flag: F.max_by(F.when(F.col("cp_flag") == flag, F.col("strike_price")), F.when(F.col("cp_flag") == flag, F.struct("_oi", -F.col("strike_price"))))
    top = interest.groupBy("date").agg(most("C").alias("max_call_oi_strike"), most("P").alias("max_put_oi_strike"))
    out = totals.join(spot, "date", "left").join(top, "date", "left")
    return out.select("date", "total_gex", F.signum("total_gex").alias("gex_sign"), F.coalesce("_flip", "spot").alias("zero_gamma_strike"), "max_call_oi_strike", "max_put_oi_strike", "gex_0dte_share", "gex_0dte_only", (F.col("total_gex") - F.col("gex_0dte_only")).alias("gex_without_0dte"))


def spot_proxy(chain: DataFrame) -> DataFrame:
    """Mean strike weighted by gamma times open interest, where that is positive."""
    w = F.col("gamma") * F.col("open_interest")
    return chain.where(w > 0).groupBy("date").agg((F.sum(F.col("strike_price") * w) / F.sum(w)).alias("spot"))


def attach_gamma(bars: DataFrame, profile: DataFrame, basis: DataFrame | None = None, days: int = 5, by: list[str] | None = None) -> DataFrame:
    """Adds yesterday's profile (up to five days old) and the distances of the close to its strikes, moved by the basis.

    `by` spreads a day's bars over its instruments; profiles are of all."""
    del by
    basis = profile.select("date", F.lit(0.0).alias("basis")) if basis is None else basis
    later = lambda d: d.withColumn("_from", F.date_add("date", 1)).drop("date")
    out = asof_days(bars.withColumn("_day", F.to_date("ts")), later(profile), [], "_day", "_from", days)
    out = asof_days(out, later(basis), [], "_day", "_from", days)
    level = lambda c: F.col("close") - (F.col(c) + F.col("basis"))
    return out.withColumns({
        "gex_log_signed": F.col("gex_sign") * F.ln(1.0 + F.abs("total_gex")),
        "distance_to_zero_gamma_flip": level("zero_gamma_strike"),
        "distance_to_zero_gamma_flip_bp": level("zero_gamma_strike") / F.col("close") * 10_000,
        "distance_to_max_call_oi": level("max_call_oi_strike"),
        "distance_to_max_put_oi": level("max_put_oi_strike"),
    }).drop("_day")


def attach_gamma_profiles(bars: DataFrame, profiles: list[DataFrame], basis: DataFrame | None = None) -> DataFrame:
    """The profiles of several sources as one; without any, the bars as they are."""
    if not profiles:
        return bars
    whole = profiles[0]
    for p in profiles[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return attach_gamma(bars, whole, basis)
