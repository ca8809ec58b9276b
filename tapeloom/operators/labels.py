"""First-touch labels: which of two barriers around the close the next bars reach first.

Windows and higher-order functions alone: the next T bars (T is small) as an array, the first gap in trading, the first bar
that touches. Rows of a null range have label 0, offset 0 and no return; a gap may drop the label (offset -1) or end the
search before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.along import Along
from ..functions.session import bar_of_day, time_of_day

LABELS = ("label", "hit_offset", "realized_ret", "realized_ret_pts", "halt_truncated")


def true_range(a: Along) -> Column:
    close = a.lag(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close))


def with_atr(bars: DataFrame, n: int, by: str = "instr", mode: str = "calendar", minutes: int = 15) -> DataFrame:
    """Adds atr: the mean true range of n bars, or of n days at this time of day (this bar included)."""
    a = Along([by], ["ts"])
    rows = bars.withColumn("_tr", true_range(a))
    if mode == "calendar":
        return rows.withColumn("atr", a.mean(F.col("_tr"), n)).drop("_tr")
    if mode != "time_conditional":
        raise ValueError(f"mode is calendar or time_conditional, not {mode!r}")
    rows = rows.withColumn("_bod", bar_of_day(F.col("ts"), minutes))
    return rows.withColumn("atr", time_of_day(by, "_bod", ["ts"]).mean(F.col("_tr"), n)).drop("_tr", "_bod")


def first_touch(bars: DataFrame, up: Column | float, down: Column | float, horizon: int, most: int | None = None, halts: bool = True, gap_seconds: int = 1800, halt_mode: str = "drop", least: int = 2, by: list[str] | None = None) -> DataFrame:
    """Adds LABELS to bars with atr. `up`, `down` and `horizon` may be columns (then `most` bounds the horizon)."""
    rows = with_next(bars, most or horizon, by)
    return touched(rows, up, down, horizon, halts, gap_seconds, halt_mode, least).select(*bars.columns, *LABELS)


def with_next(bars: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """Adds _next, the `most` bars that follow each: one window, whatever barriers and horizons are tried on it."""
    a = Along(by or ["instr"], ["ts"])
    seconds = lambda c: F.unix_seconds(c.cast("timestamp")) + F.date_format(c, "SSSSSS").cast("double") / 1e6
    rows = bars.withColumn("_s", seconds(F.col("ts"))).withColumn("_was", a.lag(F.col("_s")))
    bar = F.struct("_s", "_was", "open", "high", "low", "close")
    return rows.withColumn("_next", F.collect_list(bar).over(a.window.rowsBetween(1, most)))


def touched(rows: DataFrame, up: Column | float, down: Column | float, horizon: Column | int, halts: bool = True, gap_seconds: int = 1800, halt_mode: str = "drop", least: int = 2) -> DataFrame:
    """Adds LABELS to rows of with_next that have atr."""
    if halt_mode not in ("drop", "truncate"):
        raise ValueError(f"halt_mode is drop or truncate, not {halt_mode!r}")
    rows = rows.withColumn("_next", F.slice("_next", F.lit(1), horizon if isinstance(horizon, Column) else F.lit(horizon)))
    rows = rows.withColumns({"_top": F.col("close") + F.lit(up) * F.col("atr"), "_bottom": F.col("close") - F.lit(down) * F.col("atr")})
    places = lambda cond: F.expr(f"coalesce(array_position(transform(_next, x -> {cond}), true), 0)")  # noqa: E731  1 for the next bar, 0 for none
    halt = places(f"x._s - x._was > {gap_seconds}") if halts else F.lit(0)
    rows = rows.withColumns({"_halt": halt, "_n": F.size("_next")})
    span = F.when(F.col("_halt") > 0, F.col("_halt") - 1).otherwise(F.col("_n"))
    rows = rows.withColumn("_span", span).withColumn("_dropped", (F.col("_halt") > 0) & (F.lit(halt_mode == "drop") | (F.col("_span") < least)))
    hit = places("x.high >= _top or x.low <= _bottom")
    rows = rows.withColumn("_hit", F.when((hit > 0) & (hit <= F.col("_span")), hit))
    rows = rows.withColumn("_bar", F.when(F.col("_hit").isNotNull(), F.try_element_at("_next", F.col("_hit").cast("int"))))
    above, below = F.col("_bar.high") >= F.col("_top"), F.col("_bar.low") <= F.col("_bottom")
    side = F.when(above & below, F.when(F.col("_bar.close") > F.col("_bar.open"), 1).otherwise(-1)).when(above, 1).otherwise(-1)
    last = F.try_element_at("_next", F.greatest(F.lit(1), F.col("_span")).cast("int"))["close"]
    known = F.col("atr").isNotNull() & ~F.isnan("atr")
    live = known & ~F.col("_dropped")
    label = F.when(live & F.col("_hit").isNotNull(), side).otherwise(0)
    exit_ = F.when(live, F.when(F.col("_hit").isNotNull(), F.when(side == 1, F.col("_top")).otherwise(F.col("_bottom"))).when(F.col("_span") > 0, last))
    offset = F.when(~known, 0).when(F.col("_dropped"), -1).otherwise(F.coalesce(F.col("_hit"), F.when(F.col("_span") > 0, F.col("_span")), F.lit(0)))
    rows = rows.withColumns({"label": label.cast("int"), "hit_offset": offset.cast("int"), "_exit": exit_, "halt_truncated": known & (F.col("_halt") > 0) & ~F.col("_dropped")})
    return rows.withColumns({"realized_ret": F.ln(F.col("_exit") / F.col("close")), "realized_ret_pts": F.col("_exit") - F.col("close")})


def balance(p_up: Column, p_down: Column, p_zero: Column) -> Column:
    """Entropy of three shares over its most, 1 for equal ones."""
    term = lambda p: -p * F.ln(p + 1e-12)
    return (term(p_up) + term(p_down) + term(p_zero)) / math.log(3)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def label_statistics(labeled: DataFrame, by: list[str], cost: float = 0.5) -> DataFrame:
    """Class shares, mean returns (relative, in points, in basis points), offsets, correlation and balance of each group."""
    rows = labeled.where(finite("atr") & finite("realized_ret"))
    share = lambda v: F.avg((F.col("label") == v).cast("double"))
    names = {"pos": 1, "neg": -1, "zero": 0}
    of = lambda x, v: F.avg(F.when(F.col("label") == v, x))
    bps = F.col("realized_ret_pts") / F.col("close") * 10_000
    spread = F.stddev_pop(F.col("label").cast("double")) * F.stddev_pop("realized_ret")
    product = F.avg(F.col("label") * F.col("realized_ret")) - F.avg(F.col("label").cast("double")) * F.avg("realized_ret")
    out = rows.groupBy(*by).agg(
        *[share(v).alias(f"frac_{n}") for n, v in names.items()],
        *[of(F.col("realized_ret"), v).alias(f"mean_ret_{n}") for n, v in names.items()],
        *[of(F.col("realized_ret_pts"), v).alias(f"mean_ret_pts_{n}") for n, v in names.items()],
        *[of(bps, v).alias(f"mean_ret_bps_{n}") for n, v in names.items()],
        *[of(F.col("hit_offset").cast("double"), v).alias(f"mean_hit_offset_{n}") for n, v in names.items()],
        F.count(F.lit(1)).alias("n_total"),
        F.when(spread > 0, product / F.when(spread > 0, spread)).alias("label_forward_return_corr"),
    )
    over = {f"pts_over_cost_{n}": F.abs(F.col(f"mean_ret_pts_{n}")) / cost if cost > 0 else F.lit(None).cast("double") for n in ("pos", "neg")}
    return out.withColumns(over | {"balance_score": balance(F.col("frac_pos"), F.col("frac_neg"), F.col("frac_zero"))})


def tune_labels(bars: DataFrame, ups: tuple = (1.0, 1.5, 2.0), downs: tuple = (1.0, 1.5, 2.0), horizons: tuple = (4, 8, 12), windows: tuple = (20,), mode: str = "calendar", minutes: int = 15, cost: float = 0.5, by: str = "instr", **options) -> DataFrame:
    """Statistics of every combination. Each bar's following bars are collected once a range window; the grid is exploded onto
    them behind that window and goes straight into the aggregation, so no combination is shuffled or sorted by itself.
    Combinations without rows have none."""
    grid = [(float(u), float(d), int(t)) for t in horizons for u in ups for d in downs]
    out = None
    for n in windows:
        rows = with_next(with_atr(bars, n, by, mode, minutes), max(horizons), [by])
        rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(u).alias("k_up"), F.lit(d).alias("k_dn"), F.lit(t).alias("T")) for u, d, t in grid])))
        labeled = touched(rows, F.col("k_up"), F.col("k_dn"), F.col("T"), **options)
        stats = label_statistics(labeled, ["k_up", "k_dn", "T"], cost).withColumn("atr_window", F.lit(n))
        out = stats if out is None else out.unionByName(stats)
    return out


def hourly_statistics(labeled: DataFrame, cost: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Statistics by hour of the sessions' clock, and rolled up to sessions with the hours' counts as weights."""
    from ..functions.session import eastern, session_name

    hours = label_statistics(labeled.withColumn("hour_et", F.hour(eastern(F.col("ts")))), ["hour_et"], cost)
    weighted = lambda c: (F.sum(F.col(c) * F.col("n_total")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_total")))).alias(c)
    name = F.regexp_replace(session_name(F.col("hour_et")), "^(RTH|ETH)$", "US_$1")
    sessions = hours.groupBy(name.alias("session")).agg(F.sum("n_total").alias("n_total"), *[weighted(c) for c in ("frac_pos", "frac_neg", "frac_zero", "balance_score")])
    return hours, sessions
