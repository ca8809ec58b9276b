"""Features of price and volume bars, and of their flow."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .along import EPS, Along, flag, imbalance, share


def log_return(a: Along, price: Column, horizon: int = 1) -> Column:
    return F.ln(price / a.lag(price, horizon))


def cumulative_return(a: Along, price: Column, anchor: Column | None = None) -> Column:
    return F.ln(price / (F.first(price).over(a.so_far()) if anchor is None else anchor))


def log_volume(volume: Column) -> Column:
    return F.log1p(volume)


def realized_volatility(a: Along, ret: Column, n: int) -> Column:
    """Population deviation of n returns. The exponentially weighted form is `sequential.ema` of squares, then a root."""
    return a.std(ret, n, ddof=0)


def _root(x: Column) -> Column:
    """The root of what isn't negative; null stays null."""
    return F.sqrt(F.when(x < 0, 0.0).otherwise(x))


def parkinson(a: Along, high: Column, low: Column, n: int) -> Column:
    return _root(a.mean(F.pow(F.ln(high / low), 2), n) / (4 * math.log(2)))


def garman_klass(a: Along, open_: Column, high: Column, low: Column, close: Column, n: int) -> Column:
    term = 0.5 * F.pow(F.ln(high / low), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(close / open_), 2)
    return _root(a.mean(term, n))


def jump(a: Along, ret: Column, vol: Column, threshold: float = 3.0, output: str = "flag") -> Column:
    z = share(ret, a.lag(vol))
    if output == "zscore":
        return z
    if output != "flag":
        raise ValueError(f"output is flag or zscore, not {output!r}")
    return flag(F.abs(z) > threshold)


def autocorrelation(a: Along, ret: Column, lag: int, n: int) -> Column:
    return a.deviation_corr(ret, a.lag(ret, lag), n)


def rolling_vwap(a: Along, high: Column, low: Column, close: Column, volume: Column, n: int) -> Column:
    return share(a.sum((high + low + close) / 3 * volume, n), a.sum(volume, n))


def vwap_return(a: Along, vwap: Column, volume_sum: Column) -> Column:
    """Log ratio of successive rolling VWAPs, given as columns; null without volume."""
    ratio = F.try_divide(vwap, a.lag(vwap))
    return F.when((volume_sum > EPS) & (a.lag(volume_sum) > EPS) & (ratio > 0), F.ln(ratio))


def volume_surprise(a: Along, logv: Column, n: int) -> Column:
    return (logv - a.mean(logv, n, shift=1)) / (a.std(logv, n, ddof=0, shift=1) + EPS)


def turnover(a: Along, volume: Column, shares: Column, n: int) -> Column:
    return share(a.sum(volume, n), shares)


def amihud(a: Along, ret: Column, volume: Column, close: Column, n: int) -> Column:
    return a.mean(share(F.abs(ret), volume * close), n)


def is_weekday(ts: Column, day: int) -> Column:
    """Monday is 0."""
    return flag(F.weekday(ts) == day)


def is_month_start(ts: Column) -> Column:
    return flag(F.dayofmonth(ts) == 1)


def is_month_end(ts: Column) -> Column:
    return flag(F.to_date(ts) == F.last_day(ts))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def settlement_window(ts_et: Column) -> Column:
    return flag(minute_of_day(ts_et).between(945, 960))


def seasonal_deviation(by_time_of_day: Along, value: Column, n: int = 20) -> Column:
    return value - by_time_of_day.mean(value, n)


# Flow of a bar.

order_flow_imbalance = imbalance


def aggressor_ratio(buys: Column, sells: Column) -> Column:
    return share(buys, buys + sells)


def depth_ratio(book: Column, levels: int = 5) -> Column:
    """Bid size over ask size of the first levels of a book of arrays bid_sz, ask_sz."""
    side = lambda name: F.aggregate(F.slice(book[name], 1, levels), F.lit(0.0), lambda s, x: s + x)
    return share(side("bid_sz"), side("ask_sz"))


def topbook_side_spread(bid: Column, ask: Column, spread: Column) -> Column:
    return spread * imbalance(bid, ask)


# Top of book.


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    return share(bid * ask_size + ask * bid_size, bid_size + ask_size)


def microprice_drift(a: Along, micro: Column, k: int = 1) -> Column:
    """Over a column that is already forward-filled."""
    return F.ln(micro / a.lag(micro, k))


def order_imbalance(a: Along, bid_size: Column, ask_size: Column, n: int = 1) -> Column:
    x = imbalance(bid_size, ask_size)
    return x if n == 1 else a.mean(x, n)


def spread_bps(spread: Column, mid: Column) -> Column:
    return share(spread, mid) * 10_000


def one_sided_volatility(a: Along, ret: Column, n: int, up: bool) -> Column:
    """Deviation of n returns of one sign; 0 unless all n have it."""
    return F.coalesce(a.std(F.when(ret > 0 if up else ret < 0, ret), n), F.lit(0.0))


def jump_intensity(a: Along, ret: Column, vol: Column, n: int, threshold: float = 3.0) -> Column:
    return a.sum(flag(F.abs(ret) > threshold * a.lag(vol)), n, least=1)
