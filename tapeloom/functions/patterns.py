"""Pattern detectors over bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .along import EPS, Along, flag, share


def absorption(a: Along, flow: Column, vol: Column, notional: Column, n: int = 20) -> Column:
    return share(a.sum(F.abs(flow), n), a.mean(vol * notional + EPS, n) * n)


def breakout_magnitude(a: Along, price: Column, atr: Column, n: int = 30, up: bool = True) -> Column:
    """How far the price is beyond the extreme of the n rows before, in units of range; else 0."""
    edge = a.max(price, n, shift=1) if up else a.min(price, n, shift=1)
    beyond = price - edge if up else edge - price
    return F.when(beyond > 0, share(beyond, atr)).otherwise(0.0)


def breakout_reversal(a: Along, price: Column, close: Column, atr: Column, n: int = 30, back: float = 0.5, up: bool = True) -> Column:
    """The extreme was passed, but the bar closed back by more than `back` ranges."""
    if up:
        edge = a.max(price, n, shift=1)
        return flag((price > edge) & (close < edge - back * atr))
    edge = a.min(price, n, shift=1)
    return flag((price < edge) & (close > edge + back * atr))


def flow_after(a: Along, fired: Column, flow: Column, n: int = 3) -> Column:
    """Looks ahead: the flow of the next n rows where a flag fired, else 0."""
    return F.when(fired > 0, a.sum(flow, n, shift=-n)).otherwise(0.0)


def spike_and_fade(a: Along, volume: Column, n: int = 20, times: float = 3.0) -> Column:
    """Looks ahead: a row of many times the mean volume before it, and the next of a fraction."""
    base = a.mean(volume, n, shift=1)
    return flag((volume > times * base) & (a.lag(volume, -1) < base / times))


def run_length(a: Along, x: Column, n: int = 30) -> Column:
    return a.sum(F.when(x > 0, 1).when(x < 0, -1).otherwise(0), n)


def flow_divergence(a: Along, flow: Column, price: Column, n: int = 30, up: bool = True) -> Column:
    """A new extreme of price without one of cumulative flow."""
    if up:
        return flag((price > a.max(price, n, shift=1)) & (flow <= a.max(flow, n, shift=1)))
    return flag((price < a.min(price, n, shift=1)) & (flow >= a.min(flow, n, shift=1)))


def range_compression(a: Along, high: Column, low: Column, atr: Column, n: int = 20) -> Column:
    return share(a.std(high - low, n), atr)


def rolling_ratio(a: Along, x: Column, y: Column, n: int = 30) -> Column:
    return share(a.sum(x, n), a.sum(y, n))
