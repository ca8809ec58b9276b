"""Expressions along ordered rows of a group, null until their window is full.

An `Along` names the group and the order; every rolling expression below is null unless the window holds `least` non-null
values (by default as many as it has rows). Expressions over one `Along` share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: what denominators get added.
EPS = 1e-9


class Along:
    def __init__(self, by: list[str] | str = "instr", order: list[str] | str = ("ts", "seq")):
        self.by = [by] if isinstance(by, str) else list(by)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def so_far(self) -> Window:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.window) if k >= 0 else F.lead(x, -k).over(self.window)

    def fill(self, x: Column) -> Column:
        """The last value that isn't null."""
        return F.last(x, ignorenulls=True).over(self.so_far())

    def total(self, x: Column) -> Column:
        return F.sum(x).over(self.so_far())

    def roll(self, f: Callable[[Column], Column], x: Column, n: int, least: int | None = None, shift: int = 0) -> Column:
        """f over the n rows that end `shift` rows before this one."""
        frame = self.window.rowsBetween(-(n - 1) - shift, -shift)
        return F.when(F.count(x).over(frame) >= (n if least is None else least), f(x).over(frame))

    def mean(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.roll(F.avg, x, n, shift=shift)

    def sum(self, x: Column, n: int, shift: int = 0, least: int | None = None) -> Column:
        return self.roll(F.sum, x, n, least, shift)

    def std(self, x: Column, n: int, ddof: int = 1, shift: int = 0) -> Column:
        return self.roll(F.stddev_samp if ddof else F.stddev_pop, x, n, shift=shift)

    def max(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.roll(F.max, x, n, shift=shift)

    def min(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.roll(F.min, x, n, shift=shift)

    def median(self, x: Column, n: int, least: int | None = None) -> Column:
        """The midpoint of the middle values."""
        return self.roll(lambda c: F.percentile(c, F.lit(0.5)), x, n, least)

    def skew(self, x: Column, n: int) -> Column:
        """Adjusted skewness of n values."""
        adjust = (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 else None
        return self.roll(F.skewness, x, n) * F.lit(adjust)

    def kurtosis(self, x: Column, n: int) -> Column:
        """Population excess kurtosis."""
        return self.roll(F.kurtosis, x, n)

    def deviation_corr(self, x: Column, y: Column, n: int) -> Column:
        """Mean product of deviations, each from the mean of its own row's window, over the roots of the mean squares."""
        dx, dy = x - self.mean(x, n), y - self.mean(y, n)
        scale = F.sqrt(self.mean(dx * dx, n) * self.mean(dy * dy, n))
        return F.when(scale > 0, self.mean(dx * dy, n) / scale)

    def deviation_slope(self, x: Column, y: Column, n: int) -> Column:
        """Mean product of deviations over the mean square of x's."""
        dx, dy = x - self.mean(x, n), y - self.mean(y, n)
        spread = self.mean(dx * dx, n)
        return F.when(spread > 0, self.mean(dx * dy, n) / spread)

    def pearson(self, x: Column, y: Column, n: int) -> Column:
        """Pearson's correlation of n rows, from moments; null where a series is constant."""
        both = x.isNotNull() & y.isNotNull()
        p, q = F.when(both, x), F.when(both, y)
        frame = self.window.rowsBetween(-(n - 1), 0)
        mean = lambda c: F.avg(c).over(frame)
        scale = F.stddev_pop(p).over(frame) * F.stddev_pop(q).over(frame)
        return F.when((F.count(p).over(frame) >= n) & (scale > 0), (mean(p * q) - mean(p) * mean(q)) / F.when(scale > 0, scale))

    def zscore(self, x: Column, n: int) -> Column:
        return (x - self.mean(x, n)) / (self.std(x, n) + EPS)


def share(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def imbalance(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def flag(condition: Column) -> Column:
    """1 or 0, null where the condition is."""
    return condition.cast("int")


def added(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total
