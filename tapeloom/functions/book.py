"""Features of a ten-level book in flat columns bid_px_L1 .. ask_ord_L10, with an optional prefix for a symbol."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .along import EPS, Along, added, flag, imbalance, share


class Book:
    """Names the columns of one symbol's book."""

    def __init__(self, prefix: str = ""):
        self.prefix = f"{prefix}_" if prefix else ""

    def __call__(self, name: str, k: int = 1) -> Column:
        return F.col(f"{self.prefix}{name}_L{k}")

    def mid(self) -> Column:
        return (self("bid_px") + self("ask_px")) / 2

    def spread(self, k: int = 1) -> Column:
        return self("ask_px", k) - self("bid_px", k)

    def volume(self, k: int) -> Column:
        return self("bid_sz", k) + self("ask_sz", k)


def volume_imbalance(book: Book, k: int = 1) -> Column:
    return imbalance(book("bid_sz", k), book("ask_sz", k))


def cumulative_imbalance(book: Book, depth: int = 5) -> Column:
    return added([volume_imbalance(book, k) for k in range(1, depth + 1)])


def distance_weighted_imbalance(book: Book, depth: int = 5) -> Column:
    side = lambda s: added([book(f"{s}_sz", k) / (1 + F.abs(book(f"{s}_px", k) - book.mid())) for k in range(1, depth + 1)])
    return imbalance(side("bid"), side("ask"))


def depth_weighted_spread(book: Book, depth: int = 5) -> Column:
    """Spreads weighted by the volume up to their level, over the volume of all."""
    upto = lambda k: added([book.volume(i) for i in range(1, k + 1)])
    return share(added([book.spread(k) * upto(k) for k in range(1, depth + 1)]), upto(depth))


def liquidity_adjusted_spread(book: Book, depth: int = 5) -> Column:
    return added([share(book.spread(k), book.volume(k)) for k in range(1, depth + 1)]) / depth


def spread_acceleration(book: Book) -> Column:
    return book.spread(3) - 2 * book.spread(2) + book.spread(1)


def spread_zscore(a: Along, book: Book, k: int = 1, n: int = 60) -> Column:
    return a.zscore(book.spread(k), n)


def order_count_imbalance(book: Book, k: int = 1) -> Column:
    return imbalance(book("bid_ord", k), book("ask_ord", k))


def order_size_imbalance(book: Book, k: int = 1) -> Column:
    size = lambda s: share(book(f"{s}_sz", k), book(f"{s}_ord", k))
    return imbalance(size("bid"), size("ask"))


def concentration(book: Book, side: str = "bid", depth: int = 5, base: str = "sz") -> Column:
    """Sum of squared shares of the levels of a side."""
    if side not in ("bid", "ask") or base not in ("sz", "ord"):
        raise ValueError(f"no such side or base: {side!r}, {base!r}")
    levels = [book(f"{side}_{base}", k) for k in range(1, depth + 1)]
    return added([F.pow(share(x, added(levels)), 2) for x in levels])


def flow_at_level(a: Along, book: Book, k: int) -> Column:
    """Order-flow imbalance of a level: sizes that came or went at better, equal or worse prices than a row before."""
    bid, bid_size, ask, ask_size = (book(c, k) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz"))
    was_bid, was_bid_size, was_ask, was_ask_size = (a.lag(c) for c in (bid, bid_size, ask, ask_size))
    buying = F.when(bid > was_bid, bid_size).when(bid == was_bid, bid_size - was_bid_size).otherwise(-was_bid_size)
    selling = F.when(ask < was_ask, -ask_size).when(ask == was_ask, was_ask_size - ask_size).otherwise(was_ask_size)
    return (buying + selling).cast("double")


def deep_flow(a: Along, book: Book, depth: int = 10, decay: float = 0.0, normalize: bool = False, flows: list[Column] | None = None) -> Column:
    """Flow over levels with weights that decay by depth; the leader's book in cross-market use, by its prefix. `flows` are the
    levels' flows where a frame has them already."""
    weights = [math.exp(-decay * k) for k in range(depth)]
    flows = flows or [flow_at_level(a, book, k) for k in range(1, depth + 1)]
    total = added([w * x for w, x in zip(weights, flows, strict=True)])
    return total / sum(weights) if normalize else total


def migration(a: Along, book: Book, side: str, to: int) -> Column:
    """Size that the first level lost plus size that a deeper one gained since the row before."""
    change = lambda k: book(f"{side}_sz", k) - a.lag(book(f"{side}_sz", k))
    return change(to) - change(1)


def effective_depth(columns: list[str], depth: int = 10, book: str = "") -> int:
    """The deepest level with both prices and sizes; an error without the first."""
    at = [k for k in range(1, depth + 1) if all(f"{book}{s}_{x}_L{k}" in columns for s in ("bid", "ask") for x in ("px", "sz"))]
    if not at:
        raise ValueError("a book needs prices and sizes of its first level")
    return max(at)


# Two books side by side.


def mid_return(a: Along, book: Book) -> Column:
    return F.ln(book.mid() / a.lag(book.mid()))


def size_flow(book: Book) -> Column:
    return (book("bid_sz") - book("ask_sz")).cast("double")


def micro(book: Book) -> Column:
    return share(book("bid_px") * book("ask_sz") + book("ask_px") * book("bid_sz"), book.volume(1))


def depth_imbalance(book: Book, depth: int = 5) -> Column:
    side = lambda s: added([book(f"{s}_sz", k) for k in range(1, depth + 1)])
    return imbalance(side("bid"), side("ask"))


def relative_spread(book: Book) -> Column:
    return share(book.spread(), book.mid())


def curvature(front: Column, middle: Column, back: Column) -> Column:
    return back - 2 * middle + front


def crosses_zero(a: Along, distance: Column, n: int = 30) -> Column:
    return flag(a.min(distance, n) * a.max(distance, n) < 0)


__all__ = [n for n in dir() if not n.startswith("_")] + ["EPS"]
