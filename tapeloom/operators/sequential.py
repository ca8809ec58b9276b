"""Recursions along a series that no window expresses: volume buckets, decaying intensities, exponential means and fractional
differences. Series are parted into slices of time (see `scans`) or blocks of rows, so none is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bar
from ..functions.along import Along
from ..functions.session import eastern
from ..sources.scratch import written
from . import scans
from .scans import chunked
from .slices import HOURS, numbered, with_halo


def _per_group(df: DataFrame, by: list[str], fields: list[tuple[str, str]], work: Callable[[pd.DataFrame], pd.DataFrame], order: list[str]) -> DataFrame:
    """df with new columns of each sorted group."""
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields]) if fields else df.schema
    return df.groupBy(*by).applyInPandas(lambda g: work(g.sort_values(order, kind="stable").reset_index(drop=True)), schema)


def fracdiff_weights(d: float, tau: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """Weights of the fractional difference until one is smaller than tau."""
    weights = [1.0]
    while d > 0 and len(weights) < most:
        w = -weights[-1] * (d - len(weights) + 1) / len(weights)
        if abs(w) < tau:
            break
        weights.append(w)
    return np.array(weights)


#: Rows of a block of fractional differences.
BLOCK = 65_536


def fracdiff(df: DataFrame, value: str, d: float, out: str, tau: float = 1e-5, by: list[str] | None = None, block: int = BLOCK, hours: int = HOURS) -> DataFrame:
    """Causal fractional difference; null until all weights have values. Rows are numbered and worked in blocks, each with the rows
    before it that its weights reach."""
    by, weights = by or ["instr"], fracdiff_weights(d, tau)
    order = [c for c in ("seq",) if c in df.columns]
    # Rows that agree in time and order stand by value, in both readings.
    rows = numbered(df.withColumn("_x", F.col(value).cast("double")), by, "ts", [*order, "_x"], "_no", hours)
    keys = [f for f in rows.schema.fields if f.name in by]
    dealt = with_halo(rows.select(*by, "_no", "_x"), "_no", block, len(weights) - 1)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_no")
        x = g["_x"].to_numpy(float)
        y = np.convolve(x, weights)[: len(x)]
        y[g["_no"].to_numpy() < len(weights) - 1] = np.nan
        own = g["_own"].to_numpy(bool)
        values = pd.Series(y[own]).astype(object).where(~np.isnan(y[own]), None)
        return pd.DataFrame({**{f.name: g[f.name].to_numpy()[own] for f in keys}, "_no": g["_no"].to_numpy()[own], out: values.to_numpy()})

    found = dealt.groupBy(*by, "_block").applyInPandas(work, T.StructType([*keys, T.StructField("_no", T.LongType()), T.StructField(out, T.DoubleType())]))
    return rows.join(found, [*by, "_no"], "left").select(*[f"`{c}`" for c in df.columns], out)


def _unit_root_design(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences, and the constant, the level and the lagged differences that explain them."""
    dx = np.diff(x)
    n = len(dx) - lags
    return np.stack([np.ones(n), x[lags:-1], *(dx[lags - i - 1 : len(dx) - i - 1] for i in range(lags))], axis=1), dx[lags:]


def chosen_lags(x: np.ndarray) -> int:
    """The number of lagged differences of the least AIC; all numbers are compared over the rows that the largest leaves."""
    most = max(0, min(len(x) // 2 - 2, math.ceil(12 * (len(x) / 100) ** 0.25)))
    a, y = _unit_root_design(x, most)
    gram, right, n = a.T @ a, a.T @ y, len(y)
    best = (math.inf, 0)
    for lags in range(most + 1):
        k = lags + 2  # regressions are nested: each is a corner of the products of the largest
        rest = float(y @ y - right[:k] @ np.linalg.lstsq(gram[:k, :k], right[:k], rcond=None)[0])
        best = min(best, (n * math.log(max(rest, 1e-300) / n) + 2 * k, lags))
    return best[1]


def dickey_fuller(x: np.ndarray, lags: int | None = None) -> float:
    """The t statistic of the unit-root regression with a constant and lagged differences, by default as many as AIC chooses."""
    a, y = _unit_root_design(x, chosen_lags(x) if lags is None else lags)
    n = len(y)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ beta
    scale = rest @ rest / max(1, n - a.shape[1])
    return float(beta[1] / math.sqrt(max(1e-300, scale * np.linalg.pinv(a.T @ a)[1, 1])))


#: MacKinnon's approximation of the statistic's distribution with a constant. Below `turn` the normal value of p is the
#: first polynomial of the statistic, above it the second; beyond the bounds p is 0 or 1.
UNIT_ROOT_P = {"least": -18.83, "turn": -1.61, "most": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}
#: His response surfaces of critical values over the number of differences: coefficients of 1, 1/n, 1/n^2, 1/n^3.
UNIT_ROOT_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}


def unit_root_p(statistic: float) -> float:
    """The p value of the unit-root statistic."""
    if statistic <= UNIT_ROOT_P["least"]:
        return 0.0
    if statistic > UNIT_ROOT_P["most"]:
        return 1.0
    terms = UNIT_ROOT_P["small" if statistic <= UNIT_ROOT_P["turn"] else "large"]
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(terms)))


def unit_root_critical(level: float, n: int) -> float:
    """The statistic below which n differences reject a unit root at a level."""
    return sum(c / n**k for k, c in enumerate(UNIT_ROOT_CRITICAL[level]))


def fracdiff_auto(df: DataFrame, value: str, out: str, level: float = 0.01, grid: tuple = tuple(i / 10 for i in range(1, 11)), tau: float = 1e-5, by: list[str] | None = None) -> DataFrame:
    """The smallest order of the grid whose difference rejects a unit root by its p value; 1 where none does. Adds the order too.

    The test needs a whole series, so a series is one task's work here: its values alone travel."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        x = g[value].to_numpy(float)
        for d in grid:
            weights = fracdiff_weights(d, tau)
            y = np.convolve(x, weights)[: len(x)]
            y[: len(weights) - 1] = np.nan
            whole = y[~np.isnan(y)]
            if len(whole) >= 100 and unit_root_p(dickey_fuller(whole)) < level:
                break
        else:
            d, y = 1.0, np.concatenate(([np.nan], np.diff(x)))[: len(x)]
        g[out] = pd.Series(y).astype(object).where(~np.isnan(y), None)
        g[f"{out}_d"] = float(d)
        return g

    return _per_group(df, by or ["instr"], [(out, "double"), (f"{out}_d", "double")], work, ["ts"])


def bucket_steps(volume: np.ndarray, size: int) -> list[tuple[float, float, float]]:
    """A chunk's map from the volume that an open bucket brings along to the volume of the bucket that it leaves open.

    Steps (reach, left, ends): where the chunk's running volume must come to `reach` at most to close the first bucket, `left` stays
    open at the chunk's end after `ends` closed buckets. Each row's bucket end has its successor, found in the running volume; what a
    bucket end at a row leads to is read off the last one of its chain, whose jumps are doubled until none moves. Neighbours that lead to
    the same are one step.
    """
    n = len(volume)
    upto = np.concatenate(([0], np.cumsum(volume)))
    # A bucket that ends with row i is followed by one that ends with row after[i] (n: stays open).
    after = np.maximum(np.searchsorted(upto, upto[1:] + size, "left") - 1, np.arange(n) + 1)
    jump, ends = np.append(np.minimum(after, n), n), np.append(np.ones(n, np.int64), 0)
    last = np.where(jump < n, jump, np.arange(n + 1))  # the last bucket end that is known in each chain
    while True:
        moved = jump[jump]
        if (moved == jump).all():
            break
        ends = ends + ends[jump]
        last = np.where(jump < n, last[np.minimum(jump, n - 1)], last)
        jump = moved
    left = upto[n] - upto[last[:n] + 1]
    keep = np.append((left[1:] != left[:-1]) | (ends[1:n] != ends[: n - 1]), True) if n else np.zeros(0, bool)
    return list(zip(upto[1:][keep].tolist(), left[keep].tolist(), ends[:n][keep].tolist(), strict=True))


def volume_buckets(bars: DataFrame, size: int, keep_partial: bool = False, by: list[str] | None = None, hours: int = HOURS) -> DataFrame:
    """A row for each run of bars that reaches a volume: its signed share. What goes beyond the size isn't carried over.

    Slices are written as rows of arrays, each with its map of open volumes (see bucket_steps). A key's maps are walked in order,
    a row a slice; each slice then knows the volume and the number of buckets before it, cuts its own rows into pieces, and pieces of
    one bucket are added up.
    """
    by = by or ["instr"]
    packed = chunked(bars, by, ["buys_qty", "sells_qty"], hours)
    keys = [f for f in packed.schema.fields if f.name in (*by, "_slice")]
    names = [f.name for f in keys]
    steps = T.ArrayType(T.ArrayType(T.DoubleType()))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, totals = [], []
            for k in range(batch.num_rows):
                f = scans.fields_of(batch.column("rows"), k)
                volume = (f["buys_qty"] + f["sells_qty"]).astype(np.int64)
                found.append([list(map(float, s)) for s in bucket_steps(volume, size)])
                totals.append(int(volume.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.float64()))), pa.array(totals, pa.int64())], [*batch.schema.names, "_steps", "_total"])

    parts = written(packed.mapInArrow(mapped, T.StructType([*packed.schema.fields, T.StructField("_steps", steps), T.StructField("_total", T.LongType())])), "buckets")

    def walked(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_slice")
        held, number, rows = 0, 0, []
        for table, total in zip(g["_steps"], g["_total"], strict=True):
            rows.append((held, number))
            table = np.stack(table)
            at = int(np.searchsorted(table[:, 0], size - held, "left"))
            if at < len(table):
                held, number = int(table[at, 1]), number + int(table[at, 2])
            else:
                held += int(total)
        out = g[names].copy()
        out["_held"], out["_number"] = zip(*rows, strict=True)
        return out

    more = [T.StructField("_held", T.LongType()), T.StructField("_number", T.LongType())]
    entries = parts.select(*names, "_steps", "_total").groupBy(*by).applyInPandas(walked, T.StructType([*keys, *more]))
    piece = T._parse_datatype_string("_number long, _ends boolean, ts timestamp_ntz, signed long, volume long, n long")
    own = [f for f in keys if f.name != "_slice"]
    kind = next(f.dataType for f in bars.schema.fields if f.name == "ts")
    piece["ts"].dataType = kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = scans.fields_of(batch.column("rows"), k)
                buys, sells = f["buys_qty"].astype(np.int64), f["sells_qty"].astype(np.int64)
                upto, signed = np.concatenate(([0], np.cumsum(buys + sells))), np.concatenate(([0], np.cumsum(buys - sells)))
                n, need, at, edges = len(buys), size - batch.column("_held")[k].as_py(), 0, [0]
                while (end := max(int(np.searchsorted(upto, upto[at] + need, "left")), at + 1)) <= n:
                    edges.append(end)
                    at, need = end, size
                closed = len(edges) - 1
                if at < n:
                    edges.append(n)
                a, b = np.array(edges[:-1]), np.array(edges[1:])
                columns = [pa.array(batch.column("_number")[k].as_py() + np.arange(len(a))), pa.array(np.arange(len(a)) < closed), batch.column("rows")[k].values.field("ts").take(pa.array(b - 1)), pa.array(signed[b] - signed[a]), pa.array(upto[b] - upto[a]), pa.array(b - a)]
                yield pa.RecordBatch.from_arrays([*[pa.array([batch.column(x.name)[k].as_py()] * len(a), batch.column(x.name).type) for x in own], *columns], [*[x.name for x in own], *piece.names])

    pieces = parts.select(*names, "rows").join(entries, names).mapInArrow(cut, T.StructType([*own, *piece.fields]))
    whole = pieces.groupBy(*by, "_number").agg(F.max("ts").alias("ts"), F.sum("signed").alias("_signed"), F.sum("volume").alias("bucket_volume"), F.sum("n").alias("n_sub_bars"), F.max("_ends").alias("_ends"))
    whole = whole.where("_ends or bucket_volume > 0" if keep_partial else "_ends")
    return whole.select(*by, "ts", F.when(F.col("bucket_volume") > 0, F.abs("_signed") / F.col("bucket_volume")).otherwise(0.0).alias("vpin"), "bucket_volume", "n_sub_bars")


def session_resets(bars: DataFrame) -> DataFrame:
    """Adds `reset`: the bar that ends at 18:00:05 on the sessions' clock."""
    et = eastern(F.col("ts"))
    return bars.withColumn("reset", (F.hour(et) == 18) & (F.minute(et) == 0) & (F.second(et) == 5))


def decaying_intensity(bars: DataFrame, half_life: float, name: str, warmup: float = 5.0, by: list[str] | None = None, hours: int = HOURS) -> DataFrame:
    """Buys and sells that decay with a half life: {name}_buy, {name}_sell, {name}_imbalance and whether it is warm.

    `reset` marks rows where both restart. The decay between rows is by the true seconds between them.
    """
    return decaying_intensities(bars, {name: half_life}, warmup, by, hours)


def decaying_intensities(bars: DataFrame, half_lives: dict[str, float], warmup: float = 5.0, by: list[str] | None = None, hours: int = HOURS) -> DataFrame:
    """decaying_intensity for several half lives by name, in one scan."""
    beta = np.array([math.log(2) / h for h in half_lives.values()])
    sides = ("buys_qty", "sells_qty")
    marked = "reset" in bars.columns

    def local(f: dict[str, np.ndarray]):
        t = scans.epoch_seconds(f["ts"])
        reset = f["reset"].astype(bool) if marked else np.zeros(len(t), bool)
        start = np.maximum.accumulate(np.where(reset, t, -np.inf))
        own, summary = [t, np.where(np.isfinite(start), start, np.nan)], [t[0], t[-1], start[-1]]
        for b in beta:
            keep = np.exp(-b * np.maximum(np.diff(t, prepend=t[:1]), 0.0))  # the first row's decay is part of what enters
            keep[reset] = 0.0
            for side in sides:
                p, q = scans.affine_prefix(keep, f[side])
                own += [p, q]
                summary += [p[-1], q[-1]]
        return summary, own

    def fold(s: np.ndarray) -> np.ndarray:
        out, level, start, last = np.zeros((len(s), 1 + 2 * len(beta))), np.zeros(2 * len(beta)), s[0, 0], s[0, 0]
        for i, row in enumerate(s):
            level = level * np.exp(-np.repeat(beta, 2) * max(row[0] - last, 0.0))
            out[i] = [start, *level]
            level = row[3::2] * level + row[4::2]
            start, last = max(start, row[2]), row[1]
        return out

    def finish(own, entry):
        new = {}
        for i, (name, h) in enumerate(half_lives.items()):
            levels = [own(2 + 4 * i + 2 * j) * entry(1 + 2 * i + j) + own(3 + 4 * i + 2 * j) for j in range(2)]
            since = own(0) - F.when(F.isnan(own(1)), entry(0)).otherwise(own(1))
            new |= {f"{name}_buy": levels[0], f"{name}_sell": levels[1], f"{name}_imbalance": levels[0] - levels[1], f"{name}_is_warm": since >= warmup * h}
        return new

    return scans.scan(bars, by or ["instr"], [*sides, *(["reset"] if marked else [])], local, fold, finish, hours)


def intensities(bars: DataFrame, fast: float = 5.0, slow: float = 60.0, by: list[str] | None = None, hours: int = HOURS) -> DataFrame:
    """Imbalances of a fast and a slow half life, and their difference."""
    by = by or ["instr"]
    rows = decaying_intensities(session_resets(bars.select(*by, "ts", "buys_qty", "sells_qty")), {"_f": fast, "_s": slow}, by=by, hours=hours)
    return rows.select(*by, "ts", F.col("_f_imbalance").alias(f"hawkes_imbalance_hl{int(fast)}"), F.col("_s_imbalance").alias(f"hawkes_imbalance_hl{int(slow)}"), (F.col("_f_imbalance") - F.col("_s_imbalance")).alias("hawkes_acceleration"))


def ema(df: DataFrame, values: list[str], spans: tuple[int, ...] = (10, 30), by: list[str] | None = None, hours: int = HOURS) -> DataFrame:
    """Exponential means {value}_ema_s{span} from the first value on. A null row has none, and ages what came before it.

    A value after g rows without one weighs what came before by (1 - alpha) ^ (g + 1), so a mean is affine in the one before it; in a
    chunk, in the mean at its first value.
    """
    if not values:
        return df
    alphas = [2 / (s + 1) for s in spans]

    def local(f: dict[str, np.ndarray]):
        summary, own = [], []
        for v in values:
            x = f[v]
            at = np.flatnonzero(~np.isnan(x))
            summary += [len(x), at[0] if len(at) else -1, len(x) - 1 - at[-1] if len(at) else 0, x[at[0]] if len(at) else 0.0]
            for alpha in alphas:
                p, q = np.full(len(x), np.nan), np.full(len(x), np.nan)
                if len(at):
                    weight = (1 - alpha) ** np.diff(at)
                    p[at], q[at] = scans.affine_prefix(np.append(1.0, weight / (weight + alpha)), np.append(0.0, alpha * x[at[1:]] / (weight + alpha)))
                    summary += [p[at[-1]], q[at[-1]]]
                else:
                    summary += [0.0, 0.0]
                own += [p, q]
        return summary, own

    wide = 4 + 2 * len(spans)

    def fold(s: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), len(values) * len(spans)))
        for j in range(len(values)):
            level, gap = [None] * len(spans), 0
            for i, row in enumerate(s[:, j * wide : (j + 1) * wide]):
                rows, lead, trail, first = row[:4]
                if lead < 0:
                    gap += rows
                    continue
                for k, alpha in enumerate(alphas):
                    weight = (1 - alpha) ** (gap + lead + 1)
                    entry = first if level[k] is None else (weight * level[k] + alpha * first) / (weight + alpha)
                    out[i, j * len(spans) + k] = entry
                    level[k] = row[4 + 2 * k] * entry + row[5 + 2 * k]
                gap = trail
        return out

    def finish(own, entry):
        new = {}
        for j, v in enumerate(values):
            for k, s in enumerate(spans):
                i = j * len(spans) + k
                new[f"{v}_ema_s{s}"] = F.when(~F.isnan(own(2 * i)), own(2 * i) * entry(i) + own(2 * i + 1))
        return new

    return scans.scan(df, by or ["instr"], values, local, fold, finish, hours)


def ewm_volatility(df: DataFrame, ret: str, span: int, out: str, by: list[str] | None = None) -> DataFrame:
    """Root of the exponential mean of squared returns."""
    squares = df.withColumn("_sq", F.col(ret) * F.col(ret))
    return ema(squares, ["_sq"], (span,), by).withColumn(out, F.sqrt(f"_sq_ema_s{span}")).drop("_sq", f"_sq_ema_s{span}")


def realized_volatility(df: DataFrame, ret: str, n: int, method: str = "std", out: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds the rolling deviation of n returns ("std"), or the root of their exponential mean square of span n ("ewma")."""
    out = out or f"realized_vol_w{n}"
    if method == "std":
        return df.withColumn(out, bar.realized_volatility(Along(by or ["instr"], ["ts"]), F.col(ret), n))
    if method == "ewma":
        return ewm_volatility(df, ret, n, out, by)
    raise ValueError(f"method is std or ewma, not {method!r}")
