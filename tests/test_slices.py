"""As-of joins, recursions and buckets over slices: equal to loops over whole series, and no series is one task's work."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import sequential, slices
from tapeloom.operators.asof import asof

T0 = dt.datetime(2024, 3, 1)


def series(spark, n=400, seed=1, keys=2, ties=True):
    """instr, ts, seq, buys_qty, sells_qty, x with gaps of minutes to days, tied times, nulls."""
    rng, rows = random.Random(seed), []
    for k in range(keys):
        t = T0
        for i in range(n):
            t += dt.timedelta(seconds=0 if ties and rng.random() < 0.1 else rng.choice((60, 3_600, 7_200, 100_000)))
            rows.append((k, t, i, rng.randrange(0, 60), rng.randrange(0, 60), None if rng.random() < 0.2 else rng.uniform(-3, 3)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "instr int, ts timestamp_ntz, seq long, buys_qty long, sells_qty long, x double").repartition(5)


def plain_asof(left, right, strict, within):
    out = {}
    for r in left:
        best = None
        for q in right:
            if q.instr == r.instr and q.ts is not None and (q.ts < r.ts or (q.ts == r.ts and not strict)):
                if best is None or (q.ts, q.seq) > (best.ts, best.seq):
                    best = q
        if best is not None and within and (r.ts - best.ts).total_seconds() > within:
            best = None
        out[(r.instr, r.seq)] = (None, None) if best is None else (best.bid, best.ts)
    return out


@pytest.mark.parametrize("strict, within, hours", [(True, None, 24), (False, None, 1), (False, 86_400, 24), (True, 600, 1_000_000)])
def test_asof_equals_a_plain_search(spark, strict, within, hours):
    left = series(spark, 120, 2)
    right = series(spark, 60, 3).where("seq % 3 > 0 or instr = 1").select("instr", "ts", "seq", F.col("x").alias("bid"))
    out = asof(left, right, ["instr"], strict=strict, within=within, carry="at", hours=hours)
    got = {(r.instr, r.seq): (r.bid, r["at"]) for r in out.collect()}
    assert got == plain_asof(left.collect(), right.collect(), strict, within)


def test_asof_carries_over_empty_slices_and_ignores_null_keys(spark):
    day = lambda d: T0 + dt.timedelta(days=d)
    left = spark.createDataFrame([(1, day(0), 0), (1, day(9), 1), (2, day(9), 2), (None, day(9), 3)], "instr int, ts timestamp_ntz, seq long")
    right = spark.createDataFrame([(1, day(1), 0, None), (None, day(1), 0, 5.0), (2, None, 0, 7.0)], "instr int, ts timestamp_ntz, seq long, bid double")
    out = {r.seq: (r.bid, r["at"]) for r in asof(left, right, ["instr"], carry="at").collect()}
    assert out == {0: (None, None), 1: (None, day(1)), 2: (None, None), 3: (None, None)}


def test_one_key_is_many_tasks_and_rows_are_dealt_once(spark):
    left = series(spark, 600, 4, keys=1)
    right = left.select("instr", "ts", "seq", F.col("x").alias("bid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof(left, right, ["instr"])
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        out.collect()
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slices_never_go_back(spark):
    rows = series(spark, 300, 5, keys=1).withColumn("s", slices.time_slice(F.col("ts"), 5)).orderBy("ts").collect()
    assert all(a.s <= b.s for a, b in zip(rows, rows[1:])) and len({r.s for r in rows}) > 20


def test_numbers_and_halos(spark):
    rows = slices.numbered(series(spark, 200, 6), ["instr"], "ts", ["seq"], "no", 7)
    got = rows.collect()
    for k in (0, 1):
        ordered = sorted((r for r in got if r.instr == k), key=lambda r: (r.ts, r.seq))
        assert [r.no for r in ordered] == list(range(200))
    blocks = slices.with_halo(rows, "no", 16, 40).collect()
    for k in (0, 1):
        for b in range(13):
            inside = sorted(r.no for r in blocks if (r.instr, r._block) == (k, b))
            assert inside[: len(inside)] == list(range(max(0, 16 * b - 40), min(16 * b + 16, 200))) if b < 12 else inside
    assert sum(r._own for r in blocks) == 400


def ordered(df):
    return {k: g.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True) for k, g in df.toPandas().groupby("instr")}


@pytest.mark.parametrize("hours", [3, 24, 1_000_000])
def test_exponential_means_equal_pandas(spark, hours):
    out = ordered(sequential.ema(series(spark), ["x"], (3, 10), hours=hours))
    for g in out.values():
        x = pd.to_numeric(g["x"])
        for s in (3, 10):
            want = x.ewm(span=s, adjust=False, ignore_na=False).mean().where(x.notna())
            assert np.allclose(g[f"x_ema_s{s}"].astype(float), want, equal_nan=True, rtol=1e-12)


@pytest.mark.parametrize("hours", [3, 24, 1_000_000])
def test_intensities_equal_a_loop(spark, hours):
    rows = series(spark).withColumn("reset", F.col("seq") % 37 == 20)
    out = ordered(sequential.decaying_intensity(rows, 5_000.0, "h", warmup=2.0, hours=hours))
    for g in out.values():
        level, last, start = np.zeros(2), None, None
        for r in g.itertuples():
            t = r.ts.timestamp()
            if r.reset or last is None:
                level, start = np.zeros(2), t
            else:
                level = level * np.exp(-np.log(2) / 5_000 * (t - last))
            level = level + (r.buys_qty, r.sells_qty)
            last = t
            assert np.allclose((r.h_buy, r.h_sell, r.h_imbalance), (*level, level[0] - level[1]), rtol=1e-9)
            assert r.h_is_warm == (t - start >= 10_000)


@pytest.mark.parametrize("block, tau", [(16, 1e-2), (1_000, 1e-3)])
def test_fractional_differences_equal_a_convolution(spark, block, tau):
    rows = series(spark).withColumn("x", F.coalesce("x", F.lit(0.5)))
    weights = sequential.fracdiff_weights(0.4, tau)
    for g in ordered(sequential.fracdiff(rows, "x", 0.4, "fd", tau, block=block)).values():
        want = np.convolve(g["x"].astype(float), weights)[: len(g)]
        want[: len(weights) - 1] = np.nan
        assert np.allclose(g["fd"].astype(float), want, equal_nan=True, rtol=1e-9, atol=1e-12)


def plain_buckets(g, size, partial):
    out, total, signed, n, last = [], 0, 0, 0, None
    for r in g.itertuples():
        total, signed, n, last = total + r.buys_qty + r.sells_qty, signed + r.buys_qty - r.sells_qty, n + 1, r.ts
        if total >= size:
            out.append((last, abs(signed) / total, total, n))
            total, signed, n = 0, 0, 0
    if partial and total:
        out.append((last, abs(signed) / total, total, n))
    return out


@pytest.mark.parametrize("size, partial, hours", [(500, False, 24), (500, True, 3), (40, True, 24), (10**6, True, 5), (1, False, 50), (900, True, 1_000_000)])
def test_buckets_equal_a_walk(spark, size, partial, hours):
    rows = series(spark, ties=False)
    got = sequential.volume_buckets(rows, size, partial, hours=hours).toPandas()
    for k, g in ordered(rows).items():
        mine = got[got.instr == k].sort_values("ts")
        assert [(r.ts.to_pydatetime(), round(r.vpin, 12), r.bucket_volume, r.n_sub_bars) for r in mine.itertuples()] == [(t.to_pydatetime(), round(v, 12), b, n) for t, v, b, n in plain_buckets(g, size, partial)]


def test_recursions_of_nothing(spark):
    rows = series(spark).limit(0)
    assert sequential.ema(rows, ["x"], (3,)).count() == sequential.volume_buckets(rows, 5).count() == sequential.fracdiff(rows, "x", 0.4, "fd").count() == 0
    assert sequential.intensities(rows).count() == 0


def test_one_series_is_many_tasks(spark):
    """The largest chunk that a task gets of one key's 600 rows is a slice."""
    chunks = sequential.chunked(series(spark, 600, 7, keys=1), ["instr"], ["x"], 24)
    sizes = [r.n for r in chunks.select(F.size("rows").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 60 and len(sizes) > 30
