"""Feature expressions, normalisation, labels, recursions and scores."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import bar, book, patterns, session
from tapeloom.functions.along import Along
from tapeloom.operators import cross_section as cs
from tapeloom.operators import daily, labels, rolls, scoring, sequential
from tapeloom.plans import panel

A = Along("instr", ["ts"])


def series(spark, values, start=datetime(2024, 3, 4), step=timedelta(minutes=15), name="x"):
    return spark.createDataFrame([("ES", start + i * step, v) for i, v in enumerate(values)], f"instr string, ts timestamp_ntz, {name} double")


def column(df, c):
    return [r[0] for r in df.orderBy("ts").select(c).collect()]


def test_rolling_is_null_until_full_and_with_nulls(spark):
    df = series(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0])
    assert column(df, A.mean(F.col("x"), 3)) == [None, None, 2.0, None, None, None, 6.0]
    assert column(df, A.sum(F.col("x"), 2, shift=1)) == [None, None, 3.0, 5.0, None, None, 11.0]
    assert column(df, A.median(F.col("x"), 2)) == [None, 1.5, 2.5, None, None, 5.5, 6.5]


def test_skew_and_kurtosis_conventions(spark):
    df = series(spark, [1.0, 2.0, 4.0, 9.0])
    x = np.array([1, 2, 4, 9.0])
    m = x - x.mean()
    g = (m**3).mean() / (m**2).mean() ** 1.5
    assert column(df, A.skew(F.col("x"), 4))[3] == pytest.approx(g * math.sqrt(12) / 2)
    assert column(df, A.kurtosis(F.col("x"), 4))[3] == pytest.approx((m**4).mean() / (m**2).mean() ** 2 - 3)


def test_constant_series_have_no_correlation(spark):
    df = series(spark, [1.0] * 5)
    assert column(df, A.pearson(F.col("x"), F.col("x"), 3)) == [None] * 5
    assert column(df, A.deviation_corr(F.col("x"), F.col("x"), 2)) == [None] * 5


def test_one_sided_volatility_is_zero_with_an_opposite_row(spark):
    df = series(spark, [0.1, 0.2, -0.1, 0.1, 0.3])
    up = column(df, bar.one_sided_volatility(A, F.col("x"), 2, True))
    assert up[0] == 0 and up[2] == 0 and up[1] == pytest.approx(0.0707106781) and up[4] == pytest.approx(0.1414213562)


def test_jump_outputs(spark):
    df = series(spark, [0.0, 1.0])
    with pytest.raises(ValueError):
        bar.jump(A, F.col("x"), F.col("x"), output="other")
    assert column(df, bar.jump(A, F.col("x"), F.lit(0.1)))[1] == 1


def test_breakouts_and_look_ahead(spark):
    df = series(spark, [1.0, 2.0, 3.0, 2.5, 9.0])
    assert column(df, patterns.breakout_magnitude(A, F.col("x"), F.lit(1.0), 2))[2:] == pytest.approx([1.0, 0.0, 6.0])
    assert column(df, patterns.flow_after(A, F.lit(1), F.col("x"), 2)) == [5.0, 5.5, 11.5, None, None]
    assert column(df, patterns.run_length(A, F.col("x") - 2.2, 2)) == [None, -2, 0, 2, 2]


def books(spark, rows):
    return spark.createDataFrame([("ES", datetime(2024, 1, 1, 0, i), *r) for i, r in enumerate(rows)], "instr string, ts timestamp_ntz, bid_px_L1 double, bid_sz_L1 long, ask_px_L1 double, ask_sz_L1 long")


def test_flow_at_level_branches(spark):
    df = books(spark, [(100.0, 10, 101.0, 10), (100.5, 7, 101.0, 12), (100.5, 9, 100.75, 5), (100.0, 3, 101.5, 4)])
    assert column(df, book.flow_at_level(A, book.Book(), 1)) == [None, 7 - 2, 2 - 5, -9 + 5]
    assert column(df, book.deep_flow(A, book.Book(), 1, normalize=True))[1] == 5
    with pytest.raises(ValueError):
        book.concentration(book.Book(), "mid")
    assert book.effective_depth(df.columns, 10) == 1
    with pytest.raises(ValueError):
        book.effective_depth(["ts"], 10)


def test_calendar_follows_daylight_saving(spark):
    df = spark.createDataFrame([("ES", datetime(2024, 3, 8, 14, 30)), ("ES", datetime(2024, 3, 11, 13, 30))], "instr string, ts timestamp_ntz")
    et = session.eastern(F.col("ts"))
    assert [r[0] for r in df.orderBy("ts").select(F.hour(et) * 60 + F.minute(et)).collect()] == [570, 570]
    assert [r.hour_et for r in session.session_flags(df).collect()] == [9, 9]
    with pytest.raises(ValueError):
        session.bar_of_day(F.col("ts"), 25)


def test_time_of_day_scores_ignore_other_hours(spark):
    rows = [("ES", datetime(2024, 1, d, h), float(d if h == 10 else 1000 * d)) for d in range(1, 5) for h in (10, 11)]
    df = spark.createDataFrame(rows, "instr string, ts timestamp_ntz, x double").withColumn("seq", F.lit(0))
    out = panel.normalised(df, ["x"], (3,)).where("hour(ts) = 10").orderBy("ts").collect()
    assert [r.x_tc_z_w3 is None for r in out] == [True, True, False, False]
    assert out[2].x_tc_z_w3 == pytest.approx(1.0) and out[3].x_tc_madz_w3 == pytest.approx(1 / 1.4826)


def ohlc(spark, rows):
    return spark.createDataFrame([("ES", datetime(2024, 1, 1) + timedelta(seconds=s), *r) for s, *r in rows], "instr string, ts timestamp_ntz, open double, high double, low double, close double, atr double")


def test_first_touch_order_and_double_touch(spark):
    flat = (100.0, 100.2, 99.8, 100.0, 1.0)
    rows = [(0, *flat), (5, *flat), (10, 100.0, 102.0, 98.0, 101.0, 1.0), (15, *flat)]
    out = labels.first_touch(ohlc(spark, rows), 1.5, 1.0, 2).orderBy("ts").collect()
    assert (out[0].label, out[0].hit_offset) == (1, 2) and out[0].realized_ret_pts == pytest.approx(1.5)
    assert (out[2].label, out[2].hit_offset) == (-1, 1) and (out[3].label, out[3].hit_offset, out[3].realized_ret) == (0, 0, None)
    down = rows[:2] + [(10, 101.0, 102.0, 98.0, 100.0, 1.0)]
    assert labels.first_touch(ohlc(spark, down), 1.5, 1.0, 2).orderBy("ts").first().label == -1


def test_halts_drop_or_truncate(spark):
    flat = (100.0, 100.2, 99.8, 100.0, 1.0)
    rows = [(5 * i, *flat) for i in range(10)] + [(5 * i + 3600, *flat) for i in range(10, 15)]
    drop = labels.first_touch(ohlc(spark, rows), 2.0, 2.0, 4).orderBy("ts").collect()
    assert [r.hit_offset for r in drop[5:10]] == [4, -1, -1, -1, -1]
    cut = labels.first_touch(ohlc(spark, rows), 2.0, 2.0, 4, halt_mode="truncate").orderBy("ts").collect()
    assert [r.hit_offset for r in cut[6:10]] == [3, 2, -1, -1] and [r.halt_truncated for r in cut[5:10]] == [False, True, True, False, False]
    with pytest.raises(ValueError):
        labels.first_touch(ohlc(spark, rows), 1.0, 1.0, 4, halt_mode="keep")


def test_null_range_has_no_label(spark):
    rows = [(0, 1.0, 1.0, 1.0, 1.0, None), (5, 9.0, 9.0, 9.0, 9.0, 1.0)]
    r = labels.first_touch(ohlc(spark, rows), 1.0, 1.0, 2).orderBy("ts").first()
    assert (r.label, r.hit_offset, r.realized_ret, r.halt_truncated) == (0, 0, None, False)


def test_volume_buckets_discard_the_overshoot(spark):
    df = spark.createDataFrame([("ES", datetime(2024, 1, 1, 0, i), b, s) for i, (b, s) in enumerate([(6, 0), (6, 0), (5, 5), (1, 1)])], "instr string, ts timestamp_ntz, buys_qty long, sells_qty long")
    out = sequential.volume_buckets(df, 10).orderBy("ts").collect()
    assert [(r.vpin, r.bucket_volume, r.n_sub_bars) for r in out] == [(1.0, 12, 2), (0.0, 10, 1)]
    assert sequential.volume_buckets(df, 10, keep_partial=True).count() == 3


def test_intensity_halves_and_resets(spark):
    ts = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 5, 15)]
    df = spark.createDataFrame([("ES", t, 8, 0, i == 2) for i, t in enumerate(ts)], "instr string, ts timestamp_ntz, buys_qty long, sells_qty long, reset boolean")
    out = sequential.decaying_intensity(df, 5.0, "h").orderBy("ts").collect()
    assert [r.h_buy for r in out] == pytest.approx([8, 12, 8]) and [r.h_is_warm for r in out] == [False, False, False]


def test_fractional_difference(spark):
    w = sequential.fracdiff_weights(0.4)
    assert len(w) == 1458 and list(sequential.fracdiff_weights(1.0)) == [1.0, -1.0] and list(sequential.fracdiff_weights(0.0)) == [1.0]
    df = series(spark, [1.0, 3.0, 6.0])
    assert column(sequential.fracdiff(df, "x", 1.0, "y"), "y") == [None, 2.0, 3.0]
    rng = np.random.default_rng(1)
    walk = series(spark, [float(v) for v in np.cumsum(rng.normal(size=400))])
    noise = series(spark, [float(v) for v in rng.normal(size=400)])
    assert sequential.fracdiff_auto(noise, "x", "y", tau=1e-2).first().y_d == pytest.approx(0.1)
    assert 0.1 < sequential.fracdiff_auto(walk, "x", "y", tau=1e-2).first().y_d <= 1.0


def test_ema_starts_at_the_first_value(spark):
    df = series(spark, [None, 1.0, 2.0])
    assert column(sequential.ema(df, ["x"], (3,)), "x_ema_s3") == [None, 1.0, 1.5]


def test_gamma_profile_by_hand(spark):
    day = date(2024, 1, 2)
    chain = spark.createDataFrame([(day, 5000.0, date(2024, 2, 1), "C", 100.0, 0.01), (day, 4900.0, date(2024, 2, 1), "P", 200.0, 0.01), (day, 5100.0, date(2024, 2, 1), "C", 150.0, 0.005)], "date date, strike_price double, exdate date, cp_flag string, open_interest double, gamma double")
    spot = spark.createDataFrame([(day, 5000.0)], "date date, spot double")
    r = daily.gamma_profile(chain, spot).first()
    assert (r.max_call_oi_strike, r.max_put_oi_strike, r.gex_0dte_share, r.zero_gamma_strike) == (5100.0, 4900.0, 0.0, 4900.0)
    assert r.total_gex == pytest.approx((200 * 0.01 - 100 * 0.01 - 150 * 0.005) * 5000**2 * 100)
    with pytest.raises(NotImplementedError):
        daily.gamma_profile(chain, spot, "other")


def test_profile_applies_from_the_next_day_for_five_days(spark):
    prof = spark.createDataFrame([(date(2024, 1, 5), 1.0, 1.0, 100.0, 100.0, 100.0)], "date date, total_gex double, gex_sign double, zero_gamma_strike double, max_call_oi_strike double, max_put_oi_strike double")
    rows = spark.createDataFrame([("ES", datetime(2024, 1, d), 101.0) for d in (5, 6, 8, 11, 12)], "instr string, ts timestamp_ntz, close double")
    out = daily.attach_gamma(rows, prof).orderBy("ts").collect()
    assert [r.distance_to_zero_gamma_flip for r in out] == [None, 1.0, 1.0, 1.0, None]
    assert daily.attach_gamma_profiles(rows, []).columns == rows.columns


def test_overnight_needs_sessions(spark):
    with pytest.raises(ValueError):
        daily.overnight(series(spark, [1.0]))


def test_gauss_ranks_and_pins(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("c", 1, None), ("a", 2, 1.0)], "instr string, ts int, v double")
    out = {(r.instr, r.ts): r.gauss_rank_v for r in cs.gauss_ranks(df, ["v"]).collect()}
    assert out[("a", 1)] == pytest.approx(0.4307273) and out[("b", 1)] == pytest.approx(-0.4307273)
    assert out[("c", 1)] is None and out[("a", 2)] is None
    x = series(spark, [5000.0, 5025.0, 5049.75])
    assert column(x, panel.pin_distance(F.col("x"), 50.0)) == [0.0, 25.0, 0.25]


def test_scores(spark):
    rows = [(i, float(i), float(i % 7), float(2 * i + 1), 2020 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "ts int, a double, b double, y double, year int")
    out = {r.feature: r for r in scoring.information_coefficients(df, ["a", "b"], "y").collect()}
    assert out["a"].ic == pytest.approx(1.0) and out["a"].rank_ic == pytest.approx(1.0) and abs(out["b"].ic) < 0.2
    assert scoring.information_coefficients(df.limit(50), ["a"], "y").first().ic is None
    assert scoring.feature_columns(df) == ["a", "b", "y"]
    best = scoring.dashboard(df, ["a", "b"], "y", least=50)
    assert best.first().feature == "a" and best.first().n_years == 2
    assert abs(scoring.linear_residual(df, "y", ["a"]).agg(F.max(F.abs("residual"))).first()[0]) < 1e-6
    scores = spark.createDataFrame([("a", 0.5), ("b", -0.4), ("c", 0.3), ("d", None)], "feature string, ic double")
    corr = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", None)], "feature_a string, feature_b string, corr double")
    assert scoring.greedy_select(scores, corr, 5, 0.7) == ["a", "c"]


def test_walk_forward_keeps_an_embargo(spark):
    for k, (_, train_to, test_from, test_to) in enumerate(scoring.walk_forward(60_000), 1):
        assert train_to == 10_000 * k - 8 and test_from == 10_000 * k + 8 and test_to == min(test_from + 10_000, 60_000)
    with pytest.raises(ValueError):
        scoring.walk_forward(599, 5)
    assert len(scoring.walk_forward(6_000, 5, embargo=960)) == 4  # the last test would have 40 rows
    n = 1_237
    df = spark.range(n).select(F.lit("a").alias("instr"), F.col("id").alias("ts"))
    got = {r.ts: (r.test_fold, set(r.train_folds)) for r in scoring.with_folds(df, ["ts"], ["instr"], least_train=300).collect()}
    splits = scoring.walk_forward(n, least_train=300)
    for i in range(n):
        assert got[i] == (next((k for k, (_, _, c, d) in enumerate(splits) if c <= i < d), -1), {k for k, (a, b, _, _) in enumerate(splits) if a <= i < b})


def test_exponential_means_age_over_nulls(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, None, 3.0, 4.0])], "instr string, ts int, x double")
    got = [r.x_ema_s3 for r in sequential.ema(df, ["x"], (3,)).orderBy("ts").collect()]
    assert got[:2] == [1.0, None] and got[2:] == pytest.approx([2 + 1 / 3, 3 + 1 / 6])
    rets = df.withColumnRenamed("x", "r").na.fill(0.5)
    assert [r.v for r in sequential.realized_volatility(rets, "r", 3, "ewma", "v").orderBy("ts").collect()][0] == 1.0
    with pytest.raises(ValueError):
        sequential.realized_volatility(rets, "r", 3, "other")


def test_lags_are_chosen_by_aic():
    rng = np.random.default_rng(2)
    e = rng.standard_normal(3_000)
    dx = np.zeros(3_000)
    for i in range(3, 3_000):  # differences that lean on the third one before
        dx[i] = 0.6 * dx[i - 3] + e[i]
    walk = np.cumsum(dx)
    assert 3 <= sequential.chosen_lags(walk) <= 12 and sequential.unit_root_p(sequential.dickey_fuller(walk)) > 0.01
    assert sequential.unit_root_p(sequential.dickey_fuller(e)) < 0.01
    # By hand: the same rows for all numbers of lags, each fitted by itself.
    most = 30
    a, y = sequential._unit_root_design(walk[:800], most)
    aic = []
    for k in range(2, most + 3):
        rest = y - a[:, :k] @ np.linalg.lstsq(a[:, :k], y, rcond=None)[0]
        aic.append(len(y) * np.log(rest @ rest / len(y)) + 2 * k)
    assert sequential.chosen_lags(walk[:800]) == int(np.argmin(aic[: int(np.ceil(12 * 8**0.25)) + 1])) or abs(min(aic) - aic[sequential.chosen_lags(walk[:800])]) < 12


def test_options_join_keeps_the_panels_columns(spark):
    panel_ = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 6.0)], "ts int, close double, gex double")
    options = spark.createDataFrame([(1, 9.0, 7.0), (1, 9.5, 8.0), (3, 1.0, 1.0)], "ts int, gex double, flip double")
    got = panel.with_options(panel_, options)
    assert got.columns == ["ts", "close", "gex", "flip"] and sorted(tuple(r) for r in got.where("ts = 1").collect()) == [(1, 1.0, 5.0, 7.0), (1, 1.0, 5.0, 8.0)]
    assert got.where("ts = 2").first().flip is None and got.count() == 3

def test_rolls(spark):
    f = spark.createDataFrame([("VX", date(2024, 1, 3), "VXF4", 5_000), ("VX", date(2024, 1, 3), "VXG4", 9_000), ("VX", date(2024, 1, 3), "VXZ3", 7_000), ("VX", date(2024, 1, 3), "VXH5", 100), ("ES", date(2024, 1, 3), "ESH4", 5_000), ("ES", date(2024, 1, 3), "ESM4", 6_000), ("ES", date(2024, 1, 4), "ESH4", 7_000), ("ES", date(2024, 1, 6), "ESM4", 7_000)], "root string, day date, expiry string, bytes long")
    assert [(r.slot, r.expiry) for r in rolls.front_n(f).where("root = 'VX'").orderBy("slot").collect()] == [(1, "VXF4"), (2, "VXG4")]
    series_ = rolls.front_series(f)
    assert [(r.day, r.from_expiry, r.to_expiry) for r in rolls.detect_rolls(series_).collect()] == [(date(2024, 1, 4), "ESM4", "ESH4")]
    assert rolls.front_series(f, "2024-01-04", "2024-01-31", weekdays_only=False).count() == 2


def test_cross_composites_skip_what_is_missing(spark):
    wide = spark.createDataFrame([(i, 0.1 * i, 0.2) for i in range(4)], "ts int, ES_log_return double, GC_log_return double")
    assert cs.composites(wide, 2).columns == ["ts", "ES_log_return", "GC_log_return", "corr_ES_vs_gold_w2"]
    with pytest.raises(ValueError):
        cs.widen(wide, [], [])
    assert cs.interactions(wide, "ES").columns == wide.columns


def test_label_balance(spark):
    third = F.lit(1 / 3)
    assert spark.range(1).select(labels.balance(third, third, third)).first()[0] == pytest.approx(1.0)


def test_unit_root_p_values_agree_with_critical_values():
    for level in (0.01, 0.05, 0.10):
        assert sequential.unit_root_p(sequential.unit_root_critical(level, 10**9)) == pytest.approx(level, abs=0.002)
        assert sequential.unit_root_critical(level, 50) < sequential.unit_root_critical(level, 500) < sequential.unit_root_critical(level, 10**9)
    values = [sequential.unit_root_p(x / 10) for x in range(-200, 40)]
    assert values == sorted(values) and values[0] == 0.0 and values[-1] == 1.0
    assert sequential.unit_root_p(-1.61) == pytest.approx(sequential.unit_root_p(-1.6099), abs=0.01)


def test_normal_quantiles_equal_the_standard_librarys(spark):
    from statistics import NormalDist

    from tapeloom.functions.normal import normal_quantile

    shares = [1e-300, 1e-12, 1e-5, 0.02, 0.07, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*shares, 0.0, 1.0])], "i int, p double").select("i", normal_quantile(F.col("p")).alias("z")).orderBy("i").collect()
    assert [r.z for r in rows[: len(shares)]] == pytest.approx([NormalDist().inv_cdf(p) for p in shares], rel=1e-12)
    assert [r.z for r in rows[len(shares) :]] == [None, None]
