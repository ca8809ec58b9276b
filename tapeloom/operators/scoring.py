"""Scoring and selection of features: information coefficients, dashboards, greedy choice, walk-forward folds, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Written
from . import boosting
from .cross_section import CLASSES

ALL_INSTRUMENTS = [i for members in CLASSES.values() for i in members]
#: Raw columns, labels and bookkeeping that are never features.
NOT_FEATURES = {
    "ts", "root", "expiry",
    "open", "high", "low", "close", "volume", "dollar_volume",
    "buys_qty", "sells_qty", "trades_count", "unclassified_count",
    "implied_volume", "implied_buys", "implied_sells",
    "bid_close", "ask_close", "mid_close", "spread_abs_close",
    "spread_mean_sub", "spread_std_sub", "spread_max_sub", "spread_min_sub",
    "cvd_globex", "cvd_rth", "bars_since_rth_reset",
    "is_session_warm",
    *(f"{side}_{kind}_L{k}" for side in ("bid", "ask") for kind in ("px", "sz", "ord") for k in range(1, 11)),
    "book_ts_close", "book_ts_close_bid", "book_ts_close_ask",
    "label", "realized_ret", "realized_ret_pts", "hit_offset", "atr",
    "halt_truncated",
}
#: Columns that panels of this engine have for their keys and order.
KEYS = {"instr", "seq", "year"}
#: Parts of names that mark liquidity features.
LIQUIDITY = (
    "eff_spread", "depth_weighted_spread", "amihud_illiq",
    "volume_imbalance_L", "order_count_imbalance_L", "order_size_imbalance_L",
    "large_trade", "hhi_", "dw_imbalance", "cum_imbalance",
    "side_cond_", "spread", "kyle_lambda", "average_trade_size",
    "rolling_volume", "log_volume",
)
#: Beginnings of names, and whole names, of cross-sectional features.
CROSS_STARTS = ("cs_universe_", "cs_class_", "ix_", "corr_", "slope_2s5s_", "slope_5s10s_", "slope_2s10s_", "slope_10s30s_")
CROSS_NAMES = ("synthetic_dxy_logret", "risk_off_score", "butterfly_2s5s10s")


def feature_columns(df: DataFrame, deny: set[str] = NOT_FEATURES | KEYS) -> list[str]:
    """Numeric columns that aren't denied."""
    return [f.name for f in df.schema.fields if f.name not in deny and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")]


def melted(df: DataFrame, features: list[str], target: str, keep: list[str]) -> DataFrame:
    """feature, x, y and the kept columns: one narrow row a feature, so that thousands of features are one aggregation."""
    clean = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double"))
    rows = df.select(*keep, clean(target).alias("y"), *[clean(f).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("x")) for f in features])
    return rows.select(*keep, "y", F.inline(pairs)).where("x is not null and y is not null")


def correlation(x: Column, y: Column, least: int = 100) -> Column:
    """Pearson's correlation from sums; null below `least` rows or without spread."""
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.lit(1)) >= least) & (scale > 0), (F.avg(x * y) - F.avg(x) * F.avg(y)) / F.when(scale > 0, scale))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1; equal values share their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def t_statistic(ic: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(ic) < 1), ic * F.sqrt(F.greatest(n - 2, F.lit(0))) / F.sqrt(F.greatest(1 - ic * ic, F.lit(1e-300))))


def information_coefficients(df: DataFrame, features: list[str], target: str, by: list[str] | None = None, least: int = 100) -> DataFrame:
    """feature, n, ic (Pearson), rank_ic (Spearman) and t statistics of each group."""
    keys = ["feature", *(by or [])]
    rows = melted(df, features, target, by or [])
    ranked = rows.withColumns({"_rx": average_rank("x", keys), "_ry": average_rank("y", keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y"), least).alias("ic"), correlation(F.col("_rx"), F.col("_ry"), least).alias("rank_ic"))
    return out.withColumns({"ic_t": t_statistic(F.col("ic"), F.col("n")), "rank_ic_t": t_statistic(F.col("rank_ic"), F.col("n"))})


def dashboard(df: DataFrame, features: list[str], target: str, year: str = "year", top: int | None = 25, least: int = 100) -> DataFrame:
    """Pooled coefficients beside their mean, deviation, extremes and sign stability over years, best first."""
    pooled = information_coefficients(df, features, target, least=least)
    yearly = information_coefficients(df, features, target, [year], least).where("ic is not null").groupBy("feature").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"), F.count(F.lit(1)).alias("n_years"),
        F.greatest(F.avg((F.col("ic") > 0).cast("double")), F.avg((F.col("ic") < 0).cast("double"))).alias("sign_stability"),
    )
    out = pooled.join(yearly, "feature", "left").withColumn("abs_ic", F.abs("ic"))
    return out.orderBy(F.desc_nulls_last("abs_ic"), "feature").limit(top) if top else out


def hour_residual(df: DataFrame, target: str, hour: str = "hour_et") -> Column:
    """The target less its mean at that hour (over the whole sample)."""
    return F.col(target) - F.avg(target).over(Window.partitionBy(hour))


def linear_residual(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """Adds `residual` of the least-squares fit on the predictors, from one aggregation of products; less the mean where the
    system is singular."""
    import numpy as np

    names = [*predictors, target]
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    sums = df.where(good).agg(*[F.sum(one[i] * one[j]).alias(f"s{i}_{j}") for i in range(len(one)) for j in range(i, len(one))]).first()  # one row
    k = len(one)
    g = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
    try:
        beta = np.linalg.solve(g[:-1, :-1], g[:-1, -1])
    except np.linalg.LinAlgError:
        beta = np.array([g[0, -1] / g[0, 0] if g[0, 0] else 0.0, *[0.0] * len(predictors)])
    fit = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], predictors, strict=True):
        fit = fit + F.lit(float(b)) * F.col(c)
    return df.withColumn("residual", F.when(good, F.col(target) - fit))


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """feature_a, feature_b, corr over rows where both have values, from one aggregation of the pairs."""
    pair = [(x, y) for i, x in enumerate(features) for y in features[i + 1 :]]
    both = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull()
    row = df.agg(*[correlation(F.when(both(x, y), F.col(x).cast("double")), F.when(both(x, y), F.col(y).cast("double")), 2).alias(f"c{i}") for i, (x, y) in enumerate(pair)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (x, y) in enumerate(pair)])))


def greedy_select(scores: DataFrame, corr: DataFrame, most: int, most_corr: float) -> list[str]:
    """Features by score, each taken unless it correlates with one already taken; unknown correlations don't hinder. The driver
    holds the features' names, and of the correlations, which are written once, one taken feature's at a time."""
    order = [r["feature"] for r in scores.where("ic is not null").orderBy(F.desc(F.abs("ic")), "feature").select("feature").collect()]  # a row a feature
    pairs = Written(corr.where(~F.isnan("corr") & (F.abs("corr") >= most_corr)), "correlations")
    barred: set[str] = set()
    taken: list[str] = []
    for f in order:
        if len(taken) >= most:
            break
        if f not in barred:
            taken.append(f)
            other = F.when(F.col("feature_a") == f, F.col("feature_b")).otherwise(F.col("feature_a"))
            barred |= {r["other"] for r in pairs.df.where((F.col("feature_a") == f) | (F.col("feature_b") == f)).select(other.alias("other")).collect()}
    pairs.drop()
    return taken


def walk_forward(n: int, folds: int = 5, embargo: int = 8, purge: int = 8, least_train: int = 5_000, least_fold: int = 100, least_test: int = 50) -> list[tuple[int, int, int, int]]:
    """(train_from, train_to, test_from, test_to) of expanding folds over n rows in order of time; a fold's test rows are as
    many as n / (folds + 1), as far as there are rows. Fewer than `least_fold` such rows are an error; a test of fewer than
    `least_test` rows ends the folds."""
    size = n // (folds + 1)
    if size < least_fold:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    out = []
    for k in range(1, folds + 1):
        train_to, test_from = max(least_train, k * size - purge), k * size + embargo
        test_to = min(test_from + size, n)
        if test_to - test_from < least_test:
            break
        if train_to <= n:
            out.append((0, train_to, test_from, test_to))
    return out


def with_folds(df: DataFrame, order: list[str], by: list[str], folds: int = 5, embargo: int = 8, purge: int = 8, least_train: int = 5_000, least_fold: int = 100, least_test: int = 50) -> DataFrame:
    """Rows of each group numbered in order of time, with the fold they test (-1: none) and the folds they train, by the rule of
    `walk_forward` over each group's own number of rows. Groups with too few rows have no folds; `groups_without_folds` names them."""
    group = Window.partitionBy(*by)
    rows = df.withColumns({"row_no": F.row_number().over(group.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(group)})
    size = F.floor(F.col("_n") / (folds + 1)).cast("int")
    rows = rows.withColumn("_size", F.when(size >= least_fold, size))
    test, train = F.lit(-1), []
    for k in range(folds):
        end = F.col("_size") * (k + 1)
        test_from = end + embargo
        test_to = F.least(test_from + F.col("_size"), F.col("_n"))
        train_to = F.greatest(F.lit(least_train), end - purge)
        valid = (test_to - test_from >= least_test) & (train_to <= F.col("_n"))
        test = F.when(valid & (F.col("row_no") >= test_from) & (F.col("row_no") < test_to), k).otherwise(test)
        train.append(F.when(valid & (F.col("row_no") < train_to), k))
    return rows.withColumns({"test_fold": test, "train_folds": F.filter(F.array(*train), lambda x: x.isNotNull())}).drop("_n", "_size")


def groups_without_folds(folded: DataFrame, by: list[str]) -> DataFrame:
    """Of rows with folds: the groups that have none, with their numbers of rows."""
    some = F.max((F.col("test_fold") >= 0) | (F.size("train_folds") > 0))
    return folded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), some.alias("_some")).where(~F.col("_some")).drop("_some")


def class_metrics(df: DataFrame, label: str, probabilities: dict[int, str], by: list[str] | None = None) -> DataFrame:
    """Log loss, accuracy and balanced accuracy of predicted class probabilities, of each group of `by`. Of equal probabilities the
    first class of `probabilities` is predicted; probabilities count as 1e-12 at least."""
    p = {c: F.least(F.greatest(F.col(x), F.lit(1e-12)), F.lit(1.0)) for c, x in probabilities.items()}
    ranked = [F.struct(F.col(x).alias("p"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, x) in enumerate(probabilities.items())]
    best = F.greatest(*ranked)["c"] if len(ranked) > 1 else F.lit(next(iter(probabilities)))
    hit = (best == F.col(label)).cast("double")
    loss = F.coalesce(*[F.when(F.col(label) == c, -F.ln(x)) for c, x in p.items()])
    recall = [F.avg(F.when(F.col(label) == c, hit)) for c in probabilities]
    present = [F.when(r.isNotNull(), 1).otherwise(0) for r in recall]
    total, n = F.lit(0.0), F.lit(0)
    for r, k in zip(recall, present, strict=True):
        total, n = total + F.coalesce(r, F.lit(0.0)), n + k
    return df.groupBy(*(by or [])).agg(F.avg(loss).alias("log_loss"), F.avg(hit).alias("accuracy"), (total / n).alias("balanced_accuracy"), F.count(F.lit(1)).alias("n"))


def train_classes(rows: DataFrame, features: list[str], label: str = "label", **parameters) -> tuple[boosting.Forest, DataFrame]:
    """The boosted model refitted on all rows (see boosting.train), and the metrics of each fold over the rows that it tests."""
    model, folds = boosting.train(rows, features, label, parameters=boosting.Parameters(**parameters))
    tested = rows.where((F.col("test_fold") >= 0) & boosting.whole(features) & F.col(label).isNotNull())
    if not folds:
        return model, class_metrics(tested.select(F.col("test_fold").alias("fold"), label, *[F.lit(None).cast("double").alias(f"p{k}") for k in range(3)]), label, {c: f"p{k}" for k, c in enumerate(model.classes)}, ["fold"])
    scores = boosting.predict(tested.select(F.col("test_fold").alias("fold"), label, *[f"`{f}`" for f in features]), folds, F.col("fold"))
    metrics = class_metrics(scores, label, {c: f"p{k}" for k, c in enumerate(model.classes)}, ["fold"])
    about = rows.sparkSession.createDataFrame([(f.metadata["fold"], f.metadata["best_iteration"], f.metadata["n_train"]) for f in folds], "fold int, best_iteration int, n_train long")
    return model, metrics.join(F.broadcast(about), "fold").withColumnRenamed("n", "n_val")  # a row a fold


def top_combinations(stats: DataFrame, n: int = 10) -> DataFrame:
    """Label parameters by balance times absolute correlation."""
    return stats.withColumn("score", F.col("balance_score") * F.abs("label_forward_return_corr")).orderBy(F.desc_nulls_last("score"), "k_up", "k_dn", "T", "atr_window").limit(n)


def robustness(stats: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Least and mean of statistics over years."""
    return stats.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("mean", F.avg))])


def is_cross_asset(feature: Column, target: str, instruments: list[str] = ALL_INSTRUMENTS) -> Column:
    """Whether a feature's name is of another instrument or of the cross-section."""
    out = feature.isin(*CROSS_NAMES)
    for start in (*CROSS_STARTS, *(f"{i}_" for i in instruments if i != target)):
        out = out | feature.startswith(start)
    return out


def is_liquidity(feature: Column) -> Column:
    return feature.rlike("|".join(LIQUIDITY))


def liquidity_ranks(scores: DataFrame, value: str = "rank_ic", by: list[str] | None = None) -> DataFrame:
    """Liquidity features with their rank among all features of a score, by its size; scores have a row a feature (of `by`)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(F.abs(value)), "feature")
    return scores.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("rank", F.row_number().over(w)).where(is_liquidity(F.col("feature")))


def consistency(scores: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Of scores (target, feature, ic): features among the best of every target with one sign, and overlaps of targets."""
    w = Window.partitionBy("target").orderBy(F.desc_nulls_last(F.abs("ic")), "feature")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    n = scores.select("target").distinct()
    every = best.groupBy("feature").agg(F.count(F.lit(1)).alias("n_targets"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max")).crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("_all"))))  # with one row
    stable = every.where("n_targets = _all").select("feature", "n_targets", "ic_min", "ic_max", (F.signum("ic_min") == F.signum("ic_max")).alias("sign_stable"))
    overlap = best.select(F.col("target").alias("target_a"), "feature").join(best.select(F.col("target").alias("target_b"), "feature"), "feature").groupBy("target_a", "target_b").agg(F.count(F.lit(1)).alias("overlap"))
    return stable, overlap


def rank_correlation(scores: DataFrame) -> DataFrame:
    """Of scores (target, feature, ic): Spearman's correlation of the targets' orders of features by size of score, over features that every
    target has a score of. A row a pair of targets."""
    sized = scores.where(F.col("ic").isNotNull() & ~F.isnan("ic")).select("target", "feature", F.abs("ic").alias("_x"))
    n = scores.select("target").distinct().agg(F.count(F.lit(1)).alias("_all"))
    common = sized.groupBy("feature").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select("feature")  # n has one row
    ranked = sized.join(common, "feature").withColumn("_rank", average_rank("_x", ["target"]))
    pairs = ranked.select(F.col("target").alias("target_a"), "feature", F.col("_rank").alias("_a")).join(ranked.select(F.col("target").alias("target_b"), "feature", F.col("_rank").alias("_b")), "feature")
    return pairs.groupBy("target_a", "target_b").agg(correlation(F.col("_a"), F.col("_b"), 2).alias("rho"), F.count(F.lit(1)).alias("n"))
