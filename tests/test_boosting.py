"""Boosted trees against a plain loop over the same bins; folds, early stop, refit, metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import boosting, scoring


def table(spark, n=400, seed=3, noise=0.3):
    draw = np.random.default_rng(seed)
    a, b, c = draw.normal(size=n), draw.integers(0, 6, n).astype(float), draw.normal(size=n)
    label = np.where(a + noise * draw.normal(size=n) > 0.5, 1, np.where(b > 3, -1, 0))
    rows = [(0, i, int(y), float(x), float(z), float(w)) for i, (y, x, z, w) in enumerate(zip(label, a, b, c, strict=True))]
    return spark.createDataFrame(rows, "instr int, ts int, label int, a double, b double, c double").repartition(5)


def plain_boost(x, y, rounds, p):
    """x: binned rows. Trees as nested dicts of one fold, by exhaustive search."""
    n, wide = len(x), 3
    start = [math.log(np.mean(y == k)) for k in range(wide)]
    scores, forest = np.tile(start, (n, 1)), []
    for _ in range(rounds):
        prob = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        trees = []
        for k in range(wide):
            g, h = prob[:, k] - (y == k), 1.5 * prob[:, k] * (1 - prob[:, k])

            def split(of, node, depth, tree):
                tree[node] = (-1, 0, -p.rate * g[of].sum() / h[of].sum())
                best = None
                for f in range(x.shape[1]):
                    for b in range(p.bins):
                        left = of[x[of, f] <= b]
                        right = of[x[of, f] > b]
                        if min(len(left), len(right)) < p.least_rows:
                            continue
                        gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) - g[of].sum() ** 2 / h[of].sum()
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, b, left, right)
                if best and depth < p.depth:
                    tree[node] = (best[1], best[2], tree[node][2])
                    split(best[3], 2 * node, depth + 1, tree)
                    split(best[4], 2 * node + 1, depth + 1, tree)

            tree = {}
            split(np.arange(n), 1, 0, tree)
            trees.append(tree)
        for k, tree in enumerate(trees):
            for i in range(n):
                node = 1
                while tree[node][0] >= 0:
                    node = 2 * node + (x[i, tree[node][0]] > tree[node][1])
                scores[i, k] += tree[node][2]
        forest.append(trees)
    return start, forest, scores


def test_trees_equal_a_plain_loop(spark):
    p = boosting.Parameters(rounds=3, depth=2, bins=8, rate=0.3, bag_share=1.0, feature_share=1.0, least_rows=15, refresh=2)
    rows = table(spark).withColumns({"test_fold": F.lit(-1), "train_folds": F.array().cast("array<int>")})
    model, folds = boosting.train(rows, ["a", "b", "c"], key=["ts"], parameters=p)
    assert folds == [] and model.metadata["final_num_boost_round"] == 3 and model.metadata["n_rows_full"] == 400
    local = sorted(rows.collect(), key=lambda r: r.ts)
    x = np.stack([np.searchsorted(model.edges[i], [r[f] for r in local], "left") for i, f in enumerate("abc")], axis=1)
    start, forest, scores = plain_boost(x, np.array([r.label + 1 for r in local]), 3, p)
    assert np.allclose(model.start, start)
    for t, trees in enumerate(forest):
        for k, tree in enumerate(trees):
            assert {i for i in range(8) if model.split_feature[t, k, i] >= 0} == {i for i, s in tree.items() if s[0] >= 0}
            for node, (f, b, value) in tree.items():
                assert model.split_feature[t, k, node] == f and (f < 0 or model.split_bin[t, k, node] == b)
                assert math.isclose(model.value[t, k, node], value, rel_tol=1e-9, abs_tol=1e-12)
    got = {r.ts: (r.p0, r.p1, r.p2) for r in boosting.predict(rows, [boosting.Forest.from_json(model.to_json())]).collect()}
    want = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    assert all(np.allclose(got[r.ts], want[i]) for i, r in enumerate(local))


def test_folds_stop_early_and_the_refit_takes_their_mean(spark):
    rows = scoring.with_folds(table(spark, 700, noise=1.5), ["ts"], ["instr"], 3, 5, 5, 50, 50, 20)
    model, metrics = scoring.train_classes(rows, ["a", "b", "c"], rounds=12, patience=2, depth=2, bins=16, rate=0.5, least_rows=5)
    out = {r.fold: r for r in metrics.collect()}
    assert sorted(out) == [0, 1, 2] and all(0 < r.accuracy <= 1 and r.log_loss > 0 for r in out.values())
    assert model.metadata["final_num_boost_round"] == int(np.mean([out[f].best_iteration for f in out])) == len(model.value)
    for f in model.metadata["fold_metrics"]:
        assert f["best_iteration"] == len(f["losses"]) and min(f["losses"]) == f["losses"][-1]
        assert math.isclose(f["losses"][-1], out[f["fold"]].log_loss, rel_tol=1e-9) and f["n_val"] == out[f["fold"]].n_val
        assert f["n_train"] == rows.where(F.array_contains("train_folds", f["fold"])).count() == out[f["fold"]].n_train
    assert any(f["best_iteration"] < 12 for f in model.metadata["fold_metrics"])


def test_rows_without_numbers_are_left_out(spark):
    bad = spark.createDataFrame([(0, 9_000, 1, None, 1.0, 1.0), (0, 9_001, 1, float("nan"), 1.0, 1.0), (0, 9_002, 1, float("inf"), 1.0, 1.0), (0, 9_003, None, 1.0, 1.0, 1.0)], "instr int, ts int, label int, a double, b double, c double")
    rows = table(spark).unionByName(bad).withColumns({"test_fold": F.lit(-1), "train_folds": F.array().cast("array<int>")})
    model, _ = boosting.train(rows, ["a", "b", "c"], parameters=boosting.Parameters(rounds=1, depth=1, bins=4))
    assert model.metadata["n_rows_full"] == 400
    assert {r.ts: r.p0 is None for r in boosting.predict(rows.where("ts >= 9000"), [model]).collect()} == {9_000: True, 9_001: True, 9_002: True, 9_003: False}
    empty, _ = boosting.train(rows.limit(0), ["a"], parameters=boosting.Parameters(rounds=1, depth=1, bins=4))
    assert len(empty.value) == 1 and not empty.value.any()


def test_bags_hold_their_share():
    drawn = np.stack([boosting.in_bag(np.arange(20_000), k, 0.8, 42) for k in range(3)])
    assert np.allclose(drawn.mean(axis=1), 0.8, atol=0.02) and not (drawn[0] == drawn[1]).all()


def test_short_groups_have_no_folds(spark):
    rows = spark.range(300).select((F.when(F.col("id") < 290, 1).otherwise(2)).alias("instr"), F.col("id").alias("ts"))
    folded = scoring.with_folds(rows, ["ts"], ["instr"], 3, 4, 4, 20, 20, 10)
    assert folded.where("instr = 2").agg(F.max("test_fold"), F.max(F.size("train_folds"))).first() == (-1, 0)
    assert folded.where("instr = 1").agg(F.max("test_fold")).first()[0] == 2
    assert scoring.groups_without_folds(folded, ["instr"]).collect() == [(2, 10)]


@pytest.mark.parametrize("probs, best", [((0.4, 0.4, 0.2), -1), ((0.2, 0.4, 0.4), 0), ((0.0, 0.0, 1.0), 1)])
def test_ties_predict_the_first_class(spark, probs, best):
    row = spark.createDataFrame([(best, *probs)], "label int, pm double, p0 double, p1 double")
    assert scoring.class_metrics(row, "label", {-1: "pm", 0: "p0", 1: "p1"}).first().accuracy == 1.0


def test_a_probability_of_zero_costs_its_clip(spark):
    row = spark.createDataFrame([(-1, 0.0, 0.5, 0.5)], "label int, pm double, p0 double, p1 double")
    assert math.isclose(scoring.class_metrics(row, "label", {-1: "pm", 0: "p0", 1: "p1"}).first().log_loss, -math.log(1e-12), rel_tol=1e-9)
