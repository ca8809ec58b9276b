"""Gradient-boosted trees for a few classes, grown from histograms that Spark adds up; walk-forward validation, early stop, refit.

Features are cut into quantile bins once. A round grows one tree a class, level by level: each task sums gradients and curvatures of
its rows by (model, node, feature, bin), a shuffle by (model, node, feature) adds the tasks' sums, running sums over the bins give
each split's gain, and the driver gets the best split of each node, a row a node. All folds grow at once as models of one pass, so a
round takes as many passes as trees have levels, and one more for the losses of the rows under test, whatever the number of folds.
The rows' scores are written every `refresh` rounds; between, the few trees since then are applied again.

Leaves are Newton steps. Scores start from the logarithms of the classes' shares. Ties of gain go to the smaller feature number, then the
smaller bin. Rows with a null, NaN or infinite feature are left out, in training and under test; their predictions are null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Written


@dataclass(frozen=True)
class Parameters:
    """How trees are grown. At most 2 ** depth leaves; leaves hold least_rows rows of a bag and least_curvature at least."""

    rounds: int = 500
    patience: int = 30
    depth: int = 5
    rate: float = 0.05
    bins: int = 63
    feature_share: float = 0.9
    bag_share: float = 0.8
    bag_rounds: int = 5
    least_rows: int = 20
    least_curvature: float = 1e-3
    ridge: float = 0.0
    seed: int = 42
    refresh: int = 10


@dataclass
class Forest:
    """Trees of rounds x classes as arrays over heap-numbered nodes (root 1, children 2i and 2i + 1)."""

    features: list[str]
    classes: list[int]
    edges: list[list[float]]
    start: list[float]
    split_feature: np.ndarray  # rounds x classes x nodes; -1: no split
    split_bin: np.ndarray
    value: np.ndarray
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        raw = json.loads(text)
        return cls(**raw | {"split_feature": np.array(raw["split_feature"], np.int32), "split_bin": np.array(raw["split_bin"], np.int32), "value": np.array(raw["value"], np.float64)})


def leaves(x: np.ndarray, split_feature: np.ndarray, split_bin: np.ndarray) -> np.ndarray:
    """The node of one tree where each row of binned features ends."""
    node, rows = np.ones(len(x), np.int64), np.arange(len(x))
    while True:
        f = split_feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = x[rows, np.maximum(f, 0)] > split_bin[node]
        node = np.where(inner, 2 * node + right, node)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def slopes(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the log loss by class; a class's curvature counts k / (k - 1) times, as its tree moves it alone."""
    k = p.shape[-1]
    return p - (y[:, None] == np.arange(k)), k / (k - 1) * p * (1 - p)


def whole(features: list[str]) -> Column:
    """Rows whose features are all numbers."""
    out = F.lit(True)
    for f in features:
        x = F.col(f"`{f}`").cast("double")
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper edges of the bins of each feature but the last, at approximate quantiles; one aggregation."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))]


_PACKED = "bins binary, y int, bag long, train array<int>, test int, scores binary"


def _packed(rows: DataFrame, features: list[str], edges: list[list[float]], start: np.ndarray) -> DataFrame:
    """Rows with one byte a feature and the scores of each model: doubles, models x classes."""
    raw = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    cut = [np.array(e, float) for e in edges]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.searchsorted(cut[i], batch.column(f"x{i}").to_numpy(), "left") for i in range(len(cut))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *[batch.column(c) for c in ("y", "bag", "train", "test")], pa.array([start.tobytes()] * len(x), pa.binary())], ["bins", "y", "bag", "train", "test", "scores"])

    return rows.select(*raw, "y", "bag", "train", "test").mapInArrow(packed, _PACKED)


class _Rows:
    """A batch of packed rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, n_features: int, shape: tuple[int, int]):
        n = batch.num_rows
        self.x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, n_features)
        self.scores = np.frombuffer(b"".join(batch.column("scores").to_pylist()), np.float64).reshape(n, *shape).copy()
        self.y, self.bag, self.test = (batch.column(c).to_numpy() for c in ("y", "bag", "test"))
        train = batch.column("train")
        self.train = np.zeros((n, shape[0]), bool)
        owner = np.repeat(np.arange(n), np.diff(train.offsets.to_numpy()))
        self.train[owner, train.flatten().to_numpy()] = True

    def add(self, trees: list[tuple]) -> None:
        """Adds finished rounds of trees to the scores."""
        for split_feature, split_bin, value in trees:
            for m in range(self.scores.shape[1]):
                for k in range(self.scores.shape[2]):
                    self.scores[:, m, k] += value[m, k][leaves(self.x, split_feature[m, k], split_bin[m, k])]


_HISTOGRAM = "model int, node int, feature int, bin int, g double, h double, n long"
_HISTOGRAM_ARROW = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])


def histograms(table: DataFrame, n_features: int, shape: tuple[int, int], pending: list[tuple], grown: tuple, level: int, growing: list[int], bins: int, bag: tuple[int, float, int]) -> DataFrame:
    """Sums of gradients and curvatures and counts by (model, node of the level, feature, bin), a row a task and key. A model is
    fold x classes + class. A task holds models x nodes x features x bins sums."""
    shared = table.sparkSession.sparkContext.broadcast((pending, grown))  # trees of a few rounds
    size, wide = 1 << level, shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier, (split_feature, split_bin) = shared.value
        sums = np.zeros((shape[0] * wide, size * n_features * bins, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, n_features, shape)
            rows.add(earlier)
            drawn = in_bag(rows.bag, *bag)
            for m in growing:
                here = rows.train[:, m] & drawn
                x, y = rows.x[here], rows.y[here]
                g, h = slopes(softmax(rows.scores[here, m]), y)
                for k in range(wide):
                    node = leaves(x, split_feature[m, k], split_bin[m, k]) - size
                    live = node >= 0  # others ended in a leaf above this level
                    at = ((node[live] * n_features)[:, None] + np.arange(n_features)) * bins + x[live]
                    for c, w in enumerate((g[live, k], h[live, k], None)):
                        sums[m * wide + k, :, c] += np.bincount(at.ravel(), None if w is None else np.repeat(w, n_features), size * n_features * bins)
        model, at = np.nonzero(sums[:, :, 2])
        found = sums[model, at]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in ((model, pa.int32()), (at // (n_features * bins) + size, pa.int32()), (at // bins % n_features, pa.int32()), (at % bins, pa.int32()), (found[:, 0], pa.float64()), (found[:, 1], pa.float64()), (found[:, 2].astype(np.int64), pa.int64()))], schema=_HISTOGRAM_ARROW)

    return table.mapInArrow(summed, _HISTOGRAM)


def in_bag(bag: np.ndarray, draw: int, share: float, seed: int) -> np.ndarray:
    """Which rows a bag holds, by their hash and the bag's number."""
    with np.errstate(over="ignore"):
        x = bag.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + draw * 0xBF58476D1CE4E5B9) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) < share


def split_gains(sums: DataFrame, least_rows: int, least_curvature: float, ridge: float) -> DataFrame:
    """Each (model, node, feature, bin): sums up to the bin (gl, hl, nl), of the node (g_all, h_all, n_all), and the gain of parting
    the node there, null where a side is too small.

    One shuffle: the tasks' sums are added and run up within (model, node, feature).
    """
    keys = ["model", "node", "feature"]
    added = sums.repartition(*keys).groupBy(*keys, "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = added.select(*keys, "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{c}_all") for c in "ghn"])
    right = {c: F.col(f"{c}_all") - F.col(f"{c}l") for c in "ghn"}
    fits = (F.col("nl") >= least_rows) & (right["n"] >= least_rows) & (F.col("hl") >= least_curvature) & (right["h"] >= least_curvature)
    part = lambda g, h: g * g / (h + ridge)
    return run.withColumn("gain", F.when(fits, part(F.col("gl"), F.col("hl")) + part(right["g"], right["h"]) - part(F.col("g_all"), F.col("h_all"))))


def best_splits(gains: DataFrame, allowed: dict[int, list[int]] | None = None) -> DataFrame:
    """The split of the greatest gain of each node, with the sums of both sides; nulls where no split gains. Totals come from the node's
    first feature, as all features have the same."""
    if allowed is not None:
        pairs = F.array(*[F.lit(m * 100_000 + f) for m, fs in allowed.items() for f in fs])
        gains = gains.withColumn("gain", F.when(F.array_contains(pairs, F.col("model") * 100_000 + F.col("feature")), F.col("gain")))
    won = F.when(F.col("gain") > 1e-12, F.struct(F.col("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("gl"), F.col("hl"), F.col("nl")))
    total = F.min(F.struct("feature", "g_all", "h_all", "n_all"))
    return gains.groupBy("model", "node").agg(F.max(won).alias("best"), total.alias("total"))


@dataclass
class _Grown:
    """What `grow` made: trees by round (models x classes x nodes), losses by model and round, rounds of the least loss."""

    trees: list[tuple]
    losses: np.ndarray
    best: list[int]


def _losses(table: DataFrame, n_features: int, shape: tuple[int, int], pending: list[tuple]) -> np.ndarray:
    """Mean log loss of each model over the rows that it tests."""
    shared = table.sparkSession.sparkContext.broadcast(pending)
    schema = pa.schema([("model", pa.int32()), ("loss", pa.float64()), ("n", pa.int64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n = np.zeros(shape[0]), np.zeros(shape[0], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, n_features, shape)
            rows.add(shared.value)
            for m in range(shape[0]):
                here = rows.test == m
                p = softmax(rows.scores[here, m])
                loss[m] -= np.log(np.maximum(p[np.arange(len(p)), rows.y[here]], 1e-15)).sum()
                n[m] += here.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0]), pa.int32()), pa.array(loss), pa.array(n)], schema=schema)

    out = np.full(shape[0], np.nan)
    for r in table.where("test >= 0").mapInArrow(summed, "model int, loss double, n long").groupBy("model").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect():  # a row a fold
        if r["n"]:
            out[r["model"]] = r["loss"] / r["n"]
    return out


def _with_scores(table: DataFrame, n_features: int, shape: tuple[int, int], trees: list[tuple]) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(trees)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _Rows(batch, n_features, shape)
                rows.add(shared.value)
                yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.array([s.tobytes() for s in rows.scores], pa.binary()))

    return table.mapInArrow(added, _PACKED)


def grow(table: DataFrame, n_features: int, shape: tuple[int, int], bins: int, parameters: Parameters, rounds: int, stop_early: bool) -> _Grown:
    """Rounds of trees for all models of packed rows; a model ends `patience` rounds after its least loss."""
    p, nodes = parameters, 2 << parameters.depth
    draw = np.random.default_rng(p.seed)
    trees: list[tuple] = []
    pending: list[tuple] = []
    losses, growing, held = [], list(range(shape[0])), None
    for at in range(rounds):
        split_feature, split_bin = np.full((*shape, nodes), -1, np.int32), np.zeros((*shape, nodes), np.int32)
        value = np.zeros((*shape, nodes))
        n_used = max(1, round(p.feature_share * n_features))
        allowed = {m * shape[1] + k: sorted(draw.permutation(n_features)[:n_used].tolist()) for m in range(shape[0]) for k in range(shape[1])}
        for level in range(p.depth):
            sums = histograms(table, n_features, shape, pending, (split_feature, split_bin), level, growing, bins, (at // p.bag_rounds, p.bag_share, p.seed))
            found = best_splits(split_gains(sums, p.least_rows, p.least_curvature, p.ridge), allowed if n_used < n_features else None).collect()  # a row a node
            for r in found:
                m, k = divmod(r["model"], shape[1])
                node, best, total = r["node"], r["best"], r["total"]
                step = lambda g, h: -p.rate * g / (h + p.ridge) if h + p.ridge > 0 else 0.0
                value[m, k, node] = step(total["g_all"], total["h_all"])
                if best is not None:
                    split_feature[m, k, node], split_bin[m, k, node] = -best["f"], -best["b"]
                    value[m, k, 2 * node] = step(best["gl"], best["hl"])
                    value[m, k, 2 * node + 1] = step(total["g_all"] - best["gl"], total["h_all"] - best["hl"])
            if not any(r["best"] is not None for r in found):
                break
        pending.append((split_feature, split_bin, value))
        trees.append(pending[-1])
        if stop_early:
            losses.append(_losses(table, n_features, shape, pending))
            tested = np.array(losses)
            growing = [m for m in growing if np.isfinite(tested[-1, m]) and at - int(np.argmin(tested[:, m])) < p.patience]
            if not growing:
                break
        if len(pending) >= p.refresh:
            fresh = Written(_with_scores(table, n_features, shape, pending), "scores")
            if held:
                held.drop()
            table, held, pending = fresh.df, fresh, []
    if held:
        held.drop()
    tested = np.array(losses) if losses else np.full((0, shape[0]), np.nan)
    return _Grown(trees, tested, [int(np.argmin(tested[:, m])) + 1 if len(tested) and np.isfinite(tested[:, m]).any() else 0 for m in range(shape[0])])


def train(rows: DataFrame, features: list[str], label: str = "label", classes: tuple[int, ...] = (-1, 0, 1), key: list[str] | None = None, parameters: Parameters = Parameters()) -> tuple[Forest, list[Forest]]:
    """The model refitted on all rows, with as many rounds as the folds' best ones on average, and the folds' models.

    rows have `test_fold` and `train_folds` (see scoring.with_folds); `key` names the columns that identify a row, by default all
    features and the label: bags are drawn by its hash. Without a fold that tests anything, the refit takes all rounds. The refit's
    metadata hold the parameters, the features, the rows and what each fold gave.
    """
    p, wide = parameters, len(classes)
    if not 2 <= p.bins <= 256:
        raise ValueError("a bin's number is one byte")
    good = rows.where(whole(features) & F.col(label).isin(*classes))
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    kept = good.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], number.alias("y"), F.xxhash64(*(key or [*features, label])).alias("bag"), F.col("train_folds").cast("array<int>").alias("train"), F.col("test_fold").cast("int").alias("test"))
    source = Written(kept, "training")
    names = [f"x{i}" for i in range(len(features))]
    last_fold = source.df.agg(F.max(F.greatest("test", F.coalesce(F.array_max("train"), F.lit(-1))))).first()[0]
    n_folds = 0 if last_fold is None else last_fold + 1
    counts = {(r["fold"], r["y"]): r["n"] for r in source.df.select(F.explode(F.array_union("train", F.array(F.lit(-1)))).alias("fold"), "y").groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds x classes
    tested = {r["test"]: r["n"] for r in source.df.where("test >= 0").groupBy("test").agg(F.count(F.lit(1)).alias("n")).collect()}
    edges = quantile_edges(source.df, names, p.bins)

    def prior(fold: int) -> list[float]:
        n = [counts.get((fold, k), 0) for k in range(wide)]
        return [math.log(max(x / max(1, sum(n)), 1e-15)) for x in n]

    def forest(start: list[float], trees: list[tuple], m: int, metadata: dict) -> Forest:
        take = lambda i: np.array([t[i][m] for t in trees]) if trees else np.zeros((0, wide, 2 << p.depth), (np.int32, np.int32, np.float64)[i])
        return Forest(list(features), list(classes), edges, start, take(0), take(1), take(2), metadata)

    starts, folds = [prior(m) for m in range(n_folds)], []
    if n_folds:
        table = Written(_packed(source.df, names, edges, np.array(starts)), "packed")
        grown = grow(table.df, len(features), (n_folds, wide), p.bins, p, p.rounds, True)
        table.drop()
    for m in range(n_folds):
        about = {"fold": m, "best_iteration": grown.best[m], "n_train": sum(counts.get((m, k), 0) for k in range(wide)), "n_val": tested.get(m, 0), "losses": [float(x) for x in grown.losses[: grown.best[m], m]]}
        folds.append(forest(starts[m], grown.trees[: grown.best[m]], m, about))
    best = [f.metadata["best_iteration"] for f in folds if f.metadata["n_val"]]
    rounds = int(np.mean(best)) if best else p.rounds
    start = prior(-1)
    every = source.df.withColumns({"train": F.array(F.lit(0)), "test": F.lit(-1)})
    table = Written(_packed(every, names, edges, np.array([start])), "packed")
    final = grow(table.df, len(features), (1, wide), p.bins, p, rounds, False)
    table.drop()
    source.drop()
    about = {"n_features": len(features), "feature_names": list(features), "n_rows_full": sum(counts.get((-1, k), 0) for k in range(wide)), "params": asdict(p), "n_folds": n_folds, "fold_metrics": [f.metadata for f in folds], "final_num_boost_round": rounds}
    return forest(start, final.trees, 0, about), folds


def first_split_gains(rows: DataFrame, edges: dict[str, list[float]], label: str, classes: tuple[int, ...], least_rows: int, least_curvature: float, ridge: float = 0.0) -> DataFrame:
    """Gains of all splits of the first trees' roots at given edges: model (the class's number), node 1, feature, bin and sums."""
    features = list(edges)
    good = rows.where(whole(features) & F.col(label).isin(*classes))
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    source = Written(good.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], number.alias("y"), F.lit(0).cast("long").alias("bag"), F.array(F.lit(0)).alias("train"), F.lit(-1).alias("test")), "training").df
    n = {r["y"]: r["n"] for r in source.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    start = np.array([[math.log(max(n.get(k, 0) / max(1, sum(n.values())), 1e-15)) for k in range(len(classes))]])
    packed = _packed(source, [f"x{i}" for i in range(len(features))], list(edges.values()), start)
    no_tree = np.full((1, len(classes), 2), -1, np.int32)
    sums = histograms(packed, len(features), (1, len(classes)), [], (no_tree, no_tree), 0, [0], max(map(len, edges.values())) + 1, (0, 1.0, 0))
    return split_gains(sums, least_rows, least_curvature, ridge)


def predict(rows: DataFrame, models: list[Forest], which: Column | None = None, prefix: str = "p") -> DataFrame:
    """rows with a probability of each class ({prefix}0, {prefix}1, ...) by the model whose number `which` gives (the first by default);
    null where a feature isn't a number or no model has that number."""
    first = models[0]
    shared = rows.sparkSession.sparkContext.broadcast(models)
    cut = [np.array(e, float) for e in first.edges]
    wide = len(first.classes)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(cut))], axis=1).reshape(n, len(cut))
            number = batch.column("_which").fill_null(-1).to_numpy(zero_copy_only=False)
            out, fine = np.full((n, wide), np.nan), np.isfinite(raw).all(axis=1)
            x = np.stack([np.searchsorted(c, raw[:, i], "left") for i, c in enumerate(cut)], axis=1)
            for m, model in enumerate(shared.value):
                here = fine & (number == m)
                if here.any():
                    scores = np.tile(np.array(model.start), (int(here.sum()), 1))
                    for t in range(len(model.value)):
                        for k in range(wide):
                            scores[:, k] += model.value[t, k][leaves(x[here], model.split_feature[t, k], model.split_bin[t, k])]
                    out[here] = softmax(scores)
            kept = batch.select([c for c in batch.schema.names if not c.startswith("_x") and c != "_which"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(out[:, k], mask=np.isnan(out[:, k])) for k in range(wide)]], [*kept.schema.names, *[f"{prefix}{k}" for k in range(wide)]])

    number = F.lit(0) if which is None else which.cast("int")
    given = rows.select("*", *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(first.features)], number.alias("_which"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], *[f"`{prefix}{k}` double" for k in range(wide)]])
    return given.mapInArrow(worked, schema)
