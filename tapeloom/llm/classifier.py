"""Quality classifier: naive Bayes support vectors over indicators of n-grams.

Indicators: words (lower case), word pairs, the shapes of words (letters, digits and symbols by kind, runs cut short) and
pairs of shapes, and that a word stands twice or three times in a row. Each indicator is scaled by its class log-count ratio; a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent; a logistic curve over the margins, fitted
on labelled rows that the hinge model didn't see, makes them scores from 0 to 1.

Fitting takes at most about `most_rows` labelled rows (4,000) of at most about `most_bytes` of text (200 MB), chosen by a hash of
doc_id, never those held out (crc32 of doc_id as text, mod 3, is 1). Labels, lang, source and doc_id are no inputs of a score.
Every document is scored over its whole text, however long. Null and empty texts have no indicator and get the curve's value at
the intercept. Labels with no matching document, null labels and labels that contradict each other are left out; with labels of
one class or none, every score is the share of class 1 (0.5 without labels). Ties: a score of 0.5 is predicted 1. Null doc_ids have
no label and aren't held out. Repeated documents are scored each. Empty tables give empty results. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, chunked

MOST_ROWS, MOST_TEXT_BYTES, MIN_DOCUMENTS = 4_000, 200_000_000, 3
#: Fixed values of the fit: cost, passes over the rows, smoothing of counts, part of the rows kept for the curve.
COST, PASSES, SMOOTHING, CURVE_PART = 1.0, 30, 1.0, 4
_KINDS = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][^\W\d_]*(?<=[A-ZÀ-ÖØ-Þ])"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


class Shapes(dict):
    """The shapes of words; emptied when it holds many."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        if word.isalpha():
            shape = "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
        else:
            shape = word
            for pattern, to in _KINDS:
                shape = pattern.sub(to, shape)
            shape = shape[:12]
        self[word] = shape
        return shape


def indicators(text: str | None, shapes: Shapes) -> set:
    """The distinct n-gram indicators of a whole text."""
    if not text:
        return set()
    raw = text.split()
    words = text.lower().split()
    kinds = [shapes[w] for w in raw]
    found: set = set(words)
    found.update(zip(words, words[1:]))
    found.update(("#", s) for s in set(kinds))
    found.update(("#", *p) for p in set(zip(kinds, kinds[1:])))
    if any(a == b for a, b in zip(words, words[1:])):
        found.add(("=",))
    if any(a == b == c for a, b, c in zip(words, words[1:], words[2:])):
        found.add(("=", "="))
    return found


@dataclass
class Model:
    """Weights of indicators and the curve's slope and shift."""

    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def score(self, found: set) -> float:
        get = self.weights.get
        margin = self.bias + sum([get(x, 0.0) for x in found])
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine over sparse rows (columns, values); the last weight is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for _, v in rows]) if rows else np.zeros(0)
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            columns, values = rows[i]
            gradient = y[i] * (w[columns] @ values + w[-1]) - 1
            step = min(max(alpha[i] - gradient / square[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[columns] += step * y[i] * values
                w[-1] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w


def curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins, with Platt's softened targets; Newton's method."""
    positive, n = int((y > 0).sum()), len(y)
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(n)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - target) + np.array([1e-6 * (a - 1), 0]))
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def fit(texts: list[str], labels: list[int], min_documents: int = MIN_DOCUMENTS) -> Model:
    """A model from labelled texts."""
    y = np.where(np.array(labels, dtype=np.int64) == 1, 1, -1)
    if len(set(y.tolist())) < 2 or len(y) < 2 * CURVE_PART:
        share = min(0.99, max(0.01, float((y > 0).mean()))) if len(y) else 0.5
        return Model(shift=float(np.log(share / (1 - share))))
    shapes = Shapes()
    found = [indicators(t, shapes) for t in texts]
    rows_of = Counter(x for f in found for x in f)
    number = {x: i for i, x in enumerate(sorted((x for x, n in rows_of.items() if n >= min_documents), key=repr))}
    columns = [np.array(sorted(number[x] for x in f if x in number), np.int64) for f in found]

    def ratios(of: list[int]) -> np.ndarray:
        up, down = np.full(len(number), SMOOTHING), np.full(len(number), SMOOTHING)
        for i in of:
            (up if y[i] > 0 else down)[columns[i]] += 1
        return np.log((up / up.sum()) / (down / down.sum()))

    def weights(of: list[int]) -> np.ndarray:
        r = ratios(of)
        scale = 1 / max(1e-9, float(np.sqrt(np.mean([r[columns[i]] @ r[columns[i]] for i in of]))))
        w = dual_coordinate_descent([(columns[i], scale * r[columns[i]]) for i in of], y[of], len(number))
        return np.append(w[:-1] * r * scale, w[-1])

    w = weights([i for i in range(len(y)) if i % CURVE_PART])
    rest = [i for i in range(len(y)) if i % CURVE_PART == 0]
    slope, shift = curve(np.array([w[-1] + w[columns[i]].sum() for i in rest]), y[rest])
    return Model({x: float(w[i]) for x, i in number.items() if w[i]}, float(w[-1]), slope, shift)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_TEXT_BYTES) -> DataFrame:
    """text and quality of at most about `most_rows` labelled documents of `most_bytes` that aren't held out, chosen by a hash of doc_id."""
    one = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    one = one.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    n = one.count()
    share = min(1.0, most_rows / max(1, n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def chosen(share: float) -> DataFrame:
        few = one.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * share)) if share < 1 else one
        return texts.join(F.broadcast(few), "doc_id").select("doc_id", "text", "quality")  # at most about most_rows ids, by share

    size = chosen(share).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return chosen(share * min(1.0, most_bytes / max(1, size)))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_TEXT_BYTES) -> Model:
    """Fits a model on the sample, in the order of doc_id and text."""
    bounded_batches(docs.sparkSession)
    rows = sorted(labelled_sample(docs, labels, most_rows, most_bytes).toLocalIterator(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] or "" for r in rows], [r["quality"] for r in rows])


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the fitting sample allows

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, fitted = Shapes(), shared.value

        def rows():
            for doc_id, out, text in arrow_rows(batches):
                value = fitted.score(indicators(text, shapes))
                yield doc_id, out, value, int(value >= 0.5)

        yield from chunked(rows(), _SCORES, 5_000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
