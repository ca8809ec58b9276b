"""Resampling towards a target distribution by hashed n-grams, with counts from an external sort.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Features are the runs of one to three words; a
feature's bucket is its CRC-32 modulo `buckets`. One pass over the texts writes streams: packed uint16 buckets of many documents
behind each other, with each document's place in them. Counts come from these alone: a task sorts one stream after the other and
adds up its run lengths, and Spark adds up the tasks' at most `buckets` sums. Log-ratio gains of target against corpus (one number a
bucket, broadcast) are then gathered along the streams and added between document starts by np.add.reduceat. A document's score
is its weight plus a Gumbel draw from its doc_id, so the highest scores are a draw without replacement. The order of all scores is
a range shuffle of narrow rows that are numbered within their partitions.

Null texts have no words; documents without features have weight 0. Documents of fewer than `least_words` words are never drawn.
Ties of score go to the smaller doc_id, then to fewer features; null doc_ids come first and draw as an empty one. Repeated rows are scored
each and may be drawn each. Very long texts are one document of one stream. Without documents the result is empty; without target
texts all gains follow from zero counts. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, written
from .sharding import numbered

#: Parameters of the draw: buckets (65,536 at most, as streams hold uint16), per cent drawn, words that a drawn document has at least, seed.
BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 5, 20, 42
#: Features and documents that close a stream.
STREAM_FEATURES, STREAM_DOCUMENTS = 1 << 20, 4_000

#: Lower case of A-Z; blanks for all other ASCII but digits and letters.
_FOLD = bytes(c if chr(c).isalnum() else 32 for c in range(128)).lower() + bytes(range(128, 256))
_STREAMS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("stream", pa.binary())])


def bucket_stream(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all features of a text: of its words, then of its pairs, then of its triples."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    crc, after = zlib.crc32, [b" " + w for w in words[1:]]
    ones = [crc(w) for w in words]
    twos = [crc(w, c) for w, c in zip(after, ones)]  # a run's checksum goes on from that of the run before
    threes = [crc(w, c) for w, c in zip(after[1:], twos)]
    return (np.array(ones + twos + threes, np.uint32) % np.uint32(buckets)).astype("<u2")


def features_of(words: int) -> int:
    """How many features a text of so many words has."""
    return words + max(words - 1, 0) + max(words - 2, 0)


def write_streams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A written table of bucket streams: doc_ids, starts (of each document in the stream) and stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed as uint16")
    bounded_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, parts, held = [], [], [], 0
        for doc_id, text in arrow_rows(batches):
            part = bucket_stream(text, buckets)
            ids.append(doc_id)
            starts.append(held)
            parts.append(part)
            held += len(part)
            if held >= STREAM_FEATURES or len(ids) >= STREAM_DOCUMENTS:
                yield pa.RecordBatch.from_pylist([{"doc_ids": ids, "starts": starts, "stream": np.concatenate(parts).tobytes()}], _STREAMS)
                ids, starts, parts, held = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([{"doc_ids": ids, "starts": starts, "stream": np.concatenate(parts).tobytes()}], _STREAMS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(packed, "doc_ids array<long>, starts array<long>, stream binary"), "streams")


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in the streams; the driver gets a row a bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for (raw,) in arrow_rows(batches):
            run = np.sort(np.frombuffer(raw, "<u2"), kind="stable")
            if len(run):
                begins = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1))
                total[run[begins]] += np.diff(begins, append=len(run))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], schema=schema)

    out = np.zeros(buckets, np.int64)
    for row in streams.select("stream").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: thousandths of the log ratio of its smoothed shares, target against corpus, floored."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw that a doc_id and the seed fix, floored."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def scored(streams: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight and score of every document of the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, starts, raw in arrow_rows(batches):
            run = np.frombuffer(raw, "<u2")
            at = np.array(starts, np.int64)
            sizes = np.diff(at, append=len(run))
            weight = np.zeros(len(at), np.int64)
            full = np.flatnonzero(sizes)  # reduceat takes a part without entries for its next entry
            if len(full):
                weight[full] = np.add.reduceat(shared.value[run], at[full])
            draw = np.array([gumbel(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(weight), pa.array(weight + draw)], schema=_SCORED)

    return streams.mapInArrow(summed, "doc_id long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document; share per cent of those that are long
    enough are drawn, rounded down."""
    streams = write_streams(docs, buckets)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(write_streams(target, buckets), buckets))
    rows = written(scored(streams, gain, seed), "scores")
    eligible = F.col("n_features") >= features_of(least_words)
    # `_tie` parts rows that agree in all else, so that no range of the shuffle is one key.
    keyed = rows.where(eligible).select("*", (-F.col("score")).alias("_order"), F.monotonically_increasing_id().alias("_tie"))
    placed, n = numbered(keyed, ["_order", "doc_id", "n_features", "_tie"], "_place")
    drawn = n * share // 100
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*names, F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
    return ranked.unionByName(rows.where(~eligible).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose doc_id was drawn."""
    return docs.join(resample(docs, target, **parameters).where("rank is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "doc_id", "left_semi")
