"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in the order of doc_id, size and text digest, whatever files or partitions hold them. A keyed
Feistel network permutes the smallest power of two that holds n numbers; a number that falls outside is permuted again
until it falls inside (cycle walking), so the whole is a permutation of 0 to n - 1. Place p is slot p // shards of shard
p % shards: counts differ by one at most (law `rows`), a row's place follows from its number alone, and `inverse` gives the
number back, so a reader finds any slot without a shuffled copy.

Null texts have size 16 and the digest of no bytes; null doc_ids come first. Rows that agree in all three keys are
interchangeable and numbered one after the other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _M1, bounded_batches, mix, written

SHARDS, SEED, ROUNDS = 40, 20_240_117, 8


class Feistel:
    """A keyed permutation of 0 to n - 1 over arrays of int64."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n, self.bits = n, max(2, (max(n, 1) - 1).bit_length())
        self.low = self.bits // 2
        self.keys = mix(np.uint64(seed) + np.arange(1, rounds + 1, dtype=np.uint64) * _M1)

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        """One pass of the network. Even rounds change the high half by the low one, odd rounds the low by the high."""
        low_bits, high_bits = np.uint64(self.low), np.uint64(self.bits - self.low)
        low_mask, high_mask = (np.uint64(1) << low_bits) - np.uint64(1), (np.uint64(1) << high_bits) - np.uint64(1)
        low, high = x & low_mask, x >> low_bits
        for i in range(len(self.keys))[:: -1 if back else 1]:
            if i % 2 == 0:
                high = high ^ (mix(low * _M1 + self.keys[i]) & high_mask)
            else:
                low = low ^ (mix(high * _M1 + self.keys[i]) & low_mask)
        return (high << low_bits) | low

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = self._step(np.asarray(x).astype(np.uint64), back)
            while len(out := np.flatnonzero(y >= self.n)):
                y[out] = self._step(y[out], back)
        return y.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, False)

    def inverse(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


def numbered(rows: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Adds global row numbers in the order of `keys`, and tells how many rows there are.

    A range shuffle sorts; each partition numbers its rows; the partitions' counts (one a partition) give the offsets. The
    numbered rows are written before they are counted, so that both see the same partitions.
    """
    sorted_rows = rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    at = F.monotonically_increasing_id()
    parts = written(sorted_rows.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    # One row a partition: as small as the plan itself.
    return parts.join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset"), total


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of every document."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    rows, n = numbered(slim, ["doc_id", "size", "text_crc32"])
    permutation = Feistel(n, seed)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permutation.place(batch.column("row_number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    out = rows.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(placed, "doc_id long, size long, text_crc32 long, row_number long, place long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
