"""Bound-certified repacking of documents into fixed-length sequences.

Every document becomes byte-level BPE ids and one end id. A document longer than a sequence is cut: its first piece takes
the remainder, the others are full. Pieces are then packed:

1. each partition packs its pieces by best-fit decreasing;
2. dual-feasible functions give a lower bound of the bins that its pieces need, and of those that all pieces need;
3. while all bins are more than the bound of all, partitions release their emptiest bins, by the gap to their own bound, unless these
   bins meet the bound of what is in them; released documents meet others in new partitions of bounded size and are packed again, until
   the bound is met (the packing is certified), one partition holds all that was released, or a round saves next to nothing (then the
   better of both arrangements stands). No texts move.

The certificate goes with the rows: `partition_bins` and `partition_bound` are the bins that the row's partition kept and the
bound of the pieces in them, `total_bound` is the bound of all pieces.

Null and empty texts have the end id alone and are packed like others. Very long texts are cut, none is dropped. Pieces of equal
length are taken in the order of doc_id (null first), piece and ids. Repeated rows (also of one doc_id, or of a null one) are
packed once each. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunked, written
from .vocab import ByteBpe, loaded

CAPACITY, END_ID = 1024, 2
#: Fixed value: pieces that one packing task is dealt.
PIECES_A_TASK = 40_000
#: Share of the released bins that a round must save for another one.
LEAST_GAIN = 0.002

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first takes what full pieces leave."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as an array."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(ByteBpe, vocabulary, folder)

        def rows():
            for batch in batches:
                doc_ids, texts = (column.to_pylist() for column in batch.columns)
                for doc_id, ids in zip(doc_ids, coder.ids_of([t or "" for t in texts]), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, k, start, length, zlib.crc32(part))
                        yield (*row, np.frombuffer(part, "<u4").tolist()) if with_ids else row

        yield from chunked(rows(), schema, 2_000 if with_ids else 20_000)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""))


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces need at least: counts[s] pieces of size s, capacity len(counts) - 1.

    The greatest of the bounds that two families of dual-feasible functions give: Martello and Toth's threshold
    functions, and Fekete and Schepers' rounding functions for k from 1 to 20; the identity (k of all volume) is among them.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    volume, many = np.cumsum(counts * sizes), np.cumsum(counts)
    for t in range(1, capacity // 2 + 1):  # sizes over capacity - t fill a bin, sizes under t count as nothing
        large = int(many[capacity] - many[capacity - t])
        middle = int(volume[capacity - t] - volume[t - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):  # u(x) = x if (k + 1)x is whole, else floor((k + 1)x) / k
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, (scaled // capacity) * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin. Bins of one remaining room lie on a stack; a bit mask of the
    rooms that have bins finds the tightest in one step."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        place[i], offset[i] = b, capacity - room
        room -= size
        if room:
            if not stacks[room]:
                mask |= 1 << room
            stacks[room].append(b)
    fill = np.full(bins, capacity, np.int64)
    for room, held in enumerate(stacks):
        fill[held] -= room
    return place, offset, fill


def release(lengths: np.ndarray, place: np.ndarray, fill: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bins to give up: the emptiest, until their free room makes up the gap to the bound and one bin more. A partition that
    meets its own bound still gives one bin's worth of room, as the bound of all may be lower than the sum of theirs; so does one whose
    released pieces would need as many bins by their own bound."""
    order = np.argsort(fill, kind="stable")
    room = np.cumsum(capacity - fill[order])

    def given(gap: int) -> np.ndarray:
        out = np.zeros(len(fill), bool)
        out[order[: int(np.searchsorted(room, (gap + 1) * capacity)) + 1]] = True
        return out & (fill < capacity)

    gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
    out = given(gap)
    return given(0) if gap and lower_bound(np.bincount(lengths[out[place]], minlength=capacity + 1)) >= out.sum() else out


def _standing(out: DataFrame, capacity: int) -> DataFrame:
    """A round's rows where open bins stand after all: each task's open bins are a partition of their own, with its own certificate."""
    given, task = out.where("open"), F.shiftright("sequence_id", 32)
    sizes = given.groupBy(task.alias("_task"), "length").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("offset") == 0, 1)).alias("_bins"))
    told = sizes.groupBy("_task").applyInPandas(lambda g: _certificate(g, capacity), "_task long, _bins long, _bound long")
    given = given.withColumn("_task", task).join(F.broadcast(told), "_task")  # a row a task
    given = given.withColumns({"partition_bins": F.col("_bins"), "partition_bound": F.col("_bound"), "sequence_id": F.col("sequence_id") + (1 << 55)})
    return out.where(~F.col("open")).unionByName(given.drop("_task", "_bins", "_bound")).drop("open")


def _certificate(g: pd.DataFrame, capacity: int) -> pd.DataFrame:
    counts = np.zeros(capacity + 1, np.int64)
    counts[g["length"].to_numpy()] = g["_n"].to_numpy()
    return g.head(1)[["_task"]].assign(_bins=int(g["_bins"].sum()), _bound=lower_bound(counts))


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Adds sequence_id, offset and the certificates to a written table of pieces. Full pieces are sequences of their own."""
    spark = pieces.sparkSession
    bounded_batches(spark)
    base = [f.name for f in pieces.schema]
    held = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("partition_bins", pa.int64()), ("partition_bound", pa.int64()), ("open", pa.bool_())])
    done: list[DataFrame] = []
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a length
        counts[row["length"]] = row["n"]
    bound, closed = lower_bound(counts), 0
    left, total, rounds = pieces, int(counts.sum()), 0
    before, open_bins = None, math.inf  # the bins that the pieces left had, and how many
    tasks = max(1, -(-total // pieces_a_task))
    while True:
        tag, last = rounds << 56, tasks == 1

        def packed(batches: Iterator[pa.RecordBatch], tag: int = tag, last: bool = last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            held_batches = [b for b in batches if b.num_rows]
            if not held_batches:
                return
            table = pa.Table.from_batches(held_batches).cast(_PIECES)
            lengths = table["length"].to_numpy().astype(np.int64)
            place, offset, fill = best_fit_decreasing(lengths, capacity)
            given = np.zeros(len(fill), bool) if last else release(lengths, place, fill, capacity)
            here = len(table)
            least = lower_bound(np.bincount(lengths[~given[place]], minlength=capacity + 1))
            more = {"sequence_id": tag + (task << 32) + place, "offset": offset, "partition_bins": np.full(here, (~given).sum()), "partition_bound": np.full(here, least), "open": given[place]}
            for name, values in more.items():
                table = table.append_column(name, pa.array(values))
            yield from table.cast(held).to_batches(20_000)

        # Dealt by a hash of what a piece is and the round, so that a rerun task meets the same pieces, hot documents spread, and
        # pieces meet others each round.
        dealt = left.select(*base).repartition(tasks, F.xxhash64(F.lit(rounds), "doc_id", "piece", "ids_crc32")) if tasks > 1 else left.select(*base).coalesce(1)
        out = written(dealt.sortWithinPartitions("length", "doc_id", "piece", "ids_crc32").mapInArrow(packed, PIECE_SCHEMA + ", sequence_id long, offset long, partition_bins long, partition_bound long, open boolean"), "packed")
        bins = out.groupBy("open").agg(F.count(F.when(F.col("offset") == 0, 1)).alias("bins"), F.count(F.lit(1)).alias("n")).collect()
        made, given_up = sum(r["bins"] for r in bins), sum(r["bins"] for r in bins if r["open"])
        if before is not None and made >= open_bins:  # nothing gained: the bins that were given up stand as they were
            done.append(_standing(before, capacity))
            break
        few = before is not None and open_bins - made < LEAST_GAIN * open_bins
        if last or few or closed + made == bound or not given_up:  # certified, or not worth another round
            done.append(_standing(out, capacity) if given_up else out.drop("open"))
            break
        done.append(out.where(~F.col("open")).drop("open"))
        before, open_bins = out.where("open"), given_up
        left, closed, rounds = before, closed + made - given_up, rounds + 1
        tasks = max(1, -(-sum(r["n"] for r in bins if r["open"]) // pieces_a_task))  # never more pieces a task
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.withColumn("total_bound", F.lit(bound).cast("long"))


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and the certificates of every document's pieces."""
    return pack(written(tokenized_pieces(docs, vocabulary, folder, capacity), "pieces"), capacity)
