"""Removal of repeated passages: difference-cover anchors, extended to whole windows.

A window is `length` consecutive words of a document; every word that a window covers whose words also begin elsewhere goes. A
difference cover is a set of residues modulo a period such that every difference is one of two members. So of two equal windows
at any two places, wherever they begin, some pair of equal runs inside both stands at cover positions: only these short runs
(anchors, 15 words at 5 of 21 positions by default) are hashed and counted over all documents, and no match is missed.

Documents travel as blocks of about a megabyte, written once and bucketed by block, so that later passes join what was found to
them without moving texts again. Each pass emits narrow rows, one a block and distinct key, however often the block holds it: a key
that any part of all documents share has as many rows as there are blocks, and no more. The passes:

1. anchors that stand at two or more places;
2. of those, contexts (the anchor with all words that a window around it can reach). A context at two or more places settles all
   its windows at once. Where an anchor's contexts differ, one block of each context goes on;
3. the windows of the contexts that go on, by 128-bit hashes: those at two or more places;
4. settled ranges and repeated windows cover the words that go.

Null texts have no words; texts shorter than a window lose none, nor do they make others lose any. Texts are whole, however long.
Copies and repeated rows lose all words where they are as long as a window. Words are compared by 64-bit hashes, windows by 128
bits, contexts by the anchor's and their own 64 bits. Null and repeated doc_ids are kept. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, bucketed, chunked, mix, written

LENGTH, PERIOD = 35, 21
#: Bytes of text that close a block; a longer text is a block by itself.
BLOCK_BYTES = 1 << 20
#: Odd multipliers of the two rolling hashes; the first also hashes the bytes of words.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first of the smallest sets of residues whose differences are all residues modulo the period."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("a period is 1 or more")


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as any text needed them."""

    def __init__(self, base: int):
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)))) for b in (self.base, self.back))


_POWERS = tuple(Powers(b) for b in BASES)


#: Which bytes part words.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes hashed at a time, and the multiplier of a word's length.
_SEGMENT, _SIZE = 1 << 18, np.uint64(0xC2B2AE3D27D4EB4F)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their 64-bit hashes: of all words of a segment at once, from running sums over its bytes."""
    begins, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = at + _SEGMENT
        while end < len(data) and not _SPACE[data[end]]:  # a segment ends where a word does
            end += 1
        raw = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        word = np.concatenate(([False], ~_SPACE[raw], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, last = edges[::2], edges[1::2]
        _POWERS[0].reach(len(raw))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[0].up[: len(raw)])))
            hashes.append(mix((sums[last] - sums[first]) * _POWERS[0].down[first] + (last - first).astype(np.uint64) * _SIZE))
        begins.append(first + at)
        at = end
    return np.concatenate(begins), np.concatenate(hashes)


class Block:
    """The words of a block's documents behind each other, and hashes of their runs."""

    def __init__(self, texts: list[bytes | None], length: int, period: int):
        ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
        at, h = hashed_words(b"\n".join([t or b"" for t in texts]))
        upto = np.searchsorted(at, ends)
        self.sizes = np.diff(upto, prepend=0)
        self.begins = upto - self.sizes
        n = len(h)
        self.sums = []
        with np.errstate(over="ignore"):
            for p in _POWERS:
                p.reach(n)
                self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * p.up[:n]))))
        self.at = np.arange(n) - np.repeat(self.begins, self.sizes)  # place in its document
        self.left = np.repeat(self.sizes, self.sizes) - self.at  # words from there to the document's end
        self.length, self.short = length, length - period + 1
        self.cover = np.isin(np.arange(period), difference_cover(period))
        self.period = period

    def run(self, start: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hashes of runs of words."""
        with np.errstate(over="ignore"):
            return mix((self.sums[which][start + size] - self.sums[which][start]) * _POWERS[which].down[start])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of documents that are as long as a window."""
        there = np.flatnonzero(self.cover[self.at % self.period] & (self.left >= self.short) & (self.at + self.left >= self.length))
        return there, self.run(there, self.short)

    def contexts(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last (exclusive) word that windows around each anchor reach, and hashes of these words with how far they reach."""
        before = np.minimum(self.at[anchors], self.length - self.short)
        first, last = anchors - before, anchors + np.minimum(self.left[anchors], self.length)
        with np.errstate(over="ignore"):
            return first, last, mix(self.run(first, last - first) + (before * 4 * self.length + (last - first)).astype(np.uint64))

    def windows(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places where the windows inside ranges of words begin, each once."""
        return np.flatnonzero(self.covered(first, last - self.length + 1))

    def covered(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each word, whether a range holds it."""
        n = len(self.at)
        steps = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
        return np.cumsum(steps[:n]) > 0


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of two arrays, where each stands first, and how often."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[begins], b[begins], order[begins], np.diff(begins, append=len(a))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, doc_ids and texts: documents in blocks."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids], schema.field(1).type), pa.array([texts], schema.field(2).type)], schema=schema)

        for doc_id, text in arrow_rows(batches):
            size = len(text) if text else 0
            if ids and (held + size > block_bytes or len(ids) >= 20_000):
                yield block()
                at, ids, texts, held = at + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += size
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(packed, "block long, doc_ids array<long>, texts array<binary>")


def _found(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys (block, `by`, n) with `places`, how many there are over all blocks, and `first`, the first block with the key; of keys
    with two places or more. A group has a row a block at most."""
    group = Window.partitionBy(*by)
    return keys.withColumns({"places": F.sum("n").over(group), "first": F.min("block").over(group)}).where("places >= 2")


def _per_block(found: DataFrame, fields: list[str], name: str) -> DataFrame:
    return found.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(name))


def _joined(blocks: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Blocks stay where their buckets lie; what was found is built into a hash table, so texts aren't sorted."""
    return blocks.join(found.hint("shuffle_hash"), "block", how)


def _flat(column: pa.Array, k: int, field: str) -> np.ndarray:
    """A field of the structs in a list's k-th entry."""
    part = column[k].values
    return part.field(field).to_numpy(zero_copy_only=False) if part is not None else np.empty(0, np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every document."""
    if not 1 <= period <= length:
        raise ValueError("the period of the cover is 1 to the length of a window")
    bounded_batches(docs.sparkSession)
    blocks = bucketed(_blocks(docs, block_bytes), "block", "blocks")

    def passed(source: DataFrame, schema: pa.Schema, ddl: str, work) -> DataFrame:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    texts = batch.column("texts")[k].as_py()
                    yield from work(batch, k, texts, Block(texts, length, period))

        return source.mapInArrow(mapped, ddl)

    def rows(batch: pa.RecordBatch, k: int, schema: pa.Schema, *keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[-1]), batch.column("block")[k].as_py(), np.int64)), *[_signed(x) for x in keys]], schema=schema)

    # 1. Anchors.
    one = pa.schema([(c, pa.int64()) for c in ("block", "anchor", "n")])

    def anchors(batch, k, texts, block):
        distinct, n = np.unique(block.anchors()[1], return_counts=True)
        yield rows(batch, k, one, distinct, n)

    held = _found(passed(blocks.select("block", "texts"), one, "block long, anchor long, n long", anchors), ["anchor"])
    anchored = _per_block(held, ["anchor", "places"], "anchors")

    # 2. Contexts of repeated anchors.
    two = pa.schema([(c, pa.int64()) for c in ("block", "anchor", "context", "anchor_places", "n")])

    def contexts(batch, k, texts, block):
        there, found = block.anchors()
        wanted, places = (_flat(batch.column("anchors"), k, f) for f in ("anchor", "places"))
        order = np.argsort(wanted.view(np.uint64))
        wanted, places = wanted.view(np.uint64)[order], places[order]
        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
        hit = wanted[at] == found
        anchor, context, first, n = distinct_pairs(found[hit], block.contexts(there[hit])[2])
        yield rows(batch, k, two, anchor, context, places[at[hit]][first], n)

    pairs = passed(_joined(blocks.select("block", "texts"), anchored, "inner"), two, "block long, anchor long, context long, anchor_places long, n long", contexts)
    group = Window.partitionBy("anchor", "context")
    judged = pairs.withColumns({"places": F.sum("n").over(group), "first": F.min("block").over(group)})
    settled, goes_on = F.col("places") >= 2, (F.col("places") < F.col("anchor_places")) & (F.col("first") == F.col("block"))
    judged = written(judged.where(settled | goes_on).select("block", "context", settled.alias("settled"), goes_on.alias("goes_on")), "contexts")

    # 3. Windows of the contexts that go on.
    three = pa.schema([(c, pa.int64()) for c in ("block", "window", "second", "n")])

    def open_windows(block, contexts):
        there, _ = block.anchors()
        first, last, names = block.contexts(there)
        mine = np.isin(names.view(np.int64), contexts)
        at = block.windows(first[mine], last[mine])
        return at, block.run(at, length), block.run(at, length, 1)

    def windows(batch, k, texts, block):
        _, a, b = open_windows(block, _flat(batch.column("open"), k, "context"))
        a, b, _, n = distinct_pairs(a, b)
        yield rows(batch, k, three, a, b, n)

    still = _per_block(judged.where("goes_on"), ["context"], "open")
    again = _found(passed(_joined(blocks.select("block", "texts"), still, "inner"), three, "block long, window long, second long, n long", windows), ["window", "second"])

    # 4. What goes. One row a block holds its marks of both kinds.
    kinds = judged.where("settled").select("block", F.lit(True).alias("is_context"), F.col("context").alias("key")).unionByName(again.select("block", F.lit(False).alias("is_context"), F.col("window").alias("key")))
    marks = _per_block(kinds, ["is_context", "key"], "marks")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def kept(batch, k, texts, block):
        keys, is_context = _flat(batch.column("marks"), k, "key"), _flat(batch.column("marks"), k, "is_context").astype(bool)
        gone = np.zeros(len(block.at), bool)
        if len(keys):
            there, _ = block.anchors()
            first, last, names = block.contexts(there)
            mine = np.isin(names.view(np.int64), keys[is_context])
            gone = block.covered(first[mine], last[mine])
            every = np.flatnonzero(block.left >= length)
            at = every[np.isin(block.run(every, length).view(np.int64), keys[~is_context])]
            gone |= block.covered(at, at + length)
        ids = batch.column("doc_ids")[k].as_py()

        def documents():
            for doc_id, text, begin in zip(ids, texts, block.begins.tolist(), strict=True):
                words = text.split() if text else []
                lost = gone[begin : begin + len(words)]
                n = int(lost.sum())
                yield doc_id, len(words), n, b" ".join([w for w, x in zip(words, lost.tolist()) if not x] if n else words)

        yield from chunked(documents(), out)

    whole = passed(_joined(blocks, marks, "left"), out, "doc_id long, n_words long, n_removed long, kept binary", kept)
    return whole.withColumn("kept", F.col("kept").cast("string"))  # whole words of valid text


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
