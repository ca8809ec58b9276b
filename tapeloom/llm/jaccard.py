"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 3/4; documents without words
link with nothing. Nothing here is approximate but for 64-bit hashes that stand for shingles (63 bits for whole sets). The steps:

1. *Classes.* Documents with equal sets form a class (one row a class from here on, however many copies it has).
2. *Index.* In any fixed order of shingles, linked sets share three (or all that they must share, if fewer) among the first
   |A| - ceil(3|A|/4) + 3 of each. The order is by hash, with all shingles last that any task met twice (a map of bits has them), so that passages common to many documents
   and runs of common words give no lists of candidates. Those first shingles are the inverted index, dealt out by hash ranges.
3. *Candidates.* A short list gives its pairs of fitting sizes; so does a long one of texts that met by chance. Only a long list
   of near copies gives a star (the least hashes of near copies are mostly equal: that chooses the form, and either is without
   loss). Pairs are counted where they meet: those that no star and fewer than three lists give are gone before anything is
   joined to them. As a table grows, so do pairs that share one shingle by chance, with its square; next to none of these share
   three. Stars of lists that met by chance would make one group of a large table. Those left
   must pass a bound: parity sketches differ in at most as many bits as two linked sets may differ in shingles.
4. *Candidate groups.* Connected components over candidates, by contraction onto least neighbours until no edge is left; every
   linked pair lies within one. Groups are dealt by steps of set sizes: a set goes with those of its step and the next.
5. *DivideSkip.* Within a group a set is a query: its longest inverted lists are set aside, the shorter ones are merged (they
   are sorted runs) and count occurrences, and only sets that reach T minus the number of long lists are probed in these by
   binary search. One hub is asked first; sets that it links with need no query of their own, as a link between two components
   has an end outside the hub's. So a group of near copies of one text costs work in proportion to it.
6. *Large groups* are cut into blocks of bounded size, the hub in each; the sets that aren't connected to it are then asked
   once against each other and against every block of the others.

Joins on keys that may be hot (a class with very many copies, a group with very many classes) go through `hot_join`.

Null and empty texts: n_shingles 0 and a component of their own. Very long texts are one set like others, in whole. Repeated
rows of one doc_id have one component; rows of one doc_id with different texts are judged by their own text. Null doc_ids are never a
component's least while another exists. Ties: a component's id is its least doc_id. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, WordHash, arrow_rows, bounded_batches, chunked, dropped, fresh, hot_join, shingle_hashes, written

WORDS, SHARE = 5, (3, 4)
#: Lists up to so long give all their pairs; those up to so long too, unless half of their sets have the same least
#: hash; shingles of one task's block of a group.
SHORT_LIST, LONG_LIST, BLOCK_SHINGLES = 24, 256, 500_000
#: Bits of a task's map of the shingles that it has met (32 MB), the most of the map of those met twice (16 MB), and
#: that map's bits for each of them.
SEEN_BITS, FREQUENT_BITS, FREQUENT_KEY_BITS = 1 << 28, 1 << 27, 16
#: Index entries that one task is dealt, rows of pairs that a task holds at once, names and words it remembers.
ENTRIES_A_TASK, PAIRS_AT_ONCE, NAMES_KEPT, WORDS_KEPT = 500_000, 200_000, 100_000, 150_000
#: Shingles of their index parts that linked sets share; the weight of a star's pair, which needs no others; the
#: bits of a map of wanted keys for each key, and at most (32 MB).
SHARED, STAR, KEY_BITS, MOST_BITS = 3, 1 << 20, 16, 1 << 28
MU = 0.0085  # DivideSkip's weight of probing against merging

#: hot_join, where narrow tables of few rows need no count by key.
_joined = functools.partial(hot_join, few=FEW_ROWS)


def least_overlap(a, b):
    """The overlap that sets of a and b shingles need: the least whole number of at least 3(a + b)/7."""
    return -(-(SHARE[0] * (a + b)) // (SHARE[0] + SHARE[1]))


def index_part(n: int) -> int:
    """How many first shingles of a set of n are indexed."""
    return min(n, n - -(-SHARE[0] * n // SHARE[1]) + SHARED)


def class_of(s: np.ndarray) -> int:
    """A 63-bit name of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def sketch_bits(n: int) -> int:
    """Bits of a set's parity sketch: a power of two of at least 2n, 64 at least. Linked sets' sizes differ by a factor of two
    at most; the longer sketch folds to the shorter."""
    return max(64, 1 << (2 * n - 1).bit_length())


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall on each bit."""
    m = sketch_bits(len(s))
    hits = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").tobytes()


def narrowed(n: int, x: bytes) -> bytes:
    """The sketch of a set of n folded to a power of two of at least 3n/4 bits: enough to part most sets that share little."""
    width = max(64, 1 << (max(1, 3 * n // 4) - 1).bit_length()) // 8
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0).tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only if the sets can't link: sketches differ in no more bits than the sets differ in shingles."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    long = int.from_bytes(y, "little")
    width = 8 * len(x)
    while len(y) > len(x) and long >> width:
        size = max(width, 1 << ((long.bit_length() - 1).bit_length() - 1))
        long = (long & ((1 << size) - 1)) ^ (long >> size)
    return (long ^ int.from_bytes(x, "little")).bit_count() <= n + m - 2 * least_overlap(n, m)


class Groups:
    """Union-find over 0 to n - 1; the least is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def divide_skip(sets: list[np.ndarray], ask: list[bool] | None = None, hub: int | None = None) -> Groups:
    """Connects linked sets (sorted arrays of distinct hashes). With `ask`, only links that have an end among those are looked for."""
    n = len(sets)
    groups = Groups(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    by_size = np.argsort(sizes, kind="stable")
    sized = sizes[by_size]
    flat = np.concatenate([sets[i] for i in by_size])
    order = np.argsort(flat, kind="stable")
    values, owners = flat[order], np.repeat(np.arange(n, dtype=np.int32), sized)[order]  # owners in the order of sizes
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    ends = np.append(edge[1:], len(values))
    del flat, values
    number = np.empty(len(order), np.int32)
    number[order] = np.repeat(np.arange(len(edge), dtype=np.int32), ends - edge)
    del order
    starts = np.concatenate(([0], np.cumsum(sized)))
    find = groups.root

    def query(q: int) -> None:
        """Connects the set q with all that it links with."""
        size, me = int(sized[q]), int(by_size[q])
        lists = number[starts[q] : starts[q + 1]]
        first = int(np.searchsorted(sized, -(-SHARE[0] * size // SHARE[1])))  # smaller and larger sets can't link
        last = int(np.searchsorted(sized, SHARE[1] * size // SHARE[0], "right"))
        lo, hi = edge[lists], ends[lists]
        lengths = hi - lo
        longest = int(lengths.max())
        if longest < 2 or last - first < 2:
            return
        t = int(least_overlap(size, sized[first]))
        aside = min(t - 1, int(t / (MU * np.log2(longest) + 1)))
        rank = np.argsort(lengths, kind="stable")
        short, long = rank[: len(rank) - aside], rank[len(rank) - aside :]
        runs = [owners[lo[k] : hi[k]] for k in short if hi[k] - lo[k] > 1]
        if not runs:
            return
        merged = np.sort(np.concatenate(runs), kind="stable")  # a stable sort of sorted runs merges them
        merged = merged[(merged >= first) & (merged < last) & (merged != q)]
        if not len(merged):
            return
        at = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, count = merged[at], np.diff(np.append(at, len(merged)))
        need = least_overlap(size, sized[found])
        keep = count + aside >= need
        best = np.argsort(-(count[keep] / need[keep]), kind="stable")
        for c, have, most in zip(found[keep][best].tolist(), count[keep][best].tolist(), need[keep][best].tolist(), strict=True):
            other = int(by_size[c])
            if find(other) == find(me):
                continue
            left = aside
            for k in long:
                if have >= most or have + left < most:
                    break
                x, y = lo[k], hi[k]
                p = x + np.searchsorted(owners[x:y], c)
                have += bool(p < y and owners[p] == c)
                left -= 1
            if have >= most:
                groups.join(me, other)

    if ask is None:
        if hub is None:  # the set whose lists are longest: it lies where most sets are alike
            mean = np.add.reduceat((ends - edge)[number].astype(np.float64), starts[:-1]) / sized
            at = int(np.argmax(mean))
        else:
            at = int(np.flatnonzero(by_size == hub)[0])
        query(at)
        hub = int(by_size[at])
    for q in range(n):
        me = int(by_size[q])
        if (find(me) != find(hub)) if ask is None else ask[me]:
            query(q)
    return groups


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each end of an edge (a, b) with the least end of its component.

    Every round an end takes the least of itself and its neighbours, then what that one took, and edges are drawn again between
    what their ends took, until none are left. The least end of a component keeps itself, and the greatest is never taken: so it
    ends. Edges become fewer each round, and long chains halve.
    """
    left = written(edges.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = left.selectExpr("inline(array(struct(a as v, b as w), struct(b as v, a as w)))")
        least = written(both.groupBy("v").agg(F.min("w").alias("w")).selectExpr("v", "least(v, w) as c"), "least")
        took = written(_joined(least, least.selectExpr("v as c", "c as top"), "c", "inner").selectExpr("v", "top as c"), "took")
        tops = took.selectExpr("v as c", "c as top")
        before, labels = labels, took if labels is None else written(_joined(labels, tops, "c", "left").selectExpr("v", "coalesce(top, c) as c"), "labels")
        if before is not None:
            dropped(before)
        half = written(_joined(left, took.selectExpr("v as a", "c as x"), "a", "inner").select("x", "b"), "half")
        drawn = _joined(half, took.selectExpr("v as b", "c as y"), "b", "inner").selectExpr("least(x, y) as a", "greatest(x, y) as b")
        done, left = left, written(drawn.where("a <> b").distinct(), "edges")
        dropped(done, least, half, *([] if labels is took else [took]))
        if not left.take(1):
            dropped(left)
            return labels


_SETS = "row_key long, doc_id long, n long, name long, sketch binary"
_SETS_ARROW = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("sketch", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    """row_key (equal for repeated rows alone), doc_id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", F.lit("."), "text").alias("row_key"), "doc_id", "text")


def _set_of(text: str | None, hashes: WordHash) -> np.ndarray:
    return shingle_hashes((text or "").encode("utf-8", "replace").lower().split(), hashes, WORDS)


class Repeated:
    """Slots of the shingles that come again in one task, by a map of bits. It only orders shingles, so that a slot which others
    share, or a repetition missed, costs work and no result."""

    def __init__(self):
        self.seen, self.held = np.zeros(SEEN_BITS // 8, np.uint8), 0
        self.found: list[np.ndarray] = []

    def add(self, s: np.ndarray) -> None:
        if self.held > SEEN_BITS // 8:  # a map that is full tells little
            self.seen[:] = 0
            self.held = 0
        slot = (s & np.uint64(SEEN_BITS - 1)).astype(np.int64)
        at, bit = slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8)
        had = self.seen[at]
        again = (had & bit) != 0
        self.seen[at] = had | bit
        self.held += len(s)
        if again.any():
            self.found.append(slot[again])

    def taken(self) -> np.ndarray:
        """The slots found since the last call."""
        out = np.unique(np.concatenate([np.empty(0, np.int64), *self.found]))
        self.found = []
        return out


def set_names(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_key, doc_id, n, name, sketch of the set) of every document, and (slot) of shingles that come again in a task; one pass over the texts."""
    bounded_batches(docs.sparkSession)
    both = pa.schema([*_SETS_ARROW, ("slot", pa.int64())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names, repeated = WordHash(WORDS_KEPT), set(), Repeated()
        for batch in batches:
            rows = []
            for row_key, doc_id, text in arrow_rows([batch]):
                s = _set_of(text, hashes)
                name = class_of(s) if len(s) else 0
                rows.append((row_key, doc_id, len(s), name, sketch(s) if len(s) else None, None))
                if len(s) and name not in names:  # exact copies near each other count once in a task
                    if len(names) >= NAMES_KEPT:
                        names.clear()
                    names.add(name)
                    repeated.add(s)
            yield from chunked(rows, both, 20_000)
            if sum(map(len, repeated.found)) > 1_000_000:
                yield from _columns(both, (None, None, None, None, None, repeated.taken()))
        yield from _columns(both, (None, None, None, None, None, repeated.taken()))

    out = written(_texts(docs).mapInArrow(named, _SETS + ", slot long"), "sets")
    return out.where("n is not null").select("row_key", "doc_id", "n", "name", "sketch"), out.where("slot is not null").select("slot")


def _columns(schema: pa.Schema, columns: tuple, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Numpy columns (None: all null) as Arrow batches."""
    n = max(len(x) for x in columns if x is not None)
    for at in range(0, n, size):
        k = min(size, n - at)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, f.type) if x is None else pa.array(x[at : at + k], f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """A map of `bits` bits (a power of two) in which those of `slot` are set."""
    rows = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("set")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint64)


def frequent_map(slots: DataFrame, most: int | None = None) -> np.ndarray:
    """A map of the slots of shingles that came again in any task."""
    bits = min(most or FREQUENT_BITS, 1 << max(12, (FREQUENT_KEY_BITS * slots.count() - 1).bit_length()))
    return _bit_map(slots.select(F.pmod("slot", F.lit(bits)).alias("slot")), bits)


def _ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The indexed part of a set: by hash, shingles whose bit is set in the map `frequent` last."""
    k = index_part(len(s))
    if not len(frequent):
        return s[:k]
    slot = s & np.uint64(64 * len(frequent) - 1)
    hot = (frequent[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return np.concatenate((s[~hot], s[hot]))[:k]


#: least: the lowest byte of the set's least hash.
ENTRY = np.dtype([("s", "<u8"), ("name", "<i8"), ("n", "<i4"), ("least", "u1")])


def list_pairs(table: np.ndarray, short: int, most: int = LONG_LIST) -> Iterator[tuple]:
    """(a, b, weight) of the lists of an index part, in slices of PAIRS_AT_ONCE rows or a little more, added up within a slice.

    A list weighs 1 for each of its pairs, more if these sets may link with fewer than SHARED shingles: pairs that can link
    reach SHARED over all lists, or a star joins both to one set. Lists of more than `short` sets give a star where half of
    these have the same least hash, as near copies mostly do, or where they are more than `most`.
    """
    order = np.lexsort((table["name"], table["s"]))
    s, names, sizes, least = (table[c][order] for c in ("s", "name", "n", "least"))
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (names[1:] != names[:-1])))  # copies met in other tasks
    s, names, sizes, least = s[new], names[new], sizes[new], least[new]
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    lengths = np.diff(np.append(cuts, len(s)))

    def added(parts: list[tuple]) -> tuple:
        a, b, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b, weight = a[order], b[order], weight[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
        return a[at], b[at], np.add.reduceat(weight, at) if len(at) else weight

    star = lengths > max(short, most)
    for x in np.flatnonzero((lengths > short) & ~star):
        star[x] = 2 * np.bincount(least[cuts[x] : cuts[x] + lengths[x]]).max() >= lengths[x]

    def slices() -> Iterator[tuple]:
        for k in np.unique(lengths[(lengths > 1) & ~star]).tolist():
            at = cuts[(lengths == k) & ~star]
            i, j = np.triu_indices(k, 1)
            step = max(1, PAIRS_AT_ONCE // len(i))
            for x in range(0, len(at), step):
                rows = at[x : x + step, None] + np.arange(k)
                n, m = sizes[rows[:, i]].ravel(), sizes[rows[:, j]].ravel()
                fit = (SHARE[0] * n <= SHARE[1] * m) & (SHARE[0] * m <= SHARE[1] * n)
                weight = -(-SHARED // np.minimum(SHARED, least_overlap(n[fit].astype(np.int64), m[fit])))
                yield names[rows[:, i]].ravel()[fit], names[rows[:, j]].ravel()[fit], weight
        for x, k in zip(cuts[star].tolist(), lengths[star].tolist(), strict=True):
            yield np.full(k - 1, names[x]), names[x + 1 : x + k], np.full(k - 1, STAR)

    held: list[tuple] = []
    count = 0
    for part in slices():
        held.append(part)
        count += len(part[0])
        if count >= PAIRS_AT_ONCE:
            yield added(held)
            held, count = [], 0
    if count:
        yield added(held)


def candidate_pairs(docs: DataFrame, frequent: np.ndarray, entries: int) -> DataFrame:
    """(a, b, star) of names whose index parts meet as often as linked sets' do, or in the star of near copies. Written."""
    spark = docs.sparkSession
    parts = max(1, -(-entries // ENTRIES_A_TASK), min(spark.sparkContext.defaultParallelism, -(-entries // 100_000)))
    shared = spark.sparkContext.broadcast(frequent)  # at most FREQUENT_BITS bits
    short, most = SHORT_LIST, LONG_LIST
    blob = pa.schema([("part", pa.int32()), ("entries", pa.binary())])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hot, names = WordHash(WORDS_KEPT), shared.value, set()
        held: list[np.ndarray] = []
        count = 0

        def dealt():
            table = np.concatenate(held)
            part = ((table["s"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            table, part = table[order], part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            for x, y in zip(cuts, [*cuts[1:], len(part)], strict=True):
                yield int(part[x]), table[x:y].tobytes()

        for batch in batches:
            for _, _, text in arrow_rows([batch]):
                s = _set_of(text, hashes)
                if not len(s) or (name := class_of(s)) in names:
                    continue
                if len(names) >= NAMES_KEPT:
                    names.clear()
                names.add(name)
                first = _ordered(s, hot)
                rows = np.empty(len(first), ENTRY)
                rows["s"], rows["name"], rows["n"], rows["least"] = first, name, len(s), int(s[0]) & 255
                held.append(rows)
                count += len(rows)
            if count > 1_000_000:
                yield from chunked(dealt(), blob)
                held, count = [], 0
        if held:
            yield from chunked(dealt(), blob)

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("weight", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[bytes]] = {}
        for part, data in arrow_rows(batches):
            rows.setdefault(part, []).append(data)
        for part in sorted(rows):
            for columns in list_pairs(np.frombuffer(b"".join(rows.pop(part)), ENTRY), short, most):
                yield from _columns(pair, columns)

    met_pairs = _texts(docs).mapInArrow(indexed, "part int, entries binary").repartition(parts, "part").mapInArrow(met, "a long, b long, weight long")
    counted = met_pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= SHARED)
    return written(counted.select("a", "b", (F.col("weight") >= STAR).alias("star")), "candidates")


def _key_map(wanted: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A bit for each remainder of a wanted row_key, by a power of two of bits; a wanted key is never missed, most others are."""
    bits = min(most, 1 << max(12, (KEY_BITS * wanted.count() - 1).bit_length()))
    return _bit_map(wanted.select(F.pmod("row_key", F.lit(bits)).alias("slot")), bits)


def _sets_of(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The sets of `wanted` (row_key, name, columns), tokenized again: few of all, so only they are hashed. Written."""
    # A map of the keys tells where texts are read which are wanted: only sets of these travel, and next to no others.
    shared = docs.sparkSession.sparkContext.broadcast(_key_map(wanted))
    arrow = pa.schema([("row_key", pa.int64()), ("name", pa.int64()), ("shingles", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, there, seen = WordHash(WORDS_KEPT), shared.value, set()

        def rows():
            for batch in batches:
                slot = batch.column(0).to_numpy().view(np.uint64) & np.uint64(64 * len(there) - 1)
                hit = there[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)
                for row_key, _, text in arrow_rows([batch.filter(pa.array(hit.astype(bool)))]):
                    s = _set_of(text, hashes)
                    if not len(s) or (key := (row_key, class_of(s))) in seen:  # repeated rows near each other go once
                        continue
                    if len(seen) >= NAMES_KEPT:
                        seen.clear()
                    seen.add(key)
                    yield (*key, s.tobytes())

        yield from chunked(rows(), arrow)

    sets = _texts(docs).mapInArrow(made, "row_key long, name long, shingles binary")
    # Dealt by key whatever the size of `wanted`, so that work grows in proportion. Another row may have an equal row_key.
    return written(sets.join(wanted.hint("shuffle_hash"), ["row_key", "name"]).select("name", *columns, "shingles"), "carried")


_LINK = pa.schema([("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_())])


def _unique(table: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Names of a group's table in order, their first rows, and their sets: repeated rows carry a set more than once."""
    first: dict[int, int] = {}
    for k, name in enumerate(table["name"].to_pylist()):
        first.setdefault(name, k)
    names = sorted(first)
    at = [first[x] for x in names]
    return names, at, [np.frombuffer(table["shingles"][k].as_py(), "<u8") for k in at]


def group_links(carried: DataFrame) -> DataFrame:
    """(a, b) of connected names within groups: stars around the least connected name of a task."""

    def within(table: pa.Table) -> pa.Table:
        names, at, sets = _unique(table)
        c, cut, hub = table["c"][0].as_py(), table["blocks"][0].as_py() > 1, table["hub"][0].as_py()
        hub = names.index(hub) if cut and hub in names else None
        found = divide_skip(sets, hub=hub)
        middle = -1 if hub is None else found.root(hub)
        rows = [(c, names[found.root(i)], name, cut and found.root(i) != middle) for i, name in enumerate(names)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _LINK, strict=True)], schema=_LINK)

    # The hub of a group that is cut goes to each of its blocks.
    placed = carried.withColumn("block", F.expr("explode(if(name = hub, sequence(0, blocks - 1), array(block)))"))
    local = written(placed.groupBy("c", "block").applyInArrow(within, "c long, a long, b long, open boolean"), "links")
    links = local.where("a <> b").select("a", "b")
    if not local.where("open").take(1):
        return links

    def across(table: pa.Table) -> pa.Table:
        names, at, sets = _unique(table)
        asked = [table["asked"][k].as_py() for k in at]
        found = divide_skip(sets) if all(asked) else divide_skip(sets, ask=asked)
        rows = [(0, names[found.root(i)], name, False) for i, name in enumerate(names)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _LINK, strict=True)], schema=_LINK)

    # Sets that their block didn't connect to the hub meet, in chunks, each other once and the blocks of all other sets.
    cut = carried.where("blocks > 1").select("c", "name", "shingles")
    loose = local.where("open").select("c", F.col("b").alias("name")).distinct()
    rest, others = written(cut.join(loose, ["c", "name"]), "rest"), cut.join(loose, ["c", "name"], "left_anti")
    held = F.sum(F.expr("octet_length(shingles) div 8"))
    both = rest.groupBy("c").agg(held.alias("some")).join(cut.groupBy("c").agg(held.alias("total")), "c")
    sizes = written(both.select("c", *[F.greatest(F.lit(1), F.ceil(F.expr(x) / BLOCK_SHINGLES)).cast("int").alias(y) for x, y in (("some", "chunks"), ("total - some", "blocks"))]), "sizes")
    asked = _joined(rest, sizes, "c", "inner").withColumn("q", F.expr("cast(pmod(xxhash64(name, 1), chunks) as int)"))
    paired = asked.withColumn("k", F.expr("explode(sequence(0, chunks - 1))")).select("c", F.least("q", "k").alias("x"), F.greatest("q", "k").alias("y"), "name", "shingles", F.expr("q <= k").alias("asked"))
    sent = asked.select("c", F.col("q").alias("x"), F.expr("explode(sequence(-blocks, -1))").alias("y"), "name", "shingles", F.lit(True).alias("asked"))
    there = _joined(others, sizes, "c", "inner", keys=cut.select("c")).select("c", F.expr("explode(sequence(0, chunks - 1))").alias("x"), F.expr("cast(-1 - pmod(xxhash64(name), blocks) as int)").alias("y"), "name", "shingles", F.lit(False).alias("asked"))
    more = paired.unionByName(sent).unionByName(there).groupBy("c", "x", "y").applyInArrow(across, "c long, a long, b long, open boolean")
    return links.unionByName(written(more.where("a <> b"), "links").select("a", "b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and row_key of every document."""
    sets, repeated = set_names(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    classes = written(sets.where("n > 0").groupBy("name").agg(first, F.first("n").alias("n")).select("name", "n", F.col("first.doc_id").alias("least"), F.col("first.row_key").alias("row_key")), "classes")
    frequent = frequent_map(repeated)
    entries = int(classes.agg(F.sum(F.expr(f"n div 4 + {SHARED}"))).first()[0] or 0)
    candidates = candidate_pairs(docs, frequent, entries)
    pairs, near = (candidates.where(x).select("a", "b") for x in ("not star", "star"))

    # Sketches of the sets in pairs; a pair that can't link goes, most by narrow sketches, so that few whole ones travel.
    ends = pairs.selectExpr("inline(array(struct(a as name), struct(b as name)))").distinct()
    of_pairs = classes.join(ends, "name").select("row_key", "name", F.col("n").cast("int").alias("n"))
    whole = of_pairs.join(sets.where("n > 0").select("row_key", "sketch"), "row_key").groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    arrow = pa.schema([("name", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("narrow", pa.binary())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunked(((name, n, x, narrowed(n, x)) for name, n, x in arrow_rows(batches)), arrow)

    sketches = written(whole.mapInArrow(folded, "name long, n int, sketch binary, narrow binary"), "sketches")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(n, x, m, y) for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def passing(some: DataFrame, kind: str) -> DataFrame:
        drawn = some.join(sketches.select(F.col("name").alias("a"), "n", F.col(kind).alias("x")), "a").join(sketches.select(F.col("name").alias("b"), F.col("n").alias("m"), F.col(kind).alias("y")), "b")
        return drawn.select("a", "b", "n", "x", "m", "y").mapInArrow(likely, "a long, b long")

    fit = written(passing(pairs, "narrow"), "likely")
    close = written(passing(fit, "sketch").unionByName(near), "close")
    dropped(candidates, sketches, fit)
    grouped = components(close)

    # Groups, their hubs (the name of most candidates) and blocks; each set of a group travels once.
    degrees = close.selectExpr("inline(array(struct(a as name), struct(b as name)))").groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    members = written(classes.join(grouped.withColumnRenamed("v", "name"), "name").join(degrees, "name"), "members")
    dropped(grouped, close)
    # A group falls apart by size: sets of one step, a factor of 1.34, link with their own and the next step only.
    step = F.floor(F.log("n") / math.log(1.34)).cast("int")
    stepped = written(members.select("name", "row_key", "n", "degree", F.explode(F.array(step, step - 1)).alias("step"), "c").withColumn("c", F.xxhash64("c", "step")), "stepped")
    cut = stepped.groupBy("c").agg(F.max(F.struct("degree", "name"))["name"].alias("hub"), F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    dealt = written(_joined(stepped, cut, "c", "inner").groupBy("row_key", "name").agg(F.collect_list(F.struct("c", "hub", "blocks", F.expr("cast(pmod(xxhash64(name), blocks) as int)").alias("block"))).alias("places")), "dealt")  # two places at most
    dropped(members, stepped)
    carried = _sets_of(docs, dealt, ["places"])
    dropped(dealt)
    final = components(group_links(carried.selectExpr("name", "inline(places)", "shingles"))).withColumnRenamed("v", "name")
    dropped(carried)

    least = classes.join(final, "name").groupBy("c").agg(F.min("least").alias("component_id"))
    of_class = _joined(final, least, "c", "inner").select("name", "component_id")
    joined = written(classes.join(of_class, "name", "left").select("name", F.coalesce("component_id", "least").alias("component_id")), "of_class")
    # Documents without words have no class: their key is one of their own, which meets none.
    keyed = sets.select("row_key", "doc_id", "n", F.expr("if(n > 0, name, -1 - pmod(row_key, 1 << 62))").alias("name"))
    return _joined(keyed, joined, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those documents that have a linked one of a smaller doc_id in their component."""
    key = fresh("row_key", docs.columns)
    gone = jaccard_components(docs).where("component_id is not null and not (doc_id <=> component_id)").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.lit("."), F.col("text").cast("string")))
    return keyed.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
