"""What the near-duplicate join leaves behind and carries: it must not grow with the square of a table."""

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import jaccard
from tapeloom.llm.common import dropped, hot_join, written

from .test_text_operators import documents, prose


def test_pairs_of_one_common_shingle_are_no_candidates(spark):
    texts = []
    for i in range(40):  # each two of them share a run of five words, as texts of a large table do by chance
        run = f" r{i}a r{i}b r{i}c r{i}d r{i}e "
        texts += [prose(5_000 + i, 20) + run + prose(5_100 + i, 20), prose(5_200 + i, 20) + run + prose(5_300 + i, 20)]
    base = prose(5_500, 60)
    texts += [base, base + " at its end", "one two", "one two three"]
    found = jaccard.candidate_pairs(documents(spark, texts), np.empty(0, np.uint64), 4_000)
    pairs = {frozenset((r.a, r.b)) for r in found.collect()}
    name = lambda t: jaccard.class_of(jaccard._set_of(t, jaccard.WordHash()))
    assert pairs == {frozenset((name(base), name(base + " at its end")))}


def test_sets_that_need_few_common_shingles_are_candidates(spark):
    table = np.zeros(4, jaccard.ENTRY)  # sets of two shingles, of which both meet; n = 2 needs no third
    table["s"], table["name"], table["n"] = [1, 1, 2, 2], [7, 8, 7, 8], 2
    assert [tuple(int(x[0]) for x in columns) for columns in jaccard.list_pairs(table, 24)] == [(7, 8, 4)]
    assert int(jaccard.least_overlap(2, 2)) == 2 and jaccard.SHARED <= 4


def test_key_map_misses_no_wanted_key(spark):
    wanted = spark.range(3_000).select(F.xxhash64("id").alias("row_key"))
    for most in (1 << 28, 1 << 12):
        bits = jaccard._key_map(wanted, most)
        there = lambda df: np.array([int(bits[(k & (64 * len(bits) - 1)) >> 6]) >> (k & 63) & 1 for (k,) in df.collect()])  # noqa: E731, B023
        assert there(wanted).all()
    few = jaccard._key_map(wanted.limit(3))
    assert sum(int(x).bit_count() for x in few) <= 3


def test_dropped_tables_are_gone(spark):
    table = written(spark.range(10), "gone")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert store.exists(path)
    dropped(table)
    assert not store.exists(path)


def test_small_tables_are_joined_at_once(spark):
    left, right = spark.range(50).selectExpr("id % 3 as k", "id as v"), spark.range(3).selectExpr("id as k", "id as w")
    assert sorted(map(tuple, hot_join(left, right, "k", "left", few=100).collect())) == sorted(map(tuple, hot_join(left, right, "k", "left", 3).collect()))


def test_long_lists_of_chance_meetings_make_no_group(spark):
    texts = []
    runs = [" ".join(f"q{r}{c}" for c in "abcde") for r in range(24)]  # each in all of 40 texts that share nothing else
    for i in range(40):
        texts.append(" ".join(f"{prose(7_000 + 40 * r + i, 12)} {run}" for r, run in enumerate(runs)))
    base = prose(6_900, 120)
    copies = [f"{base} copy{i}" for i in range(30)]
    found = jaccard.candidate_pairs(documents(spark, texts + copies), np.empty(0, np.uint64), 20_000).collect()
    names = {jaccard.class_of(jaccard._set_of(t, jaccard.WordHash())) for t in copies}
    assert all({r.a, r.b} <= names for r in found if r.star)
    assert {x for r in found if r.star for x in (r.a, r.b)} == names
    for r in found:  # several runs may lie in the index parts of two texts: these are pairs, which sketches part
        assert r.star or len({r.a, r.b} & names) in (0, 2)
    docs = documents(spark, texts + copies)
    assert len({r.component_id for r in jaccard.jaccard_components(docs).collect()}) == 41


def test_form_of_a_long_list(spark):
    table = np.zeros(30, jaccard.ENTRY)
    table["s"], table["name"], table["n"], table["least"] = 5, np.arange(30), 100, np.arange(30)
    pairs = lambda **most: [x for columns in jaccard.list_pairs(table, 24, **most) for x in zip(*map(np.ndarray.tolist, columns), strict=True)]
    assert {(a, b) for a, b, _ in pairs()} == {(a, b) for b in range(30) for a in range(b)} and {w for _, _, w in pairs()} == {1}
    assert pairs(most=29) == [(0, b, jaccard.STAR) for b in range(1, 30)]
    table["least"][:15] = 9  # half of them
    assert pairs() == [(0, b, jaccard.STAR) for b in range(1, 30)]


def test_repeated_shingles_come_last(spark):
    repeated, rng = jaccard.Repeated(), np.random.default_rng(3)
    common, sets = np.sort(rng.integers(1 << 63, size=60, dtype=np.uint64)), []
    for _ in range(5):
        sets.append(np.unique(np.concatenate((common, rng.integers(1 << 63, size=300, dtype=np.uint64)))))
        repeated.add(sets[-1])
    slots = repeated.taken()
    assert np.isin((common & np.uint64(jaccard.SEEN_BITS - 1)).astype(np.int64), slots).all() and not len(repeated.taken())
    marks = jaccard.frequent_map(spark.createDataFrame([(int(x),) for x in slots], "slot long"))
    for s in sets:
        first = jaccard._ordered(s, marks)
        assert len(first) == jaccard.index_part(len(s)) and not np.isin(first, common).any() and np.isin(first, s).all()
    assert len(jaccard._ordered(common, marks)) == jaccard.index_part(60)
    assert not jaccard.frequent_map(spark.createDataFrame([], "slot long")).any()
