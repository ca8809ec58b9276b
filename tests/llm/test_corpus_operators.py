"""Resampling, fill-in-middle and removal of repeated passages against brute force, with hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.llm import fill_in_middle, importance, substrings

WORDS = "the of and river stone quiet walks under blue hills when evening comes slowly to old towns near water".split()
LONG = " ".join(f"w{i}" for i in range(3_000))


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.6 else "") for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text) among columns whose names clash with what the operators make."""
    return spark.createDataFrame([(i, t, 1, "y", 2, "z") for i, t in rows], "doc_id long, text string, n long, block string, rank long, form string").repartition(3)


HARD = [(0, None), (1, ""), (2, LONG), (3, prose(1)), (4, prose(1)), (5, prose(1) + " one more word"), (5, prose(1) + " one more word"), (None, prose(2)), (7, "a  b\n\tc é ü 日本語  x\n\n"), (8, "!!! ### $$$ \n"), (9, "word " * 500), (10, "x <P> y\nz"), (11, "\n" * 3_000 + "é\n" * 500)]

# Importance resampling


def brute_resample(docs, target, share=5, buckets=10_000, least=20):
    def found(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    corpus, wanted = Counter(), Counter()
    for _, t in docs:
        corpus.update(found(t)[1])
    for t in target:
        wanted.update(found(t)[1])
    s, w = sum(corpus.values()), sum(wanted.values())
    out = []
    for i, t in docs:
        words, f = found(t)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (w + buckets)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    long_enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(long_enough[: share * len(long_enough) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(row):
    return str(tuple(row))


@pytest.mark.parametrize("share", [5, 60])
def test_resampling_equals_brute_force(spark, share):
    docs = [*HARD, *((100 + i, prose(i, 5 + i % 60) + (" Deep-River é日 STONE_2" if i % 3 else "")) for i in range(200))]
    target = ["river stone quiet walks", None, "", "the OF and é日", prose(3)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(documents(spark, docs), table, share=share)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_resample(docs, target, share)))
    drawn = {r.doc_id for r in got.where("rank is not null and doc_id is not null").collect()}
    assert {r.doc_id for r in importance.drawn_documents(documents(spark, docs), table, share=share).collect()} - {None} == drawn


def test_resampling_of_nothing(spark):
    table = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = documents(spark, HARD)
    assert importance.resample(docs.limit(0), table).count() == 0
    out = importance.resample(docs, table.limit(0)).collect()
    assert len(out) == len(HARD) and {r.weight for r in out if r.doc_id in (0, 1, 8)} == {0}


def test_ties_of_score_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 60, 5, 7) for i in (9, 3, 7, 3)], "doc_id long, n_features long, weight long, score long")
    keyed = rows.select("*", (-F.col("score")).alias("_order"), F.monotonically_increasing_id().alias("_tie"))
    placed, n = importance.numbered(keyed, ["_order", "doc_id", "n_features", "_tie"], "_place")
    assert n == 4 and [r.doc_id for r in placed.orderBy("_place").collect()] == [3, 3, 7, 9]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ9_ é\n-日İ"), max_size=40))
def test_streams_hold_the_features_of_words(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    want = [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert importance.bucket_stream(text).tolist() == want and len(want) == importance.features_of(len(words))


# Fill in middle


def brute_transform(doc_id, text, rate=100, share=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < share else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("a\n\né日<PSM>"), max_size=60), st.integers(0, 10_000), st.integers(1, 9))
def test_chunks_find_the_lines(text, doc_id, chunk):
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    n, form, p, m, out = fill_in_middle.transformed(text.encode(), tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4)), chunk=chunk)
    assert (n, form, p, m, out.decode()) == brute_transform(doc_id, text)


@pytest.mark.parametrize("rate, share", [(100, 50), (40, 100)])
def test_fill_in_middle(spark, rate, share):
    rows = [*HARD, *((20 + i, "\n".join(prose(i + k, 4) for k in range(i % 9)) + "\n" * (i % 2)) for i in range(60)), (90, "a <\n<S\nS> x\n<P\n>M>\n<")]
    got = fill_in_middle.fill_in_middle(documents(spark, rows), rate=rate, suffix_first=share)
    assert sorted(map(key, got.collect())) == sorted(key((i, *brute_transform(i, t, rate, share))) for i, t in rows)
    back = got.select("doc_id", fill_in_middle.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted(map(key, back)) == sorted(key((i, t or "")) for i, t in rows)


def test_fill_in_middle_digest_and_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in HARD if i is not None]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    out = fill_in_middle.digest(docs)
    want = con.execute(fill_in_middle.ORACLE)
    assert out.columns == [d[0] for d in want.description]
    assert sorted(map(key, out.collect())) == sorted(map(key, want.fetchall()))
    assert fill_in_middle.digest(docs.limit(0)).count() == 0


# Repeated passages


def brute_removed(docs, length=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    n = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 21, 31])
def test_covers_hold_all_differences(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) == {1: 1, 2: 2, 3: 2, 7: 3, 13: 4, 21: 5, 31: 6}[period]


def spliced(seed):
    """Documents that share passages of 20 to 90 words, near copies, runs of one word, passages repeated inside one."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}_{i}" for i in range(rng.randrange(20, 90))) for k in range(8)]
    docs = []
    for i in range(60):
        parts = [prose(1_000 * seed + 10 * i + k, rng.randrange(1, 40)) for k in range(rng.randrange(1, 5))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), p)
        docs.append((i, " \n".join(parts)))
    base = prose(99 + seed, 300).split()
    for i in range(6):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"edit{i}"
        docs.append((100 + i, " ".join(words)))
    docs.append((200, passages[0] + " " + passages[0] + " x " + passages[0]))
    docs.append((201, " ".join(["same"] * 36)))
    docs.append((202, " ".join(["other"] * 35)))
    return docs


@pytest.mark.parametrize("seed, block_bytes", [(1, 1), (2, 3_000), (3, 1 << 22)])
def test_removal_equals_brute_force(spark, seed, block_bytes):
    docs = [*HARD, *spliced(seed)]
    got = substrings.remove_repeats(documents(spark, docs), block_bytes=block_bytes)
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_removed(docs)))


def test_removal_with_other_windows(spark):
    docs = spliced(4)
    got = substrings.remove_repeats(documents(spark, docs), length=12, period=7, block_bytes=2_000)
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_removed(docs, 12)))
    assert substrings.remove_repeats(documents(spark, docs).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(documents(spark, docs), length=5, period=7)


def test_equal_windows_share_an_aligned_anchor():
    rng = random.Random(5)
    shared = [f"s{i}".encode() for i in range(35)]
    for _ in range(60):
        a, b = (b" ".join([f"{name}{i}".encode() for i in range(rng.randrange(60))] + shared) for name in "ab")
        one, two = (substrings.Block([t], 35, 21).anchors()[1] for t in (a, b))
        assert len(np.intersect1d(one, two)) >= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t\x0b\x1c\xa0日"), max_size=12), max_size=6), st.integers(1, 9))
def test_words_are_hashed_alike_in_all_segments(texts, segment):
    raw = [t.encode() for t in texts]
    kept, substrings._SEGMENT = substrings._SEGMENT, segment
    try:
        block, (_, h) = substrings.Block(raw, 35, 21), substrings.hashed_words(b"\n".join(raw))
    finally:
        substrings._SEGMENT = kept
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert block.sizes.tolist() == [len(w) for w in words]
    assert len({(w, int(x)) for w, x in zip(sum(words, []), h, strict=True)}) == len(set(sum(words, []))) == len(set(h.tolist()))


def test_later_passes_leave_texts_where_they_lie(spark):
    """What passes find is joined to bucketed blocks: no exchange stands between the blocks and the join."""
    lines = substrings.remove_repeats(documents(spark, spliced(1)))._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(lines) if "texts#" in line and "FileScan" in line]
    assert scans
    for i in scans:
        join = max(k for k in range(i) if "Join" in lines[k])
        assert "Bucketed: true" in lines[i] and not any("Exchange" in line for line in lines[join:i])
