"""The ten operators on small fixtures: contracts, hard inputs, and brute force where SQL can't tell."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.llm import classifier, decontamination, jaccard, license_texts, licenses, packing, pii, quality_rules, sharding, url_filters, vocab, warc
from tapeloom.llm.common import WordHash, hot_join, shingle_hashes

WORDS = "the of and river stone quiet walks under blue hills when evening comes slowly to old towns near water".split()
LONG = " ".join(f"w{i}" for i in range(3_000))


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.6 else "") for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", -1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n long")


@pytest.fixture(scope="module")
def hard(spark):
    """Null and empty texts, a long one, copies, ties, null and repeated ids, columns with clashing names."""
    base = prose(1)
    rows = [(0, None), (1, ""), (2, LONG), (3, base), (4, base), (5, base + " one more word"), (5, base + " one more word"), (None, prose(2)), (7, "a  b\n\tc é ü 日本語  x"), (8, "!!! ### $$$")]
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], "doc_id long, text string, n string, name long, shard string, sequence_id long")


# Vocabularies and packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t '12# 日s"), max_size=40), min_size=1, max_size=5))
def test_kept_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    if not hasattr(test_kept_ids_are_the_tokenizers, "t"):
        test_kept_ids_are_the_tokenizers.t = Tokenizer.from_file(vocab.path_of("byte_bpe_50k.json"))
    want = [e.ids for e in test_kept_ids_are_the_tokenizers.t.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for b in vocab.loaded(vocab.ByteBpe, "byte_bpe_50k.json", None).ids_of(texts)]
    assert got == want


def test_special_tokens_keep_their_ids():
    ids = np.frombuffer(vocab.loaded(vocab.ByteBpe, "byte_bpe_50k.json", None).ids_of(["<|endoftext|> x"])[0], "<u4")
    assert ids.tolist() == [50256, 2124]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_places_all_and_the_bound_holds(lengths):
    x = np.array(lengths, np.int64)
    place, offset, fill = packing.best_fit_decreasing(x, 64)
    spans = {}
    for b, o, n in zip(place.tolist(), offset.tolist(), lengths, strict=True):
        spans.setdefault(b, []).append((o, n))
    for b, of in spans.items():
        end = 0
        for o, n in sorted(of):
            assert o == end
            end += n
        assert end == fill[b] <= 64
    assert packing.lower_bound(np.bincount(x, minlength=65)) <= len(fill)


def test_bound_sees_large_pieces():
    counts = np.zeros(65, np.int64)
    counts[33] = 10
    assert packing.lower_bound(counts) == 10  # by volume alone it would be 6


def test_packing_contract(spark, hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.path_of("byte_bpe_50k.json"))
    rows = packing.pack_documents(hard).collect()
    texts = {r.doc_id: r.text for r in hard.collect()}
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in hard.collect())
    for r in rows:
        ids = np.array(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length <= 1024 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in bins.values():
        end = 0
        for o, n in sorted(of):
            assert o == end
            end += n
        assert end <= 1024
    assert {r.total_bound for r in rows} == {packing.lower_bound(np.bincount([r.length for r in rows], minlength=1025))}
    assert all(r.partition_bound <= r.partition_bins for r in rows) and sum({r.sequence_id >> 32: r.partition_bins for r in rows}.values()) == len(bins)
    assert packing.pack_documents(hard.limit(0)).count() == 0


def test_gaps_are_repacked_over_rounds(spark):
    pieces = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (300 + F.col("id") * 37 % 424).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    many = packing.pack(pieces, pieces_a_task=20)
    n = many.select("sequence_id").distinct().count()
    whole = packing.pack(pieces).select("sequence_id").distinct().count()
    assert many.count() == 400 and whole <= n <= 1.1 * whole  # tasks of 20 pieces of half a sequence each are the worst case


@pytest.mark.parametrize("low, high", [(260, 501), (300, 724), (30, 200), (513, 1_025)])
def test_no_task_gets_more_than_its_share(spark, low, high):
    """Loose bounds release many bins: they are dealt to as many tasks as they need, and rounds end when they save nothing."""
    draw = random.Random(low)
    pieces = spark.createDataFrame([(i, 0, 0, draw.randrange(low, high), i) for i in range(6_000)], packing.PIECE_SCHEMA)
    rows = packing.pack(pieces, pieces_a_task=500).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6_000))
    tasks, bins = Counter(r.sequence_id >> 32 for r in rows), {}
    assert max(tasks.values()) < 700  # 500 by a hash
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in bins.values():
        assert [o for o, _ in sorted(of)] == [sum(n for _, n in sorted(of)[:k]) for k in range(len(of))] and sum(n for _, n in of) <= 1024
    assert sum({r.sequence_id >> 32: r.partition_bins for r in rows}.values()) == len(bins)
    assert all(r.partition_bound <= r.partition_bins for r in rows) and {r.total_bound for r in rows} == {packing.lower_bound(np.bincount([r.length for r in rows], minlength=1025))}
    place, _, fill = packing.best_fit_decreasing(np.array([r.length for r in rows], np.int64))
    assert len(bins) <= 1.02 * len(fill)


# Quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x0b é#|日"), max_size=120))
def test_base_counts(text):
    assert quality_rules.base_counts(text)[:5] == brute_counts(text)


def test_quality_query(spark, hard):
    rows = {r.doc_id: r for r in quality_rules.quality_measures(hard).collect()}
    for r in hard.collect():
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute_counts(r.text)
        assert got.base_failed == (got.n_words < 50 or 2 * got.n_repeat_words > got.n_words)
    assert not rows[0].kept and rows[3].kept
    junk = [" ".join("ab" + chr(0x1F300 + i) * 2 for i in range(80)), " ".join("%d|" % (i * 7919 % 10007) for i in range(90))]
    assert [r.rejected_by for r in quality_rules.quality_measures(documents(spark, junk)).orderBy("doc_id").collect()] == ["script"] * 2
    assert quality_rules.quality_measures(hard.limit(0)).count() == 0
    kept = quality_rules.keep_documents(hard)
    assert kept.columns == hard.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abtheingER'é#|日🌍12.,"), min_size=1, max_size=12), min_size=1, max_size=30))
def test_measures_are_the_tokenizers(words):
    import sentencepiece
    import tiktoken

    pieces = vocab.loaded(vocab.Pieces, "piece_bpe_32k.model", "byte_bpe_50k.json", None)
    text = " ".join(words)
    got = dict(zip(quality_rules._JUDGED.names, quality_rules.judge(text, pieces), strict=True))
    if not hasattr(test_measures_are_the_tokenizers, "coder"):
        test_measures_are_the_tokenizers.coder = sentencepiece.SentencePieceProcessor(model_file=vocab.path_of("piece_bpe_32k.model"))
        assert isinstance(pieces.bpe.__self__, tiktoken._tiktoken.CoreBPE)
    coder = test_measures_are_the_tokenizers.coder
    ids = [i for w in words for i in coder.encode(w)]
    bpe = [i for w in words for i in pieces.bpe(" " + w)]
    chars = sum(map(len, words))
    assert ids == coder.encode(text) and bpe == pieces.bpe(" " + text)
    assert got["piece_chars_per_token"] == chars / len(ids) and got["bpe_chars_per_token"] == chars / len(bpe)
    assert got["byte_share"] == sum(map(coder.is_byte, ids)) / len(ids)
    share = np.array(list(Counter(ids).values())) / len(ids)
    assert abs(got["token_entropy"] + float(share @ np.log2(share))) < 1e-9


def verdicts_by_hand(docs, got, pool=20):
    """rejected_by of each row: bands of language and size from medians and quartiles, pooled with the language's line over sizes."""
    pieces = vocab.loaded(vocab.Pieces, "piece_bpe_32k.model", "byte_bpe_50k.json", None)
    judged = {r.doc_id: dict(zip(quality_rules._JUDGED.names, quality_rules.judge(r.text, pieces), strict=True)) for r in docs.collect()}
    out = {i: "base" if x["base_failed"] else None if x["script_fine"] else "script" for i, x in judged.items()}
    groups = {}
    for i, r in got.items():
        if not r.base_failed and r.language:
            groups.setdefault(r.language, {}).setdefault(int(np.floor(2 * np.log2(max(1, judged[i]["n_pieces"])))), []).append(i)
    for m, (least, below, above) in quality_rules.MEASURES.items():
        stats, up, down = {}, 0.0, 0.0
        for language, steps in groups.items():
            rows = [(t, len(of), *np.quantile(np.round([judged[i][m] for i in of], 3), (0.25, 0.5, 0.75))) for t, of in steps.items()]
            n = np.array([r[1] for r in rows], float)
            w = n * n / (n + pool)
            at = np.array([r[0] for r in rows]) - w @ [r[0] for r in rows] / w.sum()
            mids = np.array([r[3] for r in rows])
            mean = w @ mids / w.sum()
            stats[language] = rows, n, at, mean, w @ (at * (mids - mean)), w @ (at * at)
            up, down = up + stats[language][4], down + stats[language][5]
        for language, (rows, n, at, mean, sxy, sxx) in stats.items():
            slope = (sxy + pool * up / (down + pool)) / (sxx + pool)
            wide = {side: (sum(r[1] * abs(r[3] - r[k]) / 0.6745 for r in rows) + pool * quality_rules.WIDE[m]) / (n.sum() + pool) for side, k in (("low", 2), ("high", 4))}
            for (t, k, low, mid, high), x in zip(rows, at, strict=True):
                centre = (k * mid + pool * (mean + slope * x)) / (k + pool)
                least_low, least_high = (max((k * d / 0.6745 + pool * wide[side]) / (k + pool), least) for side, d in (("low", mid - low), ("high", high - mid)))
                for i in groups[language][t]:
                    if out[i] is None and (below and judged[i][m] < centre - below * least_low or above and judged[i][m] > centre + above * least_high):
                        out[i] = m
    return out


def test_few_documents_have_bands_too(spark):
    """No group is too small for a verdict: five documents of a language, and twenty of many sizes."""
    few = [(i, prose(70_000 + i, 60 + 40 * i), "de") for i in range(5)] + [(10 + i, prose(71_000 + i, 60 * (i + 1)), "fr") for i in range(20)]
    odd = [(50, " ".join(f"er|nd|{k % 9}" + "ha" * (k % 7) for k in range(200)), "fr"), (51, None, "fr"), (52, "", "de"), (53, prose(9, 80), None)]
    docs = spark.createDataFrame(few + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_measures(docs).collect()}
    assert verdicts_by_hand(docs, got) == {i: r.rejected_by for i, r in got.items()}
    assert all(got[i].kept for i, *_ in few) and got[53].kept
    assert quality_rules.quality_measures(docs.limit(0)).count() == 0


def test_language_bands_reject_what_the_base_keeps(spark):
    rng = random.Random(1)

    def odd(i):  # many different words, but of few pieces
        return " ".join("".join(rng.choice(["er", "ha", "nd", "|"]) for _ in range(3)) + str(k % 3) for k in range(118 + i))
    rows = [(i, prose(40_000 + i, 110 + i % 9), "en-GB", 1, None, "m") for i in range(300)] + [(1_000 + i, odd(i), "EN", 1, None, "m") for i in range(3)] + [(2_000, odd(1), "xx-unknown-language", 1, None, "m"), (2_001, odd(1), None, 1, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, told string, `n_words.x` string")
    got = {r.doc_id: r for r in quality_rules.quality_measures(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(300)) >= 298 and not any(got[1_000 + i].kept for i in range(3))
    assert {got[1_000 + i].rejected_by for i in range(3)} <= set(quality_rules.MEASURES) and got[2_000].kept and got[2_001].kept
    assert verdicts_by_hand(docs, got) == {i: r.rejected_by for i, r in got.items()}
    kept = quality_rules.keep_documents(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_bands_reject_by_script():
    band = quality_rules.SCRIPT_BANDS["latin"]
    assert quality_rules.accepted(band, 400, 180, 0, 6.5, 200)
    assert not quality_rules.accepted(band, 400, 390, 0, 6.5, 200)  # too few characters a token
    assert not quality_rules.accepted(band, 400, 180, 60, 6.5, 200)  # byte fall-backs
    assert not quality_rules.accepted(band, 400, 180, 0, 1.0, 200)  # few different tokens
    assert quality_rules.script_of("привет мир") == "cyrillic" and quality_rules.script_of("日本語 x") == "cjk"


# Jaccard join


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    rng = random.Random(5)
    texts = [None, "", "one two", "ONE two", "a b c d e", LONG, LONG + " x"]
    for g in range(6):
        base = prose(100 + g, 60 + 20 * g).split()
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            texts.append(" ".join(w))
    passage = prose(999, 55)
    texts += [prose(300 + i, 40) + " " + passage + " " + prose(400 + i, 30) for i in range(12)]
    return texts


@pytest.mark.parametrize(("short", "block"), [(24, 4_000_000), (2, 400)])
def test_components_equal_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    texts = near_copies()
    docs = documents(spark, texts)
    want = brute_components(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == want
    if short == 24:
        assert {r.doc_id for r in jaccard.one_of_each(docs).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_components_of_hard_rows(spark, hard):
    got = jaccard.jaccard_components(hard).collect()
    assert len(got) == 10 and {(r.doc_id, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {(3, 3), (4, 3), (5, 3)}
    assert jaccard.jaccard_components(hard.limit(0)).count() == 0


def test_near_copies_of_null_and_repeated_ids(spark):
    base = [prose(60 + i, 100) for i in range(2)]
    near = [t + " at its end" for t in base]
    further = [t + " and a little more" for t in near]
    rows = [(10, base[0]), (None, near[0]), (12, further[0]), (None, near[0]), (20, base[1]), (21, near[1]), (21, prose(99, 100)), (30, "alone"), (None, "alone too")]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, _gone string, row_key int, `meta.src` int")
    got = {(r.doc_id, r.n_shingles > 1, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(10, True, 10), (None, True, 10), (12, True, 10), (20, True, 20), (21, True, 20), (21, True, 21), (30, False, 30), (None, False, None)}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[4], rows[6], rows[7], rows[8]]))


@pytest.mark.parametrize("block", [4_000_000, 3_000])
def test_one_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):  # edits of one text: some link with the first, some only with others, some with none
        w = list(base)
        for k in rng.sample(range(80), rng.randrange(0, 8)):
            w[k] = f"e{rng.randrange(60)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 100 + [""] * 60
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(1000), 400)
    edges = [*zip(names[:150], names[1:151], strict=False), *((names[200], x) for x in names[201:260]), (names[300], names[301]), (names[301], names[300]), (names[310], names[310])]
    got = {(r.v, r.c) for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = [names[:151], names[200:260], names[300:302]]
    assert got == {(v, min(part)) for part in parts for v in part}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 1, i) for i in range(200)] + [(None, -1)] * 30, "k long, v long")
    right = spark.createDataFrame([(k, k * k) for k in range(5)], "k long, w long")
    for how in ("inner", "left"):
        for share in (3, 1_000):
            assert Counter(map(tuple, hot_join(left, right, "k", how, share).select("k", "v", "w").collect())) == Counter(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), max_size=30))
def test_sketches_lose_no_link(a, change):
    b = (a ^ change) or a
    salt = lambda s: np.sort(np.array([hash((x, 17)) & (2**64 - 1) for x in s], np.uint64))
    x, y = salt(a), salt(b)
    if 4 * len(a & b) >= 3 * len(a | b):
        assert jaccard.may_link(len(x), jaccard.sketch(x), len(y), jaccard.sketch(y))
        assert jaccard.may_link(len(x), jaccard.narrowed(len(x), jaccard.sketch(x)), len(y), jaccard.narrowed(len(y), jaccard.sketch(y)))
        assert jaccard.divide_skip([x, y]).root(1) == 0
        order = set(x[: jaccard.index_part(len(x))].tolist()) & set(y[: jaccard.index_part(len(y))].tolist())
        assert order  # the index part of one meets that of the other
    else:
        assert jaccard.divide_skip([x, y]).root(1) == 1


def test_shingles_of_short_texts():
    h = WordHash()
    assert len(shingle_hashes([b"a"], h)) == 1 and len(shingle_hashes([], h)) == 0
    assert shingle_hashes([b"a", b"b"], h)[0] != shingle_hashes([b"b", b"a"], h)[0]


# URL filters


def test_lists_as_of_the_fetch(spark):
    pages = spark.createDataFrame([(1, "http://a.bad.com/x/y?q", "2024-01-05"), (2, "http://a.bad.com/x", "2024-02-05"), (3, "https://u@bad.com:80/ok/1", "2024-01-10"), (4, None, "2024-01-10"), (5, "nonsense", "2024-01-10"), (6, "http://bad.com/", None), (7, "http://bad.com/", "2024-01-01"), (7, "http://bad.com/", "2024-01-01")], "page_id long, url string, fetched_on string")
    events = spark.createDataFrame([("bad.com", "block", "2024-01-01"), ("BAD.com", "remove", "2024-02-01"), ("bad.com/ok", "allow", "2024-01-08"), ("a.bad.com", "block", "2024-02-05"), (None, "block", "2024-01-01"), ("x.com", "block", None)], "entry string, action string, listed_on string")
    got = sorted((r.page_id, r.matched_entry, r.kept) for r in url_filters.judge_captures(pages, events).collect())
    want = [(1, "bad.com", False), (2, "a.bad.com", False), (3, "bad.com/ok", True), (4, None, True), (5, None, True), (6, None, True), (7, "bad.com", False), (7, "bad.com", False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filters.judge_captures(pages, events.limit(0)).where("kept").count() == 8
    assert url_filters.judge_captures(pages.limit(0), events).count() == 0
    plan = url_filters.judge_captures(pages, events)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deep_entries_and_times_within_a_day(spark):
    at = ["2024-01-31 09:00:00", "2024-01-31 11:00:00", "2024-02-01 01:00:00", "2024-02-01 05:00:00"]
    pages = spark.createDataFrame([(k, "http://h.com/a/b/c/d?x", t) for k, t in enumerate(at)] + [(9, "http://h.com/a/b/x", at[3])], "page_id long, url string, fetched_on string")
    events = spark.createDataFrame([("h.com/a/b/c", "block", "2024-01-31 08:00:00"), ("h.com/a/b/c", "remove", "2024-01-31 10:00:00"), ("h.com/a/b/c", "block", "2024-01-31 12:00:00"), ("h.com/a/b/c", "remove", "2024-02-01 04:00:00")], "entry string, action string, listed_on string")
    got = {r.page_id: (r.matched_entry, r.kept) for r in url_filters.judge_captures(pages, events).collect()}
    assert got == {0: ("h.com/a/b/c", False), 1: (None, True), 2: ("h.com/a/b/c", False), 3: (None, True), 9: (None, True)}


# Licences


def test_licences_and_inheritance(spark):
    files = spark.createDataFrame([(1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/b/f.txt", "plain words"), (3, "p/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "p/a/b/g.txt", "x\nLicensed under CC BY-NC 4.0.\ny"), (5, "q/f.txt", "nothing"), (6, None, None), (7, "p/h.txt", ""), (8, "LICENSE", "This work is licensed under the GNU General Public License, version 3."), (8, "z/i.txt", "the license of poetry is wide")], "file_id long, path string, text string")
    got = {(r.file_id, r.path): (r.license, r.source, r.from_path) for r in licenses.scan_licenses(files).collect()}
    assert got[(1, "p/LICENSE")] == ("MIT", "own", None) and got[(2, "p/a/b/f.txt")] == ("Apache-2.0", "inherited", "p/a/LICENSE")
    assert got[(4, "p/a/b/g.txt")] == ("CC-BY-NC-4.0", "own", None) and got[(7, "p/h.txt")] == ("MIT", "inherited", "p/LICENSE")
    assert got[(5, "q/f.txt")] == ("GPL-3.0", "inherited", "LICENSE") and got[(6, None)] == (None, "none", None)
    assert got[(8, "z/i.txt")] == ("GPL-3.0", "inherited", "LICENSE")
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_term_frequencies_are_over_all_files(spark):
    texts = [None, "", "Released under the MIT License.", "(license), no-cue: \"permitted\"", "under the hill", "Licensed to the public", prose(4_000)] + ["This work is licensed under a license."] * 40 + [prose(4_001 + i) for i in range(150)]
    got, total = licenses.term_frequencies(documents(spark, texts))
    wanted = {w for _, t, _ in licenses.TEMPLATES for w in licenses.terms(t)}
    plain = Counter(w for t in texts for w in wanted & set(licenses.terms(t or "")))
    assert total == len(texts) and {w: n for w, n in got.items() if n} == plain and got["license"] == 42
    scanner = licenses.Scanner(got, total)
    assert scanner.scan("Released under the MIT License.")[0] == "MIT" and scanner.scan("Licensed under the Foo License.")[0] is None


def wrapped(text, width=70, mark="# "):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(mark + line)
            line = ""
        line += w + " "
    return "\n".join([*lines, mark + line])


LICENCE_CASES = [
    ("MIT", "Copyright (c) 2020 Some One\n\n" + license_texts.MIT),
    ("MIT", "// no title\n" + wrapped(license_texts.MIT, 50, " * ") + "\nint main() { return 0; }"),
    ("BSD-2-Clause", "Copyright 2019 X.\n" + license_texts.BSD_HEAD + "\n" + license_texts.BSD_TAIL),
    ("BSD-3-Clause", "Copyright 2019 X.\n" + "\n".join([license_texts.BSD_HEAD, license_texts.BSD_THIRD, license_texts.BSD_TAIL])),
    ("ISC", license_texts.ISC),
    ("Apache-2.0", wrapped(license_texts.APACHE_HEADER)),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n" + license_texts.APACHE_OPENING[33:] + " " + prose(5_000, 900)),
    ("GPL-3.0", wrapped(license_texts.GNU_HEADER.format(name=license_texts.GPL, version=3)) + "\nimport os\n" + prose(5_001, 80)),
    ("GPL-2.0", wrapped(license_texts.GNU_HEADER.format(name=license_texts.GPL, version=2), 40)),
    ("LGPL-2.1", wrapped(license_texts.GNU_HEADER.format(name=license_texts.LGPL, version="2.1"))),
    ("AGPL-3.0", license_texts.GNU_OPENING.format(name=license_texts.AGPL, version=3, date="19 November 2007", years=2007) + prose(5_002, 700)),
    ("Apache-2.0", prose(5_003, 60) + "\n# SPDX-License-Identifier: Apache-2.0\n" + prose(5_004, 60)),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */ x = 1"),
    ("MIT", "x = 1\n# Permission is hereby granted, free of charge, to any person\n" + wrapped(license_texts.MIT.split("any person", 1)[1], 45)),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."),
    (None, "The license of poetry is wide, and the permission to read it is granted to any person."),
    (None, prose(5_005, 300)),
    (None, "Licensed under the Foo License, Version 9."),
    (None, ""),
    (None, None),
]


def brute_licence(text, frequency, files):
    """Every run of words against every template, by dictionaries."""
    words = re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", (text or "").lower())
    known = {w for _, t, _ in licenses.TEMPLATES for w in licenses.terms(t)}
    idf = lambda w: np.log((1 + files) / (1 + frequency.get(w, 0))) + 1 if w in known else np.log(1 + files) + 1
    best = (0.0, None)
    for name, t, needed in licenses.TEMPLATES:
        c = licenses.terms(t)
        b = {w: n * idf(w) for w, n in c.items()}
        for part in (1.0, 0.75):
            n = min(len(words), max(1, int(np.ceil(part * sum(c.values())))))
            for at in range(len(words) - n + 1 if words else 0):
                run = Counter(words[at : at + n])
                if set(needed) <= set(run):
                    a = {w: k * idf(w) for w, k in run.items() if w in known}
                    others = sum(k for w, k in run.items() if w not in known) * idf("\0") ** 2  # each by itself
                    norm = np.sqrt(sum(x * x for x in a.values()) + others) * np.sqrt(sum(x * x for x in b.values()))
                    found = sum(x * b.get(w, 0) for w, x in a.items()) / norm
                    if found > best[0] + 1e-9:
                        best = (found, name)
    return best if best[0] >= licenses.LEAST_COSINE else (None, None)


def test_whole_licences_headers_and_identifiers(spark):
    texts = [t for _, t in LICENCE_CASES] + [prose(6_000 + i, 60) for i in range(40)]
    files = spark.createDataFrame([(i, f"r/f{i}.txt", t, "x", 1) for i, t in enumerate(texts)], "file_id long, path string, text string, dir string, `own.license` int")
    got = {r.file_id: r for r in licenses.scan_licenses(files).collect()}
    assert [got[i].license for i in range(len(LICENCE_CASES))] == [name for name, _ in LICENCE_CASES]
    frequency, total = licenses.term_frequencies(files)
    for i in (2, 3, 5, 8, 11, 12, 14, 15, 17, 18, 19, 25):
        cosine, name = brute_licence(texts[i], frequency, total)
        assert name == got[i].license and (name is None or abs(cosine - got[i].cosine) < 1e-6)


def test_hot_directories(spark):
    rows = [(i, f"a/b{i % 3}/c{i % 5}/f{i}", "words", 0) for i in range(300)] + [(1_000, "a/LICENSE", "Released under the MIT License", 0), (1_001, "a/b1/LICENSE", "ISC License", 0), (1_002, "a/b1/NOTICE", "The MIT License (MIT)", 0), (1_003, "a/b2/c1/LICENSE", "SPDX-License-Identifier: Zlib", 0)]
    got = {r.file_id: (r.license, r.from_path) for r in licenses.scan_licenses(spark.createDataFrame(rows, "file_id long, path string, text string, above int")).collect()}
    for i in range(300):
        want = "a/b2/c1/LICENSE" if i % 3 == 2 and i % 5 == 1 else "a/b1/" if i % 3 == 1 else "a/LICENSE"
        assert got[i][1].startswith(want), i


# Decontamination


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(700 + i, n)) for i, n in enumerate((20, 30, 45, 60, 25, 6))] + [(9, None), (10, "")]
    rng = random.Random(3)
    texts = [None, "", LONG]
    for i, (_, item) in enumerate(items[:6]):
        w = item.split()
        texts.append(prose(800 + i, 90) + " " + item.upper() + " " + prose(810 + i, 90))
        if len(w) > 10:
            for k in rng.sample(range(len(w)), len(w) // 8):
                w[k] = "changed"
            texts.append(prose(820 + i, 70) + "\n" + " ".join(w) + ".\n" + prose(830 + i, 70))
    texts += [prose(900 + i, 200) for i in range(20)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    want = decontamination.brute_force(list(enumerate(texts)), [x for x in items if x[1] and len(x[1].split()) >= 8])
    assert got >= want and (13, 5) in got  # the item of six words stands whole in document 13
    assert not {d for d, _ in got} & set(range(len(texts) - 20, len(texts))) and not {d for d, _ in got} & {0, 1, 2}
    left = {r.doc_id for r in decontamination.clean_documents(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), bench).count() == 0


def test_no_leak_of_short_unaligned_or_edited_items_is_lost(spark):
    items = [(i, prose(2_000 + i, n)) for i, n in enumerate((8, 9, 12, 15, 18, 25, 40, 59) * 3)]
    rng = random.Random(8)
    texts = []
    for i, item in items:
        w = item.split()
        if i >= 8:  # every fourth word changed at most
            for k in rng.sample(range(len(w)), len(w) // 4):
                w[k] = f"edit{k}"
        around = [f"other{rng.randrange(10**6)}" for _ in range(2 * rng.randrange(3, 60) + 1)]
        cut = len(around) // 2
        texts.append(" ".join(around[:cut] + w + around[cut:]))
    texts += [prose(2_100 + i, 400) for i in range(20)]
    want = decontamination.brute_force(list(enumerate(texts)), items)
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect() if r.lcs_share >= 0.7}
    assert got == want >= {(i, i) for i, _ in items}


def test_long_items_have_one_verdict(spark):
    # The words around and in the items are of one vocabulary, as in prose.
    items = [(i, prose(3_000 + i, n)) for i, n in enumerate((100, 200, 300, 400, 430, 700, 1_000, 2_100))]
    texts = [prose(3_100 + i, 150) + " " + item + " " + prose(3_200 + i, 77) for i, item in items]
    texts += [prose(3_300 + i, 60) + " " + " ".join(items[i][1].split()[-400:]) for i in (4, 6)]  # 400 of 430 words, 400 of 1,000
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontamination.leaks(docs, bench).collect() if r.lcs_share >= 0.7}
    assert {k: v for k, v in got.items() if k != (8, 4)} == {(i, i): 1.0 for i in range(8)} and got[(8, 4)] >= 400 / 430
    assert set(got) == decontamination.brute_force(list(enumerate(texts)), items)


def test_paraphrases_that_keep_the_answer(spark):
    rng = random.Random(21)
    items, texts = [], []
    for i in range(40):
        words = [f"u{i}x{k}" if k % 4 == 1 else rng.choice(WORDS) for k in range(30)]
        answer = [words[5], words[17], words[29]]
        items.append((i, " ".join(words), " ".join(answer)))
        changed = list(words)
        for k in rng.sample([k for k in range(30) if words[k] not in answer], 13):
            changed[k] = f"other{rng.randrange(10**6)}"
        if i % 2:  # without its answer, such a change is no leak
            changed = [f"gone{k}" if w in answer else w for k, w in enumerate(changed)]
        texts.append(prose(7_000 + i, 90) + " " + " ".join(changed) + " " + prose(7_100 + i, 90))
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()}
    assert len({(i, i) for i in range(0, 40, 2)} & set(got)) >= 18 and not {(i, i) for i in range(1, 40, 2)} & set(got)
    assert all(r.lcs_share >= 0.7 or r.lcs_share >= 0.5 and r.answer_share >= 0.6 for r in got.values()) and all(0 < r.cosine <= 1.0001 for r in got.values())


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, prose(4_000 + i, 8 + i % 50)) for i in range(60)] + [(100 + i, f"short {i} item") for i in range(5)]
    texts = [prose(4_100 + i, 80) + " " + items[i][1] + " " + prose(4_200 + i, 300) for i in range(0, 60, 3)] + ["so short 3 item is there", "a b"]
    docs, bench = documents(spark, texts * 2).withColumn("item_id", F.lit("x")).withColumn("a.b", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id, r.lcs) for r in decontamination.leaks(docs, bench).collect()}
    assert {(k, i, len(decontamination.terms_of(items[i][1]))) for k, i in enumerate(range(0, 60, 3))} <= whole and (20, 103, 3) in whole and (42, 103, 3) in whole
    blocks = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda b: blocks(b, 60, 1_000))
    assert len(list(decontamination.item_blocks(bench))) > 5
    assert {(r.doc_id, r.item_id, r.lcs) for r in decontamination.leaks(docs, bench).collect()} == whole
    kept = decontamination.clean_documents(docs, bench)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {21, 43}


@pytest.mark.parametrize("fit_passages", [500, 2_000, 20_000])
def test_fitting_sample_has_its_size_in_a_large_table(spark, fit_passages):
    total, seed = 40_000, 11
    numbers = decontamination.Numbers({b"a": 0})
    docs = spark.range(4_000).select("id", F.repeat(F.lit("a "), 640).alias("text")).toDF("doc_id", "text")
    portion = fit_passages / total
    rows = ((r.doc_id, r.text) for r in decontamination.sampled_documents(docs, portion, seed).toLocalIterator())
    n = sum(1 for _ in decontamination.fit_sample(rows, numbers, portion, seed))
    assert 0.8 * fit_passages < n < 1.2 * fit_passages


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert decontamination.common_subsequence(a, b) == t[-1][-1]


# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n)
    p = f.place(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and f.inverse(p).tolist() == list(range(n))
    assert n < 64 or p.tolist() != list(range(n))


def test_shards(spark, hard):
    def run(df):
        return sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.assign_shards(df, 3).collect()), key=str)

    rows = run(hard)
    assert rows == run(hard.repartition(5)) and len(rows) == 10
    counts = Counter(r[4] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r[5] for r in rows if r[4] == s) == list(range(n)) for s, n in counts.items())
    for r in hard.collect():
        data = (r.text or "").encode()
        assert any(x[0] == r.doc_id and x[1] == len(data) + 16 and x[2] == zlib.crc32(data) for x in rows)
    assert sharding.assign_shards(hard.limit(0)).count() == 0


# Archives


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + prose(1, 400) + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", big), (7, "é", "<p>é\u0000\r\n\r\n</p>" * 30), (2, "again", big)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest long, record_type string")
    got = warc.page_records(pages).collect()
    texts = {}
    for i, _, h in rows:
        texts.setdefault(i, h)
    first = 1
    assert len(got) == len(rows)
    for r in got:
        data = (texts[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = texts[r.page_id] == big and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert warc.page_records(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    many = spark.createDataFrame([(i, "u", prose(i, 60)) for i in range(60)], "page_id long, url string, html string")
    warc.write_archives(many.coalesce(1), path, records_a_file=25)
    back = warc.read_archives(spark, path)
    assert {(r.page_id, r.payload.decode()) for r in back.collect()} == {(i, prose(i, 60)) for i in range(60)}


def archive_of(n=80, size=400):
    records = [warc.record(i, f"http://h/{i}", prose(i, size).encode(), hashlib.sha256(prose(i, size).encode()).hexdigest(), None) for i in range(n)]
    return b"".join(x + warc.SEPARATOR for x in warc.archive(iter(records)))


def test_dictionary_leads_and_frames_are_records():
    data = archive_of()
    kinds = [k for k, _ in warc.frames(data)]
    assert kinds[0] == "dictionary" and kinds[1:] == ["record"] * 80
    assert [r[0] for r in warc.read_archive(data)] == list(range(80))


def test_damage_is_found():
    import struct

    import zstandard

    data = archive_of(20)
    at = data.index(struct.pack("<I", warc.FRAME), 20_000 if len(data) > 20_000 else 100)
    for bad in (data[:-20], data[: at + 9] + bytes([data[at + 9] ^ 0xFF]) + data[at + 10 :], b"junk" * 5):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_archive(bad))
    good = warc.record(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), None)
    for wrong in (good.replace(b"Content-Length: 1\r\n\r\nx", b"Content-Length: 2\r\n\r\nx"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good + b"tail", good.replace(b"\r\n\r\nx", b"\r\n\r\ny")):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_archive(zstandard.ZstdCompressor().compress(wrong)))


# Personal data

CASES = ["a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567. +12 3", None, "", "1 2 3 4 5 6 7 8 " * 2_000, "9" * 5_000, "é passport: 12345678-9 and 12345678-9", "GB82WEST12345698765432 xGB82WEST12345698765432 GB82WEST12345698765431"]


def luhn(digits):
    return sum((2 * d - 9 if 2 * d > 9 else 2 * d) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_personal_data(spark):
    docs = documents(spark, CASES)
    out = pii.span_digest(docs)
    rows = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(CASES):
        assert rows[i].base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest(), text
    assert rows[8].spans == "account:12:22,account:27:37" and rows[9].spans == "iban:0:22"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[0] == "<email><email> x@y" and redacted[4] is None and redacted[6] == CASES[6]
    assert pii.redact(docs).columns == docs.columns and pii.span_digest(docs.limit(0)).count() == 0


def brute_redacted(text, spans):
    """Replaces overlapping spans as one, by the first one's kind."""
    out, at, groups = [], 0, []
    for span in filter(None, spans.split(",")):
        kind, s, e = span.rsplit(":", 2)
        if groups and int(s) < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], int(e))
        else:
            groups.append([kind, int(s), int(e)])
    for kind, s, e in groups:
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join(out) + text[at:]


def test_many_matches_in_one_text(spark):
    """Blocks of matches meet at their edges; a text of thousands of matches is no slow case."""
    import time

    rng = random.Random(4)
    parts = [lambda i: f"user{i}.x@mail{i % 7}.example.com", lambda i: f"10.{i % 256}.3.4", lambda i: "4111 1111 1111 1111", lambda i: f"+49 (30) 123-{4000 + i}", lambda i: f"é日 passport {10_000_000 + i}", lambda i: "GB82WEST12345698765432", lambda i: f"a@b.c{i}.d 1.2.3.4@x.y"]
    texts = [" ".join(rng.choice(parts)(i) for i in range(n)) for n in (63, 64, 65, 129, 700)]
    docs = documents(spark, texts)
    spans = {r.doc_id: r for r in pii.span_digest(docs).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        assert spans[i].base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest()
        assert redacted[i] == brute_redacted(text, spans[i].spans) and len(spans[i].spans.split(",")) > 60
    long = documents(spark, [" ".join(f"user{i}@mail.example.com" for i in range(40_000))])
    began = time.time()
    assert pii.span_digest(long).first().n_email == 40_000 and pii.redact(long).first().text == " ".join(["<email>"] * 40_000)
    assert time.time() - began < 60


# Classifier


def test_classifier_learns_and_holds_out(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + ("###" if k % 2 else "$$$") for k, w in enumerate(prose(i, 40).split())) if bad else prose(i, 60)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (1002, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in classifier.score(docs, classifier.train(docs, marks)).collect()}
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [(r.predicted, 0 if i % 4 == 0 else 1) for i, r in out.items() if r.held_out and i < 600]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.score(docs, classifier.train(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in out.items()}  # labels that are held out change nothing
    none = classifier.train(docs, marks.limit(0))
    assert classifier.score(docs, none).first().score == 0.5 and classifier.score(docs.limit(0), none).count() == 0


def test_dual_coordinate_descent_separates():
    rows = [(np.array([0, 1]), np.array([1.0, 0.5])), (np.array([2]), np.array([1.0]))] * 10
    y = np.array([1, -1] * 10)
    w = classifier.dual_coordinate_descent(rows, y, 3)
    assert all(y[i] * (w[c] @ v + w[-1]) > 0.9 for i, (c, v) in enumerate(rows))


def test_hard_rows_of_the_other_operators(spark, hard):
    """Null, empty and long texts, copies, repeated and null ids, columns that clash with what the operators make."""
    n = hard.count()
    odd = hard.withColumns({"_pii_text": F.lit(1), "_pii_spans": F.lit("s"), "own": F.lit(2), "n_email": F.lit(3)}).withColumn("meta.src", F.lit("m"))
    spans = pii.span_digest(odd).collect()
    assert len(spans) == n and all(r.spans == "" and r.n_email == 0 for r in spans)
    redacted = pii.redact(odd)
    assert redacted.columns == odd.columns and sorted(map(str, redacted.collect())) == sorted(map(str, odd.collect()))
    assert decontamination.leaks(odd, spark.createDataFrame([(1, LONG), (2, None), (None, "a b c")], "item_id long, text string")).select("doc_id", "item_id").collect() == [(2, 1)]
    scores = classifier.score(odd.withColumn("score", F.lit("x")), classifier.Model(weights={"the": 1.0}, slope=1.0)).collect()
    assert len(scores) == n and {r.score for r in scores if r.doc_id in (0, 1)} == {0.5}
    files = odd.select(F.col("doc_id").alias("file_id"), F.lit("a/b/c.txt").alias("path"), "text", F.lit(1).alias("dir"), F.lit(2).alias("inherited"))
    assert {(r.license, r.source) for r in licenses.scan_licenses(files).collect()} == {(None, "none")}
    pages = odd.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.com/"), "text").alias("url"), F.lit("2024-01-05").alias("fetched_on"), F.lit(1).alias("_row"), F.lit(2).alias("slot"))
    assert url_filters.judge_captures(pages, spark.createDataFrame([("h.com", "block", "2024-01-01")], "entry string, action string, listed_on string")).count() == n
    records = warc.page_records(odd.select(F.col("doc_id").alias("page_id"), "text", F.col("text").alias("html"), F.lit(1).alias("digest"))).collect()
    assert len(records) == n and {(r.page_id, r.record_type, r.refers_to) for r in records if r.page_id in (3, 4)} == {(3, "response", None), (4, "revisit", 3)}
    assert {r.payload_bytes for r in records if r.page_id == 2} == {len(LONG)}


def test_sample_is_bounded_in_bytes_without_a_prefix(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 50).alias("text"))
    labels = spark.range(2_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    ids = [r.doc_id for r in classifier.labelled_sample(docs, labels, 1_000, 40_000).collect()]
    assert 120 < len(ids) < 290 and max(ids) > 1_800 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


def test_shards_equal_plain_places(spark):
    texts = [prose(i, 5 + i % 7) for i in range(300)] + [None, "", prose(1, 6), prose(1, 6)]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:2]))
    rows = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in [*enumerate(texts), *enumerate(texts[:2])])
    f = sharding.Feistel(len(rows))
    want = sorted((*row, int(p) % 7, int(p) // 7) for row, p in zip(rows, f.place(np.arange(len(rows))), strict=True))
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(docs, 7).collect()) == want


# Registration and the pipeline


def test_registered_queries_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    entry = __import__("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {m[0] for x in names if (m := re.match(r"op\d+_", x))} and "pipeline" in names
    d = str(tmp_path)
    texts = near_copies() + [f"mail me at a{i}.b@mail.example.com " + prose(600 + i, 80) for i in range(5)]
    item = prose(5_000, 40)
    texts.append(prose(5_001, 100) + " " + item)
    documents(spark, texts).withColumnRenamed("n", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d).collect()
    pieces = vocab.loaded(vocab.Pieces, "piece_bpe_32k.model", "byte_bpe_50k.json", None)
    judged = [dict(zip(quality_rules._JUDGED.names, quality_rules.judge(t, pieces), strict=True)) for t in texts]
    kept = [(i, t) for i, t in enumerate(texts) if judged[i]["script_fine"] and not judged[i]["base_failed"]]  # too few texts for bands of a language
    parts = brute_components(kept)
    left = {i for i, (_, c) in parts.items() if i == c} - {len(texts) - 1}
    assert {r.doc_id for r in rows} == left and len(texts) - 2 in left
    bpe = vocab.loaded(vocab.ByteBpe, "byte_bpe_50k.json", None)
    clean = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", texts[len(texts) - 2])
    ids = bpe.ids_of([clean])[0] + np.array([2], "<u4").tobytes()
    assert [r.ids_crc32 for r in rows if r.doc_id == len(texts) - 2] == [zlib.crc32(ids)]
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_of_hard_rows(spark, hard, tmp_path):
    """Null and empty texts, a very long one, copies, repeated rows, null ids, clashing and dotted columns; then no rows at all."""
    import corpus_pipeline

    item = prose(5_000, 40)
    rng, syllables = random.Random(8), [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "m", "nd")]
    long = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 3))) for _ in range(24_000))
    odd = hard.drop("n").withColumn("n_chars", F.lit(1)).withColumn("meta.src", F.lit("m")).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    more = spark.createDataFrame([(20, long), (21, prose(5_001, 100) + " " + item), (22, "mail a.b@c.example.com " + prose(600, 90)), (None, prose(601, 90)), (None, prose(601, 90)), (23, prose(602, 90)), (23, prose(602, 90))], "doc_id long, text string")
    rows = odd.unionByName(more, allowMissingColumns=True)
    d = str(tmp_path / "some")
    rows.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    kept = Counter(r.doc_id for r in out if r.piece == 0)
    assert set(kept) >= {20, 22, 23, None} and not set(kept) & {0, 1, 4, 5, 7, 8, 21}
    assert kept[23] == 2  # repeated rows stay or go together
    bpe = vocab.loaded(vocab.ByteBpe, "byte_bpe_50k.json", None)
    whole = np.frombuffer(bpe.ids_of([long])[0] + np.array([2], "<u4").tobytes(), "<u4")
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 20)
    assert sum(n for _, n, _ in pieces) == len(whole) > 10 * 1024 and all(zlib.crc32(whole[a : a + n].tobytes()) == c for a, n, c in pieces)
    none = str(tmp_path / "none")
    rows.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
