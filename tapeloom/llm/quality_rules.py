"""Quality rules on tokeniser fertility, after a base of word counts.

Base: a document fails with fewer than 50 words or with more than half of its words in repeated 3-word windows. The method
measures, with public vocabularies and over the whole text: characters per token of a sentence-piece and of a byte-level
vocabulary, the share of tokens that are byte fall-backs, and the entropy of the tokens. Neither vocabulary has a token that
goes on after a blank, so the tokens of a text are those of its words.

Two kinds of bands reject a document that passes the base:

* *Script*: fixed, wide limits of what any language of a script may have.
* *Language* (the `lang` column, where there is one): measured over all documents that pass the base. Documents of a language
  and of about as many tokens (half a power of two) give each measure's median and quartiles; a document is rejected below
  the centre by a measure's reach times the lower deviation (the quartile's, as a normal one's), or above it by another reach times
  the upper one (`MEASURES`). No group is too small: its median counts by its documents against `POOL` documents on the language's line of
  medians over sizes, and its deviations likewise against the language's; a line's slope against that of all languages, that against a
  level one, a language's deviations against a wide fixed one. So few documents are judged leniently, and nothing hinges on one document more. Languages without
  a two- or three-letter code have the limits of their script alone.

Null texts count as empty: all counts 0, base_failed. Very long texts are measured whole. Ties: values on a limit are kept. Repeated
rows are judged row by row (and count in the statistics as often as they come). An empty table gives an empty result. Extra
columns are ignored, and kept by `keep_documents`, whatever their names. Texts aren't shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, fresh, written
from .vocab import Pieces, loaded

#: Fixed values of the base rule: symbols, white space.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Band:
    """What is accepted: characters per token of the piece and of the byte vocabulary, byte share, and entropy as a share of
    the most that so many tokens can have."""

    piece_chars: tuple[float, float] = (1.0, 8.0)
    byte_chars: tuple[float, float] = (1.0, 8.0)
    byte_share: float = 0.25
    entropy_share: float = 0.30


#: Limits by script.
SCRIPT_BANDS = {
    "latin": Band((1.30, 8.0), (1.30, 8.0), 0.10, 0.35),
    "greek": Band((0.80, 6.0), (0.40, 6.0), 0.40, 0.35),
    "cyrillic": Band((0.90, 7.0), (0.45, 7.0), 0.30, 0.35),
    "arabic": Band((0.60, 6.0), (0.40, 6.0), 0.60, 0.30),
    "hebrew": Band((0.60, 6.0), (0.40, 6.0), 0.60, 0.30),
    "indic": Band((0.30, 5.0), (0.20, 5.0), 0.95, 0.25),
    "thai": Band((0.30, 6.0), (0.20, 6.0), 0.95, 0.25),
    "cjk": Band((0.30, 3.0), (0.25, 3.0), 0.90, 0.30),
    "other": Band((0.20, 8.0), (0.20, 8.0), 0.98, 0.25),
}
#: Last code point of each range and its script; ranges outside count as other.
_RANGES = ((0x024F, "latin"), (0x036F, "other"), (0x03FF, "greek"), (0x052F, "cyrillic"), (0x058F, "other"), (0x05FF, "hebrew"), (0x08FF, "arabic"), (0x0DFF, "indic"), (0x0EFF, "thai"), (0x1DFF, "other"), (0x1EFF, "latin"), (0x1FFF, "greek"), (0x2E7F, "other"), (0x9FFF, "cjk"), (0xABFF, "other"), (0xD7AF, "cjk"))
#: Parameter of the language bands: as many documents as the broader estimate counts for.
POOL = 20
#: Deviations that a language is given before any document is seen.
WIDE = {"piece_chars_per_token": 0.3, "bpe_chars_per_token": 0.3, "byte_share": 0.05, "token_entropy": 0.4}
#: The measures, each with the least deviation that it is given, so that a group of equal values rejects no neighbour, and how
#: many deviations below and above the median are accepted (None: any). Few characters a token are found in texts of mixed
#: languages too, so these limits are wider than that of the entropy.
MEASURES = {"piece_chars_per_token": (0.02, 6.0, 8.0), "bpe_chars_per_token": (0.02, 6.0, 8.0), "byte_share": (0.02, None, 8.0), "token_entropy": (0.05, 4.5, None)}
NORMAL_QUARTILE = 0.6745  # the quartile of the normal distribution in deviations


def script_of(text: str) -> str:
    """The script of most letters of a text."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letters = points[(points > 0x40) & ((points > 0x7A) | ((points & 0xDF) - 0x41 < 26))]
    if not len(letters):
        return "other"
    at = np.bincount(np.searchsorted([r[0] for r in _RANGES], letters), minlength=len(_RANGES) + 1)
    total: dict[str, int] = {}
    for n, (_, script) in zip(at.tolist(), (*_RANGES, (0, "other")), strict=True):
        total[script] = total.get(script, 0) + n
    return max(total, key=total.get)


def base_counts(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    duplicates = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                duplicates += 1
            elif line.strip(SPACES):
                seen.add(line)
    repeated = 0
    if n >= 4:
        first: dict[tuple, int] = {}
        covered = None
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            j = first.setdefault(window, i)
            if j != i:
                if covered is None:
                    covered = bytearray(n)
                covered[j : j + 3] = b"\1\1\1"
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered) if covered else 0
    return n, chars, symbols, duplicates, repeated, words


def entropy(ids: np.ndarray) -> float:
    """Bits a token of the distribution of ids."""
    n = len(ids)
    if not n:
        return 0.0
    ids = np.sort(ids)
    edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    counts = np.diff(edges)
    return max(0.0, math.log2(n) - float(counts @ np.log2(counts)) / n)


def accepted(band: Band, chars: int, pieces: int, byte_pieces: int, bits: float, byte_ids: int) -> bool:
    """Whether a document with words lies inside its script's limits."""
    if not pieces or not byte_ids:
        return False
    piece_chars, byte_chars = chars / pieces, chars / byte_ids
    if not band.piece_chars[0] <= piece_chars <= band.piece_chars[1] or not band.byte_chars[0] <= byte_chars <= band.byte_chars[1]:
        return False
    return byte_pieces <= band.byte_share * pieces and bits >= band.entropy_share * math.log2(pieces)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_JUDGED = pa.struct([*((x, pa.int64()) for x in COUNTS), ("base_failed", pa.bool_()), ("script", pa.string()), ("script_fine", pa.bool_()), ("n_pieces", pa.int64()), *((x, pa.float64()) for x in MEASURES)])


def judge(text: str | None, pieces: Pieces, scripts: dict[str, Band] = SCRIPT_BANDS) -> tuple:
    """The counts, the base's and the script's verdicts and the measures of one text, in the order of _JUDGED."""
    text = text or ""
    n, chars, symbols, duplicates, repeated, words = base_counts(text)
    failed = n < 50 or 100 * repeated > 50 * n
    script = script_of(text)
    if not n:
        return n, chars, symbols, duplicates, repeated, failed, script, False, 0, 0.0, 0.0, 0.0, 0.0
    pieces.learn(set(words))
    ids_of, byte_of, bpe_of = zip(*map(pieces.kept.__getitem__, words), strict=True)
    ids, byte_pieces, byte_ids = np.frombuffer(b"".join(ids_of), "<u4"), sum(byte_of), sum(bpe_of)
    bits = entropy(ids)
    fine = accepted(scripts[script], chars, len(ids), byte_pieces, bits, byte_ids)
    return n, chars, symbols, duplicates, repeated, failed, script, fine, len(ids), chars / max(1, len(ids)), chars / max(1, byte_ids), byte_pieces / max(1, len(ids)), bits


def _judged(docs: DataFrame, text: str, name: str, piece_file: str, bpe_file: str, folder: str | None, scripts: dict[str, Band]) -> DataFrame:
    """docs with `name`, the struct of what `judge` tells of the column `text`; a text column of another type counts as its string. Written."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    fields = ", ".join(f"{f.name}: {'bigint' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'boolean' if f.type == pa.bool_() else 'string'}" for f in _JUDGED)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(Pieces, piece_file, bpe_file, folder)
        for batch in batches:
            rows = [judge(t if t is None else str(t), pieces, scripts) for t in batch.column(at).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(_JUDGED)
            told = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _JUDGED, strict=True)], fields=list(_JUDGED))
            yield pa.RecordBatch.from_arrays([*batch.columns, told], [*batch.schema.names, name])

    out = StructType([*docs.schema.fields, *StructType.fromDDL(f"{name} struct<{fields}>").fields])
    return docs.mapInArrow(measured, out)


def language_key(lang: Column) -> Column:
    """The two or three letters of a language code, else nothing: at most 26**2 + 26**3 keys."""
    return F.nullif(F.regexp_extract(F.lower(lang), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def size_step(pieces: Column) -> Column:
    """Half powers of two of the number of tokens: at most 126 steps."""
    return F.floor(2 * F.log2(F.greatest(pieces, F.lit(1)))).cast("int")


def language_bands(measured: DataFrame, pool: int = POOL) -> DataFrame:
    """language, size_step, and `band`: a struct (low, high) of every measure, of all groups of rows that pass the base.

    Quantiles are exact over values of three decimals, so a group's state is bounded, and rows may come in any order. All that follows is
    over at most 18,252 languages by 126 sizes.
    """
    quantiles = [F.expr(f"percentile(round({m}, 3), array(0.25, 0.5, 0.75))").alias(m) for m in MEASURES]
    groups = measured.where(F.expr("not base_failed") & F.col("language").isNotNull()).groupBy("language", "size_step").agg(F.count(F.lit(1)).cast("double").alias("n"), *quantiles)
    own = Window.partitionBy("language")
    t, n = F.col("size_step"), F.col("n")
    weight = n * n / (n + pool)  # a few documents of a rare size don't turn the line
    mean = lambda x: F.sum(weight * x).over(own) / F.sum(weight).over(own)
    rows = groups.withColumns({"documents": F.sum("n").over(own), "at": t - mean(t)})
    for m in MEASURES:
        low, mid, high = (F.element_at(F.col(m), i) for i in (1, 2, 3))
        rows = rows.withColumns({f"mid_{m}": mid, f"low_{m}": (mid - low) / NORMAL_QUARTILE, f"high_{m}": (high - mid) / NORMAL_QUARTILE, f"mean_{m}": mean(mid)})
    spread = lambda x: F.sum(weight * F.col("at") * x)
    every = rows.agg(*[F.coalesce(spread(F.col(f"mid_{m}") - F.col(f"mean_{m}")) / (spread(F.col("at")) + pool), F.lit(0.0)).alias(f"slope_{m}") for m in MEASURES])
    rows = rows.join(F.broadcast(every))  # one row

    def band(m: str, least: float, below: float | None, above: float | None) -> Column:
        slope = (spread(F.col(f"mid_{m}") - F.col(f"mean_{m}")).over(own) + pool * F.col(f"slope_{m}")) / (spread(F.col("at")).over(own) + pool)
        centre = (n * F.col(f"mid_{m}") + pool * (F.col(f"mean_{m}") + slope * F.col("at"))) / (n + pool)

        def deviation(side: str) -> Column:
            language = (F.sum(n * F.col(f"{side}_{m}")).over(own) + pool * WIDE[m]) / (F.col("documents") + pool)
            return F.greatest((n * F.col(f"{side}_{m}") + pool * language) / (n + pool), F.lit(least))

        none = F.lit(None).cast("double")
        return F.struct((centre - below * deviation("low") if below else none).alias("low"), (centre + above * deviation("high") if above else none).alias("high")).alias(m)

    return rows.select("language", "size_step", F.struct(*[band(m, *reach) for m, reach in MEASURES.items()]).alias("band"))


def with_verdicts(measured: DataFrame, pool: int = POOL) -> DataFrame:
    """Adds `kept` and `rejected_by` (base, script, or the measure outside its language's band) to a written table of measures."""
    sized = measured.withColumn("size_step", size_step(F.col("n_pieces")))
    # At most 18,252 languages with 126 sizes each, by their keys; a row of 80 bytes a group.
    out = sized.join(F.broadcast(language_bands(sized, pool)), ["language", "size_step"], "left")
    reason = F.when(F.col("base_failed"), "base").when(~F.col("script_fine"), "script")
    for m in MEASURES:
        band = F.col(f"band.{m}")
        outside = F.coalesce(F.col(m) < band["low"], F.lit(False)) | F.coalesce(F.col(m) > band["high"], F.lit(False))
        reason = reason.when(outside, m)
    return out.withColumn("rejected_by", reason).withColumn("kept", F.col("rejected_by").isNull()).drop("size_step", "band")


def _options(options: dict) -> tuple[dict, dict]:
    """The options of the measures and those of the verdicts."""
    judging = {"piece_file": "piece_bpe_32k.model", "bpe_file": "byte_bpe_50k.json", "folder": None, "scripts": SCRIPT_BANDS}
    return {k: options.get(k, v) for k, v in judging.items()}, {k: v for k, v in options.items() if k not in judging}


def quality_measures(docs: DataFrame, **options) -> DataFrame:
    """One row a document: base counts, base_failed, kept, script, the measures and rejected_by."""
    judging, verdict = _options(options)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), language_key(lang).alias("language"))
    measured = written(_judged(rows, "text", "told", **judging).select("doc_id", "language", "told.*"), "measures")
    return with_verdicts(measured, **verdict).select("doc_id", *COUNTS, "base_failed", "kept", "language", "script", *MEASURES, "rejected_by")


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns; no shuffle of documents."""
    judging, verdict = _options(options)
    own, told = fresh("own", []), "told"
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), F.col("text").cast("string").alias("text"), language_key(lang).alias("language"))
    measured = written(_judged(rows, "text", told, **judging).select(own, "language", f"{told}.*"), "measured")
    return with_verdicts(measured, **verdict).where("kept").select(*[F.col(own)[c].alias(c) for c in docs.columns])
