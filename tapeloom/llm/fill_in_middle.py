"""Fill-in-middle transformation by overlapping-chunk decomposition.

A text is a row of lines, each with its newline. Where a line begins is told by two adjacent characters (the one before is a
newline), so a chunk that overlaps its left neighbour by one character knows its own boundaries without its neighbours. Each
text is dealt into chunks of bounded size; boundaries and code points are counted chunk by chunk, prefix sums of the counts route
the two drawn cut ranks to the chunks that own them, and only those chunks are scanned again for the places. Newlines are found in
UTF-8 bytes, where no other character holds that byte. Texts don't move between tasks, and beside a text and its output a task
holds one chunk's worth of counts, however many lines the text has.

The draws depend on the seed and doc_id alone: with h1 to h4 the first four groups of eight hex digits of sha256("seed:doc_id"), the
prefix ends after min(h1, h2) mod (lines + 1) lines, the middle after the larger, h3 decides whether the text is transformed and h4
its form (suffix first, "spm", or prefix first, "psm"). Null and empty texts and texts that hold a marker stay plain. A null
doc_id draws as an empty one. Repeated rows are transformed alike, ties of both ranks give an empty middle. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, chunked

#: The markers, the draw's seed, and per cent of texts that are transformed and of these that have the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: Bytes of a chunk.
CHUNK = 1 << 16

_NEWLINE = 10


class Lines:
    """Counts of a text's line ends and code points by chunk, and the places of cut ranks."""

    def __init__(self, text: bytes, chunk: int = CHUNK):
        self.data, self.chunk = np.frombuffer(text, np.uint8), chunk
        size = len(self.data)
        starts = range(0, size, chunk)
        self.upto_ends = np.cumsum([0, *(self._boundaries(at).size for at in starts)])
        self.upto_points = np.cumsum([0, *(_points(self.data[at : at + chunk]) for at in starts)])
        self.inner = int(self.upto_ends[-1])
        self.n = self.inner + 1 if size else 0  # what follows the last boundary is a line too

    def _boundaries(self, at: int) -> np.ndarray:
        """Places in the chunk at `at` where a line begins: the byte before is a newline. The text's own start is no such place,
        and the overlap of one byte to the left tells the chunk's first place."""
        first = max(at, 1)
        return np.flatnonzero(self.data[first - 1 : min(at + self.chunk, len(self.data)) - 1] == _NEWLINE) + first

    def cut(self, rank: int) -> int:
        """The byte after `rank` lines."""
        if rank <= 0:
            return 0
        if rank > self.inner:
            return len(self.data)
        owner = int(np.searchsorted(self.upto_ends, rank, "left")) - 1
        return int(self._boundaries(owner * self.chunk)[rank - 1 - int(self.upto_ends[owner])])

    def points(self, place: int) -> int:
        """Code points before a byte."""
        owner = place // self.chunk
        return int(self.upto_points[owner]) + _points(self.data[owner * self.chunk : place])


def _points(data: np.ndarray) -> int:
    """Code points that begin in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transformed(text: bytes, draws: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> tuple:
    """(lines, form, code points of prefix and of middle, output) of one text."""
    lines = Lines(text, chunk)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return lines.n, "plain", None, None, text
    low, high = sorted((draws[0] % (lines.n + 1), draws[1] % (lines.n + 1)))
    a, b = lines.cut(low), lines.cut(high)
    before, to_middle = lines.points(a), lines.points(b)
    if draws[3] % 100 < suffix_first:
        form, parts = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
    else:
        form, parts = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
    return lines.n, form, before, to_middle - before, b"".join(parts)


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output (the transformed text) of every document."""
    bounded_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunked(((doc, *transformed(text, tuple(h), rate, suffix_first, chunk)) for doc, text, *h in arrow_rows(batches)), _OUT)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    out = docs.select(doc_id.alias("doc_id"), text, *draws).mapInArrow(worked, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))  # joined from whole lines of valid text


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. A text with a marker stays plain, so each marker of an output is its only one."""
    head, middle = F.substring_index(output, "<M>", 1), F.substring_index(output, "<M>", -1)
    after = lambda mark: F.substring_index(head, mark, -1)
    first = lambda mark: F.substr(F.substring_index(head, mark, 1), F.lit(4))  # noqa: E731  behind the leading marker
    return F.when(form == "psm", F.concat(first("<S>"), middle, after("<S>"))).when(form == "spm", F.concat(after("<P>"), middle, first("<P>"))).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """The transformation with SHA-256 of its outputs and of the texts rebuilt from them, without the outputs."""
    out = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


ORACLE = """
    with t as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
    l as (select *, string_split(t, chr(10)) as parts,
            length(t) - length(replace(t, chr(10), '')) + (case when t <> '' and right(t, 1) <> chr(10) then 1 else 0 end) as n,
            cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 25, 8) as bigint) as h4
        from t),
    r as (select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
            t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') as plain
        from l),
    p as (select *,
            case when low = 0 then 0 else least(length(t), low + length(array_to_string(parts[1:low], ''))) end as a,
            case when high = 0 then 0 else least(length(t), high + length(array_to_string(parts[1:high], ''))) end as b
        from r),
    f as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf,
            case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
        from p)
    select doc_id, cast(n as bigint) as n, form,
        case when not plain then cast(a as bigint) end as prefix_chars, case when not plain then cast(b - a as bigint) end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
        sha256(t) as restored_sha256
    from f"""
