"""A Python data source of daily vendor files: `spark.read.format("vendor_daily")`.

    spark.read.format("vendor_daily").option("dataset", "taq").load("/raw")

`files`, a JSON list of paths, stands for the folder where single files are wanted.
A partition is a file, planned from the listing of the folders alone. Filters on root, expiry and day choose the files; filters on Type (or
Side) drop rows before they leave the reader. Each file is read as a stream: its own header tells its columns (misspelt ones are mended,
missing ones are null), its own longest time tells the clock's digits, and `seq` is a row's place in its file, so that a rerun or another
split gives the same numbers. Folders are <root>/<YYYY>/<YYYYMMDD>/<EXPIRY>.csv.gz below the dataset's, without <root> for volatility futures.
Stores are reached through Arrow's file systems (file, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .ingest import DATASETS, HEADER_TYPOS, TAQ, depth_fields

_FILE = re.compile(r"(?:([^/]+)/)?(\d{4})/(\d{8})/([^/]+)\.csv\.gz$")
_TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_BLOCK = 8 << 20


def fields_of(dataset: str) -> list[tuple[str, str]]:
    return depth_fields() if dataset == "depth" else [tuple(f.strip().split(" ")) for f in TAQ.split(",")]


@dataclass
class VendorFile(InputPartition):
    """One file."""

    path: str
    root: str
    expiry: str
    day: date


def _holds(f: Filter, value) -> bool:
    """Whether a filter that is understood lets a value through."""
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, EqualTo):
        return value == f.value
    return {GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]


class VendorReader(DataSourceReader):
    """Plans and reads the files of one dataset."""

    def __init__(self, options: dict):
        self.dataset = options.get("dataset", "taq")
        if self.dataset not in DATASETS:
            raise ValueError(f"{self.dataset!r} is none of {DATASETS}")
        self.files = json.loads(options["files"]) if "files" in options else None
        if not options.get("path") and self.files is None:
            raise ValueError("give the folder that holds the datasets, or `files`")
        self.top = options.get("path", "").rstrip("/")
        self.width = int(options["width"]) if "width" in options else None
        self.file_filters: list[tuple[str, Filter]] = []
        self.row_filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the file's columns and on the kind of row; gives back the rest, which Spark applies."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("root", "expiry", "day") and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.file_filters.append((name, f))
            elif name in ("Type", "Side") and isinstance(f, (EqualTo, In)):
                self.row_filters.append((name, f))
            else:
                yield f

    def partitions(self) -> list[VendorFile]:
        if self.files is not None:
            return [self._named(f, _FILE.search(f)) for f in self.files] or [VendorFile("", "", "", date.min)]
        store, top = fs.FileSystem.from_uri(self.top if "://" in self.top or self.top.startswith("/") else f"file:{self.top}")
        scheme = self.top.split("://")[0] + "://" if "://" in self.top else ""
        found = []
        for info in store.get_file_info(fs.FileSelector(f"{top}/{self.dataset}", recursive=True, allow_not_found=True)):
            m = _FILE.search(info.path.removeprefix(f"{top}/{self.dataset}/"))
            if info.type != fs.FileType.File or not m:
                continue
            one = self._named(f"{scheme}{info.path}", m)
            if all(_holds(f, getattr(one, name)) for name, f in self.file_filters):
                found.append(one)
        return sorted(found, key=lambda x: x.path) or [VendorFile("", "", "", date.min)]

    def _named(self, path: str, m: re.Match | None) -> VendorFile:
        if m is None:
            return VendorFile(path, "", "", date.min)
        return VendorFile(path, "VX" if self.dataset == "vix" else m[1] or "VX", m[4], datetime.strptime(m[3], "%Y%m%d").date())

    def _batches(self, path: str, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
        """A file's rows with mended names, as texts where no type is declared."""
        store, inner = fs.FileSystem.from_uri(path)
        declared = dict(fields_of(self.dataset))
        with store.open_input_stream(inner, compression="gzip" if inner.endswith(".gz") else None) as stream:
            # Strings all: what doesn't parse becomes null below, not an error.
            names = {n: pa.string() for n in [*declared, *HEADER_TYPOS]}
            with csv.open_csv(stream, csv.ReadOptions(block_size=_BLOCK), convert_options=csv.ConvertOptions(column_types=names, strings_can_be_null=True)) as rows:
                for batch in rows:
                    have = [HEADER_TYPOS.get(n, n) for n in batch.schema.names]
                    yield pa.RecordBatch.from_arrays(batch.columns, have) if columns is None else pa.RecordBatch.from_arrays([batch.column(have.index(c)) for c in columns], columns)

    def clock_width(self, path: str) -> int:
        """9, 12 or 15 characters, by the longest time of the file: an hour before ten lost its zero."""
        longest = max((pc.max(pc.utf8_length(b.column(0))).as_py() or 0 for b in self._batches(path, ["UTCTime"]) if b.num_rows), default=0)
        return next(w for w in (9, 12, 15) if w >= longest or w == 15)

    def read(self, partition: VendorFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        declared, at, width = fields_of(self.dataset), 0, self.width or None
        for batch in self._batches(partition.path):
            if not batch.num_rows:
                continue
            width = width or self.clock_width(partition.path)
            n = batch.num_rows
            have = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns = {name: _typed(have[name], _TYPES[kind]) if name in have else pa.nulls(n, _TYPES[kind]) for name, kind in declared}
            whole = {"root": pa.array([partition.root] * n), "expiry": pa.array([partition.expiry] * n), "day": pa.array([partition.day] * n), **columns, "ts": timestamps(columns["UTCDate"], columns["UTCTime"], width), "seq": pa.array(range(at, at + n), pa.int64())}
            at += n
            out = pa.RecordBatch.from_arrays(list(whole.values()), list(whole))
            for name, f in self.row_filters:
                values = list(f.value) if isinstance(f, In) else [f.value]
                if name in out.schema.names:
                    out = out.filter(pc.is_in(out.column(name), pa.array(values, pa.string())))
            if out.num_rows:
                yield out


def _typed(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Numbers of a text column; what is none is null."""
    if kind == pa.string():
        return column
    text = pc.utf8_trim_whitespace(column)
    pattern = r"^[+-]?\d{1,18}$" if kind == pa.int64() else r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    return pc.cast(pc.if_else(pc.match_substring_regex(text, pattern), text, None), kind)


def timestamps(day: pa.Array, clock: pa.Array, width: int) -> pa.Array:
    """Microseconds from YYYYMMDD and HHMMSS with the digits of a second that `width` tells; digits beyond microseconds are cut."""
    text = pc.utf8_lpad(clock, width, "0")
    number = lambda a, b: pc.cast(pc.utf8_slice_codeunits(text, a, b), pa.int64())
    micros = pc.cast(pc.utf8_slice_codeunits(pc.utf8_rpad(pc.utf8_slice_codeunits(text, 6, width), 6, "0"), 0, 6), pa.int64())
    seconds = pc.add(pc.add(pc.multiply(number(0, 2), 3_600), pc.multiply(number(2, 4), 60)), number(4, 6))
    midnight = pc.cast(pc.strptime(pc.cast(day, pa.string()), "%Y%m%d", "us", error_is_null=True), pa.int64())
    return pc.cast(pc.add(midnight, pc.add(pc.multiply(seconds, 1_000_000), micros)), pa.timestamp("us"))


class VendorDaily(DataSource):
    """The format's name, schema and reader."""

    @classmethod
    def name(cls) -> str:
        return "vendor_daily"

    def schema(self) -> str:
        columns = ", ".join(f"{n} {'bigint' if t == 'long' else t}" for n, t in fields_of(self.options.get("dataset", "taq")))
        return f"root string, expiry string, day date, {columns}, ts timestamp_ntz, seq bigint"

    def reader(self, schema) -> VendorReader:
        return VendorReader(dict(self.options))


def register(spark) -> None:
    """Makes the format known; filters are pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorDaily)
