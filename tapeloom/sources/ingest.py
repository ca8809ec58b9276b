"""Readers of daily vendor files: trades and quotes, and ten-level books, as compressed CSV.

Paths: <root>/<dataset>/<ROOT>/<YYYY>/<YYYYMMDD>/<EXPIRY>.csv.gz, without <ROOT> for the volatility set. Schemas are declared;
a compressed file can't be split, so a day's file is a task of the data source in `vendor`. Catalogues come from Spark's listing.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATASETS = ("taq", "depth", "vix")
ROOT_VARIABLE = "TAPELOOM_RAW_ROOT"
TAQ = "UTCDate long, UTCTime string, LocalDate long, LocalTime string, Ticker string, SecurityID long, TypeMask long, Type string, Price double, Quantity long, Orders long, Flags long"
#: The words that mark trades and quotes, as vendors spell them, and bits of Flags.
TRADE_TYPES = ("TRADE", "TRADE AGRESSOR ON BUY", "TRADE AGRESSOR ON SELL")
QUOTE_TYPES = {"QUOTE BID": "bid", "QUOTE SELL": "ask"}
IMPLIED, NO_TRADE = 1, 8
HEADER_TYPOS = {"Leve101Size": "L10Size"}


@dataclass(frozen=True)
class DailyFile:
    """A file of one contract and day."""

    dataset: str
    root: str
    expiry: str
    day: date
    path: str

    def exists(self, spark: SparkSession) -> bool:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def day_folder(dataset: str, root: str, day: date, top: str | None = None) -> str:
    if dataset not in DATASETS:
        raise ValueError(f"{dataset!r} is none of {DATASETS}")
    top = (top or os.environ.get(ROOT_VARIABLE) or "raw").rstrip("/")
    return "/".join([top, dataset, *([] if dataset == "vix" else [root]), f"{day:%Y}", f"{day:%Y%m%d}"])


def locate(dataset: str, root: str, expiry: str, day: date, top: str | None = None) -> DailyFile:
    return DailyFile(dataset, root, expiry, day, f"{day_folder(dataset, root, day, top)}/{expiry}.csv.gz")


def timestamp_of(day: Column, clock: Column, width: int = 9) -> Column:
    """A timestamp from YYYYMMDD and HHMMSS with 0, 3, 6 or 9 digits of a second behind it, left-padded to `width` digits
    (6 plus those of the set). Digits beyond microseconds are cut."""
    text = F.lpad(clock.cast("string"), width, "0")
    micros = F.rpad(F.substring(text, 7, 6), 6, "0") if width > 6 else F.lit("000000")
    joined = F.concat(day.cast("string"), F.substring(text, 1, 6))
    return (F.to_timestamp_ntz(joined, F.lit("yyyyMMddHHmmss")) + F.make_dt_interval(secs=micros.cast("decimal(18,6)") / 1_000_000)).cast("timestamp_ntz")


def _vendor(spark: SparkSession, dataset: str, paths: str | list[str], width: int | None) -> DataFrame:
    from . import vendor

    vendor.register(spark)
    reader = spark.read.format("vendor_daily").option("dataset", dataset).option("files", json.dumps([paths] if isinstance(paths, str) else paths))
    return (reader.option("width", width) if width else reader).load().drop("root", "expiry", "day")


def read_taq(spark: SparkSession, paths: str | list[str], width: int | None = None) -> DataFrame:
    """Rows of trade and quote files, with ts and seq (the place in the file). A file's own longest time tells its clock's digits;
    `width` saves the look at them where it is known."""
    return _vendor(spark, "taq", paths, width)


def depth_fields() -> list[tuple[str, str]]:
    levels = [(f"L{k}{x}", t) for k in range(1, 11) for x, t in (("Price", "double"), ("Size", "long"), ("Orders", "long"))]
    return [("UTCDate", "long"), ("UTCTime", "string"), ("Side", "string"), ("Flags", "long"), *levels]


def read_depth(spark: SparkSession, paths: str | list[str], width: int | None = None) -> DataFrame:
    """Book snapshots; each file has its own header: a misspelt one is mended, missing columns are null."""
    return _vendor(spark, "depth", paths, width)


def trades_of(taq: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Trades with a size, without those flagged as none, signed by who took."""
    rows = taq.where(F.col("Type").isin(*TRADE_TYPES) & (F.col("Quantity") > 0) & (F.col("Flags").bitwiseAND(NO_TRADE) == 0))
    sign = F.when(F.col("Type") == TRADE_TYPES[1], 1).when(F.col("Type") == TRADE_TYPES[2], -1).otherwise(0)
    return rows.select(*(keep or []), "ts", "seq", F.col("Price").alias("price"), F.col("Quantity").alias("quantity"), sign.alias("aggressor_sign"), (F.col("Flags").bitwiseAND(IMPLIED) != 0).alias("is_implied"))


def quotes_of(taq: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All quotes by side."""
    side = F.coalesce(*[F.when(F.col("Type") == t, s) for t, s in QUOTE_TYPES.items()])
    return taq.where(F.col("Type").isin(*QUOTE_TYPES)).select(*(keep or []), "ts", "seq", side.alias("side"), F.col("Price").alias("price"), F.col("Quantity").alias("size"), F.col("Orders").alias("orders"), (F.col("Flags").bitwiseAND(IMPLIED) != 0).alias("is_implied"))


def split_taq(taq: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    return trades_of(taq, keep), quotes_of(taq, keep)


def file_catalog(spark: SparkSession, top: str) -> DataFrame:
    """dataset, root, day, expiry, bytes of the files below a folder, from the file source's listing; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz").load(top).select("path", F.col("length").alias("bytes"))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    vix = part(-4) == "vix"
    return files.select(F.when(vix, "vix").otherwise(part(-5)).alias("dataset"), F.when(vix, "VX").otherwise(part(-4)).alias("root"), F.to_date(part(-2), "yyyyMMdd").alias("day"), F.regexp_replace(part(-1), "[.]csv[.]gz$", "").alias("expiry"), "bytes")


def catalog_gaps(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Bytes that a mirror lacks, by dataset, day and root: what each remote file has beyond the local one."""
    keys = ["dataset", "day", "root", "expiry"]
    both = remote.select(*keys, F.col("bytes").alias("_there")).join(local.select(*keys, F.col("bytes").alias("_here")), keys, "full")
    lack = F.greatest(F.lit(0), F.coalesce("_there", F.lit(0)) - F.coalesce("_here", F.lit(0)))
    return both.groupBy("dataset", "day", "root").agg(F.sum(lack).cast("long").alias("missing_bytes"), F.count(F.when(F.col("_here").isNull(), 1)).alias("missing_files"))


def type_counts(taq: DataFrame) -> DataFrame:
    return taq.groupBy("Type").agg(F.count(F.lit(1)).alias("n"))
