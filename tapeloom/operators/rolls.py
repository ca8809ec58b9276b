"""Contract rolls from a table of daily files: which expiry is in front, the first n, and when the front changes.

Files: root, day, expiry, bytes. Two kinds of order: by size (the most traded first), or by calendar where every file of a
day is a volatility future, named VX, month letter, last digit of the year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: month letters from January to December.
MONTHS = "FGHJKMNQUVXZ"
LEAST_BYTES = 1_000


def candidates(files: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    return files.where(F.col("bytes") >= least_bytes)


def front_month(files: DataFrame) -> DataFrame:
    """The largest file of a root and day; ties by expiry."""
    return candidates(files).groupBy("root", "day").agg(F.min_by(F.struct("expiry", "bytes"), F.struct(-F.col("bytes"), "expiry")).alias("f")).select("root", "day", "f.expiry", "f.bytes")


def vx_month(expiry: Column, year: Column) -> Column:
    """Year * 12 + month - 1 of a volatility future; the decade is the day's, or the next where the year would be more than
    six years back. Null for other names."""
    month = F.coalesce(*[F.when(F.substring(expiry, 3, 1) == c, k) for k, c in enumerate(MONTHS, 1)], F.lit(0))
    digit = F.substring(expiry, 4, 1).try_cast("int")
    near = F.floor(year / 10) * 10 + digit
    full = F.when(near < year - 6, near + 10).otherwise(near)
    return F.when(expiry.startswith("VX") & (F.length(expiry) >= 4) & (month > 0), full * 12 + month - 1)


def front_n(files: DataFrame, n: int = 3) -> DataFrame:
    """Up to n contracts of each root and day with their slot, from 1. Volatility futures that expired don't count."""
    day = Window.partitionBy("root", "day")
    rows = candidates(files).withColumn("_vx", F.min(F.col("expiry").startswith("VX")).over(day)).withColumn("_month", vx_month(F.col("expiry"), F.year("day")))
    rows = rows.where(~F.col("_vx") | (F.col("_month") >= F.year("day") * 12 + F.month("day") - 1))
    order = day.orderBy(F.when(F.col("_vx"), F.col("_month")).asc_nulls_last(), F.when(~F.col("_vx"), -F.col("bytes")).asc_nulls_last(), "expiry")
    return rows.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n).select("root", "day", "slot", "expiry", "bytes")


def front_series(files: DataFrame, start: str | None = None, end: str | None = None, weekdays_only: bool = True) -> DataFrame:
    """The front of each day of a range."""
    rows = files
    if start:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("day") <= F.to_date(F.lit(end)))
    return front_month(rows.where(F.weekday("day") < 5) if weekdays_only else rows)


def detect_rolls(series: DataFrame) -> DataFrame:
    """Days on which the front isn't that of the day before in the series."""
    before = F.lag("expiry").over(Window.partitionBy("root").orderBy("day"))
    return series.withColumn("from_expiry", before).where("from_expiry is not null and from_expiry <> expiry").select("root", "day", "from_expiry", F.col("expiry").alias("to_expiry"))
