"""Slices of time that part a key's history among many tasks, row numbers from slice counts, and blocks with a halo of rows before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hours of a slice by default.
HOURS = 24


def time_slice(t: Column, hours: int = HOURS) -> Column:
    """The slice of a time: later times never lie in an earlier one. Read from date and hour, so zones don't shift it."""
    if not 1 <= hours:
        raise ValueError("a slice has an hour at least")
    return F.floor((F.unix_date(F.to_date(t)).cast("long") * 24 + F.hour(t)) / hours).cast("long")


def slice_of(df: DataFrame, on: str, hours: int = HOURS) -> Column:
    """The slice of a time column, or of a number of seconds."""
    kind = df.schema[on].dataType
    return F.floor(F.col(on) / (hours * 3_600)).cast("long") if isinstance(kind, T.NumericType) else time_slice(F.col(on), hours)


def numbered(df: DataFrame, by: list[str], on: str, order: list[str], name: str, hours: int = HOURS) -> DataFrame:
    """df with each key's row numbers from 0 in the order of (on, order): numbers within slices, and before them the counts of earlier
    slices, a row a slice. No window holds more than a slice's rows."""
    rows = df.withColumn("_slice", slice_of(df, on, hours))
    counts = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # Without keys this window is one task, over a row a slice.
    before = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(on, *order))
    return rows.withColumn("_inside", inside).join(before, [*by, "_slice"]).withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_slice", "_inside", "_before")


def with_halo(rows: DataFrame, number: str, size: int, halo: int) -> DataFrame:
    """Rows dealt into blocks of `size` consecutive numbers (`_block`), each with up to `halo` rows before it (`_own` is false)."""
    own = F.floor(F.col(number) / size).cast("long")
    last = F.floor((F.col(number) + halo) / size).cast("long")
    return rows.withColumn("_block", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_block") == own)
