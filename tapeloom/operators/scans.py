"""Prefix scans along series that are parted into chunks of time: recursions without one task a series.

A chunk is the rows of one key and slice, packed into one row of arrays and written once. Each chunk is worked by itself into local
results and a summary of fixed size (for an affine recursion y = a y + b: the chunk's own map). The summaries of a key, a row a
chunk, are folded in order of time, which gives each chunk what enters it. Rows take their results by their place in the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .slices import HOURS, slice_of


def affine_prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For y[i] = a[i] y[i - 1] + b[i] with y[-1] = e: p and q with y = p e + q, by doubling the reach of composed maps."""
    p, q, reach = a.astype(float).copy(), b.astype(float).copy(), 1
    while reach < len(p):
        q[reach:] = q[reach:] + p[reach:] * q[:-reach]
        p[reach:] = p[reach:] * p[:-reach]
        reach *= 2
    return p, q


def chunked(df: DataFrame, by: list[str], values: list[str], hours: int = HOURS) -> DataFrame:
    """A row a (key, slice): `rows`, the slice's (ts, seq, values) in that order. Rows that agree in all of them are interchangeable."""
    return _sliced(df, by, hours).groupBy(*by, "_slice").agg(F.array_sort(F.collect_list(F.struct(*_order(df, values)))).alias("rows"))


def _order(df: DataFrame, values: list[str]) -> list[Column]:
    names = dict.fromkeys(["ts", *(["seq"] if "seq" in df.columns else []), *values])
    return [F.col(f"`{c}`") for c in names]


def _sliced(df: DataFrame, by: list[str], hours: int) -> DataFrame:
    return df.withColumn("_slice", slice_of(df, "ts", hours))


def epoch_seconds(times: np.ndarray) -> np.ndarray:
    if np.issubdtype(times.dtype, np.number):
        return times.astype(float)
    return times.astype("datetime64[us]").astype(np.int64) / 1e6


def fields_of(rows: pa.Array, k: int) -> dict[str, np.ndarray]:
    """The fields of the k-th chunk as arrays; null numbers are NaN."""
    part = rows[k].values
    out = {}
    for i in range(part.type.num_fields):
        f = part.type.field(i)
        column = part.field(i)
        out[f.name] = column.to_numpy(zero_copy_only=False) if pa.types.is_temporal(f.type) or pa.types.is_boolean(f.type) else column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return out


def scan(df: DataFrame, by: list[str], values: list[str], local: Callable, fold: Callable, finish: Callable, hours: int = HOURS) -> DataFrame:
    """df with new columns.

    `local(fields)` gives a chunk's summary (a flat list of numbers) and its local arrays (a list of as many as the chunk has rows);
    `fold(summaries)` gives what enters each chunk from the summaries of a key in order (arrays of chunks x numbers, both);
    `finish(own, entry)` gives the new columns by name from a row's local numbers (a Column each, by index) and its chunk's entry.
    """
    packed = chunked(df, by, values, hours)
    keys = [f for f in packed.schema.fields if f.name in (*by, "_slice")]
    schema = T.StructType([*keys, T.StructField("_summary", T.ArrayType(T.DoubleType())), T.StructField("_own", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [local(fields_of(batch.column("rows"), k)) for k in range(batch.num_rows)]
            summaries = pa.array([list(map(float, s)) for s, _ in results], pa.list_(pa.float64()))
            own = pa.array([[np.asarray(x, float) for x in o] for _, o in results], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keys], summaries, own], [*[f.name for f in keys], "_summary", "_own"])

    parts = written(packed.mapInArrow(worked, schema), "chunks")

    def folded(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_slice")
        g["_entry"] = list(fold(np.stack(g["_summary"].to_list())))
        return g[[*[f.name for f in keys], "_entry"]]

    entries = parts.select(*[f.name for f in keys], "_summary").groupBy(*by).applyInPandas(folded, T.StructType([*keys, T.StructField("_entry", T.ArrayType(T.DoubleType()))]))
    found = parts.drop("_summary").join(entries, [f.name for f in keys])
    at = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*_order(df, values)))
    rows = _sliced(df, by, hours).withColumn("_at", at).join(found, [f.name for f in keys], "left")
    own, entry = (lambda i: F.col("_own")[i][F.col("_at") - 1]), (lambda i: F.col("_entry")[i])
    return rows.withColumns(finish(own, entry)).drop("_slice", "_at", "_own", "_entry")


def by_group(df: DataFrame, by: list[str], values: list[str], outputs: list[str], work: Callable) -> DataFrame:
    """df with new doubles that `work(fields)` gives for a whole group (a dict of arrays by output's name; NaN: null).

    Only the values travel to Python, a group in one row of arrays; rows take their results by their place in the group.
    """
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*_order(df, values)))).alias("rows"))
    keys = [f for f in packed.schema.fields if f.name in by]

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(fields_of(batch.column("rows"), k)) for k in range(batch.num_rows)]
            own = [[pa.array(np.asarray(f[n], float), mask=np.isnan(np.asarray(f[n], float))) for n in outputs] for f in found]
            columns = [pa.array([o[i].to_pylist() for o in own], pa.list_(pa.float64())) for i in range(len(outputs))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keys], *columns], [*[f.name for f in keys], *[f"_own{i}" for i in range(len(outputs))]])

    schema = T.StructType([*keys, *[T.StructField(f"_own{i}", T.ArrayType(T.DoubleType())) for i in range(len(outputs))]])
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(df, values)))
    rows = df.withColumn("_at", at).join(packed.mapInArrow(worked, schema), by, "left")
    return rows.withColumns({n: F.col(f"_own{i}")[F.col("_at") - 1] for i, n in enumerate(outputs)}).drop("_at", *[f"_own{i}" for i in range(len(outputs))])
