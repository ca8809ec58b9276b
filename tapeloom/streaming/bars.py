"""Bars of trades that arrive: tumbling windows with a watermark, the same aggregates as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import bar_end


def streaming_ohlcv(trades: DataFrame, every: str, late: str = "10 minutes") -> DataFrame:
    """instr, ts and OHLCV of each bar once it is complete; trades later than `late` are dropped. ts is a TIMESTAMP."""
    at, q = F.struct("ts", "seq"), F.col("quantity")
    when = lambda sign: F.coalesce(F.sum(F.when(F.col("aggressor_sign") == sign, q)), F.lit(0))
    grouped = trades.withWatermark("ts", late).groupBy("instr", F.window("ts", every))
    out = grouped.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum(q).alias("volume"), when(1).alias("buys_qty"), when(-1).alias("sells_qty"), F.count(F.lit(1)).alias("trades_count"))
    return out.select("instr", F.col("window.end").alias("ts"), *[c for c in out.columns if c not in ("instr", "window")])


__all__ = ["bar_end", "streaming_ohlcv"]
