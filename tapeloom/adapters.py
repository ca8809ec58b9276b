"""The driver's tables as market data: the tables have none, so events and line items are read as trades, quotes, books,
monthly bars and option chains by fixed rules. The same rules stand as SQL in `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.bars import core_bars

EVERY = "6 hours"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "click", "signup"))
    sign = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return e.select((F.col("user_id") % 4).alias("instr"), "ts", F.col("event_id").alias("seq"), (100 + F.col("value")).alias("price"), (1 + F.col("event_id") % 50).alias("quantity"), sign.alias("aggressor_sign"), (F.col("event_id") % 5 == 0).alias("is_implied"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "error"))
    bid = F.col("event_type") == "view"
    return e.select((F.col("user_id") % 4).alias("instr"), "ts", F.col("event_id").alias("seq"), F.when(bid, "bid").otherwise("ask").alias("side"), (F.when(bid, 100).otherwise(101) + F.col("value")).alias("price"), (1 + F.col("event_id") % 40).alias("size"))


def depth(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    bid = F.col("side") == "bid"
    levels = []
    for k in range(1, 11):
        levels += [(F.col("price") + F.when(bid, -0.25).otherwise(0.25) * (k - 1)).alias(f"L{k}Price"), (1 + (F.col("seq") * 7 + k * 13) % 50).alias(f"L{k}Size"), (1 + (F.col("seq") + k) % 9).alias(f"L{k}Orders")]
    return q.select("instr", "ts", "seq", F.when(bid, "B").otherwise("S").alias("Side"), F.when(F.col("seq") % 7 == 0, 1).otherwise(0).cast("long").alias("Flags"), *levels)


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour core bars, with seq 0 so that their order is that of ts."""
    return core_bars(trades(spark, d), quotes(spark, d), EVERY).withColumn("seq", F.lit(0))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Monthly bars of 30 instruments from line items: close is the mean price, so no order within a month matters."""
    l = table(spark, d, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return l.groupBy((F.col("l_suppkey") % 30).alias("instr"), F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz").alias("ts")).agg(F.avg(price).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").cast("long").alias("volume"), F.sum(F.col("l_quantity") * sign).cast("long").alias("net"))


def chain(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    day = F.trunc(F.col("l_shipdate"), "month")
    return l.join(p, l.l_partkey == p.p_partkey).select(day.alias("date"), (F.col("p_size") * 100.0).alias("strike_price"), F.when(F.col("l_linenumber") == 1, day).otherwise(F.date_add(day, 30)).alias("exdate"), F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("cp_flag"), F.col("l_quantity").alias("open_interest"), F.col("l_discount").alias("gamma"))
