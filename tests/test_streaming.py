"""Keyed streams with timers give what batch gives; rows beyond the watermark are left out."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tapeloom.operators import bars, sequential
from tapeloom.streaming import flows

T0 = dt.datetime(2024, 3, 8, 12)


def trades(n=150):
    """Rows over a weekend and several sessions, in order of time."""
    rng, rows, t = random.Random(3), [], T0
    for i in range(n):
        t += dt.timedelta(minutes=rng.choice((1, 20, 90)), microseconds=rng.randrange(1_000))
        rows.append((i % 2, t, i, 100.0, rng.randrange(1, 50), rng.choice((-1, 0, 1)), False))
    return rows


SCHEMA = "instr int, ts timestamp, seq long, price double, quantity long, aggressor_sign int, is_implied boolean"


def streamed(spark, tmp_path, batches, make, name):
    """The rows that a stream gives over files that arrive one after the other."""
    src = str(tmp_path / "src")
    (tmp_path / "src").mkdir()
    schema = spark.createDataFrame([], SCHEMA).schema
    flows.use_rocksdb(spark)
    out = make(flows.signed_trades(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)))
    q = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if q is None:
            q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def shuffled(rows, seed=1):
    """Batches of 30 rows, each out of order, and a last one far in the future."""
    rng, out = random.Random(seed), []
    for at in range(0, len(rows), 30):
        part = rows[at : at + 30]
        rng.shuffle(part)
        out.append(part)
    return [*out, [(k, T0 + dt.timedelta(days=60), 10_000 + k, 1.0, 1, 1, False) for k in (0, 1)], [(k, T0 + dt.timedelta(days=90), 20_000 + k, 1.0, 1, 1, False) for k in (0, 1)]]


def batch(spark, rows):
    return flows.signed_trades(spark.createDataFrame(rows, SCHEMA)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_session_flow_equals_batch(spark, tmp_path):
    rows = trades()
    got = streamed(spark, tmp_path, shuffled(rows), lambda s: flows.streaming_flow(s, "1 hour"), "flow").where("seq < 10000").select("seq", "cvd_globex", "cvd_rth", "bars_since_rth_reset")
    want = bars.cumulative_flow(batch(spark, rows)).select("seq", "cvd_globex", "cvd_rth", "bars_since_rth_reset")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(rows)


def test_buckets_equal_batch(spark, tmp_path):
    rows = trades()
    got = streamed(spark, tmp_path, shuffled(rows, 2), lambda s: flows.streaming_buckets(s, 120, "1 hour"), "buckets")
    got = got.where(F.col("ts") < F.lit(T0 + dt.timedelta(days=40))).select("instr", F.col("ts").cast("timestamp_ntz").alias("ts"), "vpin", "bucket_volume", "n_sub_bars")
    want = sequential.volume_buckets(batch(spark, rows), 120).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_late_rows_are_left_out(spark, tmp_path):
    rows = trades(60)
    late = [(0, T0, 9_000, 100.0, 1_000, 1, False)]
    batches = shuffled(rows)
    got = streamed(spark, tmp_path, [*batches[:2], late, *batches[2:]], lambda s: flows.streaming_flow(s, "1 hour"), "late_flow").where("seq < 10000").select("seq", "cvd_globex")
    want = bars.cumulative_flow(batch(spark, rows)).select("seq", "cvd_globex")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
