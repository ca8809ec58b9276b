"""Flows of arriving trades that depend on order: signed volume that restarts with the session, and volume buckets, by keyed state and timers.

Rows may arrive out of order within the watermark. Each key's rows wait in a list state until the watermark has passed their time; a timer
at the earliest of them wakes the key, which takes what is due in the order of (ts, seq), carries its totals on and gives the rows that are
final. So the stream gives what the batch operators give over the same rows (bars.cumulative_flow, sequential.volume_buckets), less rows that
came later than the watermark allows. A key's state is its totals and the rows of the last `late`; both live in the state store.

Sources have instr, ts (TIMESTAMP), seq, buys_qty and sells_qty, as signed_trades gives them. Spark asks for the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import session

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def signed_trades(trades: DataFrame) -> DataFrame:
    """Trades as rows of bought and sold quantity."""
    part = lambda s: F.when(F.col("aggressor_sign") == s, F.col("quantity")).otherwise(0).cast("long")
    return trades.select("instr", "ts", F.col("seq").cast("long").alias("seq"), part(1).alias("buys_qty"), part(-1).alias("sells_qty"))


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then hands them on in order. Subclasses say what a row does to the totals."""

    #: DDL of the totals, and what they are at first.
    totals_schema, first = "", ()
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, buys long, sells long, week string, day string")
        self.totals = handle.getValueState("totals", self.totals_schema)

    def step(self, totals: list, row: tuple) -> tuple[list, tuple | None]:
        """The totals after a row, and the row to give, if any."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, earliest = [], None
        for part in rows:
            at = part["ts"].dt.tz_localize(None).astype("datetime64[us]").astype("int64") if part["ts"].dt.tz is not None else part["ts"].astype("datetime64[us]").astype("int64")
            fresh += list(zip(at.tolist(), part["seq"].tolist(), part["buys_qty"].tolist(), part["sells_qty"].tolist(), part["week_key"].tolist(), part["day_key"].tolist(), strict=True))
        if fresh:
            self.waiting.appendList(fresh)
            earliest = min(r[0] for r in fresh)
        if earliest is not None:
            self._wake(earliest, timerValues)
        return iter(())

    def _wake(self, at: int, timerValues) -> None:
        """A timer just after a row's time, but not before the watermark."""
        self.handle.registerTimer(max(at // 1_000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1_000
        rows = [tuple(r) for r in self.waiting.get()]
        due, rest = sorted(r for r in rows if r[0] < upto), [r for r in rows if r[0] >= upto]
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[0] for r in rest), timerValues)
        else:
            self.waiting.clear()
        totals = list(self.totals.get()) if self.totals.exists() else list(self.first)
        out = []
        for row in due:
            totals, given = self.step(totals, row)
            if given is not None:
                out.append((key[0], pd.Timestamp(row[0], unit="us", tz="UTC"), *given))
        if due:
            self.totals.update(tuple(totals))
        if out:
            yield pd.DataFrame(out, columns=["instr", "ts", *self.columns])

    def close(self) -> None:
        pass


class SessionFlow(InOrder):
    """Signed volume since the week and the session began, and rows since the latter."""

    totals_schema, first = "week string, day string, of_week long, of_day long, rows long", ("", "", 0, 0, -1)
    columns = ["seq", "cvd_globex", "cvd_rth", "bars_since_rth_reset"]

    def step(self, totals, row):
        _, seq, buys, sells, week, day = row
        last_week, last_day, of_week, of_day, n = totals
        of_week = (of_week if week == last_week else 0) + buys - sells
        of_day, n = (of_day, n + 1) if day == last_day else (0, 0)
        of_day += buys - sells
        return [week, day, of_week, of_day, n], (seq, float(of_week), float(of_day), n)


class VolumeBuckets(InOrder):
    """Runs of rows that reach a volume."""

    totals_schema, first = "volume long, signed long, rows long", (0, 0, 0)
    columns = ["vpin", "bucket_volume", "n_sub_bars"]

    def __init__(self, size: int):
        self.size = size

    def step(self, totals, row):
        volume, signed, n = totals[0] + row[2] + row[3], totals[1] + row[2] - row[3], totals[2] + 1
        if volume < self.size:
            return [volume, signed, n], None
        return [0, 0, 0], (abs(signed) / volume if volume else 0.0, volume, n)


def _stateful(rows: DataFrame, processor: InOrder, out: str, late: str) -> DataFrame:
    et = session.eastern(F.col("ts").cast("timestamp_ntz"))
    keyed = rows.withColumns({"week_key": F.date_trunc("week", et).cast("string"), "day_key": session.rth_date(et).cast("string")}).withWatermark("ts", late)
    return keyed.groupBy("instr").transformWithStateInPandas(processor, f"instr {dict(rows.dtypes)['instr']}, ts timestamp, {out}", "append", "EventTime")


def streaming_flow(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """instr, ts, seq, cvd_globex, cvd_rth and bars_since_rth_reset of each arriving row, once the watermark has passed it."""
    return _stateful(rows, SessionFlow(), "seq long, cvd_globex double, cvd_rth double, bars_since_rth_reset long", late)


def streaming_buckets(rows: DataFrame, size: int, late: str = "10 minutes") -> DataFrame:
    """instr, ts, vpin, bucket_volume and n_sub_bars of each volume bucket, once it has closed. What goes beyond the size isn't carried over."""
    return _stateful(rows, VolumeBuckets(size), "vpin double, bucket_volume long, n_sub_bars long", late)


__all__ = ["InOrder", "SessionFlow", "VolumeBuckets", "signed_trades", "streaming_buckets", "streaming_flow", "use_rocksdb"]
