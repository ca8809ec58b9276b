"""Incremental builds of partitioned panels: a manifest tells which partitions are there, from which inputs, and which failed.

A catalogue has a row a partition key (an instrument and day) and a signature of its inputs. A build makes what the manifest lacks, what
failed before and what has changed inputs, in batches of many partitions a Spark job; a batch that fails is halved until the keys that
fail stand alone, so one broken file costs no other its build. A batch's keys are noted as `started`, their old partitions removed, the new
ones written, then noted as `ok` or `empty` (no rows: no failure): what a cut-off build left as started is made again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import remove
from .tables import existing, write_panel

#: Fixed value: the first day that tuning must not see.
OUT_OF_SAMPLE = date(2024, 1, 1)


@dataclass
class Summary:
    """Counts of partitions by what became of them, and the failures."""

    built: int = 0
    empty: int = 0
    skipped: int = 0
    failed: int = 0
    errors: list[tuple[Row, str]] = field(default_factory=list)

    @property
    def fine(self) -> bool:
        return not self.failed


def refuse_out_of_sample(start: date, end: date, first: date = OUT_OF_SAMPLE) -> None:
    """An error where a range of days reaches what must stay unseen, or is none."""
    if end >= first:
        raise ValueError(f"{end} is out of sample, which begins on {first}")
    if start > end:
        raise ValueError(f"{start} is after {end}")


def in_days(df: DataFrame, start: date, end: date, ts: str = "ts") -> DataFrame:
    """Rows from the start of one day to the end of another, as a range that the scan can push down."""
    kind = df.schema[ts].dataType
    bound = lambda d, more: (F.date_add(F.lit(d), more) if more else F.lit(d)).cast(kind)
    return df.where((F.col(ts) >= bound(start, 0)) & (F.col(ts) < bound(end, 1)))


def load_days(spark: SparkSession, pattern: str, start: date, end: date, ts: str = "ts", out_of_sample: date | None = None) -> DataFrame:
    """Rows of all files that a glob matches in a range of days; an error without files or rows, or where `out_of_sample` is reached."""
    if out_of_sample is not None:
        refuse_out_of_sample(start, end, out_of_sample)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    rows = in_days(spark.read.option("mergeSchema", True).parquet(*[f.getPath().toString() for f in found]), start, end, ts)
    if rows.isEmpty():
        raise ValueError(f"no rows from {start} to {end}")
    return rows


def signature(*inputs: Column) -> Column:
    """A text that changes when any input does."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in inputs])), 256)


def latest(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in manifest.columns if c not in (*keys, "entry")]
    return manifest.groupBy(*keys).agg(F.max_by(F.struct("entry", *rest), "entry").alias("_last")).select(*keys, "_last.*")


class Build:
    """A partitioned panel at `path` whose manifest lies beside it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str = "ts"):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.manifest_path = f"{self.path}.manifest"

    def manifest(self) -> DataFrame | None:
        """Every entry so far: keys, signature, status (started, ok, empty, failed), n_rows, message, entry (a
        number that grows)."""
        return self.spark.read.parquet(self.manifest_path) if existing(self.spark, [self.manifest_path]) else None

    def todo(self, catalog: DataFrame, overwrite: bool = False) -> DataFrame:
        """Catalogue rows whose partition isn't made from these inputs yet."""
        done = self.manifest()
        if done is None or overwrite:
            return catalog
        fine = latest(done, self.keys).where("status in ('ok', 'empty')").select(*self.keys, "signature")
        return catalog.join(fine, [*self.keys, "signature"], "left_anti")

    def run(self, catalog: DataFrame, make: Callable[[list[Row]], DataFrame], batch: int = 64, overwrite: bool = False) -> Summary:
        """Makes what is to do. `make` gets catalogue rows and gives the panel's rows of these keys. The driver holds the catalogue's rows."""
        if "signature" not in catalog.columns:
            raise ValueError("a catalogue has a column `signature`")
        self.key_types = [catalog.schema[k] for k in self.keys]
        todo = self.todo(catalog, overwrite).orderBy(*self.keys).collect()
        out = Summary(skipped=catalog.count() - len(todo))
        done = self.manifest()
        self.entry = done.agg(F.max("entry")).first()[0] or 0 if done is not None else 0
        for at in range(0, len(todo), batch):
            self._batch(todo[at : at + batch], make, out)
        return out

    def _batch(self, rows: list[Row], make: Callable[[list[Row]], DataFrame], out: Summary) -> None:
        try:
            self._note([(r, "started", 0, None) for r in rows])
            made = make(rows)
            for r in rows:
                remove(self.spark, self._partition(r))
            write_panel(made, self.path, tuple(self.keys), self.order)
            counts = self._counts(rows)
        except Exception as error:  # noqa: BLE001  a broken input may fail in any way; it is recorded and counted
            if len(rows) > 1:
                half = len(rows) // 2
                self._batch(rows[:half], make, out)
                self._batch(rows[half:], make, out)
                return
            out.failed += 1
            out.errors.append((rows[0], f"{type(error).__name__}: {str(error)[:500]}"))
            self._note([(rows[0], "failed", 0, out.errors[-1][1])])
            return
        entries = []
        for r in rows:
            n = counts.get(tuple(r[k] for k in self.keys), 0)
            out.built, out.empty = out.built + (n > 0), out.empty + (n == 0)
            entries.append((r, "ok" if n else "empty", n, None))
        self._note(entries)

    def _partition(self, row: Row) -> str:
        name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join([self.path, *[name(k, None if row[k] is None else str(row[k])) for k in self.keys]])

    def _counts(self, rows: list[Row]) -> dict[tuple, int]:
        """How many rows each key of a batch has."""
        paths = existing(self.spark, [self._partition(r) for r in rows])
        if not paths:
            return {}
        there = self.spark.read.option("basePath", self.path).parquet(*paths)
        found = there.groupBy(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.key_types]).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a key
        return {tuple(r[k] for k in self.keys): r["n"] for r in found}

    def _note(self, entries: list[tuple]) -> None:
        schema = T.StructType([*self.key_types, *T._parse_datatype_string("signature string, status string, n_rows long, message string, entry long").fields])
        self.entry += 1
        rows = [(*[r[k] for k in self.keys], r["signature"], status, n, message, self.entry) for r, status, n, message in entries]
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.manifest_path)
