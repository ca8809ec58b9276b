"""Helpers that the text operators share: batch bounds, shared tables, words, hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Fixed value: so many narrow rows are no burden to one task, should they all have one key.
FEW_ROWS = 100_000


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts cannot fill a worker; settings of the user stay.

    Also sends this package to the executors, once an application, wherever they were started.
    """
    ship_package(spark)
    for key, value, default in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, None),
    ):
        try:
            now = spark.conf.get(key)
        except Exception:  # noqa: BLE001  an older Spark has no such setting
            continue
        if default is None or now == default:
            spark.conf.set(key, str(value))


def ship_package(spark: SparkSession) -> None:
    """Adds the package as a zip file to the application's Python files."""
    context = spark.sparkContext
    if getattr(context, "_tapeloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        target = Path(tempfile.mkdtemp(prefix="tapeloom-code-")) / "tapeloom_code.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(top.rglob("*.py")):
                archive.write(source, source.relative_to(top.parent))
        context.addPyFile(str(target))
    context._tapeloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):  # one machine: any of its folders is shared
        base = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/tapeloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as Parquet and read it again.

    A lost executor then costs a read of the table and not a second run of what made it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables as `written` returned them: for those of which all that reads them is written itself."""
    for df in tables:
        _remove(df.sparkSession, df._written_at)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a written table whose buckets hold the hashes of `key`: joins by the key leave its rows where they lie.

    It has as many buckets as a shuffle has partitions in this session, so that the other side of such a join is dealt alike.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tapeloom_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", new_path(spark, name)).format("parquet").saveAsTable(table)
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"drop table if exists {table}")
    except Exception:  # noqa: BLE001  the session and its catalogue have ended
        pass


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name made from `name` that is none of those taken, whatever their case."""
    name, taken = f"_{name}", {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str, share: int = 1_000, keys: DataFrame | None = None, few: int = 0) -> DataFrame:
    """left joined ("inner" or "left") with right, which has one row a key (or few), where a key may hold any part of left's rows.

    Keys with more than 1/share of left's rows are at most `share` by their count: right's rows of these are broadcast, and
    left's stay where they are. All others are joined by a shuffle, in which no key has more than 1/share of the rows. left, or
    `keys`, which has a row for each of left's, is read once more to count: give a written table. Up to `few` rows make no hot
    key: they are joined at once, without a count by key.
    """
    keys = left if keys is None else keys
    n = keys.count()
    if n <= few:
        return left.join(right, key, how)
    times = fresh("times", keys.columns)
    counts = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(times))
    hot = [row[0] for row in counts.where(F.col(times) * share > n).select(key).collect()]  # fewer than `share`
    if not hot:
        return left.join(right, key, how)
    held = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = left.where(held).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    return few.unionByName(left.where(~held).join(right, key, how))


def byte_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() parts exactly at these six ASCII characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fold(text: bytes) -> bytes:
    """Lower case of A-Z only, as bytes.lower() does."""
    return text.lower()


class WordHash(dict):
    """64-bit hashes of words, kept for the common ones; emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], hashes: WordHash, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, the whole sequence as one; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    m = len(words) - k + 1
    s = np.full(m, k, np.uint64)
    for i in range(k):
        s = mix(s * _M1 + h[i : i + m])
    s.sort()
    keep = np.empty(m, bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def chunked(rows: Iterable[tuple], schema: pa.Schema, size: int = 2_000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded rows and, for binary columns, bytes."""
    block: list[tuple] = []
    held = 0
    for row in rows:
        block.append(row)
        held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(block) >= size or held >= most_bytes:
            yield _batch(block, schema)
            block, held = [], 0
    if block:
        yield _batch(block, schema)


def _batch(block: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)
