"""Panels as Parquet: pruned scans, years stitched by name, partitioned and incremental writes; CSV results; JDBC pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, instruments: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """A partitioned panel; partitions and columns that aren't asked for aren't read."""
    df = spark.read.parquet(path)
    if instruments and "instrument" in df.columns:
        df = df.where(F.col("instrument").isin(*instruments))
    if years and "year" in df.columns:
        df = df.where(F.col("year").isin(*years))
    return df.select(*columns) if columns else df


def schema_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Names and types, from footers alone."""
    return spark.read.parquet(path).dtypes


def stitch(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of several days or years as one, by name; columns that a file lacks are null, wider types win."""
    frames = [spark.read.parquet(p) for p in paths]
    if not frames:
        raise ValueError("nothing to stitch")
    order = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string"]
    wide: dict[str, str] = {}
    for f in frames:
        for n, t in f.dtypes:
            was = wide.setdefault(n, t)
            if t in order and was in order and order.index(t) > order.index(was):
                wide[n] = t
    frames = [f.select(*[F.col(n).cast(wide[n]).alias(n) for n in f.columns]) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that are there; missing years are no error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(p)
        return bool(where.getFileSystem(conf).exists(where))

    return [p for p in paths if there(p)]


def write_panel(df: DataFrame, path: str, by: tuple[str, ...] = ("instrument", "year"), order: str = "ts") -> None:
    """One set of files a partition, sorted, zstd; only the partitions of df are replaced, so a rerun repairs itself."""
    writer = df.repartition(*by).sortWithinPartitions(*by, order).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def not_yet_built(catalog: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog rows whose partition isn't written: what an incremental build still has to do."""
    return catalog.join(built.select(*keys).distinct(), keys, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file; for results of a bounded number of rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, lower: str | None = None, upper: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A query in a remote database, read in ranges of a date or number column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if not column:
        return reader.option("query", query).load()
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()


def remote_tables(spark: SparkSession, url: str, pattern: str = "%", columns: str = "information_schema.columns", **options: str) -> DataFrame:
    """Schemas, tables and their columns of a remote database, from its catalogue `columns` (table_schema, table_name, column_name); the
    pattern is a filter that Spark pushes down, never a part of the query's text."""
    found = spark.read.format("jdbc").option("url", url).option("dbtable", columns).options(**options).load()
    found = found.select(*[F.col(c) for c in ("table_schema", "table_name", "column_name")]).where(F.col("table_name").like(pattern))
    return found.groupBy("table_schema", "table_name").agg(F.sort_array(F.collect_set("column_name")).alias("columns"))


def option_chain(raw: DataFrame) -> DataFrame:
    """A warehouse's option rows as a chain: strikes in thousandths, numbers that may not parse, unwanted rows out."""
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(F.to_date("date").alias("date"), (number("strike_price") / 1000.0).alias("strike_price"), F.to_date("exdate").alias("exdate"), "cp_flag", number("open_interest").alias("open_interest"), number("gamma").alias("gamma")).where("cp_flag in ('C', 'P') and strike_price is not null")
