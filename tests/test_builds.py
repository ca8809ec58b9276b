"""Incremental builds: failed, resumed, changed and emptied partitions; ranges of days that must stay unseen."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import builds

DAYS = [date(2023, 1, 2 + i) for i in range(6)]


def catalog(spark, sizes):
    rows = spark.createDataFrame([(k, d, n) for (k, d), n in sizes.items()], "instrument string, day date, bytes long")
    return rows.withColumn("signature", builds.signature(F.col("bytes")))


def maker(spark, broken=(), seen=None):
    def make(rows):
        if seen is not None:
            seen.append([(r.instrument, r.day) for r in rows])
        bad = [r for r in rows if (r.instrument, r.day) in broken]
        out = spark.createDataFrame([(r.instrument, r.day, i, float(r.bytes)) for r in rows for i in range(r.bytes)] or [], "instrument string, day date, ts int, x double")
        if bad:  # a task fails, as it would over a broken file
            return out.withColumn("x", F.raise_error(F.lit(f"broken file of {bad[0].day}")).cast("double"))
        return out

    return make


def contents(build):
    return sorted((r.instrument, str(r.day), r.ts, r.x) for r in build.spark.read.parquet(build.path).collect())


def test_failed_then_resumed(spark, tmp_path):
    build = builds.Build(spark, str(tmp_path / "bars"), ["instrument", "day"])
    sizes = {("ES", d): i % 3 for i, d in enumerate(DAYS)} | {("N/Q", d): 2 for d in DAYS}
    broken = {("ES", DAYS[1]), ("N/Q", DAYS[5])}
    first = build.run(catalog(spark, sizes), maker(spark, broken), batch=5)
    assert (first.built, first.empty, first.skipped, first.failed) == (8, 2, 0, 2) and not first.fine
    assert {(r.instrument, r.day) for r, _ in first.errors} == broken and all("broken file" in m for _, m in first.errors)
    seen = []
    again = build.run(catalog(spark, sizes), maker(spark, seen=seen))
    assert (again.built, again.empty, again.skipped, again.failed) == (2, 0, 10, 0) and seen == [sorted(broken)]
    assert contents(build) == sorted((k, str(d), i, float(n)) for (k, d), n in sizes.items() for i in range(n))
    assert build.run(catalog(spark, sizes), maker(spark, seen=seen)).skipped == 12 and len(seen) == 1


def test_changed_inputs_are_made_again_and_emptied_ones_removed(spark, tmp_path):
    build = builds.Build(spark, str(tmp_path / "bars"), ["instrument", "day"])
    sizes = {("ES", d): 2 for d in DAYS[:3]}
    build.run(catalog(spark, sizes), maker(spark))
    sizes |= {("ES", DAYS[0]): 3, ("ES", DAYS[1]): 0, ("ES", DAYS[3]): 1}
    out = build.run(catalog(spark, sizes), maker(spark))
    assert (out.built, out.empty, out.skipped) == (2, 1, 1)
    assert contents(build) == sorted((k, str(d), i, float(n)) for (k, d), n in sizes.items() for i in range(n))
    last = {r.day: (r.status, r.n_rows) for r in builds.latest(build.manifest(), build.keys).collect()}
    assert last[DAYS[1]] == ("empty", 0) and last[DAYS[0]] == ("ok", 3)
    assert build.run(catalog(spark, sizes), maker(spark), overwrite=True).built == 3


def test_a_build_cut_off_is_made_again(spark, tmp_path):
    build = builds.Build(spark, str(tmp_path / "bars"), ["instrument", "day"])
    sizes = {("ES", d): 2 for d in DAYS[:3]}

    def cut(rows):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        build.run(catalog(spark, sizes), cut)
    assert build.manifest().select("status").distinct().collect() == [("started",)]
    assert build.run(catalog(spark, sizes), maker(spark)).built == 3
    with pytest.raises(ValueError):
        build.run(catalog(spark, sizes).drop("signature"), maker(spark))


def test_days_are_pushed_down_and_guarded(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2023, 12, d, 23, 59), d) for d in range(1, 32)], "ts timestamp_ntz, x int")
    for half in (0, 1):
        rows.where(F.col("x") % 2 == half).write.parquet(str(tmp_path / f"y{half}.parquet"))
    out = builds.load_days(spark, str(tmp_path / "y*.parquet"), date(2023, 12, 3), date(2023, 12, 5), out_of_sample=builds.OUT_OF_SAMPLE)
    assert sorted(r.x for r in out.collect()) == [3, 4, 5]
    assert "GreaterThanOrEqual(ts" in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="out of sample"):
        builds.load_days(spark, str(tmp_path / "y*.parquet"), date(2023, 12, 3), date(2024, 1, 1), out_of_sample=builds.OUT_OF_SAMPLE)
    with pytest.raises(ValueError, match="no rows"):
        builds.load_days(spark, str(tmp_path / "y*.parquet"), date(2022, 12, 3), date(2022, 12, 5))
    with pytest.raises(FileNotFoundError):
        builds.load_days(spark, str(tmp_path / "z*.parquet"), date(2023, 12, 3), date(2023, 12, 5))
    with pytest.raises(ValueError, match="after"):
        builds.refuse_out_of_sample(date(2023, 2, 1), date(2023, 1, 1))
