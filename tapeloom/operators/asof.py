"""As-of joins over slices of time, with carries: a key's history is parted among many tasks.

Both sides are tagged, united and dealt by (key, slice) in one shuffle. Within a slice a window finds the last right row; each slice's
last right row, a row a slice, is handed on to the slices after it, where it stands in for left rows that come before any right row of
their own slice. The carries are read from the same shuffle, and join back without another one of the rows.

Right columns travel as one struct, so that a right row with nulls still covers older ones. Strict: a right row at the very
time of a left one doesn't count. `within` bounds the age of the right row in seconds (None: any age). Rows with a null key or time
find nothing and aren't found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import HOURS, slice_of


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str = "ts", strict: bool = False, within: float | None = None, carry: str | None = None, right_on: str | None = None, left_seq: str = "seq", right_seq: str = "seq", hours: int = HOURS) -> DataFrame:
    """left with the columns of the latest right row before (or at) its time; `carry` names a column for that row's time. A slice
    has `hours` hours: fewer where one key's day is too much for a task."""
    values = [c for c in right.columns if c not in (*by, right_on or on, right_seq)]
    return asof_kinds(left, right, by, {None: ({c: c for c in values}, carry)}, None, on, strict, within, right_on, left_seq, right_seq, hours)


def asof_kinds(left: DataFrame, right: DataFrame, by: list[str], kinds: dict, kind: str | None, on: str = "ts", strict: bool = False, within: float | None = None, right_on: str | None = None, left_seq: str = "seq", right_seq: str = "seq", hours: int = HOURS) -> DataFrame:
    """As-of joins with each kind of right row at once: `kinds` has for each value of the column `kind` the new columns by name, with
    the right column that each takes, and the name of a column for that row's time (or None). One shuffle and one window for all."""
    right_on = right_on or on
    clash = [c for columns, _ in kinds.values() for c in columns if c in left.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    values = sorted({c for columns, _ in kinds.values() for c in columns.values()})
    late, early = (0, 1) if strict else (1, 0)  # where the right row stands at equal times
    seq = lambda d, name: F.col(name).cast("long") if name in d.columns else F.lit(0).cast("long")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [*[f"_k{i}" for i in range(len(by))], "_slice"]
    known = F.col(right_on).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    l = left.select(*keys, F.col(on).alias("_t"), F.lit(late).alias("_side"), seq(left, left_seq).alias("_seq"), F.lit(None).cast("string").alias("_kind"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).alias("_right"))
    r = right.where(known).select(*keys, F.col(right_on).alias("_t"), F.lit(early).alias("_side"), seq(right, right_seq).alias("_seq"), F.col(kind).cast("string").alias("_kind") if kind else F.lit(None).cast("string").alias("_kind"), F.lit(None).alias("_left"), F.struct(*[F.col(c) for c in values], F.col(right_on).alias("_at")).alias("_right"))
    both = l.unionByName(r)
    dealt = both.withColumn("_slice", slice_of(both, "_t", hours)).repartition(*names)

    rows = {f"_hit{i}": F.col("_right") if k is None else F.when(F.col("_kind") == k, F.col("_right")) for i, k in enumerate(kinds)}
    frame = Window.partitionBy(*names).orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumns({n: F.last(x, ignorenulls=True).over(frame) for n, x in rows.items()}).where(F.col("_left").isNotNull())
    # A row a slice. It reads the same columns as the window does, so both share one shuffle.
    ends = dealt.groupBy(*names).agg(*[F.max_by(x, F.when(x.isNotNull(), F.struct("_t", "_side", "_seq"))).alias(n) for n, x in rows.items()], F.count("_left").alias("_lefts"))
    before = Window.partitionBy(*names[:-1]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(*names, "_lefts", *[F.last(n, ignorenulls=True).over(before).alias(f"_was{n}") for n in rows]).where("_lefts > 0").drop("_lefts")
    found = found.join(carries, names, "left").withColumns({n: F.coalesce(n, f"_was{n}") for n in rows})
    if within:
        found = found.withColumns({n: F.when(F.col("_t") - F.col(f"{n}._at") <= F.make_dt_interval(secs=F.lit(within)), F.col(n)) for n in rows})
    out = [F.col(f"_left.{c}").alias(c) for c in left.columns]
    for n, (columns, at) in zip(rows, kinds.values(), strict=True):
        out += [F.col(n)[source].alias(name) for name, source in columns.items()] + ([F.col(n)["_at"].alias(at)] if at else [])
    return found.select(*out)


def asof_days(left: DataFrame, right: DataFrame, by: list[str], day: str, apply_from: str, days: int = 5) -> DataFrame:
    """The latest right row by date of at most `days` days back: each row stands for its days, later rows win, then an
    equi-join that shuffles by (key, day) and so spreads hot keys."""
    values = [c for c in right.columns if c not in (*by, apply_from)]
    spans = right.select(*by, F.explode(F.sequence(F.col(apply_from), F.date_add(apply_from, days))).alias(day), F.struct(F.col(apply_from), *values).alias("_row"))
    best = spans.groupBy(*by, day).agg(F.max_by("_row", F.col(f"_row.{apply_from}")).alias("_row"))
    return left.join(best, [*by, day], "left").select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in values])
