"""Bars and as-of joins in SQL: views over the market tables, and table functions over the views.

    register(spark, trades, quotes, depth)
    spark.sql("select * from ohlcv_bars(3600) where instr = 1")
    spark.sql("select * from trades_asof(1800) where ts >= timestamp'2024-01-03 09:30:00'")

Views: `trades`, `quotes`, `depth` (what is given), `quote_stream` (bid, ask, mid and spread after each quote), `trade_mids` (trades with the
mid just before them), `bar_books` (hourly bars with the book before their ends). They are plans, not copies: filters and columns of a
query reach the tables. Table functions are SQL functions of the session; Catalyst puts their bodies into the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import bars, execution
from .operators.asof import asof

_END = "timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, seconds * (floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz)) / seconds) + 1))"

#: Bodies of the table functions by name, with their parameters and the view that each needs.
FUNCTIONS = {
    "ohlcv_bars": (
        "seconds int",
        "trades",
        f"""select instr, {_END} as ts, min_by(price, struct(ts, seq)) as open, max(price) as high, min(price) as low, max_by(price, struct(ts, seq)) as close, sum(quantity) as volume,
            coalesce(sum(quantity) filter (where aggressor_sign = 1), 0) as buys_qty, coalesce(sum(quantity) filter (where aggressor_sign = -1), 0) as sells_qty, count(*) as trades_count
            from trades group by 1, 2""",
    ),
    "quote_bars": (
        "seconds int",
        "quote_stream",
        f"select instr, {_END} as ts, max_by(bid, struct(ts, seq)) as bid_close, max_by(ask, struct(ts, seq)) as ask_close, max_by(mid, struct(ts, seq)) as mid_close, avg(spread) as spread_mean_sub from quote_stream group by 1, 2",
    ),
    "trades_asof": (
        "within double",
        "trade_mids",
        "select instr, ts, seq, price, quantity, aggressor_sign, case when timestampdiff(MICROSECOND, mid_ts, ts) <= within * 1000000 then mid end as mid, case when timestampdiff(MICROSECOND, mid_ts, ts) <= within * 1000000 then mid_ts end as mid_ts from trade_mids",
    ),
}


def register(spark: SparkSession, trades: DataFrame | None = None, quotes: DataFrame | None = None, depth: DataFrame | None = None, every: str = "1 hour") -> list[str]:
    """Registers the views that the given tables allow and the functions over them; returns their names."""
    views = {"trades": trades, "quotes": quotes, "depth": depth}
    if quotes is not None:
        views["quote_stream"] = bars.quote_stream(quotes)
    if trades is not None and quotes is not None:
        views["trade_mids"] = asof(trades, views["quote_stream"].select("instr", "ts", "seq", "mid"), ["instr"], strict=True, carry="mid_ts")
        if depth is not None:
            views["bar_books"] = execution.book_snapshot(bars.core_bars(trades, quotes, every), depth)
    names = []
    for name, view in views.items():
        if view is not None:
            view.createOrReplaceTempView(name)
            names.append(name)
    for name, (parameters, source, body) in FUNCTIONS.items():
        if source in names:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.sql(_with_sample(body, parameters)).schema.fields)
            spark.sql(f"create or replace temporary function {name}({parameters}) returns table ({columns}) return {body}")
            names.append(name)
    return names


def _with_sample(body: str, parameters: str) -> str:
    """The body with a number for its parameter, to tell its columns; nothing runs."""
    name, kind = parameters.split(" ")
    return f"select * from ({body.replace(name, f'cast(1 as {kind})')}) where false"
