"""URL filters by a temporal list join: what a dated block list said of a page when it was fetched.

List entries are dated events (entry, action, listed_on): `block`, `allow` or `remove` of a host, of a parent domain or of a
path prefix (host/segment/...). Per entry each event opens a validity interval that the entry's next event closes; events and
captures go by time, a date being its midnight (of several events at one time the greatest action name counts). A capture is
looked up under each of its keys: its path prefixes, as deep as the list's deepest entry, its host, and the host's parent domains. The as-of join matches an interval that holds the fetch time; the most specific match
decides, and captures without one pass.

Both sides are dealt by key and month, so the captures of one hot host are spread over the months; a key and month that still
holds very many of them goes through `hot_join`. An interval is repeated for each month of the captures' range that it covers,
not without end. Captures are numbered once, in a written table, so a lost executor changes no number.
DataFrame functions only; no Python runs on executors.

Null or unreadable urls have no host and pass; null fetch times match nothing; repeated captures are judged each. Very long urls
and paths are read whole. Ties: of matches of one rank the greatest key, then action. Null entries and dates are left out. Empty
captures give an empty result, an empty list passes all. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, written


def url_keys(url: str = "url") -> tuple:
    """Expressions: host (lower case, without port and user), and the array of (key, rank) from the most specific on."""
    host = f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return host, path


def list_intervals(events: DataFrame) -> DataFrame:
    """(entry, action, valid_from, valid_to) with valid_to open at the end; `remove` closes and opens nothing."""
    listed = events.where("entry is not null and listed_on is not null").select(F.lower("entry").alias("entry"), "action", F.to_timestamp("listed_on").alias("at"))
    last = listed.groupBy("entry", "at").agg(F.max("action").alias("action"))
    # The events of one entry are its history: as many as times at which it changed.
    span = last.withColumn("valid_to", F.lead("at").over(Window.partitionBy("entry").orderBy("at")))
    return span.where("action in ('block', 'allow')").select("entry", "action", F.col("at").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, matched_entry, action, kept of every capture (page_id, url, fetched_on)."""
    host, path = url_keys()
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.to_date("fetched_on").alias("fetched_on"), F.to_timestamp("fetched_on").alias("_at"))
    rows = rows.withColumn("host", F.expr(f"nullif({host}, '')")).withColumn("_path", F.expr(f"filter(split({path}, '/'), x -> x <> '')"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "captures")
    deepest = events.agg(F.coalesce(F.max(F.size(F.split("entry", "/")) - 1), F.lit(0)).alias("_depth"))  # one row
    keys = """array_distinct(concat(
        transform(sequence(least(size(_path), _depth), 0, -1), i -> struct(lower(concat_ws('/', host, slice(_path, 1, i))) as key, 100 + i as rank)),
        transform(filter(sequence(2, size(split(host, '[.]'))), i -> i < size(split(host, '[.]'))),
                  i -> struct(concat_ws('.', slice(split(host, '[.]'), size(split(host, '[.]')) - i + 1, i)) as key, i as rank))))"""
    keyed = rows.where("host is not null and fetched_on is not null").crossJoin(F.broadcast(deepest)).select("_row", "page_id", "fetched_on", "_at", F.expr(f"inline({keys})")).select("_row", "_at", "key", "rank", F.concat_ws("|", "key", F.trunc("fetched_on", "month")).alias("slot"))
    bounds = rows.agg(F.trunc(F.min("fetched_on"), "month").alias("first"), F.trunc(F.max("fetched_on"), "month").alias("last"))  # one row
    spans = (
        list_intervals(events)
        .crossJoin(F.broadcast(bounds))  # with one row: the range of the captures
        .where("first is not null and valid_from < add_months(last, 1) and (valid_to is null or valid_to > first)")
        .withColumn("month", F.expr("explode(sequence(greatest(trunc(valid_from, 'month'), first), least(coalesce(trunc(valid_to - interval 1 microsecond, 'month'), last), last), interval 1 month))"))
        .select(F.concat_ws("|", "entry", "month").alias("slot"), "action", "valid_from", "valid_to")
    )
    # A slot's intervals are the changes of one entry in a month.
    hits = hot_join(keyed, spans, "slot", "inner").where("_at >= valid_from and (valid_to is null or _at < valid_to)")
    best = hits.groupBy("_row").agg(F.max(F.struct("rank", "key", "action")).alias("hit"))
    out = rows.select("_row", "page_id", "host", "fetched_on").join(best, "_row", "left")
    return out.select("page_id", "host", "fetched_on", F.col("hit.key").alias("matched_entry"), F.col("hit.action").alias("action"), F.coalesce(F.col("hit.action") != "block", F.lit(True)).alias("kept"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """pages with fetch days spread over two years by page_id: the tables have none."""
    return pages.select("page_id", "url", F.expr("date_add(date'2023-01-01', cast(pmod(page_id * 37, 730) as int))").alias("fetched_on"))


def demo_events(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of pages by a rule over their digests: blocks, removals and new blocks of a third of
    the hosts, allowed paths below some, and one parent domain for half a year."""
    host, _ = url_keys()
    hosts = pages.select(F.expr(f"nullif({host}, '')").alias("host")).where("host is not null").distinct().withColumn("h", F.expr("cast(conv(substr(sha2(host, 256), 1, 7), 16, 10) as bigint)"))
    some = hosts.where("h % 3 = 0")
    day = "date_add(date'2023-01-01', cast({} as int))"
    parts = [
        some.select(F.col("host").alias("entry"), F.lit("block").alias("action"), F.expr(day.format("h % 200")).alias("listed_on")),
        some.where("h % 2 = 0").select(F.col("host").alias("entry"), F.lit("remove").alias("action"), F.expr(day.format("h % 200 + 150")).alias("listed_on")),
        some.where("h % 4 = 0").select(F.col("host").alias("entry"), F.lit("block").alias("action"), F.expr(day.format("h % 200 + 300")).alias("listed_on")),
        some.where("h % 5 = 0").select(F.concat("host", F.lit("/en")).alias("entry"), F.lit("allow").alias("action"), F.expr(day.format("h % 300")).alias("listed_on")),
    ]
    fixed = hosts.sparkSession.createDataFrame([("example.org", "block", "2023-06-01"), ("example.org", "remove", "2023-12-01")], "entry string, action string, listed_on string").withColumn("listed_on", F.to_date("listed_on"))
    out = fixed
    for part in parts:
        out = out.unionByName(part)
    return out


ORACLE = r"""
with captures as (
    select page_id, url, date '2023-01-01' + cast(((page_id * 37) % 730 + 730) % 730 as integer) as fetched_on,
        nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as path,
        row_number() over () as row_id
    from pages),
names as (select distinct host from captures where host is not null),
h as (select host, cast('0x' || substr(sha256(host), 1, 7) as bigint) as h from names),
events as (
    select 'example.org' as entry, 'block' as action, date '2023-06-01' as day
    union all select 'example.org', 'remove', date '2023-12-01'
    union all select host, 'block', date '2023-01-01' + cast(h % 200 as integer) from h where h % 3 = 0
    union all select host, 'remove', date '2023-01-01' + cast(h % 200 + 150 as integer) from h where h % 3 = 0 and h % 2 = 0
    union all select host, 'block', date '2023-01-01' + cast(h % 200 + 300 as integer) from h where h % 3 = 0 and h % 4 = 0
    union all select host || '/en', 'allow', date '2023-01-01' + cast(h % 300 as integer) from h where h % 3 = 0 and h % 5 = 0),
days as (select entry, day, max(action) as action from events group by entry, day),
spans as (select entry, action, day as valid_from, lead(day) over (partition by entry order by day) as valid_to from days),
keyed as (
    select row_id, fetched_on, host as key, 100 as rank from captures where host is not null
    union all select row_id, fetched_on, lower(host || '/' || path[1]), 101 from captures where host is not null and len(path) >= 1
    union all select row_id, fetched_on, lower(host || '/' || path[1] || '/' || path[2]), 102 from captures where host is not null and len(path) >= 2
    union all select row_id, fetched_on, array_to_string(string_split(host, '.')[-i:], '.'), i
        from captures, range(2, 12) as r(i) where host is not null and i < len(string_split(host, '.'))),
hits as (
    select row_id, arg_max(key, rank) as key, arg_max(action, rank) as action
    from keyed join spans on key = entry and fetched_on >= valid_from and (valid_to is null or fetched_on < valid_to)
    where action in ('block', 'allow') group by row_id)
select page_id, host, fetched_on, hits.key as matched_entry, hits.action as action, coalesce(hits.action <> 'block', true) as kept
from captures left join hits using (row_id)
"""
__all__ = ["demo_captures", "demo_events", "judge_captures", "list_intervals"]
