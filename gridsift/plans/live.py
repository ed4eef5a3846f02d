"""Event queries: the batch form of the streaming operators, and joins as of a time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsift.streaming import live


def events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def as_of(s, d):
    """Each purchase with the user's last click before it (-1: none): one sort by user and time instead of a join."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events(s, d).withColumn("click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before)).filter("event_type = 'purchase'").select("event_id", F.coalesce("click", F.lit(-1)).alias("click"))


QUERIES = {
    "events_tumbling": lambda s, d: live.tumbling(events(s, d)).select("start", "event_type", "n", F.round("total", 2).alias("total")),
    "events_sliding": lambda s, d: live.sliding(events(s, d)),
    "events_session": lambda s, d: live.sessions(events(s, d)).select("user_id", "start", "n"),
    "events_deduplicated": lambda s, d: live.deduplicated(events(s, d).union(events(s, d))).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")),
    "events_as_of": as_of,
}
ORACLES = {
    "events_tumbling": "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "events_sliding": "select start, count(*) as n from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as start from events) t group by start",
    "events_session": "select user_id, min(ts) as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sess from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as fresh from events) a) b group by user_id, sess",
    "events_deduplicated": "select count(*) as n, max(event_id) as last from events",
    "events_as_of": "select event_id, coalesce(click, -1) as click from (select event_id, event_type, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as click from events) t where event_type = 'purchase'",
}
