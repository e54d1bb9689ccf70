"""Windows over the event table, as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrite.plans.registry import Registry, table
from papyrite.streaming import events as V
from papyrite.streaming import jobs as J

REGISTRY = Registry()


@REGISTRY.query("select epoch_ms(time_bucket(interval '1 hour', ts)) // 1000 as start_s, event_type, count(*) as n from events group by all")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    rows = V.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")
    return rows.select(F.unix_timestamp("window_start").alias("start_s"), "event_type", "n")


@REGISTRY.query("select (epoch_ms(time_bucket(interval '1 hour', ts)) // 1000) - 3600 * k as start_s, event_type, count(*) as n from events, range(0, 2) r(k) group by all")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by two-hour windows, a new one each hour."""
    rows = V.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "2 hours", "1 hour")
    return rows.select(F.unix_timestamp("window_start").alias("start_s"), "event_type", "n")


@REGISTRY.query("""with s as (select user_id, ts, case when ts < lag(ts) over w + interval '6 hours' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from s) select user_id, floor(epoch(min(ts)))::bigint as start_s, count(*) as n from g group by user_id, g""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, six hours apart at least."""
    return V.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours").select("user_id", F.unix_timestamp("session_start").alias("start_s"), "n")


_JOB_KIND = "case event_type when 'signup' then 'submitted' when 'click' then 'started' when 'view' then 'started' when 'purchase' then 'succeeded' else 'failed' end"


@REGISTRY.query(f"""with e as (select user_id as job, event_id as event, ts as at_, {_JOB_KIND} as kind, props as said from events where event_id % 29 <> 0),
s as (select job, max(case when kind = 'started' then (epoch_us(at_), event) end) as st, max(case when kind in ('succeeded', 'failed') then (epoch_us(at_), event) end) as en, count(*) filter (where kind = 'started') as attempts, count(*) as events from e group by job),
l as (select s.*, a.at_ as start_at, b.at_ as end_at, b.kind, b.said from s left join e a on a.event = st[2] left join e b on b.event = en[2])
select job, case when en is not null and (st is null or en > st) then kind when st is not null then 'running' else 'pending' end as state, attempts::int as attempts, epoch_us(start_at) as started_us, case when en is not null and (st is null or en > st) then epoch_us(end_at) end as finished_us, case when en is not null and (st is null or en > st) and kind = 'failed' then said end as last_error, events::int as events from l""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's job after all its events, some of which come twice."""
    rows = table(spark, sf_dir, "events").where("event_id % 29 <> 0")
    events = rows.select(F.col("user_id").alias("job"), F.col("event_id").alias("event"), F.expr(_JOB_KIND).alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("props").alias("said"))
    twice = events.unionByName(events.where("event % 5 = 0"))
    return J.states(twice).select("job", "state", "attempts", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), "last_error", "events")
