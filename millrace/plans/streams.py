"""Queries of the event operators, on the whole table; the tests hold streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.tabular import read
from millrace.streaming import events as S


def _shown(df, *cols):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *cols)


def tumbling(spark, d):
    return _shown(S.tumbling(read(spark, d, "events")), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(spark, d):
    return _shown(S.sliding(read(spark, d, "events")), "event_type", "n", F.round("total", 4).alias("total"))


def session(spark, d):
    return S.sessions(read(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def dedupe_watermark(spark, d):
    twice = read(spark, d, "events").unionByName(read(spark, d, "events").where("event_id % 3 = 0"))
    return S.deduplicate(twice).groupBy("event_type").agg(F.count("*").alias("n"))


def token_bucket(spark, d):
    return S.token_bucket(read(spark, d, "events"), rate=1 / 7200, burst=3).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


QUERIES = {"tumbling": tumbling, "sliding": sliding, "session": session, "dedupe_watermark": dedupe_watermark, "token_bucket": token_bucket}

ORACLES = {
    "tumbling": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "sliding": "select strftime(time_bucket(interval 15 minute, ts) - to_minutes(15 * k), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events, (select unnest([0, 1, 2, 3]) as k) group by all",
    "session": "with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as s from events), g as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from e), c as (select user_id, g, count(*) as n from g group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from c group by 1",
    "dedupe_watermark": "select event_type, count(*) as n from events group by 1",
}
