"""Queries of the document memory and the request metrics: documents are its passages, labels later hits on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import memory as M
from millrace.plans.tabular import read

NOW = "timestamp'2025-06-01 00:00:00'"


def _entries(spark, d):
    docs = read(spark, d, "documents").where("doc_id is not null")
    seen = F.expr(f"{NOW} - make_interval(0, 0, 0, cast(doc_id % 120 as int), 0, 0, 0)")
    fields = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")), lambda _, v: v.isNotNull())
    return docs.select(F.col("doc_id").cast("string").alias("id"), M.clip(F.col("text"), 20_000).alias("text"), fields.alias("metadata"), (F.col("doc_id") % 10 / 10).alias("score"), seen.alias("first_seen"), seen.alias("last_access"), F.lit(1).cast("long").alias("access_count"))


def memory_add(spark, d):
    hits = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("text"), F.create_map(F.lit("toxic"), F.col("toxic").cast("string")).alias("metadata"), (F.col("quality") / 10).alias("score"), (F.col("quality") * 2 + F.col("toxic")).alias("position"))
    out = M.remember(_entries(spark, d), hits, F.expr(NOW))
    return out.select("id", F.sha2("text", 256).alias("text_hash"), F.col("metadata")["source"].alias("source"), F.col("metadata")["toxic"].alias("toxic"), F.round("score", 6).alias("score"), (F.col("last_access") == F.expr(NOW)).alias("fresh"), "access_count")


def memory_recall(spark, d):
    return M.recall(_entries(spark, d), F.expr(NOW), {"lang": "en"}, 12).select("id", F.round("worth", 6).alias("worth"), "access_count")


def memory_living(spark, d):
    return M.forget_source(M.expire(_entries(spark, d), F.expr(NOW)), " WEB").select("id")


def memory_evict(spark, d):
    return M.evict(_entries(spark, d), 100).select("id")


def memory_stats(spark, d):
    return M.stats(_entries(spark, d), F.expr(NOW)).select("entries", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"), F.date_format("newest", "yyyy-MM-dd").alias("newest"))


def request_counts(spark, d):
    return M.exposition(M.counter(read(spark, d, "events"), ["event_type"]), ["event_type"], "requests_total")


def latency_buckets(spark, d):
    return M.histogram(read(spark, d, "events"), ["event_type"], "value").withColumn("sum", F.round("sum", 2))


QUERIES = {f.__name__: f for f in (memory_add, memory_recall, memory_living, memory_evict, memory_stats, request_counts, latency_buckets)}

_CLIP = "case when length(coalesce(text, '')) > 20000 then substr(text, 1, 19999) || '…' else coalesce(text, '') end"
_E = f"e as (select doc_id::varchar as id, doc_id, {_CLIP} as text, source, lang, doc_id % 10 / 10.0::double as score, timestamp '2025-06-01' - to_days((doc_id % 120)::int) as seen from documents where doc_id is not null)"
_BOUNDS = ", ".join(f"{b}::double" for b in M.LATENCY)

ORACLES = {
    "memory_add": f"""with {_E}, h as (select doc_id::varchar as id, max(quality) / 10.0::double as score, count(*) as n, arg_max(toxic, quality * 2 + toxic)::varchar as toxic from labels where doc_id is not null group by 1)
select id, sha256(coalesce(text, '')) as text_hash, source, toxic, round(greatest(e.score, h.score), 6) as score, h.id is not null or seen = timestamp '2025-06-01' as fresh, (case when e.id is null then 0 else 1 end + coalesce(n, 0))::bigint as access_count
from e full outer join h using (id)""",
    "memory_recall": f"with {_E}, w as (select id, 0.7::double * score + 0.3::double * exp(-(doc_id % 120) / 30.0::double) as worth from e where doc_id % 120 <= 90 and lang = 'en') select id, round(worth, 6) as worth, 2::bigint as access_count from w order by round(w.worth, 12) desc, id limit 12",
    "memory_living": f"with {_E} select id from e where doc_id % 120 <= 90 and not contains(lower(coalesce(source, '')), 'web')",
    "memory_evict": f"with {_E} select id from e order by seen desc, score desc, id limit 100",
    "memory_stats": f"with {_E} select count(*) as entries, strftime(min(seen), '%Y-%m-%d') as oldest, strftime(max(seen), '%Y-%m-%d') as newest from e where doc_id % 120 <= 90",
    "request_counts": "select 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type",
    "latency_buckets": f"""with b as (select unnest([{_BOUNDS}, null]) as le)
select event_type, le, count(*) filter (le is null or value <= le) as bucket, count(*) as count, round(sum(value), 2) as sum from events, b where value is not null group by event_type, le""",
}
