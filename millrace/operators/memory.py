"""Document memory as a table, and request metrics.

A memory is a table of entries ``ENTRY``; every operation gives the next table.
The time is an argument, so results can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = ("id", "text", "metadata", "score", "first_seen", "last_access", "access_count")
#: Metadata fields that name a source, in the order in which they are tried.
SOURCE_FIELDS = ("source", "filename", "url", "path")
#: Upper bounds of the latency buckets in seconds.
LATENCY = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis where text is lost; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def remember(entries: DataFrame, hits: DataFrame, now: Column, most: int = 20_000) -> DataFrame:
    """``entries`` with ``hits(id, text, metadata, score, position)`` added.

    Of an id the highest score and the longest text (the earlier of equal
    length) stay, later metadata replace earlier ones field by field, and each
    hit counts as an access. Blank ids are left out, a missing score is 0.

    Both sides meet in aggregates that combine before their exchange; metadata
    are merged by (id, field), so an id with many hits is no large group.
    """
    old = entries.select(*ENTRY, F.lit(-1).cast("long").alias("position"))
    new = hits.where(F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) != "").select(
        F.trim(F.col("id").cast("string")).alias("id"), clip(F.col("text"), most).alias("text"), "metadata", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        now.alias("first_seen"), now.alias("last_access"), F.lit(1).cast("long").alias("access_count"), F.col("position").cast("long").alias("position"),
    )
    rows = old.unionByName(new)
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("position")))
    merged = rows.groupBy("id").agg(longest.alias("text"), F.max("score").alias("score"), F.min("first_seen").alias("first_seen"), F.max("last_access").alias("last_access"), F.sum("access_count").alias("access_count"))
    fields = rows.select("id", "position", F.explode("metadata").alias("field", "value")).groupBy("id", "field").agg(F.max_by("value", "position").alias("value"))
    metadata = fields.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("metadata"))
    return merged.join(metadata, "id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>"))).select(*ENTRY)


def _before(now: Column, days: int) -> Column:
    return F.col("last_access") < now - F.make_interval(days=F.lit(max(1, days)))


def expire(entries: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Entries that were read or added in the last ``days``."""
    return entries.where(~_before(now, days))


def forget_source(entries: DataFrame, source: str) -> DataFrame:
    """Entries whose source does not hold ``source``, whatever its case; a blank ``source`` takes none away."""
    needle = source.lower().strip()
    held = F.coalesce(*(F.nullif(F.col("metadata")[f], F.lit("")) for f in SOURCE_FIELDS), F.lit(""))
    return entries.where(~F.lower(held).contains(needle)) if needle else entries


def evict(entries: DataFrame, capacity: int = 5000) -> DataFrame:
    """The ``capacity`` entries read last, of equal times those with the higher score, then by id."""
    return entries.orderBy(F.desc("last_access"), F.desc("score"), "id").limit(max(1, capacity))


def recent(entries: DataFrame, now: Column, n: int = 12, days: int = 90) -> DataFrame:
    return evict(expire(entries, now, days), n)


def recall(entries: DataFrame, now: Column, where: dict[str, str] | None = None, k: int = 12, days: int = 90) -> DataFrame:
    """The ``k`` best living entries by ``worth``, 0.7 score + 0.3 exp(-age in days / 30), ties by id; their access is counted and dated."""
    for field, value in (where or {}).items():
        entries = entries.where(F.col("metadata")[field] == value)
    age = F.greatest(F.lit(0.0), (now.cast("double") - F.col("last_access").cast("double")) / 86400)
    rows = expire(entries, now, days).withColumn("worth", 0.7 * F.col("score") + 0.3 * F.exp(-age / 30))
    best = rows.orderBy(F.desc(F.round("worth", 12)), "id").limit(max(1, k))
    return best.withColumns({"access_count": F.col("access_count") + 1, "last_access": now})


def stats(entries: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return expire(entries, now, days).agg(F.count("*").alias("entries"), F.min("last_access").alias("oldest"), F.max("last_access").alias("newest"))


# ------------------------------------------------------------------ metrics


def label_value(c: Column) -> Column:
    """A label with single blanks, at most 120 characters; "none" where it is blank."""
    c = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(c == "", "none").when(F.length(c) > 120, F.concat(F.substring(c, 1, 117), F.lit("..."))).otherwise(c)


def counter(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(labels, total): how many events have these labels."""
    return events.groupBy(*(label_value(F.col(c)).alias(c) for c in labels)).agg(F.count("*").alias("total"))


def histogram(events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = LATENCY) -> DataFrame:
    """(labels, le, bucket, count, sum): cumulative buckets of ``value``, the last without a bound (null); nulls are not observed."""
    seen = events.where(F.col(value).isNotNull())
    below = F.array(*(F.count_if(F.col(value) <= b) for b in bounds), F.count("*"))
    rows = seen.groupBy(*(label_value(F.col(c)).alias(c) for c in labels)).agg(below.alias("_below"), F.count("*").alias("count"), F.sum(F.col(value).cast("double")).alias("sum"))
    edges = F.array(*(F.lit(float(b)) for b in bounds), F.lit(None).cast("double"))
    return rows.select(*labels, "count", "sum", F.explode(F.arrays_zip(edges.alias("le"), F.col("_below").alias("bucket"))).alias("_b")).select(*labels, "_b.le", "_b.bucket", "count", "sum")


def exposition(totals: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """(line): a counter in the text format of metric scrapers."""
    quoted = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in labels))
    return totals.select(F.concat(F.lit(name + "{"), quoted, F.lit("} "), F.col("total").cast("string")).alias("line"))
