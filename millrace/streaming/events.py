"""Structured Streaming over events: windows, deduplication, token buckets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder or glob, ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: Sequence[str] = ("event_type",), value: str = "value", ts: str = "ts") -> DataFrame:
    """Counts and sums of fixed windows; works on streams and on tables alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return _flat(rows.groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")), by)


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", by: Sequence[str] = ("event_type",), value: str = "value", ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return _flat(rows.groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")), by)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: Sequence[str] = ("user_id",), ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _flat(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def deduplicate(events: DataFrame, keys: Sequence[str] = ("event_id",), late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first event of each key; on streams, state is kept for the watermark's delay only."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def bucket_fold(times: Sequence[float], rate: float, burst: float, tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
    """A token bucket over ordered seconds: verdicts, tokens left and the last time."""
    out = []
    for t in times:
        tokens = burst if last is None else min(burst, tokens + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts", rate: float = 5.0, burst: float = 10.0, order: str = "event_id") -> DataFrame:
    """(key, order, allowed) of a table: each key's events in order through its bucket."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {order} {events.schema[order].dataType.simpleString()}, allowed boolean"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", order])
        allowed, _, _ = bucket_fold(frame["t"].tolist(), rate, burst, burst, None)
        return pd.DataFrame({key: frame[key], order: frame[order], "allowed": allowed})

    return events.select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t")).groupBy(key).applyInPandas(run, schema)


def token_bucket_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", rate: float = 5.0, burst: float = 10.0, order: str = "event_id") -> DataFrame:
    """The same of a stream: the state of a key is two numbers, its tokens and its last time, kept as long as the query."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ktype, otype = (events.schema[c].dataType.simpleString() for c in (key, order))

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values(["t", order])
        allowed, tokens, last = bucket_fold(rows["t"].tolist(), rate, burst, tokens, last)
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: keys[0], order: rows[order], "allowed": allowed})

    rows = events.select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {ktype}, {order} {otype}, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now, to Parquet, and stop; a rerun goes on after its checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
