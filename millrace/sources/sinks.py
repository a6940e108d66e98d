"""Writers: all through Spark's committers, so readers never see half a result."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_collection(items: DataFrame, path: str) -> None:
    """Index items, a folder for each collection; only the collections at hand are replaced."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def index_report(files: DataFrame) -> DataFrame:
    """One row: files read and failed, chunks and characters."""
    return files.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("chars").alias("chars"))


def with_averages(rows: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Rows and, last by ``part``, one of the metrics' means."""
    mean = rows.agg(*(F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in metrics)).withColumn(label, F.lit("AVERAGES")).withColumn("part", F.lit(1))
    return rows.select(F.col(label).cast("string").alias(label), *(F.col(m).cast("double").alias(m) for m in metrics)).withColumn("part", F.lit(0)).unionByName(mean)


def html_report(rows: DataFrame, title: str = "Report", most: int = 500) -> str:
    """A static page of the first ``most`` rows; for small results."""
    cells = lambda xs, tag: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows.limit(most).collect())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{cells(rows.columns, 'th')}</tr>{body}</table></body></html>"


def fixed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers as text with six places, as exports want them."""
    return df.withColumns({c: F.format_string("%.6f", F.col(c)) for c in cols})
