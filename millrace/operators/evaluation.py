"""Answer and retrieval quality by token sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieval import jaccard

RATIOS = ("exact_match", "jaccard_q2ctx", "ref_coverage", "ans_supported_ratio", "ans_ref_jaccard", "ctx_precision_like")
METRICS = (*RATIOS, "answer_len_tokens", "num_contexts")


def norm_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\p{Punct}]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(norm_text(c), " "), lambda t: t != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.?!]"), lambda s: F.trim(s)), lambda s: s != "")


def _distinct(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def _sets(texts: Column) -> Column:
    """Token sets of all sentences of an array of texts."""
    return F.transform(F.flatten(F.transform(texts, sentences)), _distinct)


def metrics(rows: DataFrame, support: float = 0.5, relevance: float = 0.25) -> DataFrame:
    """``rows(question, answer, references, contexts)`` with the metrics, ratios rounded to four places.

    Token sets are made once a row and compared in higher-order functions;
    there is no shuffle.
    """
    none = F.array().cast("array<string>")
    out = rows.withColumn("_refs", F.coalesce("references", none)).withColumn("_ctx", F.coalesce("contexts", none))
    out = out.withColumns({"_q": _distinct(F.col("question")), "_a": _distinct(F.col("answer")), "_r": _distinct(F.array_join("_refs", " ")), "_c": _distinct(F.array_join("_ctx", " ")), "_rs": _sets(F.col("_refs")), "_cs": _sets(F.col("_ctx")), "_as": F.transform(sentences(F.col("answer")), _distinct)})

    def met(sets: str, least: float):
        return lambda s: F.exists(sets, lambda o: jaccard(s, o) >= least)

    def share(part: Column, whole: str) -> Column:
        return F.size(part) / F.size(whole)

    has_refs = F.size("_refs") > 0
    covered = F.when(F.size("_rs") > 0, share(F.filter("_rs", met("_cs", support)), "_rs")).otherwise(F.when(F.size("_ctx") > 0, 1.0).otherwise(0.0))
    supported = F.filter("_as", lambda s: met("_cs", support)(s) | met("_rs", support)(s))
    held = F.when(F.size("_as") > 0, share(supported, "_as")).otherwise(F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", 1.0).otherwise(0.0))
    precise = F.filter("_cs", lambda s: F.greatest(jaccard(s, F.col("_q")), F.when(has_refs, jaccard(s, F.col("_r"))).otherwise(0.0)) >= relevance)
    out = out.withColumns(
        {
            "exact_match": has_refs & (norm_text(F.col("answer")) == norm_text(F.array_join("_refs", " "))),
            "jaccard_q2ctx": F.round(jaccard(F.col("_q"), F.col("_c")), 4),
            "ref_coverage": F.round(covered, 4),
            "ans_supported_ratio": F.round(held, 4),
            "ans_ref_jaccard": F.round(F.when(has_refs, jaccard(F.col("_a"), F.col("_r"))).otherwise(0.0), 4),
            "ctx_precision_like": F.round(F.when(F.size("_cs") > 0, share(precise, "_cs")).otherwise(0.0), 4),
            "answer_len_tokens": F.size("_a"),
            "num_contexts": F.size("_ctx"),
        }
    )
    return out.drop("_refs", "_ctx", "_q", "_a", "_r", "_c", "_rs", "_cs", "_as")


def summarize(rows: DataFrame, latency: str | None = None) -> DataFrame:
    """One row: the mean of each ratio (four places), of contexts (two) and of the latency (one)."""
    parts = [F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in RATIOS]
    parts += [F.round(F.avg("num_contexts"), 2).alias("avg_contexts"), F.count("*").alias("n")]
    if latency:
        parts.append(F.round(F.avg(latency), 1).alias("avg_latency"))
    return rows.agg(*parts)


def nearest_rank(values: str, q: float) -> Column:
    """The value of rank ceil(q n) of a group, as latency reports want it."""
    return F.expr(f"percentile_disc({q}) within group (order by {values})")


def latency(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    """Mean, population deviation and nearest-rank p50, p90, p95 and p99 of each group."""
    return df.groupBy(*by).agg(F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"), *(nearest_rank(ms, p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)))


def first_answers(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """(key, kind, question, answer): questions made from the first sentence of a text that holds a figure of each kind."""
    kinds = [
        ("percent", r"(\d{1,3}(?:\.\d+)?\s?%)", "What percentage is stated?"),
        ("money", r"([$£€]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|bn|m|k))?)", "What amount is stated?"),
        ("ratio", r"(\d+(?:\.\d+)?x)\b", "What multiple is stated?"),
        ("emissions", r"(\d[\d,]*(?:\.\d+)?\s?(?:k?t)?CO2e)", "What emissions are stated?"),
        ("number", r"\b(\d[\d,]*(?:\.\d+)?)\b", "What figure is stated?"),
    ]

    def holds(pattern: str):
        return lambda s: s.rlike(pattern)

    parts = F.split(F.col(text), r"\. ")
    made = []
    for kind, pattern, question in kinds:
        line = F.get(F.filter(parts, holds(pattern)), F.lit(0))
        made.append(F.when(line.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(question).alias("question"), F.regexp_extract(line, pattern, 1).alias("answer"))))
    return docs.select(key, F.explode(F.slice(F.array_compact(F.array(*made)), 1, most)).alias("qa")).select(key, "qa.*")
