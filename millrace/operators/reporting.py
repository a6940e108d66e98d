"""Rule detectors, weighted scorecards and peer ranking over the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of the capitals, of the flags, and of each capital's metrics.
CAPITALS = {"financial": 0.15, "manufactured": 0.10, "intellectual": 0.10, "human": 0.15, "social_relationship": 0.10, "natural": 0.40}
FLAGS = ("target_present", "period_present", "evidence_linked", "specificity_good", "metric_aligned")
FLAG_WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)
METRICS = (
    ("financial", "metric:revenue", 0.50, FLAG_WEIGHTS),
    ("financial", "metric:operating margin", 0.50, FLAG_WEIGHTS),
    ("manufactured", "metric:capex sustainability share", 1.0, FLAG_WEIGHTS),
    ("intellectual", "metric:rd intensity", 1.0, FLAG_WEIGHTS),
    ("human", "metric:training hours per employee", 0.50, FLAG_WEIGHTS),
    ("human", "metric:lost time injury frequency rate", 0.50, FLAG_WEIGHTS),
    ("social_relationship", "metric:supplier due diligence coverage", 1.0, FLAG_WEIGHTS),
    ("natural", "metric:ghg scope 1", 0.30, (0.35, 0.30, 0.15, 0.10, 0.10)),
    ("natural", "metric:ghg scope 2", 0.25, FLAG_WEIGHTS),
    ("natural", "metric:ghg scope 3", 0.20, FLAG_WEIGHTS),
    ("natural", "metric:renewable electricity share", 0.15, FLAG_WEIGHTS),
    ("natural", "metric:energy intensity", 0.10, FLAG_WEIGHTS),
)
VAGUE = ("aim", "intend", "explore", "consider", "where possible", "as appropriate")
LEAST_CONFIDENCE = 0.50


def rules(spark: SparkSession, metrics: Sequence = METRICS, capitals: dict[str, float] = CAPITALS, overrides: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(capital, capital_weight, metric_key, metric_weight, w_<flag>...): a few rows; ``overrides`` replaces metric weights of a sector."""
    overrides = overrides or {}
    rows = [(c, capitals[c], m, float(overrides.get((c, m), w)), *map(float, f)) for c, m, w, f in metrics]
    return spark.createDataFrame(rows, "capital string, capital_weight double, metric_key string, metric_weight double, " + ", ".join(f"w_{f} double" for f in FLAGS))


def vague(c: Column, terms: Sequence[str] = VAGUE) -> Column:
    return c.rlike(r"(?i)\b(" + "|".join(rf"\Q{t}\E" for t in terms) + r")\b")


def claim_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a claim: entity, metric by property and by edges, evidence count, properties."""
    about = edges.where("type = 'about'").groupBy(F.col("src_id").alias("id")).agg(F.min("dst_key").alias("entity"))
    aligned = edges.where("type = 'quantifies'").groupBy(F.col("src_id").alias("id")).agg(F.collect_set("dst_key").alias("quantified"))
    backed = edges.where("type = 'supported_by'").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n_evidence"), F.array_sort(F.collect_set("dst_id")).alias("evidence_ids"))
    p = F.col("props")
    rows = nodes.where("type = 'claim'").select("id", "tenant_id", "key", p["text"].alias("text"), F.nullif(F.trim(p["metric_key"]), F.lit("")).alias("metric_key"), F.nullif(F.trim(p["target"]), F.lit("")).alias("target"), F.nullif(F.trim(p["period"]), F.lit("")).alias("period"), F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"))
    out = rows.join(about, "id", "left").join(aligned, "id", "left").join(backed, "id", "left")
    return out.withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "quantified": F.coalesce("quantified", F.array().cast("array<string>")), "evidence_ids": F.coalesce("evidence_ids", F.array().cast("array<string>"))})


def detect(claims: DataFrame, least: float = LEAST_CONFIDENCE, evidence: int = 1, terms: Sequence[str] = VAGUE) -> DataFrame:
    """(tenant_id, claim_id, claim_key, code, severity): every detector in one pass over ``claim_table`` rows."""

    def when(code: str, severity: str, hit: Column) -> Column:
        return F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    prop, held = F.col("metric_key"), F.col("quantified")
    mismatch = (prop.isNotNull() & ~F.array_contains(held, prop)) | (prop.isNull() & (F.size(held) > 0))
    found = F.array_compact(
        F.array(
            when("missing_target", "warning", F.col("target").isNull()),
            when("missing_period", "warning", F.col("period").isNull()),
            when("low_confidence", "info", F.col("confidence") < least),
            when("no_evidence", "error", F.col("n_evidence") < evidence),
            when("vague_language", "warning", vague(F.coalesce("text", F.lit("")), terms)),
            when("metric_mismatch", "warning", F.coalesce(mismatch, F.lit(False))),
        )
    )
    return claims.select("tenant_id", F.col("id").alias("claim_id"), F.col("key").alias("claim_key"), F.explode(found).alias("issue")).select("tenant_id", "claim_id", "claim_key", "issue.*")


def metric_scores(claims: DataFrame, framework: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(entity, capital, metric_key, flags, n_claims, score) for every entity and metric of the framework.

    A metric's claims are those that quantify it; where an entity has none,
    those that name it in their property. The framework has a few rows and is
    broadcast by its size; entities are aggregated first.
    """
    rows = claims.where((F.col("confidence") >= least) & F.col("entity").isNotNull())
    by_edge = rows.select("entity", F.explode("quantified").alias("metric_key"), "id", "target", "period", "n_evidence", "text", F.lit(True).alias("aligned"))
    by_prop = rows.where("metric_key is not null").select("entity", "metric_key", "id", "target", "period", "n_evidence", "text", F.lit(False).alias("aligned"))
    by_prop = by_prop.join(by_edge.select("entity", "metric_key").distinct(), ["entity", "metric_key"], "left_anti")
    flags = by_edge.unionByName(by_prop).groupBy("entity", "metric_key").agg(
        F.count("*").alias("n_claims"),
        F.bool_or(F.col("target").isNotNull()).alias("target_present"),
        F.bool_or(F.col("period").isNotNull()).alias("period_present"),
        F.bool_or(F.col("n_evidence") > 0).alias("evidence_linked"),
        F.bool_or(~vague(F.coalesce("text", F.lit("")))).alias("specificity_good"),
        F.bool_or("aligned").alias("metric_aligned"),
    )
    spine = claims.where("entity is not null").select("entity").distinct().crossJoin(framework)  # a dozen rules for each entity
    out = spine.join(flags, ["entity", "metric_key"], "left")
    total = None
    for f in FLAGS:
        part = F.when(F.coalesce(f, F.lit(False)), F.col(f"w_{f}")).otherwise(0.0)
        total = part if total is None else total + part
    return out.select("entity", "capital", "capital_weight", "metric_key", "metric_weight", *(F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("score"))


def scorecard(scores: DataFrame) -> DataFrame:
    """(entity, capital scores, overall, coverage) from ``metric_scores``."""
    capital = scores.groupBy("entity", "capital", "capital_weight").agg(F.sum(F.col("metric_weight") * F.col("score")).alias("score"), F.sum(F.when(F.col("n_claims") > 0, 1).otherwise(0)).alias("met"), F.count("*").alias("n"))
    return capital.groupBy("entity").agg(
        *(F.coalesce(F.max(F.when(F.col("capital") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in CAPITALS),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("capital_weight") * F.col("score")))).alias("overall"),
        (F.sum("met") / F.sum("n")).alias("coverage"),
    )


def competition_rank(df: DataFrame, score: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Equal scores share a rank and the next ranks are skipped; nulls last."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col(score).desc_nulls_last())
    return df.withColumn(out, F.rank().over(w))


def benchmark(cards: DataFrame, digits: int = 9) -> DataFrame:
    """Scorecards ranked overall and in each capital; scores that differ by rounding alone are equal."""
    rounded = cards.withColumns({c: F.round(c, digits) for c in (*CAPITALS, "overall")})
    out = competition_rank(rounded, "overall")
    for c in CAPITALS:
        out = competition_rank(out, c, out=f"rank_{c}")
    return out


def card_json(scores: DataFrame) -> DataFrame:
    """(entity, card): the nested scorecard of each entity as JSON."""
    metric = F.struct("metric_key", *FLAGS, "n_claims", F.format_string("%.6f", "score").alias("score"))
    capital = scores.groupBy("entity", "capital").agg(F.array_sort(F.collect_list(metric)).alias("metrics"), F.sum(F.col("metric_weight") * F.col("score")).alias("score"))
    nested = F.struct("capital", F.format_string("%.6f", "score").alias("score"), "metrics")
    return capital.groupBy("entity").agg(F.array_sort(F.collect_list(nested)).alias("capitals")).select("entity", F.to_json(F.struct("entity", "capitals")).alias("card"))
