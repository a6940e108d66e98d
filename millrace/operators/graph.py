"""Claims from text and tables, and the property graph that they make.

Nodes and edges are two tables. Ids are hashes of (tenant, type, key), so the
same entity of two documents is one node and edges of both bind to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import sentences, strip_accents

#: Patterns of metrics in the order in which they are tried, with the metric's name.
METRIC_PATTERNS = (
    (r"\bscope\s*1\b", "GHG Scope 1"),
    (r"\bscope\s*2\b", "GHG Scope 2"),
    (r"\bscope\s*3\b", "GHG Scope 3"),
    (r"\bghg\b|\bgreenhouse\s+gas(es)?\b", "GHG (general)"),
    (r"\bco2e?\b|\bCO2e\b", "GHG (general)"),
    (r"\bintensity\b", "Emissions Intensity"),
    (r"\brenewable(s| energy)?\b", "Renewable Energy"),
    (r"\brevenue\b", "Revenue"),
    (r"\bcapex\b|\bcapital\s+expenditure(s)?\b", "Capex"),
    (r"\bwater\s+(use|consumption|withdrawal)\b", "Water Use"),
    (r"\bwaste\b", "Waste"),
    (r"\bLTIFR\b|\blost\s+time\s+injury\b", "LTIFR"),
)
#: Years, directions, net zero and baselines.
YEAR = r"(20\d{2}|19\d{2})"
DECREASE = r"(?i)\b(decrease|reduce|cut|lower|drop)\b"
INCREASE = r"(?i)\b(increase|grow|rise|higher)\b"
NET_ZERO = r"(?i)\bnet\s*zero\b"
BASELINE = r"(?i)\b(?:vs\.?|versus|against|relative\s+to|from)\s*(?:the\s*)?(?:\b(?:year|baseline)\b\s*)?" + YEAR + r"\b"
#: Units in the order in which they are tried.
UNITS = (
    (r"%", "%"),
    (r"(?i)\b(?:t|kt|mt)\s*co2e\b|\bco2e\b", "tCO2e"),
    (r"(?i)\b(?:tonnes?|tons?)\b", "tonnes"),
    (r"(?i)\b(?:k|m|bn)\b", "scalar"),
    (r"(?i)\b(?:kwh|mwh|gwh)\b", "Wh"),
    (r"(?i)£|\bgbp\b|\bpounds?\b", "GBP"),
)
EDGES = {"about": ("claim", "entity"), "quantifies": ("claim", "metric"), "supported_by": ("claim", "evidence"), "measured_by": ("entity", "metric")}


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def canonical_key(space: Column | str, name: Column) -> Column:
    """``space:name`` in lower case with single blanks."""
    space = F.lit(space) if isinstance(space, str) else space
    return F.concat(F.lower(F.trim(space)), F.lit(":"), F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))))


def truncate(c: Column, most: int = 96) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def stable_hash(*parts: Column) -> Column:
    """Forty hex digits of the joined parts, without accents, in lower case."""
    joined = F.concat_ws("|", *(F.lower(F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"\s+", " "))) for p in parts))
    return F.substring(F.sha2(strip_accents(joined), 256), 1, 40)


def metric_key(c: Column, patterns: Sequence[tuple[str, str]] = METRIC_PATTERNS) -> Column:
    out = None
    for pattern, name in patterns:
        hit, key = c.rlike(f"(?i){pattern}"), F.lit("metric:" + " ".join(name.lower().split()))
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def target(c: Column, percent_fix: bool = False) -> Column:
    """A percentage, "net zero" or a direction. As found, a percentage needs a letter or digit after the sign; ``percent_fix`` drops that."""
    percent = _first(c, r"\b(\d{1,3}(?:\.\d+)?)\s*%" + ("" if percent_fix else r"\b"))
    return F.when(percent.isNotNull(), F.concat(percent, F.lit("%"))).when(c.rlike(NET_ZERO), "net zero").when(c.rlike(DECREASE), "decrease").when(c.rlike(INCREASE), "increase")


def period(c: Column) -> Column:
    span = r"(?i)\b" + YEAR + r"\s*(?:–|-|to|through|until)\s*" + YEAR + r"\b"
    by = _first(c, r"(?i)\bby\s+" + YEAR + r"\b")
    return F.when(c.rlike(span), F.concat(F.regexp_extract(c, span, 1), F.lit("–"), F.regexp_extract(c, span, 2))).when(by.isNotNull(), F.concat(F.lit("by "), by)).otherwise(_first(c, r"\b" + YEAR + r"\b"))


def baseline(c: Column) -> Column:
    return _first(c, BASELINE)


def unit(c: Column) -> Column:
    out = None
    for pattern, name in UNITS:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


def direction(c: Column) -> Column:
    return F.when(c.rlike(DECREASE), "reduction").when(c.rlike(INCREASE), "increase").when(c.rlike(NET_ZERO), "net_zero")


def confidence(metric: Column, goal: Column, when: Column, length: Column) -> Column:
    score = F.lit(40) + F.when(metric, 30).otherwise(0) + F.when(goal, 20).otherwise(0) + F.when(when, 10).otherwise(0) - F.when(length < 24, 10).otherwise(0)
    return F.greatest(F.lit(35), F.least(F.lit(95), score)) / 100.0


def claims(chunks: DataFrame, patterns: Sequence[tuple[str, str]] = METRIC_PATTERNS, percent_fix: bool = False) -> DataFrame:
    """Claims of ``chunks(tenant_id, entity_key, doc_id, page, chunk_id, text)``: one row for each sentence with a metric, target or period.

    All of it is column expressions; nothing is shuffled.
    """
    keys = [c for c in ("tenant_id", "entity_key", "doc_id", "page", "chunk_id") if c in chunks.columns]
    s = F.col("text")
    out = chunks.select(*keys, F.posexplode(sentences(F.col("text"))).alias("sentence_no", "text"))
    # One test of a sentence comes first; what it keeps is then taken apart.
    some = "(?i)" + "|".join([r"\d\s*%", YEAR, *(p.removeprefix("(?i)") for p in (NET_ZERO, DECREASE, INCREASE)), *(p for p, _ in patterns)])
    out = out.where(s.rlike(some))
    out = out.withColumns({"metric_key": metric_key(s, patterns), "target": target(s, percent_fix), "period": period(s), "baseline": baseline(s), "unit": unit(s), "direction": direction(s)})
    out = out.where("metric_key is not null or target is not null or period is not null")
    show_unit = F.col("unit").isNotNull() & (F.col("unit") != "%") & (F.col("target").isNull() | ~F.col("target").contains("%"))
    named = F.concat_ws(
        " ",
        F.col("direction"),
        F.concat(F.lit("value:"), F.col("target")),
        F.when(show_unit, F.concat(F.lit("unit:"), F.col("unit"))),
        F.concat(F.lit("baseline_year:"), F.col("baseline")),
        F.concat(F.lit("period:"), F.col("period")),
    )
    return out.withColumns(
        {
            "confidence": confidence(F.col("metric_key").isNotNull(), F.col("target").isNotNull(), F.col("period").isNotNull(), F.length("text")),
            "normalized_text": F.when(named == "", F.trim(F.regexp_replace(s, r"\s+", " "))).otherwise(named),
        }
    )


def table_claims(table: DataFrame, entity_key: str, doc_id: str, metrics: dict[str, str] | None = None) -> DataFrame:
    """Claims of a table: a column whose header holds a metric's name, a number in the cell, a year column for the period."""
    metrics = metrics or {"scope 1": "GHG Scope 1", "scope 2": "GHG Scope 2", "scope 3": "GHG Scope 3", "revenue": "Revenue", "capex": "Capex", "water": "Water Use", "waste": "Waste", "renewable": "Renewable Energy", "intensity": "Emissions Intensity"}
    year = next((c for c in table.columns if c.strip().lower() in ("year", "fiscal year", "fy", "period")), None)
    named = {c: next((n for t, n in metrics.items() if t in c.lower()), None) for c in table.columns if c != year}
    cols = [c for c, n in named.items() if n]
    if not cols:
        return table.sparkSession.createDataFrame([], "entity_key string, doc_id string, metric_key string, period string, text string, value double")
    texts = table.select(*([F.col(f"`{year}`").cast("string").alias("_year")] if year else [F.lit(None).cast("string").alias("_year")]), *(F.col(f"`{c}`").cast("string").alias(c) for c in cols))
    long = texts.unpivot(["_year"], cols, "column", "cell").withColumn("value", F.replace(F.trim("cell"), F.lit(","), F.lit("")).try_cast("double")).where("value is not null")
    name = F.element_at(F.create_map(*(F.lit(x) for c in cols for x in (c, named[c]))), F.col("column"))
    return long.select(
        F.lit(entity_key).alias("entity_key"), F.lit(doc_id).alias("doc_id"), canonical_key("metric", name).alias("metric_key"), _first(F.col("_year"), rf"^{YEAR}$").alias("period"), F.concat(name, F.lit(" = "), F.trim("cell")).alias("text"), "value"
    )


# ------------------------------------------------------------------ building


def node_id(tenant: Column, kind: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(tenant, F.lit("")), kind, key), 256), 1, 32)


NODE = ("id", "tenant_id", "type", "key", "label", "props")
EDGE = ("tenant_id", "type", "src_id", "dst_id", "src_key", "dst_key")


def build(found: DataFrame, labels: DataFrame | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claims. Claims of one entity whose text begins alike are one node; of equal keys the first stays.

    ``whole`` tells claims apart by their whole text: a key that is cut short
    then ends in the text's hash, and no claim hides behind another.
    ``labels(entity_key, label)`` names entities; others show their key.
    """
    said = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rest = F.when(F.length(said) > 64, F.concat(F.lit("#"), F.sha2(said, 256))).otherwise("") if whole else F.lit("")
    key = F.concat(F.lit("claim:"), F.col("entity_key"), F.lit("|"), truncate(said, 64), rest)
    evidence = F.concat(F.lit("evidence:"), F.coalesce("doc_id", F.lit("NA")), F.lit("#p"), F.coalesce(F.col("page").cast("string"), F.lit("NA")), F.lit(":"), F.coalesce("chunk_id", F.lit("NA")))
    rows = found.withColumns({"claim_key": key, "evidence_key": evidence, "_o": F.struct("doc_id", "page", "chunk_id", "sentence_no")})
    props = {
        "claim": ("text", "entity_key", "metric_key", "target", "period", "baseline", "unit", "confidence", "doc_id", "page", "chunk_id", "normalized_text", "hash"),
        "evidence": ("doc_id", "page", "chunk_id"),
    }
    rows = rows.withColumn("hash", stable_hash(F.col("entity_key"), F.col("metric_key"), F.col("normalized_text"), F.col("target"), F.col("period"), F.col("baseline"), F.col("unit")))

    def nodes_of(kind: str, by: str, label: Column, fields: Sequence[str]) -> DataFrame:
        body = F.map_filter(F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f).cast("string") for f in fields))), lambda _, v: v.isNotNull()) if fields else F.create_map().cast("map<string,string>")
        one = rows.where(F.col(by).isNotNull()).groupBy("tenant_id", F.col(by).alias("key")).agg(F.min_by(F.struct(label.alias("label"), body.alias("props")), "_o").alias("n"))
        return one.select(node_id(F.col("tenant_id"), F.lit(kind), F.col("key")).alias("id"), "tenant_id", F.lit(kind).alias("type"), "key", "n.label", "n.props")

    entity = nodes_of("entity", "entity_key", F.col("entity_key"), ["entity_key"])
    if labels is not None:
        entity = entity.join(labels.select(F.col("entity_key").alias("key"), F.col("label").alias("_l")), "key", "left").withColumn("label", F.coalesce("_l", "label")).drop("_l").select(*NODE)
    nodes = entity.unionByName(nodes_of("metric", "metric_key", F.initcap(F.regexp_replace("metric_key", "^metric:", "")), ["metric_key"]))
    nodes = nodes.unionByName(nodes_of("claim", "claim_key", truncate(F.col("text")), props["claim"])).unionByName(nodes_of("evidence", "evidence_key", F.col("evidence_key"), props["evidence"]))
    ends = {"about": ("claim_key", "entity_key"), "quantifies": ("claim_key", "metric_key"), "supported_by": ("claim_key", "evidence_key"), "measured_by": ("entity_key", "metric_key")}
    edges = None
    for kind, (a, b) in ends.items():
        src, dst = EDGES[kind]
        part = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
            "tenant_id", F.lit(kind).alias("type"), node_id(F.col("tenant_id"), F.lit(src), F.col(a)).alias("src_id"), node_id(F.col("tenant_id"), F.lit(dst), F.col(b)).alias("dst_id"), F.col(a).alias("src_key"), F.col(b).alias("dst_key")
        )
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges.distinct()


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id with ``change``: created, updated (label or props differ) or kept."""
    body = lambda side: F.struct(F.col(f"{side}.label"), F.to_json(F.col(f"{side}.props")))
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    change = F.when(F.col("o.id").isNull(), "created").when(F.col("n.id").isNull() | body("o").eqNullSafe(body("n")), "kept").otherwise("updated")
    return joined.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in NODE), change.alias("change"))


def upsert_edges(nodes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (tenant, type, ends) whose ends exist, with ``change``: created or kept."""
    ids = nodes.select("id")
    sound = new.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*EDGE)
    keys = ["tenant_id", "type", "src_id", "dst_id"]
    fresh = sound.join(old.select(*keys), keys, "left_anti").withColumn("change", F.lit("created"))
    return old.select(*EDGE).withColumn("change", F.lit("kept")).unionByName(fresh)


# ------------------------------------------------------------------ queries


def list_nodes(nodes: DataFrame, tenant: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = nodes.where(F.col("tenant_id") == tenant)
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.orderBy("type", "key").offset(offset).limit(limit)


def list_edges(edges: DataFrame, tenant: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = edges.where(F.col("tenant_id") == tenant)
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.orderBy("type", "src_id", "dst_id").offset(offset).limit(limit)


def node_by_key(nodes: DataFrame, tenant: str, kind: str, key: str) -> DataFrame:
    return nodes.where((F.col("tenant_id") == tenant) & (F.col("type") == kind) & (F.col("key") == key))


def _hop(nodes: DataFrame, edges: DataFrame, kind: str, key: str | None, back: bool) -> DataFrame:
    """Nodes at the far end of edges of a kind, from the node ``key`` (or all) at the near end."""
    near, far = ("dst", "src") if back else ("src", "dst")
    rows = edges.where(F.col("type") == kind)
    rows = rows.where(F.col(f"{near}_key") == key) if key is not None else rows
    return nodes.join(rows.select(F.col(f"{far}_id").alias("id"), F.col(f"{near}_key").alias("near_key")), "id").dropDuplicates(["id", "near_key"])


def claims_about(nodes: DataFrame, edges: DataFrame, entity: str | None = None) -> DataFrame:
    return _hop(nodes, edges, "about", entity, True)


def claims_for_metric(nodes: DataFrame, edges: DataFrame, metric: str | None = None) -> DataFrame:
    return _hop(nodes, edges, "quantifies", metric, True)


def evidence_for(nodes: DataFrame, edges: DataFrame, claim: str | None = None) -> DataFrame:
    return _hop(nodes, edges, "supported_by", claim, False).where("type = 'evidence'")


def claims_with_evidence(nodes: DataFrame, edges: DataFrame, entity: str | None = None) -> DataFrame:
    """Claims about an entity with the sorted keys of their evidence, which may be none."""
    held = evidence_for(nodes, edges).groupBy(F.col("near_key").alias("claim")).agg(F.array_sort(F.collect_set("key")).alias("evidence"))
    rows = claims_about(nodes, edges, entity).withColumnRenamed("near_key", "entity_key")
    return rows.join(held, F.col("key") == F.col("claim"), "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).drop("claim")


def entity_metrics(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'measured_by'").select("tenant_id", F.col("src_key").alias("entity_key"), F.col("dst_key").alias("metric_key")).distinct()


def subgraph(edges: DataFrame, start: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(id, hops): nodes within ``depth`` (4 at most) edges of ``start(id)`` in either direction.

    Of each node and direction, only the first ``most`` edges by (type, source,
    target) are followed. Each hop is two joins on the frontier and an anti
    join on what was visited.
    """
    if not 0 <= depth <= 4:
        raise ValueError("depth is 0 to 4")
    order = ["type", "src_id", "dst_id"]
    out = edges.withColumn("_n", F.row_number().over(Window.partitionBy("src_id").orderBy(*order))).where(F.col("_n") <= most).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    back = edges.withColumn("_n", F.row_number().over(Window.partitionBy("dst_id").orderBy(*order))).where(F.col("_n") <= most).select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))
    steps = out.unionByName(back).distinct()
    seen = start.select("id").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        frontier = frontier.join(steps, frontier["id"] == steps["a"]).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each


def validate(nodes: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(severity, code, subject, detail) of all findings of a snapshot."""

    def issue(rows: DataFrame, severity: str, code: str, subject: Column, detail: Column) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))

    prop = lambda c: F.trim(F.coalesce(F.col("props")[c], F.lit("")))
    claim, ids = nodes.where("type = 'claim'"), nodes.select(F.col("id").alias("_id"), F.col("type").alias("_type"))
    ends = edges.join(ids.withColumnsRenamed({"_id": "src_id", "_type": "src_type"}), "src_id", "left").join(ids.withColumnsRenamed({"_id": "dst_id", "_type": "dst_type"}), "dst_id", "left")
    wants = F.create_map(*(F.lit(x) for k, (a, b) in EDGES.items() for x in (k, f"{a}>{b}")))
    about = edges.where("type = 'about'").select(F.col("src_id").alias("id"), F.col("dst_key").alias("about_key"))
    backed = edges.where("type = 'supported_by'").select(F.col("src_id").alias("id"))
    parts = [
        issue(nodes.groupBy("tenant_id", "type", "key").count().where("count > 1"), "error", "duplicate_node_key", F.col("key"), F.col("count")),
        issue(edges.groupBy("tenant_id", "type", "src_id", "dst_id").count().where("count > 1"), "warning", "duplicate_edge_tuple", F.concat_ws(">", "src_id", "dst_id"), F.col("count")),
        issue(ends.where("src_type is null or dst_type is null"), "error", "orphan_edge", F.concat_ws(">", "src_id", "dst_id"), F.col("type")),
        issue(ends.where("src_type is not null and dst_type is not null").where(F.element_at(wants, F.col("type")) != F.concat_ws(">", "src_type", "dst_type")), "error", "edge_type_mismatch", F.concat_ws(">", "src_id", "dst_id"), F.col("type")),
        issue(claim.where(prop("entity_key") == "").unionByName(claim.join(about, "id", "left_anti").where(prop("entity_key") != "")), "error", "claim_missing_entity_key", F.col("key"), F.lit(None)),
        issue(claim.join(backed, "id", "left_anti"), "warning", "claim_missing_provenance", F.col("key"), F.lit(None)),
        issue(claim.where(F.coalesce(F.col("props")["confidence"].try_cast("double"), F.lit(0.0)) < least), "warning", "claim_low_confidence", F.col("key"), F.col("props")["confidence"]),
        issue(claim.join(about, "id").where((prop("entity_key") != "") & (F.lower(prop("entity_key")) != F.lower(F.trim("about_key")))), "warning", "claim_entity_key_mismatch", F.col("key"), F.col("about_key")),
        issue(nodes.where("type = 'evidence'").where(prop("doc_id") == ""), "error", "evidence_missing_doc_id", F.col("key"), F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_summary(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("ok", F.col("errors") == 0)


# ------------------------------------------------------------------ resolution


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def resolve(asked: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, least: float = 0.6, most: int = 5) -> DataFrame:
    """(query, key, stage, score): alias, then name or key, then alternative name, then a fuzzy name; the first stage that hits wins.

    ``entities(key, name, alt_names)``; ``aliases(alias, key)``, of equal
    aliases the smallest key. The fuzzy stage scores only what the exact
    stages left, and only names that share a word or a prefix of three letters.
    """
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "['’]", ""), r"\s+", " ")))
    q = asked.select("query", fold(F.col("query")).alias("q")).distinct()
    e = entities.select("key", "name", fold(F.col("name")).alias("n"), "alt_names")
    parts = []
    if aliases is not None:
        one = aliases.select(fold(F.col("alias")).alias("q"), "key").groupBy("q").agg(F.min("key").alias("key"))
        parts.append(q.join(one, "q").select("query", "key", F.lit(1).alias("stage"), F.lit(1.0).alias("score")))
    names = e.select("key", F.explode(F.array_distinct(F.array("n", F.lower(F.trim("key"))))).alias("q"))
    parts.append(q.join(names, "q").select("query", "key", F.lit(2).alias("stage"), F.lit(1.0).alias("score")))
    alts = e.select("key", F.explode("alt_names").alias("alt")).select("key", fold(F.col("alt")).alias("q"))
    parts.append(q.join(alts, "q").select("query", "key", F.lit(3).alias("stage"), F.lit(0.95).alias("score")))
    exact = parts[0]
    for p in parts[1:]:
        exact = exact.unionByName(p)
    best = exact.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy("stage"))).where("_r = 1").drop("_r").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x or "", y or "") for x, y in zip(a, b)])

    blocks = lambda c: F.array_distinct(F.concat(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t != ""), F.array(F.concat(F.lit("^"), F.substring(c, 1, 3)))))
    left = q.join(best.select("query"), "query", "left_anti").select("query", "q", F.explode(blocks(F.col("q"))).alias("block"))
    pool = left.join(e.select("key", "n", F.explode(blocks(F.col("n"))).alias("block")), "block").select("query", "q", "key", "n").distinct()
    fuzzy = pool.withColumn("score", ratio("q", "n")).where(F.col("score") >= least)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return best.unionByName(fuzzy.withColumn("_n", nth).where(F.col("_n") <= most).select("query", "key", F.lit(4).alias("stage"), "score"))


# ------------------------------------------------------------------ triples


def add_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Triples by lower-cased (subject, predicate, object); of equal ones the latest stays."""
    keyed = old.unionByName(new, allowMissingColumns=True)
    key = F.concat_ws("\x1f", *(F.lower(F.trim(c)) for c in ("subject", "predicate", "object")))
    return keyed.withColumn("_k", key).groupBy("_k").agg(F.max_by(F.struct(*keyed.columns), F.struct("updated_at", "confidence")).alias("t")).select("t.*")


def lookup_facts(triples: DataFrame, asked: DataFrame, most: int = 10, block: int = 1000) -> DataFrame:
    """(query, subject, predicate, object, score): 2 for an equal subject or object, 1 for one that contains the query; the latest first.

    Questions are broadcast in blocks of about ``block``, each compared with all triples.
    """
    asked = asked.select("query").distinct()
    parts = max(1, -(-asked.count() // block))
    part = F.pmod(F.xxhash64("query"), F.lit(parts).cast("long"))
    s, o, q = F.lower("subject"), F.lower("object"), F.lower(F.trim("query"))
    score = F.when((s == q) | (o == q), 2).when(s.contains(q) | o.contains(q), 1)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("updated_at"), "subject", "predicate", "object"))
    out = None
    for n in range(parts):
        rows = triples.join(F.broadcast(asked.where(part == n)), score.isNotNull()).withColumn("score", score)
        rows = rows.withColumn("_n", nth).where(F.col("_n") <= most).select("query", "subject", "predicate", "object", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def related(triples: DataFrame) -> DataFrame:
    """(entity, neighbour, n, predicates): who stands next to whom in either direction."""
    a = triples.select(F.col("subject").alias("entity"), F.col("object").alias("neighbour"), "predicate")
    b = triples.select(F.col("object").alias("entity"), F.col("subject").alias("neighbour"), "predicate")
    return a.unionByName(b).groupBy("entity", "neighbour").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("predicate")).alias("predicates"))


# ------------------------------------------------------------------ exports


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a node or edge in column ``record``, with a plain label; the set has no order."""
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.initcap(F.regexp_replace("key", "^[^:]*:", "")))
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "tenant_id", "type", "key", label.alias("label"), "props")).alias("record"))
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *EDGE)).alias("record"))
    return n.unionByName(e)


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as lines (part, line): header, nodes, edges, footer in order of ``part``; written sorted by it they are one document."""

    def esc(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="all" attr.name="type" attr.type="string"/><key id="label" for="node" attr.name="label" attr.type="string"/><graph edgedefault="directed">'
    frame = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="type">'), esc(F.col("type")), F.lit('</data><data key="label">'), esc(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc(F.col("src_id")), F.lit('" target="'), esc(F.col("dst_id")), F.lit('"><data key="type">'), esc(F.col("type")), F.lit("</data></edge>")).alias("line"))
    return frame.unionByName(n).unionByName(e)


def positions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the positions of their ends among the nodes sorted by (type, key), as viewers want them."""
    at = nodes.select("id", (F.row_number().over(Window.partitionBy("tenant_id").orderBy("type", "key")) - 1).alias("at"))
    return edges.join(at.withColumnsRenamed({"id": "src_id", "at": "source"}), "src_id").join(at.withColumnsRenamed({"id": "dst_id", "at": "target"}), "dst_id")
