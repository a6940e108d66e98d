"""Vector, lexical and hybrid retrieval over many queries at once."""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BROADCAST_ROWS = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """A vector of length one; zero vectors stay as they are."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(a.cast("array<double>"))


def finite(a: Column) -> Column:
    """Non-finite components as 0."""
    return F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x.cast("double")))


def metadata_filter(df: DataFrame, where: dict[str, object], column: str = "metadata") -> DataFrame:
    """Rows whose metadata equal every given value; plain columns are pushed to the scan."""
    for k, v in where.items():
        df = df.where((F.col(k) if k in df.columns else F.col(column)[k]) == F.lit(v))
    return df


def vector_topk(queries: DataFrame, index: DataFrame, k: int = 20, qid: str = "query_id", qvec: str = "query", key: str = "id", vec: str = "embedding", most: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, key, score, distance, rank): the ``k`` nearest rows by cosine for each query; ties by key.

    Queries are collected into matrices of about ``most`` rows, each broadcast
    for a pass over the index. Each task reduces
    every Arrow batch to ``k`` rows a query by one matrix product, so what is
    shuffled is k rows a query and batch. Rows of another length or without a
    finite non-zero vector are left out.
    """
    parts = -(-queries.count() // most)
    if parts > 1:
        part = F.pmod(F.xxhash64(qid), F.lit(parts).cast("long"))
        blocks = [vector_topk(queries.where(part == b), index, k, qid, qvec, key, vec, 2 * most) for b in range(parts)]
        return reduce(DataFrame.unionByName, blocks)
    rows = queries.select(qid, qvec).collect()
    kept = [r for r in rows if r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(np.array(r[1], float))]
    spark = index.sparkSession
    ids = [r[0] for r in kept]
    q = np.array([r[1] for r in kept], float) if kept else np.zeros((0, 1))
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q
    held = spark.sparkContext.broadcast((ids, q))
    qtype, ktype = queries.schema[qid].dataType.simpleString(), index.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        for frame in frames:
            good = frame[frame["v"].map(lambda v: v is not None and len(v) == q.shape[1])] if len(q) else frame.iloc[:0]
            if not len(good):
                continue
            x = np.stack([np.asarray(v, float) for v in good["v"]])
            length = np.linalg.norm(x, axis=1)
            fine = np.isfinite(length) & (length > 0)
            x, keys = x[fine] / length[fine, None], good["key"].to_numpy()[fine]
            order = np.argsort(keys, kind="stable")
            x, keys = x[order], keys[order]
            for start in range(0, len(q), 256):
                scores = q[start : start + 256] @ x.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                n = top.shape[1]
                yield pd.DataFrame({"q": np.repeat(np.array(ids[start : start + 256], dtype=object), n), "key": keys[top.ravel()], "score": np.take_along_axis(scores, top, 1).ravel()})

    part = index.select(F.col(key).alias("key"), F.col(vec).alias("v")).mapInPandas(run, f"q {qtype}, key {ktype}, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return part.withColumn("rank", nth).where(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("key").alias(key), "score", (1 - F.col("score")).alias("distance"), "rank")


def distance_to_similarity(df: DataFrame, distance: str = "distance", by: Sequence[str] = ("query_id",), out: str = "similarity") -> DataFrame:
    """1 - (d - min) / (max - min) in each query; 1 where all are equal."""
    w = Window.partitionBy(*by)
    span = F.max(distance).over(w) - F.min(distance).over(w)
    return df.withColumn(out, F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col(distance) - F.min(distance).over(w)) / span))).otherwise(1.0))


def min_max(df: DataFrame, score: str = "score", by: Sequence[str] = ("query_id",), out: str = "normalized") -> DataFrame:
    """(s - min) / (max - min) in each query; 0 where all are equal."""
    w = Window.partitionBy(*by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return df.withColumn(out, F.when(span > 0, (F.col(score) - F.min(score).over(w)) / span).otherwise(0.0))


def max_normalize(df: DataFrame, score: str = "score", by: Sequence[str] = ("query_id",), out: str = "normalized") -> DataFrame:
    """s / max in each query; 0 where the maximum isn't positive."""
    top = F.max(score).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(top > 0, F.col(score) / top).otherwise(0.0))


# ------------------------------------------------------------------ lexical


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits, dots, percent signs and hyphens."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.%\-]+", " ")), " "), "")


def lexical_index(docs: DataFrame, key: str = "id", text: str = "text") -> dict[str, DataFrame]:
    """{"postings": (term, key, tf, dl), "terms": (term, df), "stats": (n, avgdl)}; items without a key or text are left out."""
    rows = docs.where(F.col(key).isNotNull() & (F.trim(F.coalesce(text, F.lit(""))) != "")).select(F.col(key).alias("key"), terms(F.col(text)).alias("ts"))
    rows = rows.withColumn("dl", F.size("ts"))
    postings = rows.select("key", "dl", F.explode("ts").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))
    return {"postings": postings, "terms": postings.groupBy("term").agg(F.count("*").alias("df")), "stats": rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))}


def bm25(queries: DataFrame, docs: DataFrame, k: int = 20, qid: str = "query_id", qtext: str = "query", key: str = "id", text: str = "text", conjunctive: bool = False) -> DataFrame:
    """(qid, key, score, rank): the ``k`` best rows by BM25 for each query; blank queries give none; ties by key.

    Postings are filtered by the queries' terms before they are aggregated, so
    what is shuffled is the occurrences of asked terms. ``conjunctive`` wants
    every term of a query.
    """
    asked = queries.select(F.col(qid).alias("q"), F.explode(F.array_distinct(terms(F.col(qtext)))).alias("term"))
    rows = docs.where(F.col(key).isNotNull() & (F.trim(F.coalesce(text, F.lit(""))) != "")).select(F.col(key).alias("key"), terms(F.col(text)).alias("ts"))
    rows = rows.withColumn("dl", F.size("ts"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    words = asked.select("term").distinct()
    tf = rows.select("key", "dl", F.explode("ts").alias("term")).join(words, "term", "left_semi").groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = asked.join(weighed.select("term", "key", score.alias("s")), "term").groupBy("q", "key").agg(F.sum("s").alias("score"), F.count("*").alias("met"))
    if conjunctive:
        hits = hits.join(asked.groupBy("q").agg(F.count("*").alias("all")), "q").where("met = all")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "key"))
    return hits.withColumn("rank", nth).where(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("key").alias(key), "score", "rank")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_overlap(queries: DataFrame, docs: DataFrame, k: int = 10, qid: str = "query_id", qtext: str = "query", key: str = "id", text: str = "text") -> DataFrame:
    """(qid, key, score, rank) by Jaccard overlap of the words; only pairs that share a word are scored."""
    a = queries.select(F.col(qid).alias("q"), F.array_distinct(terms(F.col(qtext))).alias("qt"))
    b = docs.select(F.col(key).alias("key"), F.array_distinct(terms(F.col(text))).alias("dt"))
    words = a.select("q", F.size("qt").alias("nq"), F.explode("qt").alias("term"))
    held = b.select("key", F.size("dt").alias("nd"), F.explode("dt").alias("term"))
    shared = words.join(held, "term").groupBy("q", "key", "nq", "nd").agg(F.count("*").alias("n"))
    scored = shared.withColumn("score", F.col("n") / (F.col("nq") + F.col("nd") - F.col("n")))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("key").alias(key), "score", "rank")


# ------------------------------------------------------------------ hybrid


def fuse(vector: DataFrame, lexical: DataFrame, alpha: float = 0.6, k: int = 20, qid: str = "query_id", key: str = "id") -> DataFrame:
    """(qid, key, vector, bm25, score, rank): alpha * vector + (1 - alpha) * bm25 over the full outer join of two hit lists.

    ``vector`` brings a distance, turned into a similarity, and ``lexical`` a
    score, divided by its query's maximum. Missing components are 0.
    """
    v = distance_to_similarity(vector, by=[qid]).select(qid, key, F.col("similarity").alias("vector"))
    b = max_normalize(lexical, by=[qid]).select(qid, key, F.col("normalized").alias("bm25"))
    out = v.join(b, [qid, key], "full_outer").withColumns({"vector": F.coalesce("vector", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})
    out = out.withColumn("score", alpha * F.col("vector") + (1 - alpha) * F.col("bm25"))
    nth = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(F.round("score", 9)), key))
    return out.withColumn("rank", nth).where(F.col("rank") <= k)


def method_of(vector: Column, lexical: Column) -> Column:
    return F.when((vector > 0) & (lexical > 0), "hybrid").when(lexical > 0, "bm25").otherwise("vector")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, m: int = 20, qid: str = "query_id", query: str = "query", text: str = "text") -> DataFrame:
    """The first ``m`` hits of each query scored anew (by default the overlap of words), scores divided by their maximum."""
    score = scorer(F.col(query), F.col(text)) if scorer else jaccard(F.array_distinct(terms(F.col(query))), F.array_distinct(terms(F.col(text))))
    pool = hits.where(F.col("rank") <= m).withColumn("rerank", score)
    return max_normalize(pool, "rerank", [qid], "score").withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), "rank")))


def mmr_order(query: np.ndarray, candidates: np.ndarray, k: int, lam: float = 0.5) -> list[int]:
    """Greedy maximal marginal relevance; cosines are mapped to 0..1, ties go to the lowest index."""

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x, dtype=float), where=n > 0)

    q, c = unit(np.asarray(query, float)), unit(np.asarray(candidates, float))
    relevance, likeness = (c @ q + 1) / 2, (c @ c.T + 1) / 2
    chosen: list[int] = []
    while len(chosen) < min(k, len(c)):
        worth = lam * relevance - (1 - lam) * (likeness[:, chosen].max(axis=1) if chosen else 0)
        worth[chosen] = -np.inf
        chosen.append(int(np.argmax(np.round(worth, 12))))
    return chosen


def mmr(hits: DataFrame, k: int = 8, lam: float = 0.5, qid: str = "query_id", key: str = "id", qvec: str = "query", vec: str = "embedding") -> DataFrame:
    """(qid, key, mmr_rank): hits of each query in order of marginal relevance.

    Each choice depends on those before it, so a query's few hits meet in one
    group; queries run in parallel.
    """
    qtype, ktype = hits.schema[qid].dataType.simpleString(), hits.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", key])
        order = mmr_order(np.array(frame[qvec].iloc[0], float), np.stack([np.array(v, float) for v in frame[vec]]), k, lam)
        return pd.DataFrame({qid: frame[qid].iloc[0], key: frame[key].to_numpy()[order], "mmr_rank": np.arange(1, len(order) + 1)})

    return hits.select(qid, key, "rank", qvec, vec).groupBy(qid).applyInPandas(run, f"{qid} {qtype}, {key} {ktype}, mmr_rank int")


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int = 8, alpha: float = 0.6, pool: int = 20, lam: float = 0.5, diverse: bool = True, scorer: Callable[[Column, Column], Column] | None = None, where: dict[str, object] | None = None) -> DataFrame:
    """(query_id, id, vector, bm25, score, rank): ``k`` documents for each query, ranks from 0.

    ``queries(query_id, query, query_vector)`` and ``docs(id, text, embedding)``:
    the ``pool`` best by vector and by BM25, fused, scored anew and thinned by
    marginal relevance. ``where`` filters documents before either search. A
    document without a vector can be found by its words and is thinned as a
    zero vector; blank queries give no rows, missing vectors no vector hits.
    Scores lie between 0 and 1.
    """
    docs = metadata_filter(docs, where or {})
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    near = vector_topk(asked.select("query_id", F.col("query_vector").alias("query")), docs, pool)
    fused = fuse(near, bm25(asked.select("query_id", "query"), docs, pool), alpha, max(k, pool))
    hits = fused.select("query_id", "id", "vector", "bm25", "rank").join(docs.select("id", "text", "embedding"), "id").join(asked, "query_id")
    rows = rerank(hits, scorer, max(k, pool)).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    if not diverse:
        return rows.where(F.col("rank") <= k).select("query_id", "id", "vector", "bm25", "score", (F.col("rank") - 1).alias("rank"))
    some = F.greatest(F.size("embedding"), F.size("query_vector"))
    zero = F.array_repeat(F.lit(0.0), some)
    vectors = rows.withColumns({c: F.coalesce(F.col(c).cast("array<double>"), zero) for c in ("embedding", "query_vector")})
    chosen = mmr(vectors, k, lam, qvec="query_vector")
    return rows.drop("rank").join(chosen, ["query_id", "id"]).select("query_id", "id", "vector", "bm25", "score", (F.col("mmr_rank") - 1).alias("rank"))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A term-count vector by hashing, scaled to length one: the offline stand-in for a model."""
    cells = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    return l2_normalize(counts)


# ------------------------------------------------------------------ store


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("collection", "id")) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by_ids(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return items.join(ids.select(key), key, "left_anti")


def resume(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key a checkpoint doesn't hold yet."""
    return items.join(done.select(key), key, "left_anti")


def collection_stats(items: DataFrame, by: str = "collection", created: str = "created_at") -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("items"), F.max(created).alias("last_created"))


def parity(a: DataFrame, b: DataFrame, qid: str = "query_id", key: str = "id") -> DataFrame:
    """Mean Jaccard overlap of two systems' result sets over all queries."""
    left, right = (x.groupBy(qid).agg(F.collect_set(key).alias(n)) for x, n in ((a, "l"), (b, "r")))
    none = F.array().cast(left.schema["l"].dataType)
    return left.join(right, qid, "full_outer").agg(F.avg(jaccard(F.coalesce("l", none), F.coalesce("r", none))).alias("overlap"), F.count("*").alias("queries"))


def contexts(hits: DataFrame, qid: str = "query_id", text: str = "text", source: str = "source", n: int = 12, width: int = 500) -> DataFrame:
    """(qid, context): the first ``n`` hits of each query, cut to ``width``, numbered and joined."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(source), F.lit("")), F.lit(": "), F.substring(F.coalesce(text, F.lit("")), 1, width))
    rows = hits.where(F.col("rank") <= n).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_all"))
    return rows.select(qid, F.array_join(F.transform("_all", lambda x: x["line"]), "\n").alias("context"))
