"""Queries of the retrieval operators: every row whose id is divisible by 20 asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import retrieval as R
from millrace.plans.tabular import read


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def _text_queries(spark, d):
    return read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _docs(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def vec_topk(spark, d):
    return R.vector_topk(_vector_queries(spark, d), _vectors(spark, d), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def vec_topk_filtered(spark, d):
    return R.vector_topk(_vector_queries(spark, d), R.metadata_filter(_vectors(spark, d), {"label": 3}), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def minmax_norm(spark, d):
    return R.min_max(R.vector_topk(_vector_queries(spark, d), _vectors(spark, d), 10)).select("query_id", "id", F.round("normalized", 6).alias("normalized"))


def dist_to_sim(spark, d):
    return R.distance_to_similarity(R.vector_topk(_vector_queries(spark, d), _vectors(spark, d), 10)).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def bm25_topk(spark, d):
    return R.bm25(_text_queries(spark, d), _docs(spark, d), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def token_overlap(spark, d):
    return R.token_overlap(_text_queries(spark, d), _docs(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def hybrid_fusion(spark, d):
    v = R.vector_topk(_vector_queries(spark, d), _vectors(spark, d), 20)
    b = R.bm25(_text_queries(spark, d), _docs(spark, d), 20)
    return R.fuse(v, b, 0.6, 20).select("query_id", "id", *(F.round(c, 6).alias(c) for c in ("vector", "bm25", "score")), "rank", R.method_of(F.col("vector"), F.col("bm25")).alias("method"))


def _search(spark, d, diverse):
    """Benchmark passages ask with the vector of their id; documents have the vector of theirs."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = _text_queries(spark, d).join(vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    docs = _docs(spark, d).join(vectors, "id", "left")
    return R.hybrid_search(asked, docs, diverse=diverse).select("query_id", "id", *(F.round(c, 6).alias(c) for c in ("vector", "bm25", "score")), "rank")


def hybrid_search(spark, d):
    return _search(spark, d, True)


def hybrid_search_plain(spark, d):
    return _search(spark, d, False)


def mmr(spark, d):
    q = _vector_queries(spark, d)
    hits = R.vector_topk(q, _vectors(spark, d), 20).join(_vectors(spark, d).select("id", "embedding"), "id").join(q, "query_id")
    return R.mmr(hits)


def rerank(spark, d):
    hits = R.bm25(_text_queries(spark, d), _docs(spark, d), 20).join(_docs(spark, d), "id").join(_text_queries(spark, d), "query_id")
    return R.rerank(hits).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def parity_probe(spark, d):
    q = _vector_queries(spark, d)
    a = R.vector_topk(q, _vectors(spark, d), 10)
    b = R.vector_topk(q, _vectors(spark, d).where("label < 5"), 10)
    return R.parity(a, b).select(F.round("overlap", 6).alias("overlap"), "queries")


def index_upsert(spark, d):
    old = _vectors(spark, d).where("id % 2 = 0").withColumn("collection", F.lit("c"))
    new = _vectors(spark, d).where("id % 3 = 0").withColumn("collection", F.lit("c")).withColumn("label", F.lit(99))
    return R.upsert(old, new).select("collection", "id", "label")


def jaccard_eval(spark, d):
    turns = read(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", F.round(R.jaccard(F.array_distinct(E.tokens(F.col("question"))), F.array_distinct(E.tokens(F.col("answer")))), 4).alias("overlap"))


def eval_metrics(spark, d):
    turns = read(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", "question", "answer", F.array("question").alias("references"), F.array("answer").alias("contexts"))
    return E.metrics(rows).select("conv_id", "turn", *E.METRICS)


def eval_summary(spark, d):
    return E.summarize(eval_metrics(spark, d))


COS = "list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])))"
HITS = """
hits as (
  select q.vec_id as query_id, v.vec_id as id, """ + COS.format(a="q.embedding", b="v.embedding") + """ as score
  from embeddings q join embeddings v on true where q.vec_id % 20 = 0 {where} qualify row_number() over (partition by q.vec_id order by score desc, v.vec_id) <= {k}),
ranked as (select *, 1 - score as distance, (row_number() over (partition by query_id order by score desc, id))::int as rank from hits)
"""
WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9.%\\- ]', ' ', 'g'), ' +'), lambda x: x <> '')"
LEXICAL = (
    "d as (select doc_id as id, " + WORDS.format(t="text") + " as ts from documents where trim(coalesce(text, '')) <> ''), "
    "st as (select count(*) as n, avg(len(ts)) as avgdl from d), "
    "tf as (select id, dl, term, count(*) as tf from (select id, len(ts) as dl, unnest(ts) as term from d) group by all), "
    "dfq as (select term, count(*) as df from tf group by 1), "
    "q as (select item_id as query_id, unnest(list_distinct(" + WORDS.format(t="text") + ")) as term from benchmark where item_id % 20 = 0), "
    "lex as (select query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join tf using (term) join dfq using (term), st group by 1, 2), "
    "lexr as (select *, (row_number() over (partition by query_id order by round(score, 9) desc, id))::int as rank from lex qualify rank <= 20)"
)

QUERIES = {
    "vec_topk": vec_topk,
    "vec_topk_filtered": vec_topk_filtered,
    "minmax_norm": minmax_norm,
    "dist_to_sim": dist_to_sim,
    "bm25_topk": bm25_topk,
    "token_overlap": token_overlap,
    "hybrid_fusion": hybrid_fusion,
    "hybrid_search": hybrid_search,
    "hybrid_search_plain": hybrid_search_plain,
    "mmr": mmr,
    "rerank": rerank,
    "parity_probe": parity_probe,
    "index_upsert": index_upsert,
    "jaccard_eval": jaccard_eval,
    "eval_metrics": eval_metrics,
    "eval_summary": eval_summary,
}

TOK = "list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce({t}, '')), '[[:punct:]]', ' ', 'g')), '\\s+'), lambda x: x <> ''))"

ORACLES = {
    "vec_topk": "with" + HITS.format(where="", k=20) + "select query_id, id, round(score, 6) as score, rank from ranked",
    "vec_topk_filtered": "with" + HITS.format(where="and v.label = 3", k=10) + "select query_id, id, round(score, 6) as score, rank from ranked",
    "minmax_norm": "with" + HITS.format(where="", k=10) + "select query_id, id, round((score - min(score) over w) / (max(score) over w - min(score) over w), 6) as normalized from ranked window w as (partition by query_id)",
    "dist_to_sim": "with" + HITS.format(where="", k=10) + "select query_id, id, round(1 - (distance - min(distance) over w) / (max(distance) over w - min(distance) over w), 6) as similarity from ranked window w as (partition by query_id)",
    "bm25_topk": "with " + LEXICAL + " select query_id, id, round(score, 6) as score, rank from lexr",
    "token_overlap": "with q as (select item_id as query_id, list_distinct(" + WORDS.format(t="text") + ") as qt from benchmark where item_id % 20 = 0), d as (select doc_id as id, list_distinct(" + WORDS.format(t="text") + ") as dt from documents), s as (select query_id, id, len(list_intersect(qt, dt)) / (len(qt) + len(dt) - len(list_intersect(qt, dt)))::double as score from q, d where len(list_intersect(qt, dt)) > 0) select query_id, id, round(score, 6) as score, (row_number() over (partition by query_id order by score desc, id))::int as rank from s qualify rank <= 10",
    "hybrid_fusion": "with" + HITS.format(where="", k=20) + ", " + LEXICAL + """,
v as (select query_id, id, 1 - (distance - min(distance) over w) / (max(distance) over w - min(distance) over w) as vector from ranked window w as (partition by query_id)),
b as (select query_id, id, score / max(score) over (partition by query_id) as bm25 from lexr),
f as (select query_id, id, coalesce(vector, 0) as vector, coalesce(bm25, 0) as bm25, 0.6::double * coalesce(vector, 0) + 0.4::double * coalesce(bm25, 0) as score from v full outer join b using (query_id, id))
select query_id, id, round(vector, 6) as vector, round(bm25, 6) as bm25, round(score, 6) as score, (row_number() over (partition by query_id order by round(score, 9) desc, id))::int as rank,
  case when vector > 0 and bm25 > 0 then 'hybrid' when bm25 > 0 then 'bm25' else 'vector' end as method
from f qualify rank <= 20""",
    "hybrid_search_plain": "with " + LEXICAL + """,
qv as (select b.item_id as query_id, e.embedding from benchmark b join embeddings e on e.vec_id = b.item_id where b.item_id % 20 = 0),
dv as (select d.doc_id as id, e.embedding from documents d join embeddings e on e.vec_id = d.doc_id),
hits as (select query_id, id, """ + COS.format(a="qv.embedding", b="dv.embedding") + """ as sim from qv, dv qualify row_number() over (partition by query_id order by sim desc, id) <= 20),
v as (select query_id, id, 1 - ((1 - sim) - min(1 - sim) over w) / (max(1 - sim) over w - min(1 - sim) over w) as vector from hits window w as (partition by query_id)),
b as (select query_id, id, score / max(score) over (partition by query_id) as bm25 from lexr),
f as (select query_id, id, coalesce(vector, 0) as vector, coalesce(bm25, 0) as bm25, row_number() over (partition by query_id order by round(0.6::double * coalesce(vector, 0) + 0.4::double * coalesce(bm25, 0), 9) desc, id) as place from v full outer join b using (query_id, id) qualify place <= 20),
t as (select f.*, list_distinct(""" + WORDS.format(t="q.text") + """) as qt, list_distinct(""" + WORDS.format(t="d.text") + """) as dt from f join documents d on d.doc_id = f.id join benchmark q on q.item_id = f.query_id),
j as (select *, len(list_intersect(qt, dt)) / (len(qt) + len(dt) - len(list_intersect(qt, dt)))::double as likeness from t),
s as (select *, case when max(likeness) over w > 0 then likeness / max(likeness) over w else 0 end as score from j window w as (partition by query_id))
select query_id, id, round(vector, 6) as vector, round(bm25, 6) as bm25, round(score, 6) as score, (row_number() over (partition by query_id order by score desc, place) - 1)::int as rank from s qualify rank < 8""",
    "index_upsert": "select 'c' as collection, vec_id as id, case when vec_id % 3 = 0 then 99 else label end::int as label from embeddings where vec_id % 2 = 0 or vec_id % 3 = 0",
    "parity_probe": "with" + HITS.format(where="", k=10) + """, h2 as (select q.vec_id as query_id, v.vec_id as id, """ + COS.format(a="q.embedding", b="v.embedding") + """ as score
  from embeddings q join embeddings v on true where q.vec_id % 20 = 0 and v.label < 5 qualify row_number() over (partition by q.vec_id order by score desc, v.vec_id) <= 10),
a as (select query_id, list(id) as l from hits group by 1), b as (select query_id, list(id) as r from h2 group by 1)
select round(avg(len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r)))::double), 6) as overlap, count(*) as queries from a join b using (query_id)""",
}
