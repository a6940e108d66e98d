"""The queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chroma, langid, maglev, mixing, partenum, pii, pivots, spiece, tokens, wacz
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2, block=1, seed=17).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('17:' || coalesce(cast(doc_id as varchar), 'null')) as code from documents),
src as (
  select source, cast(sum(size) as bigint) as source_size, count(*) as n, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source),
run as (
  select *, coalesce(sum(source_size) over o, 0)::double as filled, coalesce(sum(weight) over o, 0)::double as light, (sum(source_size) over ())::double as size, (sum(weight) over ())::double as weights
  from src window o as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
lev as (select *, (1.5::double * size - 2::double * filled) / (weights - light) as level from run),
stop as (select *, level * weight >= 2 * source_size as stops from lev),
tgt as (
  select source, source_size, least(4096, ceil(n / 128.0))::bigint as shards,
    case when stops then 2::double * source_size else max(case when not stops then level end) over () * weight end as target
  from stop),
narrow as (
  select d.doc_id, d.source, d.size, d.code, t.source_size, t.target, ('0x' || substr(d.code, 1, 8))::bigint % t.shards as shard
  from sized d join tgt t on d.source is not distinct from t.source),
sh as (
  select source, shard, sum(size)::bigint as shard_size, any_value(source_size) as source_size, any_value(target) as target, sum(size)::bigint as blocks from narrow group by source, shard),
bs as (
  select source, any_value(source_size) as source_size, floor(any_value(target) * 1024)::bigint as vote, sum(blocks)::bigint as blocks from sh group by source),
bq as (
  select *, floor((sum(source_size) over ()) * 1.5::double + 0.5)::bigint as seats, vote::double * floor((sum(source_size) over ()) * 1.5::double + 0.5)::bigint / greatest(1, sum(vote) over ())::double as q from bs),
bseat as (
  select source, vote, seats, unnest(range(greatest(1, floor(q)::bigint - 50), least(2 * blocks, floor(q)::bigint + 50) + 1)) as seat from bq where vote > 0),
brank as (
  select *, row_number() over (order by vote / (2.0::double * seat - 1) desc, source nulls last, seat) + (select coalesce(sum(greatest(1, floor(q)::bigint - 50) - 1), 0) from bq where vote > 0) as nth from bseat),
bquota as (select source, max(seat) as quota from brank where nth <= seats group by source),
hq as (
  select h.*, coalesce(b.quota, 0) as seats, h.shard_size * coalesce(b.quota, 0)::double / greatest(1, sum(h.shard_size) over (partition by h.source)) as q
  from sh h left join bquota b on h.source is not distinct from b.source),
hseat as (
  select source, shard, shard_size, seats, greatest(1, floor(q)::bigint - 50) as low, unnest(range(greatest(1, floor(q)::bigint - 50), least(2 * blocks, floor(q)::bigint + 50) + 1)) as seat from hq where shard_size > 0),
hlow as (select source, sum(low - 1) as before from (select distinct source, shard, low from hseat) group by source),
hrank as (
  select s.*, row_number() over (partition by s.source order by shard_size / (2.0::double * seat - 1) desc, shard, seat) + l.before as nth
  from hseat s join hlow l on s.source is not distinct from l.source),
hquota as (select source, shard, max(seat) as quota from hrank where nth <= seats group by source, shard),
place as (
  select h.source, h.shard, h.blocks, h.shard_size, coalesce(k.quota, 0) as quota,
    case when h.blocks > 0 then ('0x' || substr(md5('17:' || coalesce(h.source, '') || ':' || h.shard), 1, 8))::bigint % h.blocks else 0 end as first
  from sh h left join hquota k on h.source is not distinct from k.source and h.shard = k.shard),
laid as (
  select n.*, p.blocks, p.shard_size, p.first, p.quota, sum(n.size) over (partition by n.source, n.shard order by n.code, n.doc_id, n.size rows unbounded preceding) as e,
    case when p.blocks > 0 then p.quota % p.blocks else 0 end as rest, case when p.blocks > 0 then p.quota // p.blocks else 0 end as turns
  from narrow n join place p on n.source is not distinct from p.source and n.shard = p.shard)
select doc_id, size::bigint as size, source_size, target,
  (size * turns + greatest(0, least(e, first + rest, shard_size) - greatest(e - size, first)) + greatest(0, least(e, greatest(0, first + rest - blocks)) - (e - size)))::bigint as taken
from laid
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "page_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), num=9, den=10, width=3)


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as x from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)),
reach as (select doc_id as a, doc_id as b from n union select reach.a, links.b from reach join links on links.a = reach.b)
select n.doc_id, n.n as n_shingles, min(reach.b) as component_id from n join reach on reach.a = n.doc_id group by n.doc_id, n.n
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), rule="most")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents")).drop("added")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:03d}" for i in range(64)]
    return maglev.place(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), shards, spare="n_chars").select("doc_id", "slot", "shard")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings, so each embedding is rendered as one; near-duplicate embeddings sound alike."""
    return chroma.align(chroma.render_embeddings(table(spark, sf_dir, "embeddings"))).withColumnsRenamed({"id": "vec_id"})


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digest(table(spark, sf_dir, "documents"))


OP7_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
f as (select *, max(page_id) over (partition by d) as first from p)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when n >= 1000 and first is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and first is distinct from page_id then first end as refers_to
from f
"""


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


OP10_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on links.a = reach.b),
n as (select a, count(*) as n from links group by a)
select r.a as vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(r.b) as component_id, r.a = min(r.b) as kept from reach r left join n on n.a = r.a group by r.a
"""


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_language_id": op2_language_id,
        "language_id_pages": language_id_pages,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_token_counts": op4_token_counts,
        "op5_pii": op5_pii,
        "op6_sharding": op6_sharding,
        "op7_warc": op7_warc,
        "op8_audio_fingerprints": op8_audio_fingerprints,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL,
        "op3_ngram_jaccard_join": OP3_SQL,
        "op7_warc": OP7_SQL,
        "op10_embedding_near_dedup": OP10_SQL,
    }
