"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.plans.tabular import read
from millrace.sources.html import html_tables


def norm_text(spark, d):
    text = X.collapse_inner_whitespace(X.dehyphenate(X.collapse_blank_lines(F.col("text"))))
    return read(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("text_hash"))


def normalize_full(spark, d):
    return read(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


def ascii_safe(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(X.ascii_safe(F.col("text")), 256).alias("text_hash"))


def token_count(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.sum(X.count_tokens(F.col("text"))).alias("tokens"), F.max(X.count_tokens(F.col("text"))).alias("most"))


def char_chunks(spark, d):
    chunks = read(spark, d, "documents").select("doc_id", F.posexplode(X.char_windows(F.col("text"))).alias("position", "chunk"))
    return chunks.select("doc_id", "position", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_hash"))


def chunk_dedupe(spark, d):
    chunks = read(spark, d, "documents").select("doc_id", F.posexplode(X.char_windows(F.col("text"))).alias("position", "text"))
    return X.dedupe_chunks(chunks, order=("doc_id", "position")).select("doc_id", "position", F.md5("text").alias("chunk_hash"))


def token_chunks(spark, d):
    return X.chunk_text(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "position", "tokens", "title", F.md5("chunk").alias("chunk_hash"))


def sentence_count(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


def page_tables(spark, d):
    return html_tables(read(spark, d, "pages").select("page_id", "html"), "html", ["page_id"])


WINDOWS = "select doc_id, (i // 1050)::int as position, substr(text, i::int + 1, 1200) as chunk from documents, unnest(range(0, length(text), 1050)) as u(i)"

QUERIES = {
    "norm_text": norm_text,
    "normalize_full": normalize_full,
    "ascii_safe": ascii_safe,
    "token_count": token_count,
    "char_chunks": char_chunks,
    "chunk_dedupe": chunk_dedupe,
    "token_chunks": token_chunks,
    "sentence_count": sentence_count,
    "page_tables": page_tables,
}

ORACLES = {
    "norm_text": r"select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{2,}', chr(10) || chr(10), 'g'), '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g'), '[ \t]{2,}', ' ', 'g')) as text_hash from documents",
    "ascii_safe": r"select doc_id, sha256(regexp_replace(text, '[^\x20-\x7E\n\t£€$%]', ' ', 'g')) as text_hash from documents",
    "token_count": "select source, sum(greatest(1, length(coalesce(text, '')) // 4))::bigint as tokens, max(greatest(1, length(coalesce(text, '')) // 4))::int as most from documents group by 1",
    "char_chunks": f"select doc_id, position, length(chunk)::int as n_chars, md5(chunk) as chunk_hash from ({WINDOWS})",
    "chunk_dedupe": f"select doc_id, position, md5(chunk) as chunk_hash from ({WINDOWS}) qualify row_number() over (partition by chunk order by doc_id, position) = 1",
}
