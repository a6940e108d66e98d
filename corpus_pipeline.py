"""The corpus pipeline: language, near-duplicates, personal data, mixture, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the next one's ``docs``, which ``run`` writes and reads back. All
but the last return the columns of ``documents``. Rows are what is judged, as
ids can be null or repeated; they are told apart by their content, or by a
number that is written with them. Keys that a stage drops are written first:
Spark then knows the size of that table and broadcasts it only below
``spark.sql.autoBroadcastJoinThreshold``; above it both sides shuffle, in
``near_duplicates`` only the rows that a sieve of bounded size lets through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from millrace.llm import langid, mixing, partenum, pii, spiece
from millrace.llm.common import free, settle, sieve, table


def _key(docs: DataFrame) -> Column:
    """128 bits that tell rows apart by all that they hold; rows that are the same in every column share them.

    Nothing has to be written for it, and a recomputed task gives the same.
    """
    plain = [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]
    parts = [*plain, *(c.isNull() for c in plain)]
    return F.concat_ws(":", *(F.xxhash64(F.lit(seed), *parts).cast("string") for seed in (1, 2)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the evidence is the text, the recorded language and the source.

    A text without a letter goes unless its recorded language is a known one;
    null, empty and very long texts are judged like others, whole. Rows are
    judged one by one, whatever their doc_id; the same rows alike. An empty
    table, and one without a recorded language, gives no rows. Other columns
    stay, whatever their names.
    """
    key = free(docs, "row_key")
    rows = docs.withColumn(key, _key(docs))
    rejected = langid.identify_documents(rows, key=key).where("not accepted").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(settle(rejected, "rejected"), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at a similarity of at least 0.8, one.

    It is the one with the smallest doc_id, a null one last; of several rows
    with it, the first by content, and of the same rows one. Null, empty and
    blank texts have no shingles and all stay. Very long texts are compared
    whole. An empty table gives no rows. Other columns stay, whatever their
    names.
    """
    key, at = free(docs, "row_key"), F.col
    rows = docs.withColumn(key, _key(docs))
    order = F.struct(at("doc_id").isNull().alias("nameless"), at("doc_id").cast("long").alias("id"), at(key).alias("row"))
    found = partenum.jaccard_components(rows.select(order.alias("doc_id"), "text"), num=8, den=10, width=5)
    found = found.where("n_shingles > 0").select(F.col("doc_id.row").alias(key), (F.col("doc_id") == F.col("component_id")).alias("first"))
    # Rows that go, and kept ones that occur more than once; most documents are neither.
    found = settle(found.groupBy(key, "first").agg(F.count("*").alias("rows")).where("rows > 1 or not first"), "found")
    # Only they and the few rows that the sieve cannot tell from them are shuffled.
    near, out = sieve(rows, found, key)
    out = out.unionByName(near.join(found, key, "left_anti"))
    once = near.join(found.where("first").select(key), key, "left_semi").dropDuplicates([key])
    return out.unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; ``n_chars`` follows.

    A null text stays null with a null ``n_chars``, an empty one stays empty;
    very long ones are read whole. Every row stays, repeated ones too; other
    columns are untouched. An empty table gives no rows.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: their taken words over their size, rounded to whole copies.

    Rows are mixed one by one, whatever their doc_id. A null source is a source
    of its own. Null, empty and blank texts give the mixture nothing and go;
    very long ones count with all their words. An empty table gives no rows.
    Other columns stay, whatever their names.
    """
    key, copies, each = free(docs, "row_number"), free(docs, "row_copies"), free(docs, "row_copy")
    rows = settle(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    taken = mixing.mix(rows, key=key).select(key, F.expr("cast(floor(try_divide(taken, cast(size as double)) + 0.5D) as int)").alias(copies))
    repeated = rows.join(taken.where(F.col(copies) > 0), key).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of each document.

    A null or empty text has no pieces; very long ones are encoded whole. Every
    row gives one, repeated ones too, and a null doc_id stays null. Other
    columns are ignored. An empty table gives no rows.
    """
    return spiece.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the language model nor the encoding; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
