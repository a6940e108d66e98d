"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior:

* the text, as character trigrams under one distribution for each language,
  fitted on a bounded sample of labelled rows (``SAMPLE``) and tempered, since
  neighbouring trigrams are not independent;
* the declared language of the markup, through P(declared | language);
* the suffix of the address and the host, as priors smoothed from the whole
  corpus to the suffix and from the suffix to the host, with the document's
  own vote left out.

The tables of declared languages, suffixes and hosts are grouped counts of the
text's own verdicts over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, tidy, utf8

SAMPLE = 1200
MOST_LANGUAGES = 64
CELLS = 1 << 16
# Bytes of text that a worker has at work at once; its arrays are many times as large.
TEXT_BYTES = 500_000
TEMPER = 0.1
SMOOTH = 20.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams of letters and blanks that hold a letter, and the row of each."""
    folded = _FOLD[raw].astype(np.uint32)
    if len(folded) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = (row[:-2] == row[2:]) & (b != 32)
    code = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    return code[whole].astype(np.int64), row[:-2][whole]


def fit(texts: Sequence[str], labels: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each cell under each."""
    names = sorted(set(labels))
    if len(names) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    counts = np.zeros((CELLS, len(names)))
    cells, rows = trigrams(*utf8(pa.array(texts, pa.string())))
    np.add.at(counts, (cells, np.array([names.index(x) for x in labels], np.int64)[rows]), 1)
    return names, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * CELLS))


def sample(labelled: DataFrame, size: int = SAMPLE, seed: int = 23) -> tuple[list[str], list[str]]:
    """Texts and labels of ``size`` rows of ``labelled(doc_id, text, lang)``: those whose ids, then contents, have the smallest hashes.

    Rows that are alike in all three count once, so the sample does not depend
    on the order of rows. Only hashes are sorted; texts are read for the rows taken.
    """
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("i"), F.xxhash64("text", "lang").alias("t")).alias("_h"))
    least = rows.select("_h").distinct().orderBy("_h").limit(size).agg(F.max("_h")).first()[0]
    if least is None:
        return [], []
    found = rows.where(F.col("_h") <= F.struct(F.lit(least.i).alias("i"), F.lit(least.t).alias("t"))).dropDuplicates(["_h"]).collect()
    return [r.text for r in found], [r.lang for r in found]


def _score(held):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        k = table.shape[1]
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                raw, at = utf8(batch.column("text"))
                cells, rows = trigrams(raw, at)
                n = len(at) - 1
                total = np.stack([np.bincount(rows, weights=table[cells, j], minlength=n) for j in range(k)], axis=1) if k else np.zeros((n, 0))
                grams = np.bincount(rows, minlength=n)
                best = np.where(grams > 0, total.argmax(axis=1) if k else 0, -1)
                columns = [batch.column(c) for c in ("doc_id", "declared", "suffix", "host")]
                columns += [pa.array(grams, pa.int64()), pa.array(best, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), k).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "declared", "suffix", "host", "n_grams", "verdict", "logs"])

    return run


def _votes(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Verdicts for each value of a column, one row with an array of counts a value."""
    counts = [F.count_if(F.col("verdict") == j) for j in range(k)]
    return rows.where(F.col(by).isNotNull() & (F.col("verdict") >= 0)).groupBy(by).agg(F.array(*counts).alias(f"{by}_votes"))


def _smoothed(votes: Column, prior: Column, own: Column, smooth: float) -> Column:
    """(votes - own + smooth * prior) / total, for arrays; missing votes leave the prior."""
    total = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v) - F.when(own >= 0, 1.0).otherwise(0.0) + smooth
    mixed = F.transform(prior, lambda p, j: (F.get(votes, j) - F.when(own == j, 1.0).otherwise(0.0) + smooth * p) / total)
    return F.when(votes.isNull(), prior).otherwise(mixed)


def identify(docs: DataFrame, languages: Sequence[str], table: np.ndarray, least: float = 0.5, temper: float = TEMPER, smooth: float = SMOOTH) -> DataFrame:
    """(doc_id, language, confidence, text_language, declared, accepted) for every row of ``docs(doc_id, text, declared, suffix, host)``.

    ``language`` has the largest posterior, ``confidence`` is that posterior
    rounded to six places, ``text_language`` is the verdict of the text alone.
    A document is accepted if its confidence is at least ``least`` and it has
    evidence of its own: a letter in its text or a known declared language.

    Texts without letters, null ones too, leave the other evidence to decide.
    A declared language counts by its first subtag; unknown ones are one class,
    null is no evidence. A null suffix or host leaves the prior above it. A
    null doc_id stays null, repeated rows vote as often as they occur, other
    columns are ignored, an empty table gives an empty result. Whole texts and
    all rows are counted.
    """
    names, k = list(languages), len(languages)
    tag = F.lower(F.regexp_extract(F.col("declared").cast("string"), r"^\s*([A-Za-z]+)", 1))
    known = F.array(*(F.lit(n) for n in names))
    declared = F.when(F.col("declared").isNull(), None).otherwise(F.coalesce(F.nullif(F.array_position(known, tag), F.lit(0)) - 1, F.lit(k))).cast("long")
    kind = "string" if docs.schema["doc_id"].dataType.typeName() == "string" else "long"
    narrow = docs.select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"), declared.alias("declared"), F.col("suffix").cast("string").alias("suffix"), F.col("host").cast("string").alias("host")
    )
    held = docs.sparkSession.sparkContext.broadcast(table)
    schema = f"doc_id {kind}, declared long, suffix string, host string, n_grams long, verdict long, logs array<double>"
    rows = settle(narrow.mapInArrow(_score(held), schema), "evidence")

    # At most (languages + 1) x languages counts come to the driver.
    seen = np.zeros((k + 1, k))
    for r in rows.where("declared is not null and verdict >= 0").groupBy("declared", "verdict").count().collect():
        seen[r.declared, r.verdict] = r["count"]
    said = np.log((seen + 1.0) / (seen.sum(axis=0) + k + 1.0))
    votes = np.zeros(k)
    for r in rows.where("verdict >= 0").groupBy("verdict").count().collect():
        votes[r.verdict] = r["count"]
    prior = (votes + 1.0) / (votes.sum() + k)

    constant = lambda values: F.array(*(F.lit(float(v)) for v in values))
    # Suffixes and hosts may be many: their counts stay tables, and a hot one is split by the adaptive join.
    joined = rows.join(_votes(rows, "suffix", k), "suffix", "left").join(_votes(rows, "host", k), "host", "left")
    own = F.col("verdict")
    joined = joined.withColumn("p", _smoothed(F.col("suffix_votes"), constant(prior), own, smooth))
    joined = joined.withColumn("p", _smoothed(F.col("host_votes"), F.col("p"), own, smooth))
    says = F.get(F.array(*(constant(row) for row in said)), F.col("declared").cast("int"))
    score = F.zip_with(F.zip_with("logs", "p", lambda x, p: x * temper + F.log(p)), F.coalesce(says, constant([0.0] * k)), lambda a, b: a + b)
    joined = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    total = F.aggregate("score", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    confidence = F.round(1.0 / total, 6)
    name = lambda at: F.get(known, at.cast("int"))
    language = name(F.array_position("score", F.col("top")) - 1)
    evidence = (F.col("n_grams") > 0) | (F.col("declared") < k)
    return joined.select(
        "doc_id",
        language.alias("language"),
        confidence.alias("confidence"),
        F.when(own >= 0, name(own)).alias("text_language"),
        F.when(F.col("declared") < k, name(F.col("declared"))).when(F.col("declared").isNotNull(), "other").alias("declared"),
        F.coalesce((confidence >= least) & evidence, F.lit(False)).alias("accepted"),
    )


def of_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents as evidence: the recorded language is what was declared, the source is the host; there is no address."""
    return docs.select(F.col(key).alias("doc_id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as evidence: visible text, the lang attribute of the html element, the address's suffix and its host."""
    html = F.col("html")
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(
        F.col("page_id").alias("doc_id"), visible.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host")
    )


def identify_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``identify`` over ``docs(doc_id, text, lang, source)``, with texts fitted on a sample of the rows that have a language; doc_id is ``key``."""
    texts, labels = sample(docs)
    names, table = fit(texts, [x.lower() for x in labels]) if labels else ([], np.zeros((CELLS, 0)))
    if not names:
        return docs.select(F.col(key).cast("long").alias("doc_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("language", "string"), ("confidence", "double"), ("text_language", "string"), ("declared", "string"))), F.lit(False).alias("accepted"))
    return identify(of_documents(docs, key), names, table, **options)


def identify_pages(pages: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """``identify`` over ``pages(page_id, url, html)``, with texts fitted on a sample of ``docs``; doc_id is the page_id."""
    names, table = fit(*sample(docs))
    return identify(of_pages(pages), names, table, **options)
