"""What the sieve passes, and that near-duplicates are taken from a table without shuffling it."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from millrace.llm.common import sieve
from millrace.llm.partenum import jaccard_components


@pytest.fixture
def shuffled(spark):
    """Bytes that stages have written for exchanges since the last call, where tables are never small."""
    store, last = spark.sparkContext._jsc.sc().statusStore(), [-1]

    def since():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        stages = [found.apply(i) for i in range(found.size())]
        new = sum(s.shuffleWriteBytes() for s in stages if s.stageId() > last[0])
        last[0] = max(s.stageId() for s in stages)
        return new

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield since
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("words", [1 << 20, 2, 1])
def test_sieve_loses_no_key(spark, words):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), F.lit("x").alias("sieve_slot"), F.lit(1).alias("Sieve_Bits"))
    keys = spark.range(0, 6000, 100).select(F.col("id").alias("k")).unionByName(spark.range(7, 3000, 100).select(F.col("id").alias("k")))
    near, clear = sieve(rows, keys, "k", words)
    assert near.columns == clear.columns == rows.columns
    a, b = ([r.k for r in part.collect()] for part in (near, clear))
    assert sorted(a + b, key=str) == sorted((r.k for r in rows.collect()), key=str)
    assert set(range(7, 3000, 100)) <= set(a) and (words < 10 or len(a) < 60)
    none, every = sieve(rows, keys.limit(0), "k", words)
    assert none.count() == 0 and every.count() == 3000


def test_near_duplicates_do_not_shuffle_the_table(spark, shuffled, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"{rng.getrandbits(60):x}" for _ in range(400))
    rows = [(i, text(), "en", "a", 0) for i in range(200)]
    rows += [(500 + k, rows[k][1] + " tail", *rows[k][2:]) for k in range(4)] + [rows[9]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/docs")
    docs, size = spark.read.parquet(f"{tmp_path}/docs"), sum(len(r[1]) for r in rows)
    out = pipeline.near_duplicates(spark, docs, "")
    shuffled()
    out.write.parquet(f"{tmp_path}/out")
    assert shuffled() < size / 10
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").select("doc_id").collect()) == list(range(200))


def test_only_texts_of_candidates_are_shuffled(spark, shuffled, monkeypatch):
    from millrace.llm.common import Scratch

    rng = random.Random(6)
    text = lambda: " ".join(f"{rng.getrandbits(60):x}" for _ in range(400))
    rows = [(i, text()) for i in range(200)]
    rows += [(500 + k, rows[k][1] + " tail") for k in range(4)]
    wrote = {}

    def keep(self, df, what, *args, inner=Scratch.keep, **kwargs):
        shuffled()
        out = inner(self, df, what, *args, **kwargs)
        wrote[what] = wrote.get(what, 0) + shuffled()
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    found = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 8, 10, 5).collect()}
    assert found == {i: i - 500 if i >= 500 else i for i, _ in rows}
    assert 0 < wrote["texts"] < sum(len(t) for _, t in rows) / 10
