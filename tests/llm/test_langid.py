import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm.common import utf8
from millrace.llm import langid
from millrace.llm.langid import SMOOTH, TEMPER, fit, identify, identify_documents, identify_pages, trigrams

SF = "/root/testdata/sf0.01"


def test_trigrams_stay_within_rows():
    texts = ["abc", "", "a b", "ABCd", None, "1x2", "zz"]
    cells, rows = trigrams(*utf8(pa.array(texts, pa.string())))
    assert Counter(rows.tolist()) == {0: 1, 3: 2, 5: 1}
    assert cells[0] == cells[1]


def brute(rows, names, table):
    k = len(names)
    logs, verdict = [], []
    for _, text, *_ in rows:
        cells, _ = trigrams(*utf8(pa.array([text], pa.string())))
        logs.append(table[cells].sum(axis=0) if len(cells) else np.zeros(k))
        verdict.append(int(np.argmax(logs[-1])) if len(cells) else -1)
    code = [None if d is None else names.index(d.lower()[:2]) if d.lower()[:2] in names else k for _, _, d, *_ in rows]
    said = np.ones((k + 1, k))
    prior = np.ones(k)
    by = defaultdict(lambda: np.zeros(k))
    for v, d, (_, _, _, suffix, host) in zip(verdict, code, rows):
        if v >= 0:
            prior[v] += 1
            by["s", suffix][v] += 1
            by["h", host][v] += 1
            if d is not None:
                said[d, v] += 1
    said /= said.sum(axis=0)
    prior /= prior.sum()
    out = []
    for (number, *_, suffix, host), x, v, d in zip(rows, logs, verdict, code):
        p = prior
        for key in (("s", suffix), ("h", host)):
            if key[1] is not None and key in by:
                own = np.eye(k)[v] if v >= 0 else 0
                p = (by[key] - own + SMOOTH * p) / (by[key].sum() - (v >= 0) + SMOOTH)
        score = x * TEMPER + np.log(p) + (np.log(said[d]) if d is not None else 0)
        post = np.exp(score - score.max())
        out.append((number, names[int(score.argmax())], post.max() / post.sum()))
    return out


def test_posterior_matches_brute_force(spark):
    rng = random.Random(3)
    words = {"en": ["the", "of", "and", "with"], "fr": ["le", "que", "être", "avec"], "de": ["der", "und", "nicht", "für"]}
    names, table = fit([" ".join(rng.choices(words[n], k=40)) for n in words for _ in range(5)], [n for n in words for _ in range(5)])
    rows = []
    for i in range(150):
        n = rng.choice(list(words))
        text = rng.choice([" ".join(rng.choices(words[n], k=rng.randint(1, 6))), "", "123", None])
        rows.append((i, text, rng.choice([n, n.upper() + "-x", "xx", None, "en"]), rng.choice(["com", n, None]), rng.choice([f"{n}.example", "hot", "hot", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string").withColumn("p", F.lit(1)).repartition(4)
    got = {r.doc_id: r for r in identify(df, names, table).collect()}
    for number, language, confidence in brute(rows, names, table):
        assert math.isclose(got[number].confidence, confidence, abs_tol=2e-6)
        if confidence > 0.51:
            assert got[number].language == language
    assert identify(df.limit(0), names, table).count() == 0
    lost = identify(spark.createDataFrame([(None, None, None, None, None)], df.drop("p").schema), names, table).first()
    assert lost.doc_id is None and not lost.accepted


def test_documents_and_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    assert got.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()[:] >= (0.97, 0.99)
    pages = identify_pages(spark.read.parquet(f"{SF}/pages.parquet"), docs)
    assert pages.agg(F.avg((F.col("text_language") == F.col("declared")).cast("int"))).first()[0] > 0.9
    assert identify_documents(docs.limit(0)).count() == 0
    assert identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == 0


def test_a_worker_scores_short_runs_of_text(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("etaoin shr", k=n)) for n in [2000] * 3000 + [0, 1, 700_000, 3]] + [None]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=["doc_id", "text", "declared", "suffix", "host"])

    class Held:
        value = np.random.default_rng(1).random((langid.CELLS, 3))

    def rows(most):
        monkeypatch.setattr(langid, "TEXT_BYTES", most)
        return [r for b in langid._score(Held)(iter([batch])) for r in b.to_pylist()]

    tracemalloc.start()
    found = rows(langid.TEXT_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == rows(1 << 40) and len(found) == n
    # 6.7 MB of text: its arrays took 143 MB when it was scored 4 MB at a time
    assert peak < 60e6
