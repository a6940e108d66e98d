import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import memory as M
from millrace.operators import retrieval as R

NOW = datetime(2025, 6, 1)
SCHEMA = "id string, text string, metadata map<string,string>, score double, first_seen timestamp, last_access timestamp, access_count long"
HITS = "id string, text string, metadata map<string,string>, score double, position long"


@pytest.fixture()
def entries(spark):
    at = lambda days: NOW - timedelta(days=days)
    return spark.createDataFrame(
        [
            ("a", "short", {"source": "Web", "k": "1"}, 0.5, at(9), at(9), 1),
            ("b", "bee", {"url": "http://x/WEB"}, 0.9, at(200), at(89), 3),
            ("c", "sea", {"source": "", "path": "disk"}, 0.1, at(300), at(91), 1),
        ],
        SCHEMA,
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_remember(spark, entries):
    hits = [("a", "longer!", {"k": "2"}, 0.2, 1), ("a", "LONGER!", {"k": "3", "n": "x"}, None, 2), (" d ", None, None, 0.7, 3), ("  ", "lost", None, 1.0, 4), (None, "lost", None, 1.0, 5)]
    got = {r.id: r for r in M.remember(entries, spark.createDataFrame(hits, HITS), F.lit(NOW)).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    a = got["a"]
    assert (a.text, a.score, a.access_count, a.last_access, a.first_seen) == ("longer!", 0.5, 3, NOW, NOW - timedelta(days=9))
    assert a.metadata == {"source": "Web", "k": "3", "n": "x"}
    assert (got["d"].text, got["d"].metadata, got["d"].score) == ("", {}, 0.7) and got["b"].access_count == 3
    long = spark.createDataFrame([("z", "x" * 30, None, 1.0, 0)], HITS)
    assert M.remember(entries.limit(0), long, F.lit(NOW), 10).first().text == "x" * 9 + "…"
    assert M.remember(entries.limit(0), long.limit(0), F.lit(NOW)).count() == 0


def test_what_leaves_and_what_is_found(spark, entries):
    now = F.lit(NOW)
    assert sorted(ids(M.expire(entries, now))) == ["a", "b"]
    assert ids(M.forget_source(entries, " wEb ")) == ["c"] and M.forget_source(entries, " ").count() == 3
    assert sorted(ids(M.evict(entries, 2))) == ["a", "b"] and sorted(ids(M.recent(entries, now, 1))) == ["a"]
    found = M.recall(entries, now).collect()
    assert [r.id for r in found] == ["b", "a"] and [r.access_count for r in found] == [4, 2]
    assert found[0].worth == pytest.approx(0.63 + 0.3 * math.exp(-89 / 30))
    assert ids(M.recall(entries, now, {"k": "1"})) == ["a"]
    assert M.stats(entries.limit(0), now).first()[:] == (0, None, None)


def test_metrics(spark):
    events = spark.createDataFrame([(" a  b ", 0.01), (None, 0.3), ("a b", 9.0), ("a b", None)], "route string, s double")
    assert {tuple(r) for r in M.counter(events, ["route"]).collect()} == {("a b", 3), ("none", 1)}
    rows = {(r.route, r.le): (r.bucket, r["count"], r.sum) for r in M.histogram(events, ["route"], "s").collect()}
    assert rows["a b", 0.01] == (1, 2, 9.01) and rows["a b", 5.0] == (1, 2, 9.01) and rows["a b", None] == (2, 2, 9.01)
    assert rows["none", 0.25][0] == 0 and rows["none", 0.5][0] == 1 and len(rows) == 20
    lines = M.exposition(M.counter(spark.createDataFrame([('q"',)], "route string"), ["route"]), ["route"], "n")
    assert lines.first().line == 'n{route="q\\""} 1'


def test_hybrid_search_thins_its_pool(spark):
    rng = np.random.default_rng(5)
    words = "net zero water waste revenue carbon energy scope".split()
    docs = [(i, " ".join(rng.choice(words, 6)), rng.normal(size=8).tolist()) for i in range(40)] + [(40, "net zero water", None), (41, None, [1.0] * 8)]
    asked = [(1, "net zero", rng.normal(size=8).tolist()), (2, " ", rng.normal(size=8).tolist()), (3, "waste", None)]
    d = spark.createDataFrame(docs, "id long, text string, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, query string, query_vector array<double>")
    plain = {(r.query_id, r["rank"]): r for r in R.hybrid_search(q, d, k=20, diverse=False).collect()}
    assert {k for k, _ in plain} == {1, 3} and plain[1, 0].score == 1.0
    assert all(0 <= r.score <= 1 for r in plain.values())
    got = {(r.query_id, r["rank"]): r.id for r in R.hybrid_search(q, d).collect()}
    for query, vector in ((1, asked[0][2]), (3, [0.0] * 8)):
        pool = [plain[query, n].id for n in range(sum(k == query for k, _ in plain))]
        want = R.mmr_order(np.array(vector), np.array([docs[i][2] or [0.0] * 8 for i in pool]), 8)
        assert [got[query, n] for n in range(8)] == [pool[i] for i in want]
