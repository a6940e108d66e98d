import numpy as np
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evaluation as E
from millrace.operators import retrieval as R
from millrace.sources.html import parse_tables


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_normalisation(spark):
    assert "Gross margin improved" in one(spark, X.normalize, "Gross mar-\ngin improved")
    assert one(spark, X.normalize, "Operating    cash-flow") == "Operating cash-flow"
    assert one(spark, X.normalize, "Page 3 / 9\nbody\npage 4\n\n\n\nend") == "body\npage 4\n\nend"
    assert one(spark, lambda c: X.normalize(c, page_hint=r"(?i)^page\s+\d+$"), "Page 3 / 9\nbody\npage 4\n\n\n\nend") == "Page 3 / 9\nbody\n\nend"
    assert one(spark, X.normalize_quotes, "‛a‛ ‚b") == "'a' ‚b"
    assert one(spark, X.fix_bullets_and_dashes, "a ▪ b ● c") == "a - b ● c"
    assert one(spark, X.normalize_quotes, "‘a’ “b” «c»") == "'a' \"b\" \"c\""
    assert one(spark, X.fix_bullets_and_dashes, "• one\n2–3 a—b") == "- one\n2-3 a - b"
    assert one(spark, X.ascii_safe, "£5 é ok") == "£5   ok"
    assert one(spark, X.nfkc, "ﬁ①") == "fi1"
    assert one(spark, X.strip_accents, "Crème") == "Creme"
    assert one(spark, lambda c: X.filter_lines(c, "drop", "keep"), "drop\ndrop keep\nother") == "drop keep\nother"


def test_tokens_windows_and_sentences(spark):
    assert one(spark, X.count_tokens, "") == 1 and one(spark, X.count_tokens, "abcdefgh") == 2
    assert one(spark, lambda c: X.char_windows(c, 4, 1), "abcdefghij") == ["abcd", "defg", "ghij", "j"]
    assert one(spark, X.char_windows, None) == []
    assert len(one(spark, X.sentences, "Rev grew. Net zero by 2030! ok")) == 2
    assert one(spark, X.slug, "Ünïted Corp, plc") == "n-ted-corp-plc"


def test_tags(spark):
    df = spark.createDataFrame([([" A b ", "a_b", "Ü#x", ""],)], "tags array<string>")
    assert df.select(X.sanitize_tags(F.col("tags")).alias("t")).first().t == ["a_b", "üx"]


def test_chunks(spark):
    text = "INTRODUCTION\n" + "\n\n".join("This sentence has some words in it. " * 12 for _ in range(12)) + "\n\n- one\n- two\n\n1.1. Scope\nShort."
    chunks = X.chunk(text, target=200, overlap=20, most=300)
    assert [c["position"] for c in chunks] == list(range(len(chunks)))
    assert chunks[0]["title"] == "INTRODUCTION" and chunks[-1]["title"] == "1.1. Scope"
    assert all(c["tokens"] <= 300 for c in chunks) and any("- one\n- two" in c["text"] for c in chunks)
    assert X.chunk("") == [] and X.chunk(None) == []
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert X.chunk_text(df, target=200, overlap=20, most=300).count() == len(chunks)


def test_row_blocks_and_first_copies(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(65)], "n int, v string")
    blocks = X.chunk_rows(df, "n").orderBy("position").collect()
    assert [b.rows for b in blocks] == [30, 30, 5] and blocks[0].text.startswith("n\tv\n0\tv0\n")
    copies = spark.createDataFrame([("b", 0, "x"), ("a", 1, "x"), ("a", 0, "y")], "path string, position int, text string")
    assert {(r.path, r.position) for r in X.dedupe_chunks(copies).collect()} == {("a", 1), ("a", 0)}


def test_html_tables():
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1<td>2</tr></table><p><table><tr><td>x&amp;y</table>"
    assert parse_tables(html) == [[["A", "B"], ["1", "2"]], [["x&y"]]]
    assert parse_tables(None) == [] and parse_tables("<table><tr><td>") == [[[""]]]


def test_vector_search(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [2.0, 0.0])], "id int, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id int, query array<double>")
    got = [(r.query_id, r.id) for r in R.vector_topk(queries, index, 3).orderBy("query_id", "rank").collect()]
    assert got == [(9, 1), (9, 7), (9, 3)]


def test_similarities_and_fusion(spark):
    v = spark.createDataFrame([(1, "A", 0.1), (1, "B", 0.3)], "query_id int, id string, distance double")
    b = spark.createDataFrame([(1, "B", 4.0), (1, "C", 2.0)], "query_id int, id string, score double")
    assert {(r.id, r.similarity) for r in R.distance_to_similarity(v).collect()} == {("A", 1.0), ("B", 0.0)}
    assert [r.similarity for r in R.distance_to_similarity(v.where("id = 'A'")).collect()] == [1.0]
    assert [r.normalized for r in R.min_max(b.where("id = 'B'")).collect()] == [0.0]
    assert {r.id: round(r.score, 6) for r in R.fuse(v, b).collect()} == {"A": 0.6, "B": 0.4, "C": 0.2}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "cat sat mat"), (2, "dog"), (3, None), (None, "cat"), (4, "cat cat dog")], "id int, text string")
    asked = spark.createDataFrame([(1, "cat dog"), (2, "  "), (3, "zebra")], "query_id int, query string")
    got = [r.id for r in R.bm25(asked, docs).orderBy("rank").collect()]
    assert got[0] == 4 and set(got) == {1, 2, 4}
    assert [r.id for r in R.bm25(asked, docs, conjunctive=True).collect()] == [4]


def test_mmr_ties_go_to_the_lowest_index():
    assert R.mmr_order(np.array([1.0, 0.0]), np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), 2, 0.5) == [0, 1]
    assert R.mmr_order(np.array([1.0, 0.0]), np.array([[1.0, 0.0], [1.0, 0.0]]), 2, 0.0) == [0, 1]


def test_store(spark):
    old = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "collection string, id int, text string")
    new = spark.createDataFrame([("c", 2, "B"), ("c", 3, "C")], "collection string, id int, text string")
    assert {(r.id, r.text) for r in R.upsert(old, new).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert R.delete_by_ids(old, new).count() == 1 and R.resume(new, old).count() == 1


def test_evaluation(spark):
    rows = spark.createDataFrame([("what is net zero", "Net zero is a goal.", ["Net zero is a goal"], ["Net zero is a goal. Other words entirely"]), ("q", "", [], []), ("q", "x", None, None)], "question string, answer string, references array<string>, contexts array<string>")
    a, b, c = E.metrics(rows).collect()
    assert a.exact_match and a.ref_coverage == 1.0 and a.ans_supported_ratio == 1.0 and a.num_contexts == 1 and a.ctx_precision_like == 0.5
    assert not b.exact_match and b.ans_supported_ratio == 1.0 and b.ref_coverage == 0.0
    assert c.ans_supported_ratio == 0.0
    pair = spark.sql("select array() as a, array('x') as b")
    assert pair.select(R.jaccard(F.col("a").cast("array<string>"), F.col("a").cast("array<string>"))).first()[0] == 1.0
    assert pair.select(R.jaccard(F.col("a").cast("array<string>"), F.col("b"))).first()[0] == 0.0
    ten = spark.range(1, 11).withColumn("ms", F.col("id").cast("double"))
    got = E.latency(ten, [], "ms").first()
    assert (got.p50, got.p95) == (5.0, 10.0)
    assert {r.kind for r in E.first_answers(spark.createDataFrame([(1, "Margin was 40%. It cost $5 million. Nothing")], "doc_id int, text string")).collect()} == {"percent", "money", "number"}
