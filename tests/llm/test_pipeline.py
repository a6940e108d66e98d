import random

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from millrace.llm.spiece import MODEL


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = {"en": ["the", "of", "and", "motion", "with"], "fr": ["le", "que", "être", "nation", "avec"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(rng.randint(1, 120)))
        rows.append((i, text, lang, rng.choice(["a", "a", "b", "c"]), len(text)))
    rows += [(300 + k, rows[k][1].replace("the", "THE", 1), *rows[k][2:]) for k in range(20)]
    rows += [(400, "12 34 56", None, "a", 8), (401, "", None, "b", 0), (402, None, None, None, None), (403, "write to x.y@z.example.com and le", "fr", "b", 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages(spark, docs):
    before = {r.doc_id: r for r in docs.collect()}
    kept = pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(before) - ids == {400, 401, 402}
    single = pipeline.near_duplicates(spark, kept, "")
    left = {r.doc_id for r in single.collect()}
    assert left == {i for i, (_, c) in brute5([(i, before[i].text) for i in sorted(ids)]).items() if i == c}
    masked = pipeline.personal_data(spark, single, "")
    texts = {r.doc_id: r for r in masked.collect()}
    assert set(texts) == left and texts[403].text == "write to [email] and le" and texts[403].n_chars == 23
    assert all(texts[i].text == before[i].text for i in left - {403})
    mixed = pipeline.mixture(spark, masked, "")
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id].text
    assert set(copies.values()) <= {1, 2}
    coded = pipeline.sentencepiece(spark, mixed, "").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted((r.doc_id, list(r.ids), r.n_pieces) for r in coded) == sorted((i, ids := model.encode(texts[i].text), len(ids)) for i, n in copies.items() for _ in range(n))


def test_rows_with_null_repeated_and_blank_keys(spark):
    word = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, "the motion of and with " + word(k), "en", "a", 0) for k in range(30)] + [
        (40, "12 34", None, "a", 0), (40, "the nation " + word(40), "en", "a", 0),  # one id, one row rejected
        (None, "12 34", None, "a", 0), (None, "the nation " + word(41), "en", "a", 0),
        (42, "", "en", "a", 0), (43, None, "en", "a", 0),
    ]
    kept = pipeline.language_id(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(map(str, kept)) == sorted(map(str, (r for r in spark.createDataFrame(rows, schema).collect() if r.text != "12 34")))

    near = [(None, word(1), "en", "a", 0), (5, word(1), "en", "a", 1), (5, word(1), "en", "a", 2), (3, word(1) + " tail", "en", "a", 3), (5, word(2), "en", "a", 4), (None, word(3), "en", "a", 5), (None, word(3), "en", "a", 5), (6, "", "en", "a", 6), (6, "", "en", "a", 7)]
    left = pipeline.near_duplicates(spark, spark.createDataFrame(near, schema), "").collect()
    assert sorted(r.n_chars for r in left) == [3, 4, 5, 6, 7]

    mixed = [(None, word(k), "en", "a", k) for k in range(4)] + [(9, word(4), "en", "a", 4), (9, word(5), "en", "a", 5), (7, "", "en", "a", 6), (8, None, "en", "a", 7)]
    got = pipeline.mixture(spark, spark.createDataFrame(mixed, schema), "").collect()
    assert {r.n_chars for r in got} == {0, 1, 2, 3, 4, 5} and all(r.text == word(r.n_chars) for r in got)
    assert 8 <= len(got) <= 10  # 1.5 times as many words


def brute5(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    comp = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], moved = comp[b], True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_pieces", "ids"] and out.count() > 100


def test_stages_of_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, row_number int, copies int, _copy string, size string, node int"
    long = "the motion of and with " * 20_000
    rows = [(1, "the motion of and with", "en", "a", 5, "x", 3, 9, "y", "z", 0), (1, "the motion of and with", "en", "a", 5, "x", 3, 9, "y", "z", 0), (2, long, "en", None, 5, None, None, None, None, None, None), (None, None, "en", None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} == ({1, 2} if name == "mixture" else {1, 2, None}), name
    assert pipeline.sentencepiece(spark, docs.limit(0), "").count() == 0
