import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from millrace.llm.pii import KINDS, LABELS, Field, find, find_spans, labelled, luhn, patterns, redact, train, written

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keep(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if keep(k, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@pytest.fixture(scope="module")
def field():
    return train(labelled())


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_patterns_match_plain_regexes():
    rng = random.Random(2)
    alphabet = ["a", "Z", "1", "25", "256", "0", ".", "..", "-", "@", "@@", "+", " ", "(", ")", "_", "%", "é", "４", "\n", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "x.y@z.example.com"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert patterns(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "+1" * 100_000):
        patterns(text)


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(5)
    k = 4
    field = Field({}, np.zeros((1, k)), rng.normal(size=(k, k)))
    scores = rng.normal(size=(6, 5, k))
    for row, path in zip(scores, field.viterbi(scores)):
        def worth(p):
            return field.move[0, p[0]] + sum(row[i, p[i]] for i in range(5)) + sum(field.move[p[i], p[i + 1]] for i in range(4)) + field.move[p[4], 0]

        assert tuple(path) == max(itertools.product(range(k), repeat=5), key=worth)


def test_held_out_accuracy(field):
    right = total = 0
    for tokens, labels in labelled(seed=77, rows=250):
        path = field.viterbi(field.emit[field.codes([tokens], len(tokens))].sum(axis=2))[0]
        right += sum(LABELS[p] == x for p, x in zip(path, labels))
        total += len(labels)
    assert right / total > 0.97


def test_disguised_forms_are_found_and_clean_text_is_left_alone(field):
    text = "mail jo [at] mail [dot] example [dot] org, call (017) 555-7713 today, host 192[.]0[.]2[.]7 or pay 4111.1111.1111.1111 now"
    base, spans = find(field, [text])[0]
    assert base == [] and [k for k, _, _ in spans] == ["email", "phone", "ip", "card"]
    clean = ["Licensed under CC BY-NC 4.0.", "In 1999, 12.5 % of 3,400 (see pages 12-15) at 10:30 met.", 'token = "44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "ISBN 978-3-16-148410-1, 2024-01-31, 31/12/1999", "look at it dot dot dot", ""]
    assert all(spans == [] for _, spans in find(field, clean))


def test_find_spans(spark, field):
    texts = ["é x.y@z.example.com!", "", None, "ip 10.0.0.1 and 256.1.1.1", "+1 (017) 555-7713 4111111111111111", "(017) 555-7713"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a@b.c", "x"), (0, texts[0], "x")]
    got = find_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string"), field).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or "" if r.doc_id is not None else "a@b.c"
        base = brute(text)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(written(base).split(",")) - {""} <= set(r.spans.split(","))
    assert {r.spans for r in got if r.doc_id == 5} == {"phone:0:14"}
    assert find_spans(spark.createDataFrame([], "doc_id long, text string"), field).count() == 0


def test_redact(spark, field):
    df = spark.createDataFrame([(1, "to x.y@z.example.com, or +1 (017) 555-7713.", None), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in redact(df, field).collect()}
    assert got == {1: ("to [email], or [phone].", None), 2: (None, "k"), 3: ("clean", "k")}
