import base64
import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken

from millrace.llm.tokens import PATTERN, RANKS, attribute, count_tokens


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(encoding, text, rule):
    """Token by token and byte by byte."""
    data = text.encode()
    section, of = 0, []
    for k, b in enumerate(data):
        of.append(section)
        if b == 10:
            section += 1
    sections = (of[-1] if of else 0) + 1
    counts, at = defaultdict(int), 0
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        held = of[at : at + n]
        counts[{"start": held[0], "end": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]] += 1
        at += n
    return [counts[s] for s in range(sections)]


@pytest.mark.parametrize("rule", ["most", "start", "end"])
def test_sections_match_a_walk_over_bytes(spark, encoding, rule):
    rng = random.Random(6)
    texts = ["", None, "\n", "\n\n\n", "one line", "a\n\n\n  b\n", "é\nñ 你好\n🎉🎉\n\n", "x" * 20_000, "<|endoftext|>\n<|endoftext|>"]
    texts += ["".join(rng.choice(["word", " ", "\n", "\n\n", "\n \n", "é", "99", "。\n"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = defaultdict(dict)
    for r in count_tokens(df, rule=rule).collect():
        got[r.doc_id][r.section] = r
    for i, text in enumerate(texts):
        rows = [got[i][s] for s in range(len(got[i]))]
        assert [r.n_tokens for r in rows] == brute(encoding, text or "", rule)
        assert "".join((text or "")[r.start : r.end] for r in rows) == (text or "") and rows[0].start == 0
        assert {r.doc_tokens for r in rows} == {sum(r.n_tokens for r in rows)} == {len(encoding.encode_ordinary(text or ""))}


def test_rules_on_crossing_tokens():
    starts, cuts = np.array([0, 4, 5, 9, 12]), np.array([0, 2, 3, 6, 11])
    assert attribute(starts, cuts, "start").tolist() == [0, 2, 2, 3]
    assert attribute(starts, cuts, "end").tolist() == [2, 2, 3, 4]
    assert attribute(starts, cuts, "most").tolist() == [0, 2, 3, 3]


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b\nc"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.section, r.n_tokens) for r in count_tokens(df).collect()) == [("1", 0, 1), ("1", 0, 1), ("None", 0, 3), ("None", 1, 1)]
    assert count_tokens(df.limit(0)).count() == 0
