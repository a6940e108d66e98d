import random
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from millrace.llm import spiece
from millrace.llm.spiece import MODEL, Decoder, Encoder, Pieces, decode, digest, encode


@pytest.fixture(scope="module")
def bpe():
    data = open(MODEL, "rb").read()
    pieces = Pieces(data)
    return sentencepiece.SentencePieceProcessor(model_proto=data), Encoder(pieces), Decoder(pieces)


def unigram(fallback):
    """The same pieces read as a unigram model; nothing is trained."""
    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = fallback
    kept = [p for p in model.pieces if not (p.piece.startswith("▁▁")) and (fallback or p.type != 6)]
    del model.pieces[:]
    model.pieces.extend(kept)
    for k, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -float(np.float32(7 + (k * 7919 % 10007) / 1024))
    return model.SerializeToString()


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", " " * 37 + "x", "x" + " " * 11, "\n", "a\nb", "\n \n", "é̂ 你好 🎉", "▁a▁▁b", "<s></s><0x41>", "\x00\x1f", "a" * 700, "ab" * 300 + " " + "%" * 50]


def test_bpe_matches_the_library(bpe):
    theirs, ours, decoder = bpe
    rng = random.Random(7)
    texts = [*ODD, *("".join(rng.choice(["the", " ", "  ", "ing", "x", "é", "\n", "99", "ß", "ation", "’", "!", "aa", "鿿"]) for _ in range(rng.randint(0, 80))) for _ in range(400))]
    assert [i.tolist() for i in ours.encode(texts)] == theirs.encode(texts)
    assert [decoder.decode(i) for i in ours.encode(texts)] == [t.replace("▁", " ") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_bpe_matches_the_library_on_any_text(bpe, text):
    assert bpe[1].encode([text])[0].tolist() == bpe[0].encode(text)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_matches_the_library(fallback):
    data = unigram(fallback)
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=data), Encoder(Pieces(data))
    rng = random.Random(3)
    texts = ["the motion of nations", "", "a", "unrecognisable antidisestablishmentarianism", "x鿿鿿y", "a\nb"]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(20)) for _ in range(60)]
    assert [i.tolist() for i in ours.encode(texts)] == theirs.encode(texts)


def test_operators(spark, bpe):
    texts = [*ODD, None, "the same", "the same", "long " * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, ids string").repartition(4)
    coded = encode(df)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {**{i: bpe[0].encode(t or "") for i, t in enumerate(texts)}, None: bpe[0].encode("null id")}
    back = {r.doc_id: r.text for r in decode(coded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    rows = {r.doc_id: r for r in digest(df).collect()}
    assert all(rows[i].round_trip == ("▁" not in (t or "")) and rows[i].n_pieces == len(got[i]) for i, t in enumerate(texts))
    assert digest(df.limit(0)).count() == 0


def test_broken_ids_decode(bpe):
    first = [i for i in range(bpe[0].get_piece_size()) if bpe[0].id_to_piece(i) == "<0xE4>"]
    assert bpe[2].decode(np.array(first)) == "�"


def test_words_are_looked_up_in_short_runs(bpe, monkeypatch):
    theirs, ours, _ = bpe
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(500)]
    texts = ["", *(" ".join(rng.choices(words, k=300)) for _ in range(1200)), *ODD, " ".join(rng.choices(words, k=60_000)), "", ""]
    expected = ours.encode(texts)  # learns the words
    tracemalloc.start()
    found, ends = ours.flat(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, np.concatenate(expected)) and len(ends) == len(texts) and ends[-1] == len(found)
    # 2.3 million characters: their arrays took 106 MB when all were hashed at once
    assert peak < 60e6

    monkeypatch.setattr(spiece, "RUN_CHARS", 50)  # runs of one text and of several, new words in several runs
    assert [len(r) for r in spiece.text_runs(["", "a" * 60, "", "b" * 30, "c" * 30, ""], 50)] == [2, 2, 2] and list(spiece.text_runs([], 50)) == []
    ours.clear()
    some = texts[:40] + ODD
    assert [i.tolist() for i in ours.encode(some)] == theirs.encode(some)
    assert ours.encode(["", ""])[0].tolist() == [] and len(ours.flat([])[1]) == 0
