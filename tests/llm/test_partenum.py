import random

import pytest

from millrace.llm.partenum import Bands, apart, jaccard_components, sketch
from millrace.llm.common import shingle_sets, utf8
import numpy as np
import pyarrow as pa


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, num=9, den=10):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice("uvwxyz") * rng.randint(1, 9)
        yield " ".join(words)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = []
    for size, n, edits in ((5, 4, 1), (12, 6, 2), (40, 30, 3), (150, 60, 9), (150, 40, 3), (900, 12, 40), (3000, 4, 60)):
        base = " ".join(rng.choice(vocabulary) for _ in range(size))
        texts += [*family(rng, base, n, edits), base.upper(), base.replace(" ", " \n\t"), base]
    texts += ["", None, "  \n", "one", "ONE", "one two", "one  two", "\x1f one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute(rows)


def test_empty_table_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, "a b c d"), (3, "a b c d"), (1, "A b c D"), (None, "a b c d"), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, None), (9, 0, 9)], key=str)


def test_a_null_id_before_its_twin_takes_no_links(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text), (4, text + " tail"), (None, text + " tail")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str)
    assert got == sorted([(None, None), (7, 4), (4, 4), (None, None)], key=str)


def similar(rng, n, num, den):
    """Two random sets, the first of n elements, that are just similar enough."""
    a = rng.integers(0, 2**64, n, np.uint64)
    out = int(rng.integers(0, n * (den - num) // den + 1))
    inn = (den * (n - out)) // num - n
    return (np.sort(a), np.sort(np.concatenate([a[out:], rng.integers(0, 2**64, inn, np.uint64)]))) if inn >= 0 else similar(rng, n, num, den)


@pytest.mark.parametrize("num", [9, 8])
def test_signatures_cover_every_similar_pair(num):
    rng = np.random.default_rng(2)
    bands = Bands(num, 10)
    for n in (1, 2, 9, 10, 13, 19, 30, 57, 111, 240, 700, 2500):
        for _ in range(12):
            a, b = similar(rng, n, num, 10)
            assert set(bands.signatures(a).tolist()) & set(bands.signatures(b).tolist())
            assert apart(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("num", [9, 8])
def test_similar_pairs_meet_whatever_cells_are_common(num):
    """Counts of cells are made up, as a hostile corpus would: most cells of a pair are held by many others."""
    rng = np.random.default_rng(3)
    bands = Bands(num, 10)
    for n in (28, 40, 90, 250, 900):
        for _ in range(15):
            keys, spares = [], []
            for items in similar(rng, n, num, 10):
                keys.append(bands.sign(items))
                spares.append(bands.spare(items))
            counts = {k: int(rng.choice([2, 2, 50, 3000])) for k in np.concatenate(keys).tolist()}
            found = []
            for k, s in zip(keys, spares):
                k = k[np.isin(k, keys[0]) & np.isin(k, keys[1]) | (rng.random(len(k)) < 0.5)]  # the others: shared with further sets, or with none
                found.append(set(bands.subsets(np.zeros(len(k), np.int64), k, np.array([counts[x] for x in k.tolist()]), [s])[1].tolist()))
            assert found[0] & found[1]


def test_rows_that_share_a_doc_id_link_each_by_its_own_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " tail"), (4, "else"), (None, a)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, None)], key=str)


def test_shingle_counts_on_odd_texts():
    texts = ["", "a", "a b", "a b c", "a b c a b c", "x\x0by\x0cz", "é è ê ë", "a b c d", " lead and trail ", None, "q" * 50_000 + " b c d"]
    got = [len(s) for s in shingle_sets(*utf8(pa.array(texts, pa.string())), 3)]
    assert got == [len(shingles(t)) for t in texts]


def test_cells_are_taken_in_runs_and_none_is_lost(monkeypatch):
    from millrace.llm import partenum

    rng = random.Random(4)
    bands = partenum.Bands(8, 10)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in [1, 2, 40, 3000, 5, 700, 60, 4, 900, 2500] * 3]
    keys = [np.unique(bands.sign(x)).view(np.int64).tolist() for x in sets]
    kind = pa.struct([("key", pa.int64()), ("n", pa.int64())])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sets)), pa.int64()), pa.array([[{"key": k, "n": 2} for k in x] for x in keys], pa.list_(kind)), pa.array([len(x) for x in sets], pa.int64()), pa.array([bands.spare(x) for x in sets], pa.list_(pa.int64()))],
        names=["node", "cells", "n", "spare"],
    )
    runs = [len(r) for r in partenum._runs(iter([batch, batch.slice(3, 9), batch.slice(0, 0)]), "cells", 500)]
    assert sum(runs) == len(sets) + 9 and min(runs) == 1 < max(runs)

    def rows(most):
        monkeypatch.setattr(partenum, "RUN_CELLS", most)
        run, _ = partenum._subsets(bands)
        found = list(run(iter([batch])))
        return sorted(r for b in found for r in zip(*(b.column(c).to_pylist() for c in ("node", "sig", "n")), strict=True)), len(found)

    (one, whole), (many, cut) = rows(1 << 40), rows(500)
    assert one == many and whole == 1 < cut
