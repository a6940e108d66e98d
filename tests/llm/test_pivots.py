import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.pivots import fit_pivots, list_keys, near_duplicates, orders

SF = "/root/testdata/sf0.01/embeddings.parquet"


def brute(ids, vectors, least=0.95):
    """Links and components over rows; None stands for a vector that links with nothing."""
    good = [k for k, v in enumerate(vectors) if v is not None and ids[k] is not None]
    unit = np.array([np.array(vectors[k], float) / np.linalg.norm(vectors[k]) for k in good])
    linked = unit @ unit.T >= least
    links = {k: 0 for k in range(len(ids))}
    comp = {k: ids[k] for k in range(len(ids))}
    for a, k in enumerate(good):
        links[k] = int(linked[a].sum()) - 1
    moved = True
    while moved:
        moved = False
        for a, k in enumerate(good):
            low = min(comp[good[b]] for b in np.flatnonzero(linked[a]))
            if low < comp[k]:
                comp[k], moved = low, True
    return sorted(((ids[k], links[k], comp[k], None if ids[k] is None else ids[k] == comp[k]) for k in range(len(ids))), key=str)


def test_matches_brute_force_and_splits_long_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    rows = [centres[i % 60] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3]) for i in range(300)]
    rows += [centres[0] + rng.normal(size=16) * 0.05 for _ in range(200)] + [centres[1] * 3] * 20 + [centres[2] * s for s in (1.0, 1e-30, 1e30)]
    vectors = [r.astype(np.float32).astype(float).tolist() for r in rows]
    vectors = [v if np.isfinite(np.array(v, np.float32)).all() else None for v in vectors]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    ids = list(range(len(vectors))) + [9000 + k for k in range(len(odd))] + [None]
    everything = vectors + odd + [vectors[0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, everything)], "vec_id long, embedding array<float>, n_links int").repartition(5)
    want = brute(ids, vectors + [None] * (len(odd) + 1))
    for block in (1024, 64):
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, pivots=24, block=block).collect()), key=str)
        assert got == want


def test_whole_table(spark):
    ids, vectors = zip(*duckdb.connect().execute(f"select vec_id, embedding from '{SF}'").fetchall())
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.read.parquet(SF)).collect()), key=str)
    assert got == brute(list(ids), list(vectors))


@pytest.mark.parametrize("sf", ["check_s", "check_h"])
def test_recall(sf):
    import os

    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    rows = duckdb.connect().execute(f"select embedding from '{path + '/*.parquet' if os.path.isdir(path) else path}' limit 6000").fetchnumpy()["embedding"]
    x = np.stack([np.asarray(e, float) for e in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    keys = list_keys(orders(x, fit_pivots(x, 256), 5), 2)
    step = max(1, len(i) // 3000)
    met = [bool(set(keys[a]) & set(keys[b])) for a, b in zip(i[::step], j[::step])]
    assert np.mean(met) >= 0.97


def test_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (2, [1.0, 2.0]), (7, [2.0, -1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False), (7, 0, 7, True)]
    assert near_duplicates(df.limit(0)).count() == 0
    nothing = near_duplicates(df.withColumn("embedding", F.lit(None).cast("array<double>")))
    assert {r.n_links for r in nothing.collect()} == {0}


def test_rows_that_share_a_vec_id_and_vectors_of_other_lengths(spark):
    a, near_b, b = [1.0, 0.0, 0.1], [0.1, 1.0, 0.0], [0.11, 1.0, 0.01]
    rows = [(1, a), (1, b), (2, near_b), (3, [x * 1.01 + 0.01 for x in a]), (8, [1.0, 0.1]), (9, [1.0, 0.12]), (6, [0.0, -1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (6, 0, 6, True), (8, 1, 8, True), (9, 1, 8, False)]
