import io
import wave
from collections import Counter

import numpy as np

from millrace.llm.chroma import FRAME, HOP, RATE, SPAN, align, chroma, fingerprint, fingerprints, pcm_of, render


def tune(rng, seconds=12):
    notes = rng.integers(0, 36, (int(seconds / 0.2), 3))
    time = np.arange(int(0.2 * RATE)) / RATE
    sound = sum(np.sin(2 * np.pi * 110 * 2 ** (notes[:, k, None] / 12) * time) for k in range(3))
    return (sound * np.hanning(len(time)) * 8000).ravel()


def wav(pcm):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(pcm.astype("<i2").tobytes())
    return out.getvalue()


def errors(a, b):
    return np.unpackbits((a ^ b).view(np.uint8)).mean()


def test_fingerprints_are_robust_and_telling():
    rng = np.random.default_rng(1)
    a, b = tune(rng), tune(rng)
    noisy = a * 0.5 + rng.normal(size=len(a)) * 200
    fa, fb, fn = (fingerprint(chroma(x.astype(np.int16))) for x in (a, b, noisy))
    assert len(fa) == (len(a) - FRAME) // HOP + 1 - SPAN + 1
    assert errors(fa, fn) < 0.1 < 0.3 < errors(fa, fb)


def test_pitch_classes():
    time = np.arange(RATE) / RATE
    for semitone in range(12):
        image = chroma((np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * time) * 9000).astype(np.int16))
        assert (image.argmax(axis=1) == semitone).all()


def brute(prints, every=20, most=0.12, least=20):
    classes = {}
    for i in sorted(prints):
        classes.setdefault(prints[i].tobytes() or i, []).append(i)
    reps = [v[0] for v in classes.values() if len(prints[v[0]])]
    asked = {v[0] for v in classes.values() if any(i % every == 0 for i in v)}
    out = set()
    for q in asked & set(reps):
        for m in reps:
            if q != m:
                votes = Counter(a - b for a, x in enumerate(prints[q].tolist()) for b, y in enumerate(prints[m].tolist()) if x == y)
                if votes:
                    best = max(votes, key=lambda o: votes[o])
                    n = min(len(prints[q]), len(prints[m]) + best) - max(0, best)
                    if n >= least and errors(np.ascontiguousarray(prints[q][max(0, best) :][:n]), np.ascontiguousarray(prints[m][max(0, -best) :][:n])) <= most:
                        out.add((q, m))
    return out, {i: v[0] for v in classes.values() for i in v}


def test_alignment(spark):
    rng = np.random.default_rng(3)
    songs = [tune(rng) for _ in range(30)]
    media = {}
    for k in range(120):
        song = songs[k % 30]
        start = int(rng.integers(0, 8)) * HOP
        media[k] = (song[start:] * rng.uniform(0.4, 1) + rng.normal(size=len(song) - start) * rng.choice([0, 30, 100])).astype(np.int16)
    media[200], media[201], media[202] = media[20], np.zeros(RATE, np.int16), np.zeros(10, np.int16)
    rows = [(i, bytearray(wav(x) if i % 2 else x.astype("<i2").tobytes()), 1) for i, x in media.items()] + [(300, None, 1), (None, bytearray(b"x"), 1)]
    df = spark.createDataFrame(rows, "id long, audio binary, error int").repartition(4)
    prints = {i: fingerprint(chroma(x)) for i, x in media.items()} | {300: np.empty(0, np.uint32)}
    want, classes = brute(prints)
    got = align(fingerprints(df)).collect()
    assert {r.id: r.class_id for r in got if r.match_id is None and r.id is not None} == classes
    found = {(r.id, r.match_id) for r in got if r.match_id is not None}
    assert found <= want and len(found) >= 0.9 * len(want) > 10
    for r in got:
        if r.match_id is not None:
            assert r.error <= 0.12 and r.overlap >= 20
    assert align(fingerprints(df.limit(0))).count() == 0


def test_wav_and_odd_audio():
    pcm = np.arange(-500, 500, dtype=np.int16)
    assert (pcm_of(wav(pcm)) == pcm).all() and (pcm_of(pcm.astype("<i2").tobytes() + b"x") == pcm).all()
    assert len(pcm_of(b"RIFF\x00\x00\x00\x00WAVEjunk")) == 0 and len(pcm_of(b"")) == 0
    assert len(fingerprint(chroma(np.zeros(50, np.int16)))) == 0


def test_recall_on_rendered_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 64))
    y = x + rng.normal(size=x.shape) * 0.2
    a, b = ([fingerprint(chroma(p)) for p in render(v)] for v in (x, y))
    near = [(p, q) for p, q in zip(a, b) if errors(p, q) <= 0.12]
    assert len(near) > 50 and np.mean([bool(set(p.tolist()) & set(q.tolist())) for p, q in near]) >= 0.9


def test_alignment_against_all_pairs_and_offsets(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 64))
    vectors = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    prints = [fingerprint(chroma(p)) for p in render(vectors)]
    base = rng.integers(0, 2**32, 60, np.uint32)
    prints += [base, base ^ np.uint32(1 << 5)]  # no integer in common, one bit in each

    def best(p, q, least=20):
        out = 1.0
        for o in range(least - len(q), len(p) - least + 1):
            n = min(len(p), len(q) + o) - max(0, o)
            out = min(out, np.bitwise_count(p[max(0, o) :][:n] ^ q[max(0, -o) :][:n]).sum() / (32 * n))
        return out

    want = {(i, j) for i in range(len(prints)) for j in range(i) if best(prints[i], prints[j]) <= 0.15}
    rows = spark.createDataFrame([(i, [int(v) for v in p]) for i, p in enumerate(prints)], "id long, prints array<long>")
    found = {(r.id, r.match_id): r.error for r in align(rows, every=1).collect() if r.match_id is not None}
    assert all(found[p] <= 0.15 for p in found) and {(max(p), min(p)) for p in found} <= want
    hit = [p for p in want if p in found]
    print("recall over all pairs and offsets", len(hit), "of", len(want), "; exact integers", sum(bool(set(prints[i].tolist()) & set(prints[j].tolist())) for i, j in want))
    assert (81, 80) in found and len(want) > 30 and len(hit) >= 0.95 * len(want)


def most_rows(spark, run):
    """The most rows that a node of any plan made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, ends = 0, store.executionsList()
    for i in range(before, ends.size()):
        key = ends.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                if metrics.apply(k).name() == "number of output rows" and values.contains(metrics.apply(k).accumulatorId()):
                    most = max(most, int(values.apply(metrics.apply(k).accumulatorId()).replace(",", "")))
    return most


def test_rows_are_made_of_matches_and_not_of_candidates(spark):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**32, (400, 30))
    prints[:, 7] = 12345  # all share an integer, and nothing else
    rows = spark.createDataFrame([(i, [int(v) for v in p]) for i, p in enumerate(prints)], "id long, prints array<long>")
    found = []
    most = most_rows(spark, lambda: found.extend(align(rows, every=2).collect()))
    assert len(found) == 400 and all(r.match_id is None for r in found)
    assert most <= 400 + 200 * 32  # recordings, and each query in each block


def test_search_counted_in_small_parts(monkeypatch):
    import pyarrow as pa

    from millrace.llm import chroma as module

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**32, 40)
    prints = [np.concatenate([rng.integers(0, 2**32, int(rng.integers(0, 9))), base ^ (1 << rng.integers(0, 32, 40)) * rng.integers(0, 2, 40)]) for _ in range(25)] + [rng.integers(0, 3, 50) for _ in range(15)]
    ids, asks = np.arange(len(prints)), np.arange(0, len(prints), 3)
    rows = [*((0, False, int(i)) for i in ids), *((0, True, int(i)) for i in asks), *((1, True, int(i)) for i in asks)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part]), pa.array([prints[r[2]].tolist() for r in part], pa.list_(pa.int64()))], names=["block", "asks", "class_id", "prints"]) for part in (rows[:17], rows[17:41], rows[41:])]

    def found():
        return sorted(tuple(r.values()) for b in module._search(1, 0.15, 20)[0](iter(batches)) for r in b.to_pylist())

    want = []
    for q in asks.tolist():
        for m in ids.tolist():
            heads = [[(at, v) for at, v in enumerate(prints[i].tolist()) if not at or prints[i][at - 1] != v] for i in (q, m)]
            votes = Counter(a - b for a, x in heads[0] for b, y in heads[1] if (x ^ y).bit_count() <= 1)
            if q != m and votes:
                o = max(votes, key=lambda o: (votes[o], -abs(o), o))
                n = min(len(prints[q]), len(prints[m]) + o) - max(0, o)
                wrong = sum((x ^ y).bit_count() for x, y in zip(prints[q][max(0, o) :].tolist(), prints[m][max(0, -o) :].tolist()))
                if n >= 20 and wrong / (32 * n) <= 0.15:
                    want.append((q, m, o, n, wrong))
    assert len(want) > 100 and found() == sorted(want)
    monkeypatch.setattr(module, "EVENTS", 7)
    assert found() == sorted(want)
