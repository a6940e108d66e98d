"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames; the spectrum of each is folded into
twelve pitch classes and normalised. Sixteen filters, differences of rectangle
sums over an integral image of the last frames, are quantised to two bits each
and packed into one 32-bit integer for every frame. Recordings that share
whole integers, or nearly, meet in an inverted index; the offset at which most of their
shared integers agree aligns them, and the share of differing bits over the
whole overlap at that offset decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, settle

RATE, FRAME, HOP = 5512, 1024, 256
LOW, HIGH = 55.0, 2200.0
SPAN = 12
#: Blocks of the index, at least; integers in a block, about; integers and meetings that a task has in hand at once.
BLOCKS, HELD, EVENTS = 32, 1 << 20, 1 << 21
FLIPS = np.array([0, *(1 << k for k in range(32))], np.int64)
#: Filters as (kind, first class, classes, frames): 1 halves by class, 2 halves by time, 3 quarters, 4 and 5 thirds.
FILTERS = [
    (1, 0, 6, 3),
    (2, 4, 4, 8),
    (3, 2, 6, 10),
    (1, 6, 4, 12),
    (2, 8, 3, 12),
    (3, 0, 12, 6),
    (4, 3, 9, 4),
    (5, 0, 12, 9),
    (1, 2, 8, 6),
    (2, 0, 12, 4),
    (3, 6, 4, 8),
    (4, 0, 6, 10),
    (5, 6, 6, 12),
    (1, 4, 8, 10),
    (2, 1, 6, 12),
    (3, 4, 8, 4),
]
CUTS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _folding() -> np.ndarray:
    """Bins of the spectrum to pitch classes."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12))
    inside = (hertz >= LOW) & (hertz <= HIGH)
    note = np.round(12 * np.log2(np.maximum(hertz, 1e-9) / 440.0)).astype(int) % 12
    out[np.flatnonzero(inside), note[inside]] = 1
    return out


FOLD, TAPER = _folding(), np.hanning(FRAME)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch classes of each frame of samples at ``RATE``, scaled to length one; silence is zero."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    for start in range(0, len(frames), 512):
        spectrum = np.abs(np.fft.rfft(frames[start : start + 512] * TAPER, axis=1)) ** 2
        out[start : start + 512] = np.sqrt(spectrum @ FOLD)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each position of the chroma image at which all filters fit."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return integral[at + t1, c1] - integral[at + t0, c1] - integral[at + t1, c0] + integral[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        c = min(c, 12 - h)
        if kind == 1:
            a, b = area(0, w, c, c + h // 2), area(0, w, c + h // 2, c + h)
        elif kind == 2:
            a, b = area(0, w // 2, c, c + h), area(w // 2, w, c, c + h)
        elif kind == 3:
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
            b = area(0, w, c, c + h) - a
        elif kind == 4:
            a = area(0, w, c + h // 3, c + 2 * h // 3)
            b = (area(0, w, c, c + h) - a) / 2
        else:
            a = area(w // 3, 2 * w // 3, c, c + h)
            b = (area(0, w, c, c + h) - a) / 2
        level = np.log1p(a) - np.log1p(b)
        out = out << np.uint32(2) | GRAY[np.searchsorted(CUTS, level)]
    return out


def render(vectors: np.ndarray, notes: int = 32, seconds: float = 0.14) -> np.ndarray:
    """A recording for each vector, as a stand-in where there are none: a chord of twelve tones for each pair of components.

    The tones of a chord are as loud as twelve successive components tell, so
    near vectors sound alike and others don't.
    """
    size = int(seconds * RATE)
    time = np.arange(size) / RATE
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    scaled = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0) * vectors.shape[1] ** 0.5
    heard = (np.arange(notes)[:, None] * 2 + np.arange(12) * 5) % vectors.shape[1]
    loud = np.exp(1.2 * np.clip(scaled[:, heard], -3, 3))
    tones = np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(12) / 12)[:, None] * time) * np.hanning(size)
    sound = loud / loud.sum(axis=2, keepdims=True) @ tones
    return (sound * 24000).astype(np.int16).reshape(len(vectors), -1)


def pcm_of(audio: bytes) -> np.ndarray:
    """Samples of 16-bit mono PCM, with or without a WAV header."""
    if audio[:4] == b"RIFF" and audio[8:12] == b"WAVE":
        at = 12
        while at + 8 <= len(audio):
            size = int.from_bytes(audio[at + 4 : at + 8], "little")
            if audio[at : at + 4] == b"data":
                audio = audio[at + 8 : at + 8 + size]
                break
            at += 8 + size + size % 2
        else:
            return np.empty(0, np.int16)
    return np.frombuffer(audio[: len(audio) // 2 * 2], "<i2")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(chroma(pcm_of(a.as_py() or b""))).astype(np.int64) for a in batch.column("audio")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], names=["id", "prints"])


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, prints array<long>) for every row of ``media(id, audio)``, 16-bit mono PCM at ``RATE``; null, empty and short audio has none."""
    return media.select(F.col("id").cast("long").alias("id"), "audio").mapInArrow(_prints, "id long, prints array<long>")


def render_embeddings(rows: DataFrame) -> DataFrame:
    """``fingerprints`` of the tunes of ``rows(vec_id, embedding)``, without the audio leaving the task that makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                vectors = [np.array([np.nan if x is None else x for x in v.as_py() or []] or [0.0] * 64, float) for v in part.column("embedding")]
                found = [fingerprint(chroma(render(np.nan_to_num(v, posinf=0, neginf=0)[None])[0])).astype(np.int64).tolist() if len(v) > 1 else [] for v in vectors]
                silent = [not np.isfinite(v).any() or not np.nan_to_num(v).any() for v in vectors]
                found = [[] if s else f for s, f in zip(silent, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "prints"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "id long, prints array<long>")


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of neighbours whose sizes sum up to ``most``; one that is larger is a run of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield slice(start, stop)
        start = stop


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges, the number of the range and the place of each element."""
    at = np.repeat(np.arange(len(size)), size)
    return at, np.arange(len(at)) + (start - (np.cumsum(size) - size))[at]


class _Prints:
    """Prints of several recordings, end to end."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.ids, self.sizes, self.flat = ids, sizes, flat
        self.starts = np.cumsum(sizes) - sizes

    def part(self, rows: slice) -> _Prints:
        size = self.sizes[rows]
        return _Prints(self.ids[rows], size, self.flat[self.starts[rows][0] : self.starts[rows][0] + size.sum()])

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recording, place, integer) where a run of equal integers begins."""
        row, place = _spread(np.zeros(len(self.sizes), np.int64), self.sizes)
        new = np.ones(len(self.flat), bool)
        new[1:] = (self.flat[1:] != self.flat[:-1]) | (place[1:] == 0)
        return row[new], place[new], self.flat[new]


class _Index:
    """Where each integer of some recordings is; ``ask`` aligns queries with all of them."""

    def __init__(self, held: _Prints):
        self.held = held
        row, place, value = held.firsts()
        order = np.argsort(value, kind="stable")
        self.row, self.place, self.value = row[order], place[order], value[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._slot(self.value)] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return ((value.view(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(42)).view(np.int64)

    def ask(self, asked: _Prints, agree: int, most_errors: float, least_overlap: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, recording, offset, overlap, differing bits) of the matches."""
        for rows in _pieces(asked.sizes * len(FLIPS), EVENTS):
            queries = asked.part(rows)
            q, at, value = queries.firsts()
            probes = (value[:, None] ^ FLIPS).ravel()
            some = np.flatnonzero(self.filter[self._slot(probes)])
            low, high = (np.searchsorted(self.value, probes[some], side=side) for side in ("left", "right"))
            q, at, n = q[some // len(FLIPS)], at[some // len(FLIPS)], high - low
            for here in _pieces(np.bincount(q, n, len(queries.ids)).astype(np.int64), EVENTS):
                these = slice(*np.searchsorted(q, (here.start, here.stop)))
                yield self._matches(queries, q[these], at[these], low[these], n[these], agree, most_errors, least_overlap)

    def _votes(self, queries: _Prints, q: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, recording, offset, votes); what a query meets is counted in parts, however much it is."""
        back = int(self.held.sizes.max(initial=0))
        span = back + int(queries.sizes.max(initial=0)) + 1
        keys, votes = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(n)
        for start in range(0, int(n.sum()), EVENTS):
            stop = min(start + EVENTS, int(ends[-1]))
            a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
            first = np.maximum(ends[a:b] - n[a:b], start)
            which, place = _spread(low[a:b] + first - (ends[a:b] - n[a:b]), np.minimum(ends[a:b], stop) - first)
            which += a
            other = self.row[place]
            key = (q[which] * len(self.held.ids) + other) * span + at[which] - self.place[place] + back
            found, count = np.unique(key[queries.ids[q[which]] != self.held.ids[other]], return_counts=True)
            if len(keys):
                found, where = np.unique(np.concatenate((keys, found)), return_inverse=True)
                count = np.bincount(where, np.concatenate((votes, count)), len(found)).astype(np.int64)
            keys, votes = found, count
        pair, offset = np.divmod(keys, span)
        return *np.divmod(pair, len(self.held.ids)), offset - back, votes

    def _matches(self, queries: _Prints, *asked) -> tuple[np.ndarray, ...]:
        *asked, agree, most_errors, least_overlap = asked
        q, row, offset, votes = self._votes(queries, *asked)
        order = np.lexsort((offset, -np.abs(offset), votes, row, q))
        best = order[np.append((q[order][1:] != q[order][:-1]) | (row[order][1:] != row[order][:-1]), True)] if len(order) else order
        best = best[votes[best] >= agree]
        q, row, offset = q[best], row[best], offset[best]
        start = np.maximum(offset, 0)
        overlap = np.minimum(queries.sizes[q], self.held.sizes[row] + offset) - start
        long = np.flatnonzero(overlap >= max(1, least_overlap))
        q, row, offset, start, overlap = (x[long] for x in (q, row, offset, start, overlap))
        wrong = np.zeros(len(q), np.int64)
        for here in _pieces(overlap, EVENTS):
            _, mine = _spread(queries.starts[q[here]] + start[here], overlap[here])
            _, theirs = _spread(self.held.starts[row[here]] + start[here] - offset[here], overlap[here])
            bits = np.bitwise_count((queries.flat[mine] ^ self.held.flat[theirs]).view(np.uint64))
            wrong[here] = np.add.reduceat(bits, np.cumsum(overlap[here]) - overlap[here], dtype=np.int64)
        keep = wrong / (32.0 * overlap) <= most_errors
        return queries.ids[q[keep]], self.held.ids[row[keep]], offset[keep], overlap[keep], wrong[keep]


def _search(*limits):
    """Queries against the recordings of their block: rows come by block, its recordings before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            blocks, asks = np.asarray(batch.column("block")), np.asarray(batch.column("asks"))
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                lists = part.column("prints")
                prints = np.asarray(part.column("class_id")), np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(lists.flatten())
                if blocks[a] != block:
                    block, held, index = blocks[a], [], None
                if not asks[a]:
                    held.append(prints)
                    continue
                if index is None and held:
                    index, held = _Index(_Prints(*(np.concatenate(x) for x in zip(*held, strict=True)))), []
                for found in index.ask(_Prints(*prints), *limits) if index else ():
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["q", "class_id", "offset", "overlap", "wrong"])

    return run, "q long, class_id long, offset long, overlap long, wrong long"


def align(prints: DataFrame, every: int = 20, agree: int = 1, most_errors: float = 0.15, least_overlap: int = 20) -> DataFrame:
    """Recordings aligned with the query recordings, of ``prints(id, prints)``; queries are the ids divisible by ``every``.

    Rows (id, class_id, match_id, offset, overlap, error): every recording has
    one row with its class, the smallest id of equal fingerprints, and null in
    the other columns; the class of a query has one more row for each other
    class that it matches: ``match_id``, the offset in frames (position here
    minus position there) with the most agreeing integers (those that differ in
    one bit at most), the integers that
    overlap there, and the share of their bits that differ, at most
    ``most_errors``. Copies are thus told by their classes and not as pairs.

    The index holds every integer, and a query asks for each of its own and for
    the 32 that differ from it in one bit; a candidate has at least ``agree``
    of them at its best offset (the tests measure the recall). The index lies
    in blocks of recordings, by a hash of their class, and every query is asked
    of every block; meetings, histograms of offsets and the comparison of whole
    overlaps stay in the task that holds the block, so rows are made of matches
    alone: a common integer is no hot key, and none is dropped. Recordings without
    prints are their own class and match nothing, a null id has a null class,
    repeated rows are copies, other columns are ignored, an empty table gives an
    empty result.
    """
    known = settle(prints.withColumn("key", F.when(F.size("prints") > 0, F.sha1(F.array_join(F.transform("prints", lambda x: x.cast("string")), ",")))), "prints")
    sound = known.where("key is not null and id is not null")
    classes = sound.groupBy("key").agg(F.min("id").alias("class_id"), F.max(F.when(F.pmod("id", F.lit(every)) == 0, 1).otherwise(0)).alias("asked"))
    full = known.join(classes, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    one = settle(sound.join(classes, "key").where("id = class_id").dropDuplicates(["class_id"]).select("class_id", "asked", "prints"), "classes")

    total = one.agg(F.sum(F.size("prints")).alias("n")).first().n or 0
    blocks = max(BLOCKS, -(-total // HELD))
    indexed = one.select(F.expr(f"cast(pmod(xxhash64(class_id), {blocks}) as int)").alias("block"), F.lit(False).alias("asks"), "class_id", "prints")
    queries = one.where("asked = 1").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "class_id", "prints")
    dealt = indexed.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(*_search(agree, most_errors, least_overlap)).withColumn("error", F.col("wrong") / (32.0 * F.col("overlap")))
    matches = found.select(F.col("q").alias("id"), F.col("q").alias("class_id"), F.col("class_id").alias("match_id"), F.col("offset").cast("int").alias("offset"), F.col("overlap").cast("int").alias("overlap"), F.round("error", 6).alias("error"))
    rows = full.select("id", "class_id", F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("overlap"), F.lit(None).cast("double").alias("error"))
    return rows.unionByName(matches)
