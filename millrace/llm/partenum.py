"""N-gram Jaccard self-join by PartEnum signatures.

Documents are sets of word shingles. Sizes fall into bands; within a band two
sets of the wanted similarity differ in at most k elements. The feature domain
(64-bit shingle hashes) is cut into n1 first-level partitions and each of them
into n2 second-level ones, cells. Every subset of r cells of a first-level
partition is a signature. Cells in which two sets differ, at most k, cannot fill
n1 partitions to n2 - r + 1 cells each if k < n1 * (n2 - r + 1): one partition
is left where r cells agree, and the sets share that subset's signature. Sets
that share none cannot be linked, so no link is lost.

Bands of up to ``SMALL`` differences have one first-level partition of k + 3
cells, and all its subsets of three are written. In larger bands subsets are of
two cells, and they are enumerated only where they can be shared:

* The cells alone are counted first, by key. A cell that no other set has agrees
  with nothing, and no subset with it is written.
* Cells that two sets both leave empty, and cells that either leaves out, count
  as differences too. A set with m non-empty cells may thus leave out any
  x = m - k - n1 - 1 of them, and leaves out those that most sets have: all
  above the largest count t that at most x exceed. Of two sets let t be the
  smaller one; the set that it belongs to has at most x agreeing cells above
  it, so both sign enough of the others. Cells of passages and lines that many
  documents repeat go, where a document has enough of its own beside them.
* A set with too few non-empty cells for that writes its empty ones as well and
  leaves out none.

Shared signatures give candidates. Each set has a sketch of one to two parity
bits a shingle: the bits in which two sketches differ are a lower bound of the
difference of the sets, compared before any text is read; only pairs that pass
it are verified, on whole texts. Candidates are drawn in two passes (each node
of a bucket with the least one and with one that comes first in one of a few
pseudo-random orders; then all pairs of a bucket that lie in different
components), so a group of copies costs a few stars and not a clique, while no
link between components is missed: after the last pass every pair of a bucket
is either in one component or was compared.

A node is a distinct set, whatever rows hold it; its key is a hash of the set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, components, join_split, mix64, shingle_sets, sieve, slices, tidy, utf8

SMALL = 6
CELLS = 1.6
GROUP = 8
SEEN = 200_000
# Bytes of text, bytes of packed text and cells that a worker has at work at once; its arrays are many times as large.
TEXT_BYTES = 1_000_000
PACKED_BYTES = 250_000
RUN_CELLS = 1 << 17
ORDERS = 8
LEAST_BITS = 512
PARITY = [f"p{j}" for j in range(LEAST_BITS // 64)]


class Bands:
    """Size bands for a similarity of at least ``num / den``; a band's highest size is about 1.5 times its lowest.

    A pair belongs to the band of its smaller set, so a set signs its own band
    and the band below if a set there can still be similar to it.
    """

    def __init__(self, num: int = 9, den: int = 10):
        self.ratio = Fraction(num, den)
        self.power = max(1, round(log(1.5) / -log(num / den))) if num < den else 1

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, upto: int) -> np.ndarray:
        low = [1]
        while low[-1] <= upto:
            low.append(int(low[-1] / self.ratio**self.power) + 1)
        return np.array(low)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges(1 << max(10, size.bit_length())), size, side="right")) - 1

    def of(self, size: int) -> list[int]:
        least = -int(-size * self.ratio // 1)
        return list(range(self.band(max(1, least)), self.band(size) + 1))

    def differ(self, a: int, b: int) -> int:
        """The most elements in which similar sets of a and b elements can differ: a + b - 2 * ceil(r (a + b) / (1 + r))."""
        shared = -int(-self.ratio * (a + b) / (1 + self.ratio) // 1)
        return max(0, a + b - 2 * shared)

    @lru_cache(maxsize=None)  # noqa: B019
    def shape(self, band: int) -> tuple[int, int, int, int]:
        """(first-level partitions, cells of each, cells of a subset, differences)."""
        edges = self.edges(1 << 10)
        while len(edges) < band + 2:
            edges = self.edges(2 * int(edges[-1]))
        high = int(edges[band + 1]) - 1
        k = 0
        for a in (high, high - 1):  # the largest difference of a pair whose smaller set has a elements
            if a >= 1:
                b = int(a / self.ratio)
                k = max(k, *(self.differ(a, c) for c in range(max(a, b - 2), b + 1)))
        if k <= SMALL:
            return 1, k + 3, 3, k
        cells = ceil(CELLS * k + 4 * sqrt(k))
        n1 = max(1, cells // GROUP)
        return n1, ceil(cells / n1), 2, k

    def _cut(self, items: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where the cells of a band begin and end in a sorted set, those to be written, and how many of them may be left out."""
        n1, n2, _, k = self.shape(band)
        cuts = (np.arange(n1 * n2 + 1, dtype=np.float64) * (2.0**64 / (n1 * n2))).clip(max=2.0**64 - 2048).astype(U64)
        at = np.searchsorted(items, cuts)
        at[0], at[-1] = 0, len(items)
        full = at[1:] > at[:-1]
        left = int(full.sum()) - k - n1 - 1
        return (at, full, left) if left >= 0 else (at, np.ones(n1 * n2, bool), 0)

    def spare(self, items: np.ndarray) -> list[int]:
        """For each larger band that a set signs, how many of its cells it may leave out."""
        return [band << 32 | self._cut(items, band)[2] for band in self.of(len(items)) if self.shape(band)[2] == 2]

    def sign(self, items: np.ndarray) -> np.ndarray:
        """Keys of one sorted set of hashes.

        A key above 2^63 is a whole signature, one below a cell: six bits of
        the band, 25 of the cell's place and 32 of its content.
        """
        keys = []
        mixed = np.zeros(len(items) + 1, U64)
        np.cumsum(mix64(items ^ U64(0xA5A5A5A5A5A5A5A5)), out=mixed[1:])
        for band in self.of(len(items)):
            _, n2, r, _ = self.shape(band)
            at, full, _ = self._cut(items, band)
            part = mixed[at[1:]] - mixed[at[:-1]]
            if r == 3:
                chosen = np.array(list(combinations(range(n2), r)))
                value = np.arange(len(chosen), dtype=U64) + U64(band * 0x9E3779B97F4A7C15 % 2**64)
                for j in chosen.T:
                    value = mix64(value ^ (part[j] + j.astype(U64) + U64(1)))
                keys.append(value | U64(1 << 63))
                continue
            place = np.arange(len(part), dtype=U64)
            content = mix64(part + place * U64(0x9E3779B97F4A7C15)) >> U64(32)
            keys.append(((U64(band & 63) << U64(57)) | (place << U64(32)) | content)[full])
        return np.concatenate(keys)

    def subsets(self, at: np.ndarray, keys: np.ndarray, counts: np.ndarray, spares: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of sets (rows ``at``) from their shared keys and how often each is held: (row, signature)."""
        whole = keys >> U64(63) == 1
        rows, out = [at[whole]], [keys[whole]]
        at, keys, counts = at[~whole], keys[~whole], counts[~whole]
        band = (keys >> U64(57)).astype(np.int64)
        allowed = {(i, s >> 32 & 63): s & 0xFFFFFFFF for i, found in enumerate(spares) for s in found}
        order = np.lexsort((keys, -counts, band, at))
        at, keys, counts, band = at[order], keys[order], counts[order], band[order]
        group = at * 64 + band
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
        length = np.diff(np.append(start, len(group)))
        spare = np.array([allowed[int(g) >> 6, int(g) & 63] for g in group[start]], np.int64)
        limit = np.where(spare < length, counts[np.minimum(start + spare, len(counts) - 1)], 0) if len(group) else spare
        kept = counts <= np.repeat(limit, length)
        at, keys, band = at[kept], keys[kept], band[kept]
        order = np.lexsort((keys, at))
        at, keys, band = at[order], keys[order], band[order]
        n2 = np.array([self.shape(b)[1] for b in range(64)] if len(band) else [1] * 64)[band]
        part = (keys >> U64(32) & U64((1 << 25) - 1)).astype(np.int64) // n2
        for step in range(1, int(n2.max(initial=1))):
            i = np.arange(len(at) - step)
            i = i[(at[i] == at[i + step]) & (band[i] == band[i + step]) & (part[i] == part[i + step])]
            if not len(i):
                break
            rows.append(at[i])
            out.append(mix64(keys[i] ^ mix64(keys[i + step])) | U64(1 << 63))
        return np.concatenate(rows), np.concatenate(out)

    def signatures(self, items: np.ndarray) -> np.ndarray:
        """All signatures of one set, as if each of its cells were shared and none left out."""
        keys = self.sign(items)
        return self.subsets(np.zeros(len(keys), np.int64), keys, np.ones(len(keys), np.int64), [self.spare(items)])[1]


def sketch(items: np.ndarray) -> bytes:
    """One to two parity bits an element and ``LEAST_BITS`` at least, a power of two; halves of a longer sketch fold onto a shorter one."""
    bits = max(LEAST_BITS, 2 << (len(items).bit_length() - 1))
    odd = np.bincount((items >> U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(x: bytes) -> list[int]:
    """A sketch folded to ``LEAST_BITS``, as whole numbers of 64 bits."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, LEAST_BITS // 64), axis=0).tolist()


def apart(x: bytes, y: bytes) -> int:
    """The bits in which two sketches differ: at most the elements in which their sets do."""
    if len(x) < len(y):
        x, y = y, x
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def _hashes(sets: list[np.ndarray], seed: int) -> np.ndarray:
    return np.array([mix64(x ^ U64(seed)).sum(dtype=U64) for x in sets], U64).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int, strangers: frozenset) -> Iterator[tuple]:
    """(batch, sets, node keys, second hashes, rows with a doc_id whose set this task has not met lately)."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES):
            sets = shingle_sets(*utf8(batch.column("text")), width)
            h2 = _hashes(sets, 0x5851F42D4C957F2D)
            node = _hashes(sets, 0)
            if strangers:
                node = np.array([b if (a, b) in strangers else a for a, b in zip(node.tolist(), h2.tolist(), strict=True)], np.int64)
            fresh = []
            named = batch.column("doc_id").is_valid().to_pylist()
            for i, key in enumerate(node.tolist()):
                if named[i] and len(sets[i]) and key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    fresh.append(i)
            yield batch, sets, node, h2, fresh


def _describe(bands: Bands, width: int, kind: str):
    """Every row with its set's size, key and second hash; the sketch and the spare cells once for a set in a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, node, h2, fresh in _sets(batches, width, frozenset()):
            drawn, spare = [None] * len(sets), [None] * len(sets)
            for i in fresh:
                drawn[i], spare[i] = sketch(sets[i]), bands.spare(sets[i])
            folded = list(zip(*(fold(x) if x else [None] * len(PARITY) for x in drawn), strict=True)) or [[]] * len(PARITY)
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(node), pa.array(h2), pa.array(drawn, pa.binary()), pa.array(spare, pa.list_(pa.int64())), *(pa.array(p, pa.int64()) for p in folded)],
                names=["doc_id", "n_shingles", "node", "h2", "sketch", "spare", *PARITY],
            )

    return run, f"doc_id {kind}, n_shingles long, node long, h2 long, sketch binary, spare array<long>, " + ", ".join(f"{p} long" for p in PARITY)


def _cells(bands: Bands, width: int, strangers: frozenset):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, node, _, fresh in _sets(batches, width, strangers):
            keys = [bands.sign(sets[i]) for i in fresh]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(node[fresh], [len(k) for k in keys]))], names=["key", "node"])

    return run, "key long, node long"


def _runs(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut into runs of rows of about ``most`` items in the lists of ``column``."""
    for batch in batches:
        ends, start = np.cumsum(np.asarray(batch.column(column).value_lengths(), np.int64)), 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _subsets(bands: Bands):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "cells", RUN_CELLS):
            cells = batch.column("cells")
            flat = cells.flatten()
            at = np.repeat(np.arange(len(batch)), np.asarray(cells.value_lengths()))
            keys, counts = np.asarray(flat.field("key")).view(U64), np.asarray(flat.field("n"))
            order = np.lexsort((keys, at))  # a set that several tasks wrote has its keys once
            once = order[np.flatnonzero(np.concatenate(([True], (at[order][1:] != at[order][:-1]) | (keys[order][1:] != keys[order][:-1]))))] if len(order) else order
            rows, sigs = bands.subsets(at[once], keys[once], counts[once], batch.column("spare").to_pylist())
            for start in range(0, len(rows), 1 << 20):
                here = slice(start, start + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(sigs[here].view(np.int64)), pa.array(np.asarray(batch.column("node"))[rows[here]]), pa.array(np.asarray(batch.column("n"))[rows[here]])], names=["sig", "node", "n"])

    return run, "sig long, node long, n long"


def _near(num: int, den: int):
    """Pairs whose sketches do not prove that they differ in too much: |xy| >= num (nx + ny) / (num + den)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))
            keep = [(num + den) * apart(x, y) <= (den - num) * (a + b) for a, b, x, y in zip(*cols, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, "a long, b long"


def _texts(width: int, strangers: frozenset):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, node, _, fresh in _sets(batches, width, strangers):
            texts = batch.column("text").take(pa.array(fresh, pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), pa.array([zlib.compress(t.encode(), 1) for t in texts], pa.binary())], names=["node", "text"])

    return run, "node long, text binary"


def _verify(num: int, den: int, width: int):
    def unpack(values: list[bytes]) -> list[np.ndarray]:
        return shingle_sets(*utf8(pa.array([zlib.decompress(v).decode() for v in values], pa.large_string())), width)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ta", PACKED_BYTES):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                ends = dict(zip(a, batch.column("ta").to_pylist(), strict=True)) | dict(zip(b, batch.column("tb").to_pylist(), strict=True))
                last = dict(zip(ends, unpack(list(ends.values())), strict=True))
                keep = []
                for i, j in zip(a, b, strict=True):
                    shared = len(np.intersect1d(last[i], last[j], assume_unique=True))
                    keep.append(shared > 0 and den * shared >= num * (len(last[i]) + len(last[j]) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, "a long, b long"


def jaccard_components(docs: DataFrame, num: int = 9, den: int = 10, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; two documents link
    when ``den * |intersection| >= num * |union|`` of their distinct
    ``width``-word shingles, and ``component_id`` is the smallest doc_id that
    links reach. Texts of fewer words have one shingle, their whole sequence.

    Null, empty and blank texts have no shingles and are their own component.
    A null doc_id keeps its row with a null component_id and links nothing.
    Repeated rows are returned as often as they occur; rows of one doc_id with
    different texts are documents of their own, each linked by its own text.
    Other columns of ``docs``, whatever their names, are ignored. An empty table
    gives an empty result. Texts are processed whole. A doc_id is a whole number
    or a struct, which orders by its fields.
    """
    spark = docs.sparkSession
    given = docs.schema["doc_id"].dataType
    kind = given.simpleString() if given.typeName() == "struct" else "long"
    texts = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.where("doc_id is not null and text is not null")
    bands = Bands(num, den)
    with Scratch(spark) as scratch:
        known = scratch.keep(texts.mapInArrow(*_describe(bands, width, kind)), "sets", stays=True)
        # Two sets with one key (of 64 bits; about one in 10^10 sets): all but the first are keyed by their second hash.
        sound = known.where("n_shingles > 0 and doc_id is not null")
        same = sound.groupBy("node").agg(F.min("h2").alias("h2"), F.max("h2").alias("hi")).where("h2 < hi").select("node", F.col("h2").alias("first"))
        first = {r.node: r.first for r in same.collect()}
        odd = sound.where(F.col("node").isin(list(first))).select("node", "h2").distinct().collect() if first else []
        odd = [r for r in odd if r.h2 != first[r.node]]
        strangers = frozenset((r.node, r.h2) for r in odd)
        if strangers:
            moved = F.when(F.struct("node", "h2").isin([F.struct(F.lit(a), F.lit(b)) for a, b in strangers]), F.col("h2")).otherwise(F.col("node"))
            known = known.withColumn("node", moved)
            sound = known.where("n_shingles > 0 and doc_id is not null")
        facts = scratch.keep(sound.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch", True).alias("sketch"), F.first("spare", True).alias("spare"), F.min("doc_id").alias("least"), F.count("*").alias("size"), *(F.first(p, True).alias(p) for p in PARITY)), "facts")

        # Keys that several sets have, with how many; a key streams through a spillable sort.
        by_key = Window.partitionBy("key")
        held = signed.mapInArrow(*_cells(bands, width, strangers)).withColumn("lo", F.min("node").over(by_key)).withColumn("hi", F.max("node").over(by_key)).withColumn("n", F.count("*").over(by_key))
        cells = scratch.keep(held.where("lo < hi").groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("cells")), "cells")
        by_sig = Window.partitionBy("sig")
        placed = cells.join(facts.select("node", "n", "spare"), "node").mapInArrow(*_subsets(bands))
        order = F.xxhash64(F.pmod("sig", F.lit(ORDERS).cast("long")), "node")
        bucket = placed.withColumn("hub", F.min("node").over(by_sig)).withColumn("hi", F.max("node").over(by_sig)).withColumn("other", F.min_by("node", order).over(by_sig))
        bucket = scratch.keep(bucket.where("hub < hi").drop("hi"), "buckets")
        scratch.drop(cells)

        def near(pairs: DataFrame) -> DataFrame:
            """Pairs (a, b) that sketches do not tell apart."""
            ends = facts.select("node", "n", "sketch")
            left = pairs.join(ends.toDF("a", "na", "sa"), "a")
            return left.join(ends.toDF("b", "nb", "sb"), "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)").mapInArrow(*_near(num, den))

        def across(comp: DataFrame, inside: DataFrame | None = None) -> DataFrame:
            """Pairs of a bucket that ``comp`` has apart (and ``inside`` together); buckets of one component are left out first.

            Sizes and folded sketches are compared where the pair meets, so a
            pair that they tell apart is no row.
            """
            rows = bucket.select("sig", F.col("node").alias("id"), "n").join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
            if inside is not None:
                rows = rows.join(inside.withColumnRenamed("component", "w"), "id")
            by = ["sig"] + (["w"] if inside is not None else [])
            mixed = Window.partitionBy(*by)
            rows = rows.withColumn("lo", F.min("c").over(mixed)).withColumn("hi", F.max("c").over(mixed)).where("lo < hi").select(*by, "id", "c", "n")
            rows = rows.join(facts.select(F.col("node").alias("id"), *PARITY), "id").select(*by, "id", "c", "n", *PARITY)
            x, y = (rows.toDF(*by, end, *(f"{side}_{c}" for c in ("c", "n", *PARITY))) for end, side in (("a", "x"), ("b", "y")))
            odd = " + ".join(f"bit_count(x_{p} ^ y_{p})" for p in PARITY)
            fits = f"a < b and x_c <> y_c and {den} * least(x_n, y_n) >= {num} * greatest(x_n, y_n) and {num + den} * ({odd}) <= {den - num} * (x_n + y_n)"
            return x.join(y, by).where(fits).select("a", "b").distinct()

        def verified(pairs: DataFrame, source: DataFrame) -> DataFrame:
            both = pairs.join(source.toDF("a", "ta"), "a").join(source.toDF("b", "tb"), "b")
            return scratch.keep(both.select("a", "b", "ta", "tb").mapInArrow(*_verify(num, den, width)), "links")

        def texts_of(pairs: DataFrame) -> DataFrame:
            """The texts of the nodes of ``pairs``, each once and packed."""
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            packed, _ = sieve(signed.mapInArrow(*_texts(width, strangers)), nodes, "node")
            packed = packed.join(nodes, "node", "left_semi")
            return scratch.keep(packed.groupBy("node").agg(F.first("text").alias("text")), "texts")

        def crossing(pairs: DataFrame, comp: DataFrame) -> DataFrame:
            """The pairs whose ends ``comp`` has apart."""
            out = pairs
            for side in "ab":
                out = out.join(comp.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left")
            return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

        ends = F.array(*(F.struct(F.least(h, "node").alias("a"), F.greatest(h, "node").alias("b")) for h in ("hub", "other")))
        stars = bucket.select(F.explode(ends).alias("e")).select("e.*").where("a < b").distinct()
        found = scratch.keep(near(stars), "pairs")
        loose = components(scratch, found)
        pairs = scratch.keep(found.unionByName(near(across(loose))).distinct(), "pairs")

        # Texts are compared for one pair of each node first; of the other pairs, only those count that these links leave apart.
        source = texts_of(pairs)
        tree = scratch.keep(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tree")
        links = verified(tree, source)
        groups = components(scratch, links)
        rest = scratch.keep(crossing(pairs.join(tree, ["a", "b"], "left_anti"), groups), "pairs")
        failed = links.count() < tree.count()
        if not rest.isEmpty():
            more = verified(rest, source)
            failed |= more.count() < rest.count()
            links = scratch.keep(links.unionByName(more), "links")
            groups = components(scratch, links)
        if failed:  # a bound let a pair through that held others back: look again between the groups that remain of its component
            rest = scratch.keep(near(across(groups, components(scratch, pairs))).join(pairs, ["a", "b"], "left_anti"), "pairs")
            if not rest.isEmpty():
                last = links.unionByName(verified(rest, source))  # their nodes are all in ``pairs``
                groups = components(scratch, last)

        # The least doc_id of each component, by node; then the nodes' rows, hot ones apart.
        least = facts.select("node", "least", "size").join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("component", "node"))
        whole = least.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
        named = join_split(least.select("node", "size", "group"), whole, "group", "nodes", facts.count())
        named = scratch.keep(named.select("node", "size", "component_id"), "named", stays=True)
        rows = known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node")).alias("node"))
        done = join_split(rows.where("node is not null"), named, "node", "size", known.count())
        lone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return done.select("doc_id", "n_shingles", "component_id").unionByName(lone)
