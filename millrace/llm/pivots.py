"""Embedding near-duplicates by a pivot-permutation index.

Vectors are described by the order of their nearest reference points (pivots).
Inverted lists hold the vectors that have a pivot, or a combination of pivots,
among their first few: two vectors that share the wanted number of pivots meet
in the list of such a combination, so the count of shared pivots is a lookup
and no list of one pivot has to be joined with itself. Pairs that meet are
verified by cosine in double precision. A pair is counted in the first list
that both are in, so links add up without a table of pairs, and components
come from one star for each group of linked vectors of a list.

Pivots are fitted on a bounded, seeded sample (``SAMPLE`` rows at most); every
vector is indexed. Lists longer than ``BLOCK`` are split into pairs of blocks,
so no task holds a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, join_split

SAMPLE = 16_384
PIVOTS = (256, 4096)
APART = 0.8
FIRST = 5
SHARED = 2
BLOCK = 1024


def fit_pivots(sample: np.ndarray, count: int, seed: int = 29) -> np.ndarray:
    """Up to ``count`` unit rows of the sample, in seeded order, no two with a cosine above ``APART``.

    Pivots that are far apart keep the order of the nearest ones stable within
    a group of near-duplicates; several pivots inside such a group would not.
    """
    rng = np.random.default_rng(seed)
    points = np.unique(sample, axis=0)
    points = points[rng.permutation(len(points))]
    kept = np.empty((0, sample.shape[1]))
    for start in range(0, len(points), 256):
        chunk = points[start : start + 256]
        chunk = chunk[(chunk @ kept.T <= APART).all(axis=1)]
        for row in chunk:
            if len(kept) == count:
                return kept
            if (kept @ row <= APART).all():
                kept = np.vstack((kept, row))
    return kept


def unit(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision scaled to length one, and which rows can link at all."""
    n = len(vectors)
    out, good = np.zeros((n, dim)), np.zeros(n, bool)
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    if len(rows) and dim:
        flat = vectors.take(pa.array(rows)).flatten()
        values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64).reshape(len(rows), dim)
        with np.errstate(invalid="ignore", over="ignore"):
            top = np.abs(values).max(axis=1, keepdims=True)
            fine = np.isfinite(values).all(axis=1) & (top[:, 0] > 0)
            values = values[fine] / top[fine]  # so that squares neither overflow nor vanish
            out[rows[fine]] = values / np.linalg.norm(values, axis=1, keepdims=True)
        good[rows[fine]] = True
    return out, good


def orders(vectors: np.ndarray, pivots: np.ndarray, first: int) -> np.ndarray:
    """The ``first`` nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T
    first = min(first, len(pivots))
    some = np.argpartition(-near, first - 1, axis=1)[:, :first]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


def list_keys(order: np.ndarray, shared: int) -> np.ndarray:
    """The combinations of ``shared`` pivots of each vector as sorted numbers: the lists that it is in."""
    ids = np.sort(order, axis=1).astype(np.int64)
    shared = min(shared, ids.shape[1])
    keys = np.stack([sum(ids[:, c] << (16 * j) for j, c in enumerate(reversed(combo))) for combo in combinations(range(ids.shape[1]), shared)], axis=1)
    return np.sort(keys, axis=1)


def _index(held, first: int, shared: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        k = comb(min(first, len(pivots)), min(shared, min(first, len(pivots))))
        for batch in batches:
            vectors, good = unit(batch.column("embedding"), pivots.shape[1])
            sizes = np.asarray(batch.column("embedding").value_lengths())
            keys = np.repeat(-sizes.astype(np.int64)[:, None], k, axis=1)  # other lengths: one list each
            if good.any():
                keys[good] = list_keys(orders(vectors[good], pivots, first), shared)
            flat = np.asarray(batch.column("embedding").flatten()).astype(kind)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("copies"),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), k).cast(pa.list_(pa.int64())),
                    pa.array([flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                ],
                names=["node", "copies", "lists", "vector"],
            )

    return run


def _scaled(vectors: pa.Array, kind: str) -> np.ndarray:
    """Vectors in their stored precision as rows of length one in double precision; shorter ones end in zeros."""
    rows = [np.frombuffer(v, kind) for v in vectors.to_pylist()]
    full = np.zeros((len(rows), max(len(r) for r in rows)), kind)
    for at, r in enumerate(rows):
        full[at, : len(r)] = r
    return unit(pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), full.shape[1]).cast(pa.list_(pa.from_numpy_dtype(np.dtype(kind)))), full.shape[1])[0]


def _pairs(least: float, key: int, a: slice, b: slice, unit_rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two runs of rows that have no list before ``key`` in common."""
    linked = unit_rows[a] @ unit_rows[b].T >= least
    if a == b:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    i, j = i + a.start, j + b.start
    first = np.ones(len(i), bool)
    for c in range(lists.shape[1]):
        mine = lists[i, c]
        first &= ~((mine < key) & (lists[j] == mine[:, None]).any(axis=1))
    return i[first], j[first]


def _links(least: float, kind: str):
    """For each list and pair of blocks: links of its members, and the least member that these links reach."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def work(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        take = {c: np.asarray(rows.column(c)) for c in ("list", "lo", "hi", "block", "node", "copies")}
        lists = np.asarray(rows.column("lists").combine_chunks().flatten()).reshape(len(rows), -1)
        vectors = _scaled(rows.column("vector").combine_chunks(), kind)
        ends_i, ends_j = [], []
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if end - start > 1:
                lo, hi = take["lo"][start], take["hi"][start]
                middle = start + int(np.searchsorted(take["block"][start:end], lo, side="right"))
                a, b = (slice(start, middle), slice(start, middle)) if lo == hi else (slice(start, middle), slice(middle, end))
                if a.stop > a.start and b.stop > b.start:
                    i, j = _pairs(least, int(take["list"][start]), a, b, vectors, lists)
                    ends_i.append(i)
                    ends_j.append(j)
        i, j = (np.concatenate(e) if e else np.empty(0, np.int64) for e in (ends_i, ends_j))
        here, there = np.concatenate((i, j)), np.concatenate((j, i))
        links, low = np.zeros(len(rows), np.int64), take["node"].copy()
        np.add.at(links, here, take["copies"][there])
        while len(here):  # the least node of the linked rows
            before = low.copy()
            np.minimum.at(low, here, low[there])
            if (low == before).all():
                break
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(take["node"][some]), pa.array(links[some]), pa.array(low[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = [table.column(c).to_numpy() for c in ("list", "lo", "hi")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if not len(change):
                held = table
                continue
            yield work(table.slice(0, int(change[-1])), np.concatenate(([0], change)))
            held = table.slice(int(change[-1]))
        if held is not None and len(held):
            yield work(held, np.array([0, len(held)]))

    return run


def near_duplicates(rows: DataFrame, least: float = 0.95, pivots: int | None = None, first: int = FIRST, shared: int = SHARED, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows(vec_id, embedding)``.

    Two vectors link when their cosine in double precision is at least
    ``least``. ``n_links`` counts the other vectors linked with this one,
    ``component_id`` is the smallest vec_id that links reach, and ``kept`` is
    true for it alone. Found are the pairs that share ``shared`` of their
    ``first`` nearest pivots (the recall is measured in the tests); none below
    ``least`` is returned. There are ``pivots`` of them, by default about the
    square root of the number of vectors within ``PIVOTS``, so that lists stay
    short as the table grows.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. Vectors of different lengths don't link; those of another
    length than most have no pivots, so each such length is one list, in which
    all pairs are compared, block by block. Equal vectors are one node of the
    index and linked with each other. Repeated rows are vectors of their own,
    which share a vec_id; rows of one vec_id with different vectors are linked
    each by its own. A null vec_id keeps its row, with null component_id and
    kept, and links with nothing. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    kind = "f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"  # floats travel as floats
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("embedding"))
    sound = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    plain = plain.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    plain = plain.withColumn("same", F.when(F.col("sound"), F.md5(F.array_join(F.transform("embedding", lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))), ","))))
    with Scratch(spark) as scratch:
        marked = scratch.keep(plain, "vectors", stays=True)
        # A node is a distinct vector, whatever rows hold it; it is numbered where it is written.
        each = marked.where("sound").groupBy("same").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        nodes = scratch.keep(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
        common = nodes.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if common is None:
            return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.expr("vec_id = vec_id").alias("kept"))
        total = nodes.count()
        sample = nodes.where(F.size("embedding") == common.n).orderBy(F.xxhash64(F.lit(seed), "same"), "same").limit(SAMPLE).select("embedding").toArrow()
        points, _ = unit(sample.column(0).combine_chunks(), common.n)
        count = pivots or min(PIVOTS[1], max(PIVOTS[0], int(total**0.5)))
        held = spark.sparkContext.broadcast(fit_pivots(points, count, seed))

        index = scratch.keep(nodes.select("node", "copies", "embedding").mapInArrow(_index(held, first, shared, kind), "node long, copies long, lists array<long>, vector binary"), "index")
        # Lists of one member link nothing; long ones are dealt out as pairs of blocks.
        listed = index.select(F.explode(F.array_distinct("lists")).alias("list"), "node")
        lengths = listed.groupBy("list").count().where("count > 1").withColumn("blocks", F.expr(f"cast(ceil(count / {block}D) as int)")).drop("count")
        member = listed.join(lengths, "list").withColumn("block", F.expr("cast(pmod(xxhash64(node, list), blocks) as int)"))
        dealt = member.select("list", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("list", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        groups = dealt.join(index, "node").repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi", "block")
        found = scratch.keep(groups.select("list", "lo", "hi", "block", "node", "copies", "lists", "vector").mapInArrow(_links(least, kind), "node long, links long, low long"), "links")

        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        comp = components(scratch, found.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))).withColumnRenamed("id", "node")
        every = nodes.select("node", "same", "least", "copies").join(counts, "node", "left").join(comp, "node", "left").withColumn("group", F.coalesce("component", "node"))
        lowest = every.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        named = scratch.keep(join_split(every.select("same", "copies", "links", "group"), lowest, "group", "members", total).select("same", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named", stays=True)
        done = join_split(marked.where("sound").select("vec_id", "same"), named, "same", "copies", marked.count())
        done = done.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
        lone = marked.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.expr("vec_id = vec_id").alias("kept"))
        return done.unionByName(lone)
