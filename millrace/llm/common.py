"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``.

    Where it is unset, a local application gets a temporary folder of its own
    (the setting cannot change once a session runs); on a cluster such a folder
    is no shared one, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN[app]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df``; the files of its exchanges go as soon as the job has ended."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in replicated files.

    Lost executors then cost a reread and not a recomputation, and later
    plans read only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace/{what}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Settled tables that go when they are no longer read.

    ``keep`` settles a table, ``drop`` empties the files of one (an overwrite by
    a table without rows), and leaving the ``with`` block empties the folder of
    all but those that were kept with ``stays``, which a result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, what: str, stays: bool = False) -> DataFrame:
        path = f"{self.folder}{'-result' if stays else ''}/{what}-{len(self.paths)}"
        _write(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.spark.range(0).write.mode("overwrite").parquet(self.paths[id(df)][1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.spark.range(0).write.mode("overwrite").parquet(self.folder)


def join_split(big: DataFrame, small: DataFrame, key: str, size: str, total: int, share: int = 2000) -> DataFrame:
    """``big`` with the columns of ``small`` (one row a ``key``, null keys in neither), left-joined without a hot task.

    ``size`` is the number of rows of ``big`` with that key. Keys of more than
    one ``share``-th of all rows, fewer than ``share`` of them, are broadcast;
    the rest meet in an exchange.
    """
    hot = F.broadcast(small.where(F.col(size) * share > total))
    spread = big.join(hot.select(key), key, "left_anti").join(small.where(F.col(size) * share <= total), key, "left")
    return big.join(hot, key).unionByName(spread)


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def sieve(rows: DataFrame, keys: DataFrame, key: str, words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in ``keys``, and those whose key is certainly not; ``rows`` is not shuffled.

    Each of ``keys`` marks a bit of at most ``words`` words of 64 bits, a table
    that is broadcast. A key that meets a marked bit by chance is in the first
    part, so that one needs an exact join; with many more keys than bits it
    holds most rows, and none is lost.
    """
    slot, bits = free(rows, "sieve_slot"), free(rows, "sieve_bits")
    place, mark = f"pmod(xxhash64(`{key}`), {words}L)", f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{key}`), 32), 64L) as int))"
    marks = keys.groupBy(F.expr(place).alias(slot)).agg(F.bit_or(F.expr(mark)).alias(bits))
    met = rows.join(F.broadcast(marks), F.expr(place) == F.col(slot), "left")
    marked = F.coalesce(F.expr(f"({bits} & {mark}) <> 0"), F.lit(False))
    return met.where(marked).drop(slot, bits), met.where(~marked).drop(slot, bits)


def slices(batch: pa.RecordBatch, column: str, budget: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about ``budget`` bytes in ``column``."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    width = 8 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else 4
    offsets = np.frombuffer(values.buffers()[1], dtype=f"i{width}")[values.offset : values.offset + len(values) + 1]
    start = 0
    while start < len(values):
        end = int(np.searchsorted(offsets, int(offsets[start]) + budget, side="right")) - 1
        end = min(max(end, start + 1), len(values))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task ends, its worker, which waits for others, gives freed memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 offsets of its rows; nulls are empty."""
    if values.null_count:
        values = values.fill_null("")
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ODD = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows and n+1 offsets into them."""
    if not len(raw):
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    if lower:
        raw = _LOWER[raw]
    ink = ~_SPACE[raw]
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    head[inner] = ink[inner]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:]
    cut = inner[inner > 0] - 1
    tail[cut] = ink[cut]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * power[:-1], out=total[1:])
    hashed = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
    return hashed, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has its whole sequence as its only shingle; a row
    without words has none.
    """
    words, at = word_hashes(raw, offsets)
    factor = mix64(np.arange(11, 11 + width, dtype=U64)) | U64(1)
    out = []
    joined = np.zeros(max(0, len(words) - width + 1), U64)
    for j in range(width):
        joined += words[j : j + len(joined)] * factor[j]
    joined = mix64(joined)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * factor[: b - a]).sum(dtype=U64)
            out.append(mix64(np.array([short], U64) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id in ``edges`` reaches; a settled table.

    An edge leads from the larger id u to the smaller v. Each round joins the
    smaller neighbours of a vertex to the least of them and then moves every
    edge on to the least neighbour of its end, until the graph is stars. The
    least neighbours are an aggregate that combines before its exchange, so a
    vertex with many neighbours meets nowhere; each round's table replaces the
    last, and the driver sees one count a round.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        small = e.join(least(e), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        small = small.distinct()
        low = least(small)
        held = small.join(low, "u").withColumn("several", F.col("m") != F.col("v")).drop("m")
        moved = held.join(low.withColumnRenamed("u", "w"), F.col("v") == F.col("w"), "left")
        # an end that is no star's middle yet is moved on; one that is the least of its own neighbours stays
        moved = moved.select("u", F.coalesce("m", "v").alias("v"), (F.col("several") | F.col("m").isNotNull()).alias("open"))
        e = scratch.keep(moved.groupBy("u", "v").agg(F.bool_or("open").alias("open")), "edges")
        if not e.where("open").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return scratch.keep(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "groups")
