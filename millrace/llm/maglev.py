"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an
offset and a step hashed from its name. Shards take turns: each claims the
first slot of its permutation that is still free, until the table is full. A
row's key is hashed to a slot and the slot names the shard, so placement takes
one probe, shards get nearly equal shares of the slots, and when a shard comes
or goes only few other slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 65_537
MOST_SLOTS = 1 << 20


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def fill(shards: Sequence[str], slots: int = PRIME, weights: Sequence[int] | None = None) -> np.ndarray:
    """The shard number of each slot.

    ``slots`` must be a prime of at most ``MOST_SLOTS`` (which bounds what is
    broadcast) and not less than the number of shards; names must differ. With
    whole-number ``weights`` a shard takes that many turns in each round.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names, each its own")
    if not len(shards) <= slots <= MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime from {len(shards)} to {MOST_SLOTS}")
    turns = [1] * len(shards) if weights is None else [int(w) for w in weights]
    if len(turns) != len(shards) or min(turns) < 0 or not sum(turns):
        raise ValueError("weights are whole numbers, one for each shard, and not all 0")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    left = slots
    while left:
        for k, n in enumerate(turns):
            for _ in range(n):
                slot = at[k]
                while owner[slot] >= 0:
                    slot = (slot + step[k]) % slots
                owner[slot] = k
                at[k] = (slot + step[k]) % slots
                left -= 1
                if not left:
                    return np.array(owner, np.int32)
    raise AssertionError


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = PRIME, weights: Sequence[int] | None = None) -> DataFrame:
    """The table as a DataFrame (slot, shard): at most ``MOST_SLOTS`` short rows, so it may be broadcast."""
    owner = fill(shards, slots, weights)
    names = F.array(*(F.lit(s) for s in shards))
    numbers = F.unhex(F.lit(owner.astype(">i4").tobytes().hex()))
    row = spark.range(slots).select(F.col("id").alias("slot"), F.conv(F.hex(F.substring(numbers, F.col("id").cast("int") * 4 + 1, F.lit(4))), 16, 10).cast("int").alias("n"))
    return row.select("slot", F.element_at(names, F.col("n") + 1).alias("shard"))


def slot_of(*key: Column, slots: int = PRIME) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots).cast("long"))


def place(rows: DataFrame, shards: Sequence[str], key: Sequence[str] = ("doc_id",), spare: str | None = "text", slots: int = PRIME, weights: Sequence[int] | None = None) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``, replacing columns of these names.

    Rows are placed by the hash of their ``key`` columns, so equal keys meet.
    Rows whose key is null are placed by column ``spare``, where it is given
    and exists, so that they don't pile up in one slot; if that is null, too,
    they share the slot of null. An empty table gives an empty result.
    """
    table = lookup(rows.sparkSession, shards, slots, weights)
    code = slot_of(*(F.col(k) for k in key), slots=slots)
    if spare and spare in rows.columns:
        empty = F.coalesce(*(F.col(k).cast("string") for k in key)).isNull()
        code = F.when(empty, slot_of(F.col(spare), slots=slots)).otherwise(code)
    out = rows.drop("slot", "shard").withColumn("slot", code)
    return out.join(F.broadcast(table), "slot").select(*(c for c in rows.columns if c not in ("slot", "shard")), "slot", "shard")


def write_shards(rows: DataFrame, path: str, shards: Sequence[str], salts: int = 8, **options) -> None:
    """Write ``rows`` below ``path``, a folder for each shard; each shard's rows are spread over ``salts`` tasks and files."""
    placed = place(rows, shards, **options)
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in placed.columns if c in ("doc_id", "slot"))), F.lit(salts).cast("long"))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
