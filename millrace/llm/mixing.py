"""Mixing sources to target weights by Sainte-Lague apportionment.

Native: DataFrame operations only. Documents are laid end to end in a seeded
order within their shard (a hash bucket of one source), cut into blocks of
equally many words, and whole blocks are handed out: first to sources, then to
the shards of a source, each time to the highest quotients v / (2 s + 1). A
shard that is due more than all its blocks takes each of them once and the
rest a second time, beginning at a seeded block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none.

    Each word becomes one byte and the blanks vanish, so what is counted is a
    string and no array of words is built.
    """
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(F.col(text), WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight)``, one row a source.

    The budget is ``share`` of all sizes and is dealt by weight; a target
    stops at ``most`` times its source's size and the excess is dealt again by
    weight until none is above. With sources in the order of size / weight,
    those that stop are a prefix, so the fixed point is one running sum.
    """
    order = Window.orderBy(F.expr("source_size / weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("_full", F.coalesce(F.sum("source_size").over(order), F.lit(0)))
        .withColumn("_light", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("_size", F.sum("source_size").over(every))
        .withColumn("_weight", F.sum("weight").over(every))
        .withColumn("_level", F.expr(f"({share}D * _size - {most}D * _full) / (_weight - _light)"))
        .withColumn("_stops", F.expr(f"_level * weight >= {most}D * source_size"))
        .withColumn("_level", F.max(F.expr("if(_stops, null, _level)")).over(every))
    )
    return filled.withColumn("target", F.expr(f"if(_stops, {most}D * source_size, _level * weight)")).drop("_full", "_light", "_size", "_weight", "_level", "_stops")


def highest_quotients(votes: DataFrame, group: list[str], key: str, vote: str, seats: str, most: str, out: str) -> DataFrame:
    """Add ``out``: the seats of ``key`` when each group's ``seats`` go to its highest quotients vote / (2 s + 1).

    No key gets more than ``most``; ties go to the smaller key. Rounding
    vote * seats / votes takes exactly the quotients of at least the standard
    divisor's half, so only the few quotients about it are ranked: with m keys
    the divisor that deals all seats is within m / seats of the standard one,
    which bounds how many seats of a key can change.
    """
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    base = (
        votes.withColumn("_votes", F.sum(vote).over(all_of))
        .withColumn("_keys", F.count("*").over(all_of))
        .withColumn("_q", F.expr(f"if(_votes > 0, cast({vote} as double) * {seats} / cast(_votes as double), 0D)"))
        .withColumn("_base", F.expr(f"least(cast(floor(_q + 0.5D) as bigint), {most})"))
        .withColumn("_miss", F.expr(f"{seats}") - F.sum("_base").over(all_of))
        .withColumn("_reach", F.expr(f"cast(floor(_q * 2 * _keys / greatest({seats}, 1)) as bigint) + 1"))
    )
    near = base.where(f"_miss <> 0 and {vote} > 0").select(
        *group,
        key,
        "_miss",
        F.explode(
            F.expr(
                f"""if(_miss > 0,
                      if(_base < {most}, sequence(_base + 1, least({most}, _base + least(_reach, _miss))), array()),
                      if(_base > 0, sequence(greatest(1, _base + 1 - least(_reach, -_miss)), _base), array()))"""
            )
        ).alias("_seat"),
        F.col(vote).alias("_vote"),
    )
    rank = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    quotient = F.expr("_vote / (2D * _seat - 1D)")
    up = F.row_number().over(rank.orderBy(quotient.desc(), F.col(key).asc_nulls_last(), F.col("_seat")))
    down = F.row_number().over(rank.orderBy(quotient.asc(), F.col(key).desc_nulls_first(), F.col("_seat").desc()))
    moved = (
        near.withColumn("_up", up).withColumn("_down", down)
        .where("(_miss > 0 and _up <= _miss) or (_miss < 0 and _down <= -_miss)")
        .groupBy(*group, key)
        .agg(F.sum(F.signum("_miss")).cast("long").alias("_moved"))
    )
    joined = base.alias("b").join(moved.alias("m"), [F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*group, key)], "left")
    return joined.select(*(F.col(f"b.{c}") for c in votes.columns), (F.col("b._base") + F.coalesce(F.col("m._moved"), F.lit(0))).alias(out))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: int = 2, block: int = 1, shard_rows: int = 128, most_shards: int = 4096, seed: int = 17, key: str | None = None) -> DataFrame:
    """(doc_id, source, shard, size, source_size, target, taken) for every row of ``docs(doc_id, text, source)``.

    ``weights(source, weight)`` holds a positive whole number for each source;
    without it, sources in code-point order, null last, weigh 3, 1, 2, 3, ...
    ``taken`` is the number of words that the mix takes of a document, repeats
    counted: 0 to ``most`` times its size. A source's taken words differ from
    its target by less than one block for each of its shards, plus one: a shard's
    last block may be short, so blocks of one word (the default) meet the target
    to a word or two, however short the documents are. A rerun gives the same
    result.

    A null source is a source of its own; null and blank texts have size 0 and
    give nothing; a null doc_id is placed as a key of its own. Repeated rows
    are documents of their own that share a place in the order, unless ``key``
    names a column that tells rows apart: it orders them and is returned too.
    Other columns are ignored. An empty table gives an empty result.
    """
    # Texts are read once; all that follows works on three narrow columns.
    keys = [key] if key else []
    sized = settle(docs.select(*keys, F.col("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")), "sizes")
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    if weights is None:
        nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        source = source.withColumn("weight", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (nth - 1) % 3 + 1).cast("long"))
    else:
        source = source.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.*", F.col("w.weight").cast("long").alias("weight"))
    source = water_fill(source, share, float(most))
    # Sources, shards and quotas are small tables that several branches read: written, each is planned once and not once a branch.
    source = settle(source.withColumn("_shards", F.expr(f"least({most_shards}L, cast(ceil(_rows / {shard_rows}D) as bigint))")), "sources")

    # One narrow row a document; its shard is a seeded hash bucket of its source, so a hot source is spread.
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    narrow = sized.withColumn("_code", code).alias("d").join(source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    narrow = narrow.select(
        *(f"d.{k}" for k in keys), "d.doc_id", "d.source", "d.size", "d._code", "s.source_size", "s.target", F.expr("cast(conv(substring(d._code, 1, 8), 16, 10) as bigint) % s._shards").alias("shard")
    )
    shards = narrow.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = settle(shards.withColumn("blocks", F.expr(f"cast(ceil(shard_size / {float(block)}D) as bigint)")), "shards")
    by_source = shards.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("blocks").alias("blocks"))
    by_source = (
        by_source.withColumn("all_seats", F.expr(f"cast(floor(sum(source_size) over (partition by 0) * {min(share, most)}D / {float(block)}D + 0.5D) as bigint)"))
        .withColumn("most_seats", F.col("blocks") * most)
        .withColumn("vote", F.expr("cast(floor(target * 1024D) as bigint)"))  # whole numbers: their sum has no order
    )
    by_source = settle(highest_quotients(by_source, [], "source", "vote", "all_seats", "most_seats", "quota").select("source", "quota"), "quotas")
    shards = shards.alias("h").join(by_source.alias("q"), F.col("h.source").eqNullSafe(F.col("q.source"))).select("h.source", "h.shard", "h.shard_size", "h.blocks", F.col("q.quota").alias("source_quota"))
    shards = shards.withColumn("most_seats", F.col("blocks") * most)
    shards = highest_quotients(shards, ["source"], "shard", "shard_size", "source_quota", "most_seats", "quota")
    first = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    start = F.conv(F.substring(first, 1, 8), 16, 10).cast("long") % F.col("blocks")
    shards = settle(shards.withColumn("first_block", F.when(F.col("blocks") > 0, start).otherwise(F.lit(0).cast("long"))), "placed")

    placed = Window.partitionBy("source", "shard").orderBy("_code", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = narrow.withColumn("_end", F.sum("size").over(placed)).withColumn("_start", F.col("_end") - F.col("size"))
    laid = laid.alias("d").join(
        shards.select("source", "shard", "blocks", "quota", "first_block", "shard_size").alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d.shard") == F.col("h.shard"))
    ).select("d.*", "h.blocks", "h.quota", "h.first_block", "h.shard_size")
    # Of the ring of blocks, quota // blocks turns are whole; the words of the last turn lie in one or two runs of the shard.
    laid = laid.withColumn("_left", F.expr("if(blocks > 0, quota % blocks, 0)")).withColumn("_turns", F.expr("if(blocks > 0, quota div blocks, 0)"))
    laid = laid.withColumn("_from", F.expr(f"first_block * {block}")).withColumn("_to", F.expr(f"(first_block + _left) * {block}")).withColumn("_over", F.expr(f"greatest(0, first_block + _left - blocks) * {block}"))
    taken = "size * _turns + greatest(0, least(_end, _to, shard_size) - greatest(_start, _from)) + greatest(0, least(_end, _over) - _start)"
    return laid.select(*keys, "doc_id", "source", "shard", "size", "source_size", "target", F.expr(taken).cast("long").alias("taken"))
