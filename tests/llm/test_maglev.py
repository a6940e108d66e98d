import pytest
from pyspark.sql import functions as F

from millrace.llm.maglev import PRIME, _hash, fill, lookup, place, slot_of, write_shards


def brute(shards, slots, weights):
    orders = [[(_hash(s, "offset") + k * (_hash(s, "step") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    owner = {}
    while len(owner) < slots:
        for s, order in enumerate(orders):
            for _ in range(weights[s]):
                if len(owner) < slots:
                    owner[next(k for k in order if k not in owner)] = s
    return [owner[k] for k in range(slots)]


@pytest.mark.parametrize("weights", [None, [1, 2, 0, 5, 1]])
def test_fill_matches_full_permutations(weights):
    shards = [f"s{i}" for i in range(5)]
    assert fill(shards, 211, weights).tolist() == brute(shards, 211, weights or [1] * 5)


def test_shares_are_even_and_changes_few():
    names = [f"shard-{i:03d}" for i in range(64)]
    whole, less = fill(names), fill(names[:-1])
    counts = [int((whole == k).sum()) for k in range(64)]
    assert max(counts) - min(counts) <= 1
    kept = whole != 63
    assert (whole[kept] != less[kept]).mean() < 0.1


def test_placement(spark):
    names = ["a", "b", "c"]
    owner = fill(names, 101)
    assert {r.slot: r.shard for r in lookup(spark, names, 101).collect()} == {k: names[s] for k, s in enumerate(owner.tolist())}
    rows = [(i, f"t{i}", "old") for i in range(500)] + [(None, "x", "old"), (None, "y", "old"), (None, None, "old"), (3, "t3", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = place(df, names, slots=101).collect()
    assert len(got) == len(rows) and all(r.shard == names[owner[r.slot]] for r in got)
    want = {r.doc_id: r.s for r in df.where("doc_id is not null").select("doc_id", slot_of(F.col("doc_id"), slots=101).alias("s")).collect()}
    assert all(r.slot == want[r.doc_id] for r in got if r.doc_id is not None)
    assert place(spark.createDataFrame([], df.schema), names, slots=101).count() == 0


def test_shards_are_written(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    write_shards(df, f"{tmp_path}/out", ["a", "b"], slots=101)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b"}


def test_bad_tables_are_refused():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"], PRIME * PRIME), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill(shards, slots)
