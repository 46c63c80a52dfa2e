"""Bounds of shards come from the values they are given; rows that are dear to compute are not computed for them."""

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm.chunkstore import GEAR, REACH, marks
from tallyhouse.llm.shards import with_shards


def test_rows_are_not_computed_for_bounds(spark):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(k):
        computed.add(1)
        return k

    rows = spark.range(100).select(same.asNondeterministic()("id").alias("id"))
    placed, shards = with_shards(rows, "id", 10, spark.range(100))
    assert computed.value == 0 and shards == 10
    assert [r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()] == [n for n in (9, *[10] * 8, 11)]


def test_marks_are_those_of_the_sum_over_the_ids_before():
    ids = np.random.default_rng(3).integers(0, 49_000, 4000)
    gear = GEAR[ids]
    rolled = [sum(int(gear[i - k]) << k for k in range(min(REACH, i + 1))) % 2**32 for i in range(len(ids))]
    assert marks(ids).tolist() == [i + 1 for i, r in enumerate(rolled) if r >> 16 & 255 == 0]
