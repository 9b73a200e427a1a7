"""Blocks in nested and overlapping ranges by a sweep, against plain comparison."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.ranges import blocks_in_ranges, in_any_range

RANGES = "doc_id long, name string, start_pos int, end_pos int, text string"


def rows(seed=1, docs=4, blocks=90, ranges=150):
    rng = random.Random(seed)
    b = [(d, k, f"t{k}") for d in range(docs) for k in range(rng.randrange(1, blocks))]
    r = []
    for k in range(ranges):
        a = rng.randrange(-3, blocks)
        r.append((rng.randrange(docs + 1), f"r{k}", a, rng.choice([a, a + rng.randrange(-2, 40), 2**31 - 1]), "clash"))
    r += [(0, "twin", 2, 5, "x"), (0, "twin", 2, 5, "x"), (0, "open", None, 5, "x"), (0, "open", 2, None, "x"), (None, "none", 0, 9, "x")]
    return [*b, (0, 3, "t3"), (None, 1, "n"), (1, None, "p")], r


def frames(spark, b, r):
    return spark.createDataFrame(b, "doc_id long, block_pos int, text string"), spark.createDataFrame(r, RANGES)


def holds(b, r):
    return None not in (b[0], b[1], r[0], r[2], r[3]) and b[0] == r[0] and r[2] <= b[1] <= r[3]


@pytest.mark.parametrize("stretch", [1, 7, 64, 4096])
def test_equals_plain_comparison(spark, stretch):
    b, r = rows()
    blocks, ranges = frames(spark, b, r)
    got = sorted((x.doc_id, x.block_pos, x.text, x.name) for x in blocks_in_ranges(blocks, ranges, stretch=stretch).collect())
    assert got == sorted((x[0], x[1], x[2], y[1]) for x in b for y in r if holds(x, y))
    inside = [tuple(x) for x in in_any_range(blocks, ranges, stretch=stretch).collect()]
    outside = [tuple(x) for x in in_any_range(blocks, ranges, stretch=stretch, inside=False).collect()]
    assert sorted(inside, key=repr) == sorted((x for x in b if any(holds(x, y) for y in r)), key=repr)
    assert sorted(inside + outside, key=repr) == sorted(b, key=repr)


def test_many_ranges_of_one_block_and_empty_sides(spark):
    blocks, ranges = frames(spark, [(1, k, "t") for k in range(5)], [(1, f"r{k}", 0, k % 5, "x") for k in range(200)])
    assert blocks_in_ranges(blocks, ranges).groupBy("block_pos").count().orderBy("block_pos").collect() == [(k, 200 - 40 * k) for k in range(5)]
    assert blocks_in_ranges(blocks, ranges.limit(0)).collect() == [] and blocks_in_ranges(blocks.limit(0), ranges).collect() == []
    assert in_any_range(blocks, ranges.limit(0), inside=False).count() == 5


def test_a_long_document_needs_no_join_of_blocks(spark):
    blocks = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("block_pos"), F.lit("t").alias("text"))
    _, ranges = frames(spark, [], [(1, "all", 0, 2**31 - 1, "x"), (1, "half", 0, 499_999, "x"), (1, "one", 999_999, 999_999, "x")])
    found = blocks_in_ranges(blocks, ranges)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of the ranges with the documents' bounds
    assert {x.name: x["count"] for x in found.groupBy("name").count().collect()} == {"all": 1_000_000, "half": 500_000, "one": 1}
