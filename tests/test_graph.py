"""Components of shapes that the test tables don't have."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph, joins


def labels(edges):
    return {r["id"]: r["label"] for r in graph.components(edges).collect()}


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_graphs_equal_union_find(spark):
    for seed, nodes, edges in ((1, 60, 40), (2, 300, 280), (3, 5, 30)):
        r = random.Random(seed)
        pairs = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)]
        want = {x: v for x, v in union_find([p for p in pairs if p[0] != p[1]]).items()}
        assert labels(spark.createDataFrame(pairs, "a long, b long")) == want
    assert labels(spark.createDataFrame([(1, 1)], "a long, b long")) == {}


def test_a_star_and_a_path(spark):
    """A star of a million around a node that isn't its least, and a path of ten thousand in random order."""
    order = list(range(2_000_000, 2_010_000))
    random.Random(3).shuffle(order)
    path = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    star = spark.range(1_000_001).filter("id <> 7").select(F.lit(7).cast("long").alias("a"), F.col("id").alias("b"))
    got = graph.components(star.unionByName(path)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 1_000_001, 2_000_000: 10_000}


def test_rows_of_a_hot_key_stay_in_place(spark, tmp_path):
    """Nine tenths of the rows have one key: after the join no partition has more than twice the median's rows."""
    many = spark.range(200_000, numPartitions=8).select("id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"))
    many.write.parquet(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    one = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = joins.many_to_one(rows, one, "k", few=0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in out)
    assert sum(sizes) == 200_000 and max(sizes) < 50_000
