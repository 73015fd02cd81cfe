"""Hard negatives against a plain search over all pairs, and on awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>, anchor_id string, slot int, place long"


def brute(rows, positives=5, most=10):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    anchors = {}
    for i, label, v in rows:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        scored = {(r[1] == label, sum(x * y for x, y in zip(v, r[2])), r[0], tuple(r[2]), r[1]) for r in rows if r[0] != i and len(r[2]) == len(v)}
        same = sorted({(-s, j) for own, s, j, _, _ in scored if own})[:positives]
        rest = sorted({(-s, j) for own, s, j, _, _ in scored if not own})
        for p, j in same:
            window = [(s, k) for s, k in rest if -30 * p <= -100 * s <= -90 * p][:most]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(window)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 7) for r in rows], SCHEMA)


def found(spark, rows, **options):
    return sorted(map(tuple, negatives.hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 100 == 0, **options).collect()))


def some_rows(seed, n=400, spread=4, labels=3):
    r = random.Random(seed)
    return [(25 * i, r.randrange(labels), [r.randint(-1, spread) for _ in range(4)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_pairs(spark, seed):
    """Small components, so most scores are tied."""
    rows = some_rows(seed, spread=2 + 5 * seed)
    want = brute(rows)
    assert len(want) > 500 and found(spark, rows) == want
    assert found(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)


def test_blocks_of_anchors_and_rows(spark, monkeypatch):
    rows = some_rows(3, 300)
    want = brute(rows)
    monkeypatch.setattr(negatives, "ANCHORS", 20)
    monkeypatch.setattr(negatives, "CELLS", 100)
    assert found(spark, rows) == want


def test_awkward_tables(spark):
    """Nulls, vectors of several lengths, repeated rows, one label for all, an empty table, too large components."""
    rows = some_rows(4, 120)
    odd = rows + rows[:40] + [(None, 1, [1, 1, 1, 1]), (1, None, [9, 9, 9, 9]), (2, 1, None), (3, 1, [1, None, 1, 1]), (100, 2, [3, 3, 3, 3]), (7, 0, [5, 5]), (200, 0, []), (300, 1, [4, 4]), (11, 1, [2, 3]), (12, 0, [3, 2])]
    assert found(spark, odd) == brute(odd)
    assert found(spark, [(i, 1, v) for i, _, v in rows]) == []
    assert found(spark, []) == [] and found(spark, [(100, 1, [1])]) == []
    with pytest.raises(Exception, match="56 bits"):
        found(spark, [(100, 1, [1 << 40]), (1, 1, [1 << 40])])


def test_odd_components_are_no_vector(spark):
    rows = [(1, [0.5, -0.001]), (2, [0.1, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (6, [])]
    got = spark.createDataFrame(rows, "i int, e array<float>").select("i", negatives.quantised(F.col("e")).alias("q")).collect()
    assert {r["i"]: r["q"] for r in got} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
