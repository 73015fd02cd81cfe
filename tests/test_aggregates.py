"""Aggregations beyond the sizes that the test tables reach."""

import collections
import itertools

from tessera.operators import aggregates


def test_coauthors_of_large_works(spark):
    works = {1: range(130), 2: range(100, 160), 3: [5, 140], 4: [7]}
    rows = [(w, a) for w, authors in works.items() for a in authors]
    want = collections.Counter(p for authors in works.values() for p in itertools.combinations(sorted(authors), 2))
    table = spark.createDataFrame(rows + rows[:9], "work long, author long")
    for got in (aggregates.coauthor_edges(table), aggregates.coauthor_edges(table, block=20)):
        got = {(r["a"], r["b"]): r["weight"] for r in got.collect()}
        assert got == {p: round(min(1, 0.18 * n), 6) for p, n in want.items()}


def test_coauthors_go_to_more_tasks_as_they_grow(spark, monkeypatch):
    from tessera.functions import store

    rows = [(w, (w * 7 + k) % 150) for w in range(400) for k in range(4)]
    table = spark.createDataFrame(rows, "work long, author long")
    want = sorted(map(tuple, aggregates.coauthor_edges(table).collect()))
    monkeypatch.setattr(store, "ROWS", 100)
    monkeypatch.setattr(aggregates, "ROWS", 100)
    found = aggregates.coauthor_edges(table)
    assert found.rdd.getNumPartitions() >= 24 and sorted(map(tuple, found.collect())) == want
