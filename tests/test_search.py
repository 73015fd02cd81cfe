"""Search beyond the sizes that the test tables reach."""

from pyspark.sql import functions as F

from tessera.operators import search


def test_search_of_any_number_of_queries(spark, data, monkeypatch):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").limit(200).cache()
    queries = vectors.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    found = lambda: sorted(map(tuple, search.batch_search(queries, vectors, k=4).select("query_id", "place", "vec_id").collect()))
    want = found()
    monkeypatch.setattr(search, "MAX_QUERIES", 11)
    assert queries.count() > 11 and found() == want


def test_coded_lists_find_nine_in_ten(spark, data, tmp_path):
    """H-07 against the exact search of the same queries: opened again by path, with a tenth of the vectors compared at most."""
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").cache()
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    exact = search.batch_search(queries, vectors).select("query_id", "vec_id").cache()
    search.VectorIndex.build(vectors, str(tmp_path / "v"))
    index = search.VectorIndex(spark, str(tmp_path / "v"))
    found = index.search(queries, shortlist=50)
    assert found.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()
    looked_at = index.candidates(queries, 80, 50).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert looked_at <= 0.1 * vectors.count()
    assert {(r["query_id"], r["place"]) for r in found.collect()} == {(r["query_id"], p) for r in queries.collect() for p in range(1, 11)}


def test_vectors_added_later_are_found(spark, data, tmp_path):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    index = search.VectorIndex.build(vectors.filter("vec_id % 2 = 0"), str(tmp_path / "v"), lists=5, sample=100)
    odd = spark.createDataFrame([(10_001, None), (10_002, [0.0] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    index.append(vectors.filter("vec_id % 2 = 1").unionByName(odd))
    queries = vectors.filter("vec_id IN (1, 2)").select((F.col("vec_id") + 50_000).alias("query_id"), F.col("embedding").alias("asked"))
    first = {r["query_id"]: (r["vec_id"], round(r["similarity"], 5)) for r in index.search(queries, k=1, probed=100).collect()}
    assert first == {50_001: (1, 1.0), 50_002: (2, 1.0)}
    assert index.search(queries.limit(0)).count() == 0
    assert search.VectorIndex.build(vectors.limit(0), str(tmp_path / "none")).search(queries).count() == 0


def test_postings_are_read_by_term(spark, tmp_path):
    """A request sees the buckets of its terms and no text; nulls, repeats and empty texts have their place."""
    rows = [(1, "The quick fox. The end"), (2, "slow fox"), (3, None), (4, ""), (5, "THE the the " * 500), (6, "über-fox"), (6, "again"), (None, "fox fox")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, term string, tf long")
    search.TextIndex.build(docs, str(tmp_path / "t"))
    index = search.TextIndex(spark, str(tmp_path / "t"))
    assert tuple(index.stats().first()) == (6, (5 + 2 + 0 + 0 + 1500 + 3) / 6)
    assert sorted(map(tuple, index.of(["fox", "the", "absent"]).select("term", "doc_id", "tf", "n").collect())) == [("fox", 1, 1, 5), ("fox", 2, 1, 2), ("fox", 6, 1, 3), ("the", 1, 2, 5), ("the", 5, 1500, 1500)]
    plan = search.lexical_rank(index, "the fox")._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "bucket" in plan.split("PartitionFilters")[1] and "text#" not in plan
    ranks = {r["doc_id"]: r["text_rank"] for r in search.lexical_rank(index, "the fox").collect()}
    assert set(ranks) == {1, 2, 5, 6} and ranks[1] == max(ranks.values()) and all(0 < x < 1 for x in ranks.values())
    assert search.lexical_rank(index, "!!").count() == 0


def test_unicode_folds(spark):
    from tessera.functions.session import fold_unicode

    names = ["  Łukasz ﬁne-Öl ", "Ｆｕｌｌ　Ｗｉｄｔｈ", "山田 太郎", "Анна-Мария", "x_y", "", None]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", fold_unicode("n").alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == ["łukasz fine ol", "full width", "山田 太郎", "анна мария", "x y", "", None]


def test_building_keeps_no_postings_beside_the_index(spark, tmp_path, monkeypatch):
    """Between jobs only ids of several rows are kept, and the index is that of a count by hand."""
    import collections
    import random
    import re

    r = random.Random(3)
    rows = [(i if r.random() < 0.9 else i // 2, " ".join(r.choice(["Fox", "the", "End", "ÉTÉ", "x1y", "-"]) for _ in range(r.randrange(40)))) for i in range(400)]
    kept, write = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df, name: kept.append(write(df, name)) or kept[-1])
    index = search.TextIndex.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "t"))
    want = collections.defaultdict(collections.Counter)
    for i, text in rows:
        want[i].update(re.findall("[a-z]+", text.lower()))
    assert sum(df.count() for df in kept) == sum(n > 1 for n in collections.Counter(i for i, _ in rows).values()) > 9
    assert sorted(map(tuple, index.postings().select("doc_id", "term", "tf", "n").collect())) == sorted((i, t, tf, c.total()) for i, c in want.items() for t, tf in c.items())
    assert tuple(index.stats().first()) == (len(want), sum(c.total() for c in want.values()) / len(want))


def test_memory_of_a_search_is_bounded_by_its_blocks():
    """The distances that are held at once don't grow with rows, lists or queries."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(1)
    rows, centres = r.normal(size=(20_000, 8)), r.normal(size=(1024, 8))
    tracemalloc.start()
    own = search._nearest(rows, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * 1024 * 8 / 4
    some = r.choice(20_000, 50, replace=False)
    assert [((centres - rows[i]) ** 2).sum(axis=1).argmin() for i in some] == own[some].tolist()
    assert search._nearest(rows[:0], centres).tolist() == [] and search.CELLS <= 1_000_000


def test_memory_of_an_exact_search_is_bounded(spark, monkeypatch):
    """What a task holds doesn't grow with its batches or their width, and a block of queries not with theirs; ties, nulls and zeros as by brute force."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    rows = r.normal(size=(20_000, 256)).astype(np.float32)
    rows[5000:5040], rows[7], rows[900::1000] = rows[0], 0, rows[1]
    held = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa.array([None if i == 3 else x for i, x in enumerate(rows)], pa.list_(pa.float32()))], ["vec_id", "embedding"])
    asked = [*range(0, 3), *range(50, 1000, 50)]
    vectors, sizes = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), []
    queries = spark.createDataFrame([(i, rows[i].tolist()) for i in asked], "query_id long, asked array<float>")
    tasks, real = [], type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda df, f, schema: tasks.append(f) or real(df, f, schema))
    search._search_block(queries, vectors, 10)
    tracemalloc.start()
    (out,) = tasks[0](iter([held.slice(0, 11_000), held.slice(11_000)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * 256 * 8 / 2
    units = rows.astype(np.float64) / np.maximum(np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True), 1e-300)
    for i in asked:
        near = np.round(units @ units[i], 6)
        want = [j for j in np.lexsort((np.arange(20_000), -near)) if j not in (i, 3, 7)][:10]
        mine = sorted((-round(s, 6), v) for q, v, s in zip(*(c.to_pylist() for c in out.columns), strict=True) if q == i)
        assert [v for _, v in mine] == want
    monkeypatch.setattr(search, "MAX_VALUES", 256 * 7, raising=False)
    block = search._search_block
    monkeypatch.setattr(search, "_search_block", lambda q, v, k: sizes.append(q.count()) or block(q, v.limit(0), k))
    assert search.batch_search(queries, vectors).count() == 0
    assert sum(sizes) == len(asked) and max(sizes) * 256 <= search.MAX_VALUES * 2
