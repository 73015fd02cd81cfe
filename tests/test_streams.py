"""Streams against the batch result."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import streams as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def landed(spark, data, tmp_path):
    path = str(tmp_path / "landing")
    spark.read.parquet(f"{data}/events.parquet").orderBy("ts").repartitionByRange(4, "ts").write.parquet(path)
    return T.read_stream(spark, path, SCHEMA), spark.read.parquet(path)


def drain(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_activity_windows_equal_batch(spark, data, tmp_path):
    stream, batch = landed(spark, data, tmp_path)
    got = drain(T.stream_activity(stream.withColumnRenamed("user_id", "person_id"), late="60 days"), "activity", "complete", str(tmp_path / "c")).toPandas()
    want = batch.groupBy(F.col("user_id").alias("person_id"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).toPandas()
    key = ["person_id", "day", "n"]
    pd.testing.assert_frame_equal(got[key].sort_values(key, ignore_index=True), want[key].sort_values(key, ignore_index=True), check_dtype=False)


def test_first_of_each_key(spark, data, tmp_path):
    stream, batch = landed(spark, data, tmp_path)
    got = drain(T.stream_evidence(stream.withColumn("key", F.col("user_id")), at="ts", late="60 days"), "firsts", "append", str(tmp_path / "c"))
    assert got.count() == batch.select("user_id").distinct().count()


def test_best_of_each_key(spark, data, tmp_path):
    stream, batch = landed(spark, data, tmp_path)
    got = drain(T.stream_best_evidence(stream.select(F.col("user_id").cast("string").alias("key"), F.col("value").alias("confidence"))), "best", "update", str(tmp_path / "c"))
    best = {r["key"]: r["c"] for r in got.groupBy("key").agg(F.max("confidence").alias("c")).collect()}
    want = {str(r["user_id"]): r["c"] for r in batch.groupBy("user_id").agg(F.max("value").alias("c")).collect()}
    assert best == want


def test_rate_window(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 61), ("b", 2)], "key string, at long").write.parquet(path)
    got = drain(T.stream_rate_window(T.read_stream(spark, path, "key string, at long"), 2, 60), "rate", "append", str(tmp_path / "c"))
    assert sorted((r["key"], r["at"], r["allowed"], r["retry_after"]) for r in got.collect()) == [("a", 0, True, 0), ("a", 1, True, 0), ("a", 2, False, 58), ("a", 61, True, 0), ("b", 2, True, 0)]


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    """T-08: the checkpoint is the cursor; rows that came before the restart are not read again."""
    path, out, c = (str(tmp_path / x) for x in ("in", "out", "c"))
    for n in range(3):
        spark.range(10 * n, 10 * n + 10).write.mode("append").parquet(path)
        T.read_stream(spark, path, "id long").writeStream.format("parquet").option("path", out).option("checkpointLocation", c).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(10 * n + 10))


def test_scores_of_touched_people_only(spark, tmp_path):
    """T-07: a batch rescores whom it touches, over the whole history."""
    past = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0), (3, 2.0)], "person_id long, value double")
    spark.createDataFrame([(1, 9.0), (3, 1.0), (3, 1.0)], "person_id long, value double").write.parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), "person_id long, value double")
    T.stream_score_refresh(stream, lambda: past, lambda h: h.groupBy("person_id").agg(F.sum("value").alias("total")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("person_id", "total").collect())) == [(1, 12.0), (3, 2.0)]


def lands(spark, path, schema, *batches):
    """Each batch a file of its own, in order; times as text."""
    import time

    names = [f.split()[0] for f in schema.split(", ")]
    for rows in batches:
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        df = df.select([F.col(c).cast("timestamp").alias(c) if f"{c} timestamp" in schema else F.col(c) for c in names])
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are read in order of their times
    return T.read_stream(spark, path, schema, files=1)


RUN = "run_id string, started_at timestamp, ended boolean"


def test_stale_runs(spark, tmp_path):
    """T-04: a run without an end in time fails, also one that talks on every five minutes or ends too late; one that ended or is still young doesn't."""
    clock = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    first = [("quiet", clock(0), False), ("done", clock(0), False), ("done", clock(5), True), ("tardy", clock(1), False), ("tardy", clock(17), True)]
    talk = [[("talks", clock(m), False)] for m in range(0, 65, 5)]
    df = lands(spark, str(tmp_path / "in"), RUN, first, *talk, [("young", clock(120), False)], [("young", clock(121), None)])
    got = drain(T.stream_stale_runs(df, late="10 minutes"), "stale", "append", str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == [(r, "failed", "WORKER_TIMEOUT") for r in ("quiet", "talks", "tardy")]


def test_ninety_days_in_a_ring(spark, tmp_path):
    """T-03: equal to the batch form up to the watermark, from a state of a row a person."""
    import random

    r = random.Random(5)
    day = lambda d: (pd.Timestamp("2024-01-01") + pd.Timedelta(days=d, hours=r.randrange(24))).strftime("%Y-%m-%d %H:%M:%S")
    rows = [(p, day(d)) for p in range(6) for d in sorted(r.sample(range(200), 12))]
    rows.sort(key=lambda x: x[1])
    schema = "person_id long, ts timestamp"
    df = lands(spark, str(tmp_path / "in"), schema, rows[:30], rows[30:60], rows[60:], [(9, "2024-09-01 00:00:00")])
    q = T.stream_activity_90d(df).writeStream.format("memory").queryName("ring").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((x["person_id"], x["until"].strftime("%Y-%m-%d"), x["n"]) for x in spark.table("ring").collect())
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy("person_id", F.window("ts", "90 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    want = sorted((x["person_id"], x["w"]["end"].strftime("%Y-%m-%d"), x["n"]) for x in batch.filter("w.end <= '2024-08-31'").collect())
    assert got == want and len(got) > 500
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3 * 7


def test_state_goes_in_event_time(spark, tmp_path):
    """T-02 and T-05: queries that end by themselves forget keys that the watermark has left behind."""
    day = lambda d: f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 00:00:00"
    batches = [[(f"k{d}", 0.5, day(d)), ("steady", 0.1 + d / 1000, day(d))] for d in range(0, 200, 10)]
    schema = "key string, confidence double, discovered_at timestamp"
    df = lands(spark, str(tmp_path / "in"), schema, *batches, [("k0", 0.2, day(201))])
    q = T.stream_best_evidence(df, days=30).writeStream.format("memory").queryName("best_kept").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [tuple(x) for x in spark.table("best_kept").collect()]
    assert ("k0", 0.5) in got and ("k0", 0.2) in got and len([x for x in got if x[0] == "steady"]) == 20
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 3 * 8

    path = str(tmp_path / "requests")
    for n in range(6):
        spark.createDataFrame([(f"u{n}", 1_000_000 + n * 200_000), ("a", 1_000_000 + n * 200_000)], "key string, at long").coalesce(1).write.mode("append").parquet(path)
    q = T.stream_rate_window(T.read_stream(spark, path, "key string, at long", files=1), 2, 60, days=1).writeStream.format("memory").queryName("rate_kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.table("rate_kept").count() == 12
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1] <= 3 * 2


def test_a_lost_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.upserts_to(str(tmp_path / "none"), ["k"], ["v"])(spark.createDataFrame([(1, "x")], "k int, v string"), 5)


def test_research_queue(spark, data, tmp_path):
    """Changes are counted over batches; claims are held, given again when repeated, and finished rows go."""
    stream, batch = landed(spark, data, tmp_path)
    path, changes = str(tmp_path / "queue"), stream.select(F.col("user_id").alias("candidate_id"), F.col("ts").alias("discovered_at"))
    T.stream_research_queue(changes, path, str(tmp_path / "c"), 4).awaitTermination(120)
    want = {r["user_id"]: (r["n"], r["t"]) for r in batch.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("t")).collect()}
    assert {r["candidate_id"]: (r["n"], r["next_at"]) for r in T.pending(spark, path, 4).collect()} == want
    first = sorted(want, key=lambda k: (want[k][1], k))
    ids = lambda df: sorted(r["candidate_id"] for r in df.collect())
    now, until = "2025-01-01 00:00:00", "2025-01-01 00:06:00"
    taken = T.claim(spark, path, 0, 3, now, until, 4)
    assert ids(taken) == sorted(first[:3])
    assert ids(T.claim(spark, path, 1, 2, now, until, 4)) == sorted(first[3:5])
    assert ids(T.claim(spark, path, 2, 1, "2025-01-01 00:07:00", until, 4)) == first[:1]
    done = taken.withColumn("n", F.when(F.col("candidate_id") == first[0], F.lit(1)).otherwise(F.col("n")))
    T.complete(spark, path, 0, done, 4)
    T.complete(spark, path, 0, done, 4)
    left = {r["candidate_id"]: r["n"] for r in T.pending(spark, path, 4).collect()}
    assert left == {k: n - (k == first[0]) for k, (n, _) in want.items() if k not in first[1:3] and n - (k == first[0])}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    """Ten keys into a table of a million rewrite under a twentieth of it; a batch that runs again and a writer that died change nothing."""
    from tessera.functions.store import BucketTable

    path = str(tmp_path / "t")
    write = T.upserts_to(path, ["k"], ["v"], first="a")
    write(spark.range(1_000_000).select(F.col("id").alias("k"), F.lit("x").alias("v"), F.lit(5).alias("a")), 0)
    some = spark.createDataFrame([(k, "y", 7) for k in [*range(0, 900, 100), 2_000_000]], "k long, v string, a int")
    table = BucketTable(spark, path, ["k"])
    for _ in range(2):
        write(some, 1)
        assert table.versions() == [0, 1]
    assert spark.read.parquet(f"{path}/data/v=1").count() < 50_000
    rows = table.rows()
    assert rows.count() == 1_000_001 and sorted(map(tuple, rows.filter("v = 'y'").select("k", "a").collect())) == [*[(k, 5) for k in range(0, 900, 100)], (2_000_000, 7)]
    assert table.rows(0).count() == 1_000_000
    (tmp_path / "t/data/v=2/bucket=0").mkdir(parents=True)
    (tmp_path / "t/manifest/v=2").mkdir(parents=True)
    assert table.versions() == [0, 1]
    write(some.withColumn("v", F.lit("z")), 2)
    assert table.versions() == [0, 1, 2] and table.rows().filter("v = 'z'").count() == 10


def test_bucket_tables_keep_their_last_versions(spark, tmp_path):
    from tessera.functions.store import BucketTable, upsert

    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=4, keep=3)
    for n in range(6):
        table.apply(spark.createDataFrame([(n, f"v{n}", n), (0, f"v{n}", n)], "k int, bucket string, n int"), n, lambda old, new: upsert(old, new, ["k"], ["bucket", "n"]))
    assert table.versions() == [3, 4, 5]
    assert sorted(map(tuple, table.rows().select("k", "bucket").collect())) == [(0, "v5"), *[(k, f"v{k}") for k in range(1, 6)]]
    assert table.rows(3).count() == 4
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=8).rows()
