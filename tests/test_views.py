"""Briefs: the ways to pick facts agree, with each other and with a plain greedy pick."""

import random
import re

from tessera.operators import views


def test_briefs_of_small_and_large_groups(spark):
    r = random.Random(3)
    vocabulary = ["river", "stone", "window", "garden", "market", "silver", "winter", "an", "of", "it"]
    rows = [(c, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 6))), float(r.randrange(5))) for c in range(6) for _ in range(60)]
    facts = spark.createDataFrame(rows, "candidate_id long, fact string, strength double")
    got = [sorted(map(tuple, views.operator_brief(facts, group=g).collect())) for g in (10_000, 0)]
    want = []
    for c in range(6):
        best = {}
        for k, f, s in rows:
            if k == c:
                best[f] = max(s, best.get(f, s))
        kept = []
        for f in sorted(best, key=lambda f: (-best[f], f)):
            w = {x for x in re.split("[^a-z0-9]+", f) if len(x) > 3}
            if len(kept) < 3 and not any(w and s and len(w & s) / min(len(w), len(s)) >= 0.72 for _, s in kept):
                kept.append((f, w))
        want += [(c, n + 1, f) for n, (f, _) in enumerate(kept)]
    assert got[0] == got[1] == want


def test_pages_of_large_candidates(spark):
    from pyspark.sql import functions as F

    rows = [(1, f"2024-01-{d:02d} {h:02d}:30:00", 100 * d + h, "t", "u") for d in (1, 2, 3) for h in range(10)] + [(2, "2024-01-01 00:00:00", 1, "t", "u"), (1, None, 5, "t", "u")]
    evidence = spark.createDataFrame(rows, "candidate_id long, discovered_at string, event_id long, type string, source_url string").withColumn("discovered_at", F.col("discovered_at").cast("timestamp"))
    candidates = spark.createDataFrame([(1,), (2,), (3,)], "candidate_id long")
    whole = {r["candidate_id"]: r for r in views.hydrate(candidates, evidence).collect()}
    assert {k: (r["page"], len(r["events"] or [])) for k, r in whole.items()} == {1: (0, 31), 2: (0, 1), 3: (0, 0)}
    paged = sorted(((r["page"], r["events"]) for r in views.hydrate(candidates, evidence, page=8).filter("candidate_id = 1").collect()), key=lambda x: x[0])
    assert [len(e) for _, e in paged] == [8, 8, 8, 7]
    assert [e for _, p in paged for e in p] == whole[1]["events"]


def test_large_candidates_equal_their_sql(spark, data, tmp_path):
    """A candidate of over a page of events has one row with all of them, newest first, in the query and in its SQL."""
    import duckdb
    from pyspark.sql import functions as F

    from tessera.plans import catalog

    n = views.PAGE * 2 + 500
    events = spark.range(n).select(F.col("id").alias("event_id"), (F.lit("2024-01-03 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{7}").alias("props"))
    few = spark.range(n, n + 60).select(F.col("id").alias("event_id"), F.lit("2024-01-01 07:00:00").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{7}").alias("props"))
    customer = spark.range(200).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("m").alias("c_mktsegment"))
    for name, df in (("events", events.unionByName(few)), ("customer", customer), ("nation", spark.read.parquet(f"{data}/nation.parquet"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in ("events", "customer", "nation"):
        c.execute(f"create view {name} as select * {'replace (CAST(ts AS TIMESTAMP) AS ts)' if name == 'events' else ''} from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted((r["candidate_id"], r["n"], r["ids"]) for r in catalog.QUERIES["p08_hydrate"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(catalog.ORACLES["p08_hydrate"]).fetchall())
    assert sorted(r[1] for r in got if r[1]) == [60, n] and len(got) == 200
    assert max(got, key=lambda r: r[1])[2] == ",".join(str(i) for i in reversed(range(n)))
