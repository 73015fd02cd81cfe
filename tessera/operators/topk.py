"""Work queues and ranked lists: every one a computed order and a top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import publisher_host
from tessera.operators.scoring import accepted_licensed, event_priority


def _counted(*passive: str):
    return ~F.col("type").isin("social_graph_signal", "identity_observed", *passive) & (F.col("confidence") >= 0.65) & accepted_licensed()


def prioritize_events(evidence: DataFrame, limit: int = 400) -> DataFrame:
    return evidence.withColumn("priority", event_priority()).orderBy(F.desc("priority"), "event_id").limit(max(1, min(1000, limit)))


def work_signals(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("candidate_id").agg(F.max(F.col("tag") == "manual-roster-deep-dive").alias("deep"), F.count_distinct(F.when(_counted("profile_observed"), publisher_host("source_url"))).alias("publishers"), F.max("discovered_at").alias("latest"))


def due_brief_work(candidates: DataFrame, evidence: DataFrame, now: str, n: int = 30, lease_s: int = 300) -> DataFrame:
    pool = candidates.filter("status <> 'archived' AND resolution = 'resolved'").join(work_signals(evidence), "candidate_id").filter("publishers >= 1")
    x = pool.orderBy(F.desc("deep"), F.desc(F.col("publishers") >= 2), F.desc("score"), F.desc("latest"), "candidate_id").limit(max(1, min(50, n)))
    return x.withColumn("lease_until", F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max(60, min(1800, lease_s)))))


def due_enrichment_work(candidates: DataFrame, evidence: DataFrame, minimum: float, n: int = 5) -> DataFrame:
    """Deep dives first, then those one source short of the queue, fewest attempts, best score, fewest sources."""
    pool = candidates.filter("status <> 'archived'").join(work_signals(evidence), "candidate_id")
    near = (F.col("publishers") < 2) & (F.col("score") >= max(10.0, 0.65 * minimum))
    return pool.orderBy(F.desc("deep"), F.desc(near), F.least(F.lit(3), "attempts"), F.desc("score"), "publishers", "candidate_id").limit(max(1, min(20, n)))


def complete_enrichment(attempts: DataFrame, now: str) -> DataFrame:
    """candidate_id, attempts, next_at: at once if a newer revision waits, else after 4 hours, 7 days or 30 days."""
    tries = F.col("attempts") + 1
    hours = F.when(F.col("input_revision") > F.col("completed_revision"), 0).when(tries < 3, 4).when(F.col("found") > 0, 168).otherwise(720)
    return attempts.select("candidate_id", tries.alias("attempts"), (F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("next_at"))


def operator_queue(candidates: DataFrame, evidence: DataFrame, now: str, n: int = 24) -> DataFrame:
    s = evidence.groupBy("candidate_id").agg(F.max("discovered_at").alias("latest"), F.max("confidence").alias("strongest"), F.count_distinct(F.when(_counted(), publisher_host("source_url"))).alias("publishers"))
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 86400
    rank = 0.67 * F.col("score") + 0.16 * 100 * F.greatest(F.lit(0.0), 1 - days / 60) + 0.10 * F.col("strongest") * 100 + 0.07 * F.least(F.lit(100), 35 * F.col("publishers"))
    return candidates.join(s, "candidate_id").withColumn("rank", rank).orderBy(F.desc("rank"), "candidate_id").limit(n)


ORDERS = {"score": ["-score", "candidate_id"], "recent": ["-last_seen", "-score", "candidate_id"], "undiscovered": ["confidence", "-score", "candidate_id"]}


def people_sorted(candidates: DataFrame, mode: str, n: int) -> DataFrame:
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[mode]]
    top = candidates.orderBy(*order).limit(n)  # numbered after the cut, so one small sort
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def review_shortlist(candidates: DataFrame, fresh: DataFrame, n: int) -> DataFrame:
    """The unscored backlog first, oldest first, then the ranked ones, no one twice."""
    ranked = candidates.join(fresh.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", F.lit(1).alias("tier"), (-F.col("score")).alias("o"))
    both = fresh.select("candidate_id", F.lit(0).alias("tier"), F.col("candidate_id").cast("double").alias("o")).unionByName(ranked)
    return both.orderBy("tier", "o", "candidate_id").limit(n)


def project_locators(evidence: DataFrame, n: int = 3) -> DataFrame:
    best = evidence.filter("type = 'project_created'").groupBy("candidate_id", "source_url").agg(F.max(2 * F.col("complexity") + F.log1p("momentum") / 5).alias("strength"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("strength"), "source_url"))).filter(F.col("place") <= n)
