"""Periodic digests: ranking, diversity, frozen snapshots, calendars, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.joins import exclude_recent, latest

OPEN = ("new", "watching", "saved")


def rank_for_digest(candidates: DataFrame, evidence: DataFrame, items: DataFrame, now: str, min_score: float = 60, k: int = 20, exclude_days: int = 21) -> DataFrame:
    """The k candidates for a digest: open, scored well, in no digest of the last days; by a blend of score, momentum, confidence and
    the novelty of the newest event. Filters and the exclusion run before the evidence is joined; the end is one top-k."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max(0, min(365, exclude_days))))
    pool = candidates.filter(F.col("status").isin(*OPEN) & (F.col("score") >= max(0, min(100, min_score))))
    pool = exclude_recent(pool, items, "candidate_id", since)
    newest = latest(evidence, "candidate_id", ["discovered_at", "event_id"], ["discovered_at", "novelty"])
    x = pool.join(newest, "candidate_id", "left")
    rank = F.col("score") * 0.62 + F.greatest(F.lit(0.0), "momentum") * 0.18 + F.col("confidence") * 100 * 0.12 + F.least(F.lit(100.0), F.coalesce("novelty", F.lit(0.0))) * 0.08
    x = x.withColumn("digest_rank_score", rank).orderBy(F.desc("digest_rank_score"), F.desc_nulls_last("discovered_at"), "candidate_id")
    return x.limit(max(1, min(100, k)))


def diverse_pick(ranked: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows in order, at most max(2, ceil(n / 3)) a group; what is short is filled from the others in order. ranked is a short list."""
    most = max(2, -(-n // 3))
    x = ranked.withColumn("tier", F.when(F.row_number().over(Window.partitionBy(group).orderBy(*order)) <= most, 0).otherwise(1))
    return x.orderBy("tier", *order).limit(n)


def freeze(existing: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Snapshots by key: the first one stays."""
    fresh = snapshot.join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(fresh)


def calendar(profiles: DataFrame, first: str, last: str) -> DataFrame:
    """profile_id, period_start, period_end: the times at which each profile's digest closes, between two days.

    profiles: profile_id, days (array of 0 for Sunday to 6), hour, minute. Days out of range are dropped, hours held within 0 to 23,
    minutes within the quarters.
    """
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY")))
    minute = F.floor(F.greatest(F.lit(0), F.least(F.lit(59), "minute")) / 15) * 15
    x = profiles.select("profile_id", "days", F.greatest(F.lit(0), F.least(F.lit(23), "hour")).alias("h"), minute.alias("m"), days.alias("day"))
    x = x.filter(F.array_contains("days", F.dayofweek("day") - 1))
    x = x.withColumn("period_end", F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("h").cast("int"), F.col("m").cast("int")))
    x = x.withColumn("period_start", F.lag("period_end").over(Window.partitionBy("profile_id").orderBy("period_end")))
    return x.filter("period_start IS NOT NULL").select("profile_id", "period_start", "period_end")


def claimable(digests: DataFrame, now: str, retry_minutes: int = 720, stale_minutes: int = 15) -> DataFrame:
    """Digests to deliver: ready; failed within the retry window; sending for too long."""
    at = F.lit(now).cast("timestamp")
    age = (F.unix_timestamp(at) - F.unix_timestamp("scheduled_for")) / 60
    retry, stale = max(60, min(1380, retry_minutes)), max(5, min(60, stale_minutes))
    return digests.filter((F.col("scheduled_for") <= at) & ((F.col("status") == "ready") | ((F.col("status") == "failed") & (age <= retry)) | ((F.col("status") == "sending") & (age >= stale))))


def recipients(subscribers: DataFrame, size: int = 100) -> DataFrame:
    """email, name, batch: valid addresses in lower case, once each with the longest name, in batches. Places count within
    hash buckets, whose sizes add up, so no task sorts all subscribers."""
    low = F.lower(F.trim("email"))
    one = subscribers.filter(low.rlike("^[^@ ]+@[^@ ]+[.][^@ ]+$")).groupBy(low.alias("email")).agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"))
    x = one.withColumn("bucket", F.substring(F.md5("email"), 1, 2))
    starts = x.groupBy("bucket").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("email")) - 1
    return x.withColumn("place", place).join(F.broadcast(starts), "bucket").select("email", "name", F.floor((F.col("before") + F.col("place")) / size).alias("batch"))


def snapshot_copy(rows: DataFrame) -> DataFrame:
    """headline and summary with their fallbacks: first fact, name, a constant; joined facts."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return rows.withColumn("headline", F.coalesce(some(F.col("headline")), some(F.get("facts", 0)), some(F.col("name")), F.lit("Untitled"))).withColumn("summary", F.coalesce(some(F.col("summary")), F.array_join("facts", "\n")))
