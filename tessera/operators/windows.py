"""What ranks, counts and caps within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return cap_per_group(rows, keys, order, 1)


def cap_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place_") <= n).drop("place_")


def dedup_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """One row a key: the surest, the earliest on ties."""
    return first_of(evidence, [key], [F.desc("confidence"), F.asc("event_id")])


def interleave(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first of every group, then the second, and so on, up to `most`; adds turn."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", group).limit(most)


def fixed_window_counter(requests: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """Requests with their window, whether they are allowed, what remains and when to retry."""
    epoch = F.unix_timestamp(at)
    start = F.floor(epoch / seconds) * seconds
    n = F.row_number().over(Window.partitionBy(key, start).orderBy(at, "event_id"))
    x = requests.withColumn("window_start", start).withColumn("n", n)
    return x.withColumn("allowed", F.col("n") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("n"))).withColumn("retry_after", F.when(F.col("n") > limit, F.col("window_start") + seconds - epoch).otherwise(0))


def rotate(rows: DataFrame, group: str, order: list[Column], turn: int) -> DataFrame:
    """Places within groups, shifted by the pass so that each pass begins elsewhere."""
    w = Window.partitionBy(group)
    n, place = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    return rows.withColumn("place", (place - 1 + n - F.lit(turn) % n) % n)


def active_version(criteria: DataFrame, scope: str) -> DataFrame:
    """Versions numbered in order of creation; the newest is active, the others retired."""
    w = Window.partitionBy(scope)
    version = F.row_number().over(w.orderBy("created_at", "criterion_id"))
    return criteria.withColumn("version", version).withColumn("state", F.when(F.col("version") == F.count("*").over(w), "active").otherwise("retired"))
