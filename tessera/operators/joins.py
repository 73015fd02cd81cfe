"""Join shapes: newest row, existence, recency, both directions, derived keys, overlap, intervals, blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import doi_author_key
from tessera.functions.store import stored


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and the columns of its newest row by one aggregation, without a window."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def having_any(left: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return left.join(rows.select(key), key, "left_semi")


def exclude_recent(left: DataFrame, items: DataFrame, key: str, since: Column) -> DataFrame:
    """Rows without an item that neither failed nor is older than `since`."""
    return left.join(items.filter((F.col("status") != "failed") & (F.col("scheduled_for") >= since)).select(key), key, "left_anti")


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions, so a walk is an equi-join and not a nested loop over an OR. Edges are read once."""
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    both = edges.withColumn("way_", F.explode(F.array(way(a, b), way(b, a))))
    return both.select(*[F.col("way_.a").alias(x) if x == a else F.col("way_.b").alias(x) if x == b else F.col(x) for x in edges.columns])


#: No more than so many keys can each hold over 1/HOT of all rows; tables with fewer rows than FEW are joined as they are.
HOT, FEW = 256, 100_000


def many_to_one(many: DataFrame, one: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """Inner join of many rows (stored) with one row a key (stored). Keys that hold over 1/HOT of the rows are at most HOT: they are named and broadcast,
    and their rows stay where they are; the others shuffle, and none of them is large."""
    total = many.count()
    if total < (FEW if few is None else few):
        return many.join(one, key)
    hot = [r[0] for r in many.groupBy(key).count().filter(F.col("count") * HOT > total).select(key).collect()]
    if not hot:
        return many.join(one, key)
    named = F.col(key).isin(hot)
    return many.filter(named).join(F.broadcast(one.filter(named)), key).unionByName(many.filter(~named).join(one.filter(~named), key))


def unique_match(events: DataFrame, runs: DataFrame, event_key: str, at: str, started: str, run_key: str) -> DataFrame:
    """(event_key, run_key) of events whose time is the start of exactly one run."""
    single = runs.groupBy(started).agg(F.count("*").alias("n"), F.min(run_key).alias(run_key)).filter("n = 1")
    return events.join(single, F.col(at) == F.col(started)).select(event_key, run_key)


def share_any(left: DataFrame, right: DataFrame, key: str, other: str, values: str) -> DataFrame:
    """Distinct (key, other) that have a value in common.

    Keys of the same set of values are one class. Classes meet by an equi-join on values, and a pair of them only under its least
    common value, so it is made once; members follow by joins. No pair of keys is shuffled: the last join puts them out.
    """

    def classes(df: DataFrame, name: str, prefix: str) -> tuple[DataFrame, DataFrame]:
        own = df.select(name, F.explode(values).alias("v")).groupBy(name).agg(F.sort_array(F.collect_set("v")).alias("set"))
        own = stored(own.filter("size(set) > 0"), "value-sets")
        sets = stored(own.select("set").distinct().withColumn("class", F.monotonically_increasing_id()), "value-classes")
        return own.join(sets, "set").select(name, F.col("class").alias(f"{prefix}_class")), sets.select(F.col("class").alias(f"{prefix}_class"), F.col("set").alias(f"{prefix}_set"), F.explode("set").alias("v"))

    (a, a_sets), (b, b_sets) = classes(left, key, "a"), classes(right, other, "b")
    met = a_sets.join(b_sets, "v").filter(F.array_min(F.array_intersect("a_set", "b_set")) == F.col("v")).select("a_class", "b_class")
    return met.join(a, "a_class").join(b, "b_class").select(key, other)


def link_authorships(left: DataFrame, right: DataFrame, doi: str = "doi", place: str = "place") -> DataFrame:
    """Rows of two indexes that name the same author of the same work, by work and place; names take no part."""
    key = lambda df: df.withColumn("authorship", doi_author_key(doi, place)).drop(doi, place).filter("authorship IS NOT NULL")
    return key(left).join(key(right), "authorship")


def in_period(events: DataFrame, periods: DataFrame, at: str) -> DataFrame:
    """Events with the period (start, end] they fall in. Both sides carry the day, so the range is checked within a day only."""
    days = F.explode(F.sequence(F.to_date("period_start"), F.to_date("period_end"), F.expr("INTERVAL 1 DAY")))
    p = periods.withColumn("day", days)
    e = events.withColumn("day", F.to_date(at))
    return e.join(p, "day").filter((F.col(at) > F.col("period_start")) & (F.col(at) <= F.col("period_end"))).drop("day")


def block(observations: DataFrame, identities: DataFrame, keys: dict[str, int | None]) -> DataFrame:
    """Candidate pairs (observation_id, identity_id) from one equi-join a blocking key; a key's bound keeps its first identities
    of each value by id."""
    out = None
    for key, most in keys.items():
        side = identities.select(F.col(key), "identity_id").filter(F.col(key).isNotNull())
        if most is not None:
            side = side.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("identity_id"))).filter(F.col("place") <= most).drop("place")
        pairs = observations.select(key, "observation_id").join(side, key).select("observation_id", "identity_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()
