"""Aggregations over evidence, edges and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import publisher_host
from tessera.functions.store import ROWS, stored, tasks


def evidence_fingerprint(evidence: DataFrame, key: str, policy: str) -> DataFrame:
    """MD5 over the content hashes in order of discovery, the newest discovery and the count."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("discovered_at", "event_id", "content_hash"))), lambda x: x["content_hash"])
    return evidence.groupBy(key).agg(F.md5(F.concat(F.lit(f"{policy}|"), F.array_join(ordered, ""))).alias("fingerprint"), F.max("discovered_at").alias("latest"), F.count("*").alias("n"))


def dominant_publisher(evidence: DataFrame, key: str) -> DataFrame:
    """The most frequent host a key, the first in order of letters on ties."""
    counts = evidence.groupBy(key, publisher_host("source_url").alias("host")).agg(F.count("*").alias("n")).filter("host IS NOT NULL")
    return counts.groupBy(key).agg(F.min_by(F.struct("host", "n"), F.struct(-F.col("n"), F.col("host"))).alias("r")).select(key, "r.host", "r.n")


def facet_counts(candidates: DataFrame, evidence: DataFrame, most: int = 12) -> DataFrame:
    """facet, value, n: case-folded values by count, `most` a facet; one grouping over a union of narrow facets."""
    plain = [candidates.select(F.lit(f).alias("facet"), "candidate_id", F.col(f).alias("label")) for f in ("status", "stage", "location")]
    seen = [evidence.select(F.lit(name).alias("facet"), "candidate_id", F.col(c).alias("label")).distinct() for name, c in (("event_type", "type"), ("source", "source"))]
    counts = reduce(DataFrame.unionByName, plain + seen).groupBy("facet", F.lower("label").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("place") <= most).drop("place")


def dashboard_metrics(candidates: DataFrame, evidence: DataFrame, now: str) -> DataFrame:
    a = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("score") >= 80).alias("strong"), F.count_if(F.col("resolution") != "resolved").alias("unresolved"))
    week = F.col("discovered_at") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return a.crossJoin(F.broadcast(evidence.agg(F.count_distinct("source").alias("sources"), F.count_if(week).alias("fresh"))))


def graph_support(edges: DataFrame, key: str) -> DataFrame:
    """What supports each key: sources, links, weights by relation. Edges are added up by source first, and links counted on their own,
    so nothing is expanded for a distinct count and a hot key is spread over its sources."""
    weight = lambda *r: F.coalesce(F.sum(F.when(F.col("relation").isin(*r), F.greatest(F.lit(0.0), "weight"))), F.lit(0.0))
    by_source = edges.groupBy(key, "source_id").agg(
        F.max("weight").alias("strongest"), F.sum(F.least(F.lit(1.0), "weight")).alias("support"), weight("coauthors_with").alias("coauthor"),
        weight("collaborates_with", "contributes_to").alias("collaboration"), weight("engages_with").alias("engagement"), F.collect_set("relation").alias("relations"), F.max("observed_at").alias("latest"),
    )
    sums = [F.sum(c).alias(c) for c in ("support", "coauthor", "collaboration", "engagement")]
    # A key has as many sets of relations as sources, but few different ones.
    relations = F.sort_array(F.array_distinct(F.flatten(F.collect_set("relations"))))
    out = by_source.groupBy(key).agg(F.count("source_id").alias("sources"), F.max("strongest").alias("strongest"), *sums, relations.alias("relations"), F.max("latest").alias("latest"))
    links = edges.select(key, "source_url").distinct().groupBy(key).agg(F.count("source_url").alias("links"))
    return out.join(links, key)


def coauthor_edges(works: DataFrame, block: int = 500) -> DataFrame:
    """(a, b, weight) of authors of common works: 0.18 a work, 1 at most.

    A work's authors are dealt into blocks of about `block`, and each pair of blocks meets under a key of its own, so no task holds
    all pairs of a large work; works of one block meet once. Tasks are as many as rows and pairs ask for.
    """
    authors = works.repartition(tasks(works.sparkSession, works.count()), "work").distinct()
    sizes = authors.groupBy("work").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1")
    dealt = stored(authors.join(sizes, "work").withColumn("own", F.pmod(F.xxhash64("author"), F.col("blocks")).cast("int")), "authors")
    rows, pairs, names = dealt.agg(F.sum("blocks"), F.sum((F.col("n") - 1) / 2), F.count_distinct("author")).first()
    x = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    left, right = (x.select("work", "i", "j", F.col("author").alias(c), F.col("own").alias(f"{c}_own")).repartition(tasks(works.sparkSession, rows), "work", "i", "j") for c in ("a", "b"))
    # Under a key of two blocks, pairs within one of them are left to that block's own key.
    met = left.join(right, ["work", "i", "j"]).filter("a < b AND (i = j OR a_own <> b_own)").select("a", "b")
    groups = min(pairs or 0, names**2 / 2)
    if groups > ROWS * int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        met = met.repartition(tasks(works.sparkSession, groups), "a", "b")
    return met.groupBy("a", "b").agg(F.round(F.least(F.lit(1.0), 0.18 * F.count("*")), 6).alias("weight"))


def edge_upsert(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_id", "target_id", "relation").agg(F.count("*").alias("evidence_count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.round(F.max_by("weight", F.struct("observed_at", "weight")), 6).alias("strength"))


def research_trigger(changes: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """One pending revision per changed candidate, however many rows changed."""
    c = changes.groupBy("candidate_id").agg(F.count("*").alias("n"), F.min("discovered_at").alias("first_change"))
    at = F.lit(now).cast("timestamp")
    return state.join(c, "candidate_id").select("candidate_id", F.greatest("input_revision", F.col("completed_revision") + 1).alias("revision"), F.least(F.coalesce("first_change", at), at).alias("next_at"), "n")
