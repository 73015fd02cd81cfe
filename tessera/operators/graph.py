"""Relationship graphs: edges, support, components, frontiers and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.store import stored
from tessera.operators.aggregates import graph_support
from tessera.operators.joins import many_to_one, undirected
from tessera.operators.windows import cap_per_group, first_of

#: What makes graph evidence strong enough for a candidate.
STRONG, COAUTHOR, COLLABORATION, ENGAGEMENT = 0.78, 0.34, 0.9, 0.72


def collaboration_edges(contributions: DataFrame, most: int = 12) -> DataFrame:
    """(repo, a, b, weight): contributors of a repository by commits, with its owner; bots and the owner left out."""
    real = contributions.filter(~F.lower("contributor").rlike("bot(\\])?$") & (F.col("contributor") != F.col("owner")))
    top = cap_per_group(real, ["repo"], [F.desc("commits"), F.asc("contributor")], most)
    weight = F.least(F.lit(0.82), 0.42 + 0.2 * F.log10(F.col("commits") + 1))
    return top.select("repo", F.col("owner").alias("a"), F.col("contributor").alias("b"), F.round(weight, 6).alias("weight"))


def follow_edges(follows: DataFrame) -> DataFrame:
    return follows.withColumn("weight", F.when(F.col("provider") == "x", 0.4).otherwise(0.25))


def reply_edges(posts: DataFrame) -> DataFrame:
    """(thread, a, b, weight): replies to another author's post; long ones weigh more."""
    parents = posts.select("thread", F.col("post").alias("parent"), F.col("author").alias("b"))
    weight = F.when(F.length("text") >= 180, 0.22).otherwise(0.16)
    return posts.join(parents, ["thread", "parent"]).filter("author <> b").select("thread", "post", F.col("author").alias("a"), "b", weight.alias("weight"))


def support_dedup(edges: DataFrame) -> DataFrame:
    """The strongest edge of each source, target, relation and URL."""
    return first_of(edges, ["source_id", "target_id", "relation", "source_url"], [F.desc("weight"), F.asc("observed_at")])


def graph_candidates(edges: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Targets with enough independent or strong support, with a bounded confidence; by support."""
    s = graph_support(support_dedup(edges), key)
    two, strong = F.col("sources") >= 2, F.col("strongest") >= STRONG
    co, col, eng = F.col("coauthor") >= COAUTHOR, F.col("collaboration") >= COLLABORATION, F.col("engagement") >= ENGAGEMENT
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    confidence = F.lit(0.58) + flag(two, 0.07 + F.least(F.lit(0.05), (F.col("sources") - 2) * 0.02)) + flag(strong, 0.08) + flag(co, 0.07) + flag(col, 0.06) + flag(eng, 0.04) + F.least(F.lit(0.04), (F.size("relations") - 1) * 0.02)
    x = s.filter(two | strong | co | col | eng).withColumn("confidence", F.least(F.lit(0.82), F.round(confidence, 3)))
    return x.orderBy(F.desc(F.round("support", 6)), F.desc("confidence"), key).limit(max(1, min(100, most)))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes of edges (a, b): the least id reachable.

    Each round hooks every node to its least neighbour, follows the hooks to their roots (their length halves with each step), and contracts the edges to
    edges between roots, until none is left: the nodes that still have edges at least halve, so rounds grow with the logarithm. A node with a large part
    of all edges, or a root with a large part of all nodes, stays in place (many_to_one). All steps are stored.
    """
    left = stored(edges.select("a", "b").filter("a <> b").distinct(), "graph-edges")
    levels = []
    while left.limit(1).count():
        hooks = undirected(left, "a", "b").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
        roots = stored(hooks.select("id", F.least("id", "least").alias("label")), "hooks")
        while True:
            further = stored(many_to_one(roots, roots.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label"), F.col("label").alias("was")), "hooks")
            roots = further.select("id", "label")
            if not further.filter("label <> was").limit(1).count():
                break
        levels.append(roots)
        for side in ("a", "b"):
            left = stored(many_to_one(left, roots.select(F.col("id").alias(side), F.col("label").alias("root")), side).drop(side).withColumnRenamed("root", side), "graph-edges")
        left = stored(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    if not levels:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = levels[0]
    for roots in levels[1:]:
        up = roots.select(F.col("id").alias("label"), F.col("label").alias("root"))
        moved = many_to_one(labels, up, "label").select("id", F.col("root").alias("label"))
        labels = stored(labels.join(up.select("label"), "label", "left_anti").select("id", "label").unionByName(moved), "labels")
    return labels


def expand_frontier(seeds: DataFrame, edges: DataFrame, depth: int = 2, nodes: int = 1000, per_seed: int = 60) -> DataFrame:
    """(id, depth) reached from seeds (id), breadth first. A node's strongest edges count up to per_seed; a target is taken further only over a strong
    edge, from two sources or with enough weight in all; a layer has at most `nodes` nodes."""
    seen, frontier = seeds.select("id", F.lit(0).alias("depth")), seeds.select("id")
    for layer in range(1, min(3, depth) + 1):
        out = edges.join(frontier, F.col("source_id") == F.col("id")).drop("id")
        capped = cap_per_group(out, ["source_id"], [F.desc("weight"), F.asc("target_id"), F.asc("relation"), F.asc("source_url"), F.asc("observed_at")], per_seed)
        targets = capped.groupBy(F.col("target_id").alias("id")).agg(F.max("weight").alias("strongest"), F.count_distinct("source_id").alias("sources"), F.sum("weight").alias("weight"))
        new = targets.join(seen.select("id"), "id", "left_anti").orderBy(F.desc(F.round("weight", 6)), "id").limit(nodes)
        seen = seen.unionByName(new.select("id", F.lit(layer).alias("depth")))
        frontier = new.filter((F.col("strongest") >= 0.6) | (F.col("sources") >= 2) | (F.col("weight") >= 0.9)).select("id")
    return seen


def neighbors(edges: DataFrame, start: int, depth: int = 2, n: int = 100) -> DataFrame:
    """(id, depth, strength) around a node over edges (a, b, weight) in both directions: shortest distance, and the best of the paths' weakest edges at it.

    A layer keeps one row a node, so paths are never listed.
    """
    both = undirected(edges.select("a", "b", "weight"), "a", "b").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    layer = both.sparkSession.range(start, start + 1).select("id", F.lit(0).alias("depth"), F.lit(1e9).alias("strength"))
    seen = layer
    for d in range(1, min(4, depth) + 1):
        step = layer.join(both, F.col("id") == F.col("a")).groupBy("b").agg(F.max(F.least("strength", "weight")).alias("strength"))
        layer = step.withColumnRenamed("b", "id").join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "strength")
        seen = seen.unionByName(layer)
    return seen.filter("depth > 0").orderBy("id").limit(n)


def merge_component_person(people: DataFrame, key: str = "component") -> DataFrame:
    """One person a component: the fields of its most complete observation, and the verified identities of all, e-mail left out.

    people: key, name, headline, biography, website, location, affiliations, identities (array of provider, subject, verified), source_url, and
    avatar_url and career_stage where there are such columns (else null).
    """
    people = people.withColumns({c: F.lit(None).cast("string") for c in ("avatar_url", "career_stage") if c not in people.columns})
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    none = F.array().cast("array<string>")
    complete = F.size("identities") * 4 + some("headline") * 2 + some("biography") * 2 + some("website") * 2 + some("location") + F.size(F.coalesce("affiliations", none))
    fields = F.struct("name", "headline", "biography", "website", "location", "affiliations", "avatar_url", "career_stage", "source_url")
    base = people.groupBy(key).agg(F.min_by(fields, F.struct(-complete, F.col("name"), F.col("source_url"))).alias("b"), F.count("*").alias("observations"))
    known = people.select(key, F.explode("identities").alias("i")).filter(F.col("i.verified") & (F.col("i.provider") != "email") & F.col("i.subject").isNotNull())
    one = known.select(key, F.lower("i.provider").alias("provider"), F.lower("i.subject").alias("subject")).distinct()
    named = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("provider", "subject"))).alias("identities"))
    return base.join(named, key, "left").select(key, "b.*", F.coalesce("identities", F.array().cast("array<struct<provider:string,subject:string>>")).alias("identities"), "observations")
