"""Rules over evidence and claims: contact routes, characteristics, agency, releases, due sources, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import host_of, private_address, term_match
from tessera.operators.windows import cap_per_group, first_of

#: Kinds of contact routes in order of preference.
ROUTES = ("email", "website", "linkedin", "github", "x")


def contact_routes(routes: DataFrame, most: int = 12) -> DataFrame:
    """Routes (candidate_id, kind, url, verified, confidence, stage) that may be used; adds place, 1 for the preferred one.

    Only verified routes of 0.85 and more with a public http(s) or a plain mailto address; a stage that reads like a
    minor's loses its direct routes, always. The surest row of each URL stays.
    """
    plain = F.col("url").rlike("^mailto:[^@ ?]+@[^@ ?]+[.][a-z]+$")
    public = F.col("url").rlike("^https?://") & host_of("url").isNotNull() & ~private_address("url")
    minor = F.lower("stage").rlike("school|minor|teen|under 18")
    ok = routes.filter(F.col("verified") & (F.col("confidence") >= 0.85) & F.when(F.col("kind") == "email", plain & ~minor).otherwise(public))
    one = first_of(ok, ["candidate_id", "url"], [F.desc("confidence"), F.asc("kind")])
    order = [F.array_position(F.array(*map(F.lit, ROUTES)), F.col("kind")), F.desc("confidence"), F.asc("url")]
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order)))
    return placed.filter(F.col("place") <= most)


#: Verbs of a claim, by root.
AGENCY = {"found": "found(ed|er|ing)?", "lead": "le(d|ad|ads|ading|ader)", "build": "buil(t|d|ds|ding|der)", "win": "(won|win|wins|winner|winning)"}


def unsupported_agency(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fact_id, root): verbs of agency in a fact without the same root in the evidence it cites. facts: fact_id, fact, event_id."""
    cited = facts.join(evidence.select("event_id", F.col("text").alias("own")), "event_id", "left").groupBy("fact_id").agg(F.first("fact").alias("fact"), F.array_join(F.sort_array(F.collect_list(F.lower(F.coalesce("own", F.lit("")))) ), " ").alias("own"))
    bad = [F.when(F.lower("fact").rlike(f"\\b{p}\\b") & ~F.col("own").rlike(f"\\b{p}\\b"), root) for root, p in AGENCY.items()]
    return cited.select("fact_id", F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("root"))


def characteristics(evidence: DataFrame, rules: list[dict]) -> DataFrame:
    """(candidate_id, rule, matched, n): terms found in enough evidence, for a short list of rules (name, terms, least). One aggregation for all."""
    hits = evidence.groupBy("candidate_id").agg(*[F.count_if(term_match("text", r["terms"])).alias(r["name"]) for r in rules])
    rows = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("rule"), (F.col(r["name"]) >= r["least"]).alias("matched"), F.col(r["name"]).alias("n")) for r in rules]))
    return hits.select("candidate_id", rows.alias("r")).select("candidate_id", "r.*")


def release_brief(failures: DataFrame, evidence: DataFrame, now: str) -> DataFrame:
    """candidate_id, retry_at: after 24 hours, 6 hours or never, by kind of failure; at once where newer substantive evidence is in."""
    at = F.lit(now).cast("timestamp")
    wait = F.when(F.col("kind") == "generation", at + F.expr("INTERVAL 24 HOURS")).when(F.col("kind") == "transient", at + F.expr("INTERVAL 6 HOURS")).otherwise(F.lit("9999-01-01 00:00:00").cast("timestamp"))
    fresh = evidence.groupBy("candidate_id").agg(F.max("discovered_at").alias("newest"))
    x = failures.join(fresh, "candidate_id", "left")
    return x.select("candidate_id", F.when(F.col("newest") > F.col("failed_at"), at).otherwise(wait).alias("retry_at"))


def due_sources(sources: DataFrame, now: str, n: int = 10, lease_minutes: int = 15) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    due = sources.filter(F.col("enabled") & (F.col("state") == "active") & (F.col("due_at") <= at)).orderBy("due_at", "source_id").limit(n)
    return due.withColumn("lease_until", at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max(1, min(120, lease_minutes)))))


def equivalent_citations(evidence: DataFrame, most: int = 2) -> DataFrame:
    """(event_id, other): for each event the first of the same folded title from another host, so a fact can cite both."""
    x = evidence.select("event_id", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ").alias("work"), host_of("source_url").alias("host"))
    firsts = cap_per_group(x.groupBy("work", "host").agg(F.min("event_id").alias("other")), ["work"], [F.asc("other")], most)
    pairs = x.join(firsts.withColumnRenamed("host", "other_host"), "work").filter("host <> other_host")
    return pairs.groupBy("event_id").agg(F.min("other").alias("other"))
