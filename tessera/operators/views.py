"""Projections: cards, documents, merged profiles, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import first_sentence, fold_name, words
from tessera.functions.store import ship, stored


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.82, "high").when(x >= 0.58, "medium").otherwise("low")


def search_document(candidates: DataFrame, evidence: DataFrame, events: int = 30, most: int = 24_000) -> DataFrame:
    """candidate_id, text: name, location, stage and its newest events, cut to `most` characters."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc("discovered_at"), F.desc("event_id"))
    top = evidence.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= events)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(": ", "type", "title").alias("line")))), lambda x: x["line"])
    e = top.groupBy("candidate_id").agg(F.array_join(lines, ". ").alias("events"))
    return candidates.join(e, "candidate_id", "left").select("candidate_id", F.substring(F.concat_ws("\n", "name", "location", "stage", "events"), 1, most).alias("text"))


def people_view(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cards: last activity, distinct types and sources, and whether the identity needs a warning."""
    e = evidence.groupBy("candidate_id").agg(F.max(F.coalesce("occurred_at", "discovered_at")).alias("last_activity"), F.count_distinct("type").alias("types"), F.count_distinct("source").alias("sources"))
    warning = (F.col("resolution") != "resolved") | (F.col("confidence") < 0.72)
    return candidates.join(e, "candidate_id").select("candidate_id", "last_activity", "types", "sources", warning.alias("warning"))


def fallback_summary(evidence: DataFrame) -> DataFrame:
    """The newest event's title, how many pages stand behind it, and a band by the weakest and strongest evidence."""
    x = evidence.groupBy("candidate_id").agg(F.max_by("title", F.struct("discovered_at", "event_id")).alias("headline"), F.least(F.lit(12), F.count_distinct("source_url")).alias("links"), F.every(F.col("confidence") >= 0.85).alias("all_sure"), F.some(F.col("confidence") < 0.65).alias("some_weak"))
    return x.select("candidate_id", "headline", "links", F.when(F.col("all_sure"), "high").when(F.col("some_weak"), "low").otherwise("medium").alias("band"))


def signal_type(type_: Column) -> Column:
    return F.when(type_ == "paper_published", "research").when(type_.isin("project_created", "project_momentum", "open_source_contribution"), "building").when(type_.isin("competition_result", "hackathon_result", "fellowship_or_grant"), "achievement").when(type_ == "social_graph_signal", "network").otherwise("other")


def event_rollup(evidence: DataFrame, metrics: list[str]) -> DataFrame:
    """event_id, metrics above 0 as name=value pairs in order of name."""
    pairs = F.map_filter(F.create_map(*[x for m in sorted(metrics) for x in (F.lit(m), F.col(m))]), lambda k, v: v > 0)
    text = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 2).cast("string"))), ";")
    return evidence.select("event_id", text.alias("metrics"))


#: Events in an array; those of a candidate with more are dealt into pages.
PAGE = 10_000


def hydrate(candidates: DataFrame, evidence: DataFrame, page: int = PAGE) -> DataFrame:
    """Candidates with their events, newest first, as an array of structs.

    A candidate has one row, with page 0, unless it has over `page` events. Then it has a row a page: pages go back in time and are cut
    between hours, so one holds less than `page` events and an hour's more. Only such candidates' hours are counted up.
    """
    hour = F.date_trunc("hour", "discovered_at").alias("hour")
    hours = evidence.groupBy("candidate_id", hour).agg(F.count("*").alias("n"))
    large = hours.groupBy("candidate_id").agg(F.sum("n").alias("all")).filter(F.col("all") > page).select("candidate_id")
    upto = F.sum("n").over(Window.partitionBy("candidate_id").orderBy(F.desc("hour")))
    pages = hours.join(large, "candidate_id").select("candidate_id", F.col("hour").alias("hour_"), F.floor((upto - F.col("n")) / page).cast("int").alias("page"))
    e = evidence.select("candidate_id", "discovered_at", "event_id", "type", "source_url", hour)
    dealt = e.join(pages.withColumnRenamed("candidate_id", "large_"), (F.col("candidate_id") == F.col("large_")) & F.col("hour").eqNullSafe(F.col("hour_")), "left")
    newest = F.sort_array(F.collect_list(F.struct("discovered_at", "event_id", "type", "source_url")), asc=False)
    events = dealt.groupBy("candidate_id", F.coalesce("page", F.lit(0)).alias("page")).agg(newest.alias("events"))
    return candidates.join(events, "candidate_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def slugify(name: Column, key: Column) -> Column:
    """The folded name with dashes, 54 characters at most, and eight digits of the key's hash."""
    return F.concat(F.regexp_replace(F.substring(F.regexp_replace(fold_name(name), " ", "-"), 1, 54), "-+$", ""), F.lit("-"), F.substring(F.md5(key.cast("string")), 1, 8))


def merge_profile(current: DataFrame, observed: DataFrame, most: int = 12) -> DataFrame:
    """What is known stays; gaps are filled; affiliations unite, known ones first."""
    o = observed.select("person_id", *[F.col(c).alias(f"o_{c}") for c in ("headline", "location", "affiliations")])
    x = current.join(o, "person_id", "full_outer")
    none = F.array().cast("array<string>")
    both = F.slice(F.array_union(F.coalesce("affiliations", none), F.coalesce("o_affiliations", none)), 1, most)
    return x.select("person_id", F.coalesce("headline", "o_headline").alias("headline"), F.coalesce("location", "o_location").alias("location"), both.alias("affiliations"))


def merge_trusted(current: DataFrame, observed: DataFrame) -> DataFrame:
    """person_id, name, website, conflict: a trusted name replaces only a handle; another website is a conflict and never rebound."""
    x = current.join(observed.select("person_id", F.col("name").alias("o_name"), F.col("website").alias("o_website")), "person_id", "left")
    handle = ~F.contains("name", F.lit(" "))
    return x.select("person_id", F.when(handle & F.col("o_name").isNotNull(), F.col("o_name")).otherwise(F.col("name")).alias("name"), F.coalesce("website", "o_website").alias("website"), F.coalesce((F.col("website") != F.col("o_website")), F.lit(False)).alias("conflict"))


#: The status that a reviewer's action leads to.
STATUS_OF = {"accept": "saved", "save": "saved", "watch": "watching", "contact": "contacted", "pass": "passed"}


def status_from_actions(feedback: DataFrame) -> DataFrame:
    last = feedback.groupBy("candidate_id").agg(F.max_by("action", F.struct("created_at", "feedback_id")).alias("action"))
    return last.select("candidate_id", F.coalesce(*[F.when(F.col("action") == a, s) for a, s in STATUS_OF.items()]).alias("status"))


def brief_issues(briefs: DataFrame, known: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """(brief_id, issue) of briefs that break the contract: number of lines, bullets, lengths, citations there and known."""
    lines = briefs.select("brief_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    cited = lines.select("brief_id", "i", F.explode(F.regexp_extract_all("line", F.lit("\\((https?://[^)]+)\\)"), 1)).alias("url"))
    unknown = cited.join(known.select("url").distinct(), "url", "left_anti").select("brief_id", F.lit("unknown_citation").alias("issue"))
    claim = F.length(F.regexp_replace(F.regexp_replace("line", "\\(https?://[^)]+\\)", ""), "^- ", ""))
    each = lines.select("brief_id", F.explode(F.filter(F.array(F.when(~F.col("line").startswith("- "), "format"), F.when(~claim.between(18, 190), "length"), F.when(~F.contains("line", F.lit("(http")), "no_citation")), lambda x: x.isNotNull())).alias("issue"))
    count = briefs.select("brief_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n")).filter(~F.col("n").between(least, most)).select("brief_id", F.lit("line_count").alias("issue"))
    return each.unionByName(unknown).unionByName(count).distinct()


def plain_language_flags(fact: Column) -> Column:
    """Flags of a fact: jargon, filler, too long."""
    flags = (F.when(F.lower(fact).rlike("\\b(leverage|synergy|cutting-edge|paradigm)\\b"), "jargon"), F.when(F.lower(fact).rlike("\\b(very|really|basically|actually)\\b"), "filler"), F.when(F.size(F.split(F.trim(fact), "\\s+")) > 24, "long"))
    return F.concat_ws(",", *flags)


#: Facts of a candidate that one task picks from; more are picked from in rounds.
GROUP = 5000


def operator_brief(facts: DataFrame, most: int = 3, group: int = GROUP) -> DataFrame:
    """candidate_id, place, fact: the strongest facts, near-duplicates of a stronger one dropped.

    Facts of the same words are near-duplicates of the same others, so the strongest of them stands for all. What a candidate has left
    is picked from by one task if it is no more than `group`; of a larger one the strongest is taken, what is near it goes, and so on.
    """
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for r in pdf.sort_values(["strength", "fact"], ascending=[False, True]).itertuples():
            w = set(r.words)
            if any(w and s and len(w & s) / min(len(w), len(s)) >= 0.72 for _, s in kept):
                continue
            kept.append((r.fact, w))
            if len(kept) == most:
                break
        return pd.DataFrame({"candidate_id": [pdf["candidate_id"].iloc[0]] * len(kept), "place": range(1, len(kept) + 1), "fact": [f for f, _ in kept]})

    ship(facts.sparkSession)
    best = facts.groupBy("candidate_id", first_sentence("fact", 190).alias("fact")).agg(F.max("strength").alias("strength"))
    own = best.withColumn("words", F.sort_array(words(F.col("fact"))))
    # A fact without such words is near no other.
    one = own.groupBy("candidate_id", "words", F.when(F.size("words") == 0, F.col("fact")).alias("apart")).agg(F.min_by(F.struct("fact", "strength"), F.struct(-F.col("strength"), F.col("fact"))).alias("f"))
    left = stored(one.select("candidate_id", "words", "f.*"), "facts")
    large = left.groupBy("candidate_id").count().filter(F.col("count") > group).select("candidate_id")
    schema = "candidate_id long, place int, fact string"
    out = left.join(large, "candidate_id", "left_anti").groupBy("candidate_id").applyInPandas(pick, schema)
    rest = left.join(large, "candidate_id", "left_semi")
    if not large.take(1):
        return out
    for place in range(1, most + 1):
        top = stored(rest.groupBy("candidate_id").agg(F.min_by(F.struct(F.col("fact").alias("top"), F.col("words").alias("top_words")), F.struct(-F.col("strength"), F.col("fact"))).alias("t")).select("candidate_id", "t.*"), "tops")
        out = out.unionByName(top.select("candidate_id", F.lit(place).alias("place"), F.col("top").alias("fact")))
        least = F.least(F.size("words"), F.size("top_words"))
        near = (least > 0) & (F.size(F.array_intersect("words", "top_words")) / least >= 0.72)
        rest = stored(rest.join(top, "candidate_id").filter((F.col("fact") != F.col("top")) & ~F.coalesce(near, F.lit(False))).select("candidate_id", "words", "fact", "strength"), "rest")
    return out
