"""Landing tables and the evidence they become. Every normalizer is a projection to one evidence schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import account_claim, clamp, clean_text, human_name, medal, norm_doi, placement, stable_hash, strip_tracking
from tessera.operators.windows import cap_per_group

EVIDENCE = ("key", "source", "external_id", "type", "title", "occurred_at", "source_url", "momentum", "confidence")


def read_landing(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """A landing folder with its explicit schema, Parquet or JSON lines."""
    return spark.read.schema(schema).format(kind).load(path)


def to_evidence(df: DataFrame, source: str, type_: Column | str, external_id: Column, title: Column, url: Column, occurred: Column, now: str, confidence: Column | float = 0.8, momentum: Column | float = 0.0, extra: list[str] = ()) -> DataFrame:
    """Canonical evidence: stable key by source, id and day; bounded text; a date at or before now; a confidence in [0, 1]."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    at = F.coalesce(F.try_to_timestamp(occurred.cast("string")), F.lit(now).cast("timestamp"))
    out = df.select(F.lit(source).alias("source"), external_id.cast("string").alias("external_id"), lit(type_).alias("type"), clean_text(title, 500).alias("title"), at.alias("occurred_at"), strip_tracking(url).alias("source_url"), lit(momentum).cast("double").alias("momentum"), clamp(F.coalesce(lit(confidence), F.lit(0.8))).alias("confidence"), *extra)
    key = stable_hash("source", "external_id", "type", F.date_format("occurred_at", "yyyy-MM-dd"))
    return out.select(key.alias("key"), *EVIDENCE[1:], *extra)


def normalize_repositories(repos: DataFrame, now: str, popular: int = 25) -> DataFrame:
    """Repositories of people that are no forks; popular ones as momentum."""
    own = repos.filter(~F.col("fork") & (F.col("owner_type") == "user"))
    type_ = F.when(F.col("stars") > popular, "project_momentum").otherwise("project_created")
    confidence = F.when(F.col("analysis").isNotNull(), F.least(F.lit(0.98), 0.78 + 0.2 * F.col("analysis"))).otherwise(0.82)
    return to_evidence(own, "github", type_, F.col("repo_id"), F.col("name"), F.col("url"), F.col("pushed_at"), now, confidence, (F.log1p("stars") + F.log1p("forks")) / 40)


def normalize_activity(profiles: DataFrame, activity: DataFrame, now: str) -> DataFrame:
    """profile_id with its activity of 90 days: count, active days, commits held at 100."""
    recent = activity.filter((F.col("ts") > F.lit(now).cast("timestamp") - F.expr("INTERVAL 90 DAYS")) & (F.col("ts") <= F.lit(now).cast("timestamp")))
    agg = recent.groupBy("profile_id").agg(F.count("*").alias("activity90d"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.least(F.lit(100.0), F.sum("commits")).alias("commits"))
    return profiles.select("profile_id").join(agg, "profile_id", "left").fillna(0)


def normalize_papers(works: DataFrame, now: str, confidence: tuple[float, float] = (0.96, 0.7)) -> DataFrame:
    """One event an author, twenty authors a work at most; the author's place is part of the id."""
    x = works.select("*", F.posexplode(F.slice("authors", 1, 20)).alias("place", "author"))
    ident = F.concat(norm_doi("doi"), F.lit("#author-"), F.col("place"))
    sure = F.when(F.col("author_id").isNotNull() if "author_id" in works.columns else F.lit(False), confidence[0]).otherwise(confidence[1])
    return to_evidence(x, "openalex", "paper_published", ident, F.col("title"), F.concat(F.lit("https://doi.org/"), norm_doi("doi")), F.col("published"), now, sure, F.lit(0.0), ["author", "place"])


def restrict_to_subject(papers: DataFrame, subjects: DataFrame) -> DataFrame:
    """Only the authors under research: no evidence for their coauthors."""
    return papers.join(subjects.select(F.lower("author").alias("a_")), F.lower("author") == F.col("a_"), "left_semi")


def normalize_contests(standings: DataFrame, now: str, newest: int = 5) -> DataFrame:
    """One event a member of a party in the newest finished contests."""
    done = standings.filter("finished")
    last = done.groupBy("contest_id").agg(F.max("ended_at").alias("at")).orderBy(F.desc("at"), F.desc("contest_id")).limit(newest)
    x = done.join(F.broadcast(last.select("contest_id")), "contest_id").select("*", F.explode("members").alias("member"))
    return to_evidence(x, "codeforces", "competition_result", F.concat_ws(":", F.col("contest_id"), F.lower("member")), F.concat(F.lit("Placed "), F.col("place"), F.lit(" in contest "), F.col("contest_id")), F.concat(F.lit("https://contest.example/"), F.col("contest_id")), F.col("ended_at"), now, F.lit(0.9), 1 / F.greatest(F.lit(1), F.col("place")), ["member", "place"])


def first_person_build(title: Column, text: Column) -> Column:
    """Whether a post shows the author's own work."""
    return title.rlike("(?i)^show hn:") & text.rlike("(?i)\\b(i|we)('ve| have)? (built|made|wrote|created|launched|developed)\\b")


def normalize_forum(items: DataFrame, topics: list[str], now: str, min_score: int = 2) -> DataFrame:
    """Live stories on a topic: own work as momentum, links to others' as recognition."""
    text = F.lower(F.concat_ws(" ", "title", "text"))
    hits = F.size(F.filter(F.array(*map(F.lit, topics)), lambda t: F.contains(text, t)))
    live = items.filter((F.col("score") >= min_score) & ~F.coalesce("deleted", F.lit(False))).withColumn("hits", hits).filter("hits > 0")
    own = first_person_build(F.col("title"), F.coalesce("text", F.lit("")))
    return to_evidence(live, "hacker-news", F.when(own, "project_momentum").otherwise("community_recognition"), F.col("item_id"), F.col("title"), F.col("url"), F.col("ts"), now, F.when(own, 0.88).otherwise(0.55), F.col("score") + 1.5 * F.col("comments"), ["hits"])


#: Words that make a byline a desk, not a person.
DESKS = ("staff", "team", "editors", "editorial", "newsroom", "press")


def byline_names(byline: Column) -> Column:
    """Names of a byline: parted at commas and 'and' where each part is a full name; desks left out; first spelling kept; eight at most."""
    parts = F.transform(F.split(byline, " *(,|;| and ) *"), lambda p: F.trim(p))
    full = F.when((F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(p, F.lit(" "))), parts).otherwise(F.array(F.trim(byline)))
    people = F.filter(full, lambda p: (p != "") & ~F.lower(p).rlike("(^| )(" + "|".join(DESKS) + ")( |$)"))
    lower = F.transform(people, F.lower)
    return F.slice(F.filter(people, lambda p, i: F.array_position(lower, F.lower(p)) == i + 1), 1, 8)


def normalize_feeds(entries: DataFrame, now: str) -> DataFrame:
    x = entries.select("*", F.explode(byline_names(F.col("byline"))).alias("author")).filter(F.lower("author") != F.lower("publisher"))
    return to_evidence(x, "rss", "publication", F.concat_ws("#", F.col("entry_id").cast("string"), F.lower("author")), F.col("title"), F.col("url"), F.col("published"), now, F.lit(0.62), F.lit(0.0), ["author"])


def roster_lines(docs: DataFrame) -> DataFrame:
    """name, affiliation, rank, medal from pipe tables with a labelled person column: the last header above a row names its cells.

    Lines are exploded with their numbers; the header comes from a window within a document.
    """
    from pyspark.sql.window import Window

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter(F.contains("raw", F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace("raw", "^\\s*\\||\\|\\s*$", ""), "\\|"), lambda x: F.trim(x))
    lines = lines.select("doc_id", "line", cells.alias("cells"))
    head = F.exists("cells", lambda x: F.lower(x).isin("name", "contestant", "participant", "winner", "student"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("head", F.last(F.when(head, F.transform("cells", F.lower)), ignorenulls=True).over(w)).filter(~head & F.col("head").isNotNull())
    cell = lambda *names: F.coalesce(*[F.get("cells", F.array_position("head", n).cast("int") - 1) for n in names])
    out = x.select("doc_id", "line", cell("name", "contestant", "participant", "winner", "student").alias("name"), cell("country", "school", "affiliation").alias("affiliation"), placement(cell("rank", "place")).alias("rank"), medal(cell("award", "medal")).alias("medal"))
    return out.filter(human_name("name"))


def roster_to_evidence(people: DataFrame, year: int, now: str) -> DataFrame:
    placed = F.col("rank").isNotNull() | F.col("medal").isNotNull()
    title = F.concat(F.col("name"), F.when(F.col("medal").isNotNull(), F.concat(F.lit(" received a "), F.col("medal"))).when(F.col("rank").isNotNull(), F.concat(F.lit(" placed "), F.col("rank"))).otherwise(" took part"))
    return to_evidence(people, "roster", F.when(placed, "competition_result").otherwise("community_recognition"), F.concat_ws(":", F.lower("name"), F.lit(str(year))), title, F.lit("https://roster.example/"), F.lit(f"{year}-07-01"), now, F.when(placed, 0.82).otherwise(0.7), F.lit(0.0), ["name", "rank", "medal"])


def structured_results(rows: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """Rows of configured pages (page, name, rank_text, medal_text): placements and medals parsed, each page held to its share of `most`."""
    share = -(-most // max(1, pages.count()))
    x = rows.join(pages, "page").withColumn("rank", placement("rank_text")).withColumn("medal", medal("medal_text")).filter("rank IS NOT NULL OR medal IS NOT NULL")
    return cap_per_group(x, ["page"], [F.asc_nulls_last("rank"), F.asc("name")], share)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href, host of every anchor, as often as a page has it."""
    href = F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]+)"'), 1))
    return pages.select("page_id", href.alias("href"))


def page_main_text(pages: DataFrame, most: int = 12_000) -> DataFrame:
    """page_id, text: the longest article or main part without tags, else the body; access gates dropped."""
    found = F.regexp_extract_all("html", F.lit("(?s)<(?:article|main)[^>]*>(.*?)</(?:article|main)>"), 1)
    best = F.get(F.transform(F.sort_array(F.transform(found, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False), lambda x: x["t"]), 0)
    body = F.nullif(F.regexp_extract("html", "(?s)<body[^>]*>(.*?)</body>", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(best, body, F.lit("")), "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    text = F.substring(F.trim(F.regexp_replace(bare, "\\s+", " ")), 1, most)
    return pages.select("page_id", text.alias("text")).filter(~F.lower("text").rlike("^(access denied|enable javascript|are you a robot)") & (F.col("text") != ""))


def normalize_artifacts(artifacts: DataFrame, now: str) -> DataFrame:
    """Public, ungated artifacts; complexity grows with what their files indicate."""
    signs = ("config[.]json$", "[.]safetensors$", "tokenizer", "readme[.]md$", "train.*[.]py$")
    n = sum((F.when(F.exists("files", lambda f: F.lower(f).rlike(s)), 1).otherwise(0) for s in signs), F.lit(0))
    x = artifacts.filter(~F.col("private") & ~F.col("gated")).withColumn("indicators", n)
    return to_evidence(x, "hugging-face", F.when(F.col("likes") >= 10, "project_momentum").otherwise("project_created"), F.col("artifact_id"), F.col("name"), F.col("url"), F.col("updated"), now, F.when(F.col("indicators") > 0, F.least(F.lit(0.75), 0.3 + 0.08 * F.col("indicators"))).otherwise(0.2), F.col("likes"), ["indicators"])


def normalize_people_search(results: DataFrame, now: str) -> DataFrame:
    """One event a person found and week, so that weekly repeats meet."""
    x = results.select("found_at", F.explode("people").alias("p")).select("found_at", "p.*")
    return to_evidence(x, "exa-people", "profile_observed", F.col("url"), F.concat_ws(" at ", "job", "company"), F.col("url"), F.date_trunc("week", "found_at"), now, F.lit(0.7)).dropDuplicates(["key"])


def normalize_posts(posts: DataFrame, now: str) -> DataFrame:
    return to_evidence(posts, "x", "social_graph_signal", F.col("post_id"), F.col("text"), F.col("url"), F.col("ts"), now, F.lit(0.6), F.col("likes") + 2 * F.col("reposts") + 1.5 * F.col("replies"))


def licensed_profiles(profiles: DataFrame, recent: DataFrame, now: str) -> DataFrame:
    """Licensed profiles not refreshed within 90 days; confidence and tag by likelihood and decision."""
    fresh = recent.filter(F.col("discovered_at") > F.lit(now).cast("timestamp") - F.expr("INTERVAL 90 DAYS")).select("person_id")
    x = profiles.join(fresh, "person_id", "left_anti")
    sure = (F.col("decision") == "match") & (F.col("likelihood") >= 6)
    return x.select("person_id", F.when(sure, F.least(F.lit(0.95), 0.6 + 0.04 * F.col("likelihood"))).otherwise(0.6).alias("confidence"), F.when(sure, "model-corroborated-identity").otherwise("identity-review").alias("tag"))


def import_manual(rows: DataFrame, now: str) -> DataFrame:
    """Reviewed profile URLs that name a member."""
    claim = account_claim("url")
    return to_evidence(rows.filter(claim.isNotNull()), "manual", "profile_observed", F.lower("url"), F.col("name"), F.col("url"), F.col("added_at"), now, F.lit(0.9))


def account_hypotheses(hits: DataFrame, known: DataFrame) -> DataFrame:
    """The only account a provider and person in search hits, if it isn't known: with a score by handle and number of queries."""
    x = hits.groupBy("person_id", "provider").agg(F.count_distinct("handle").alias("n"), F.min("handle").alias("handle"), F.count_distinct("asked").alias("queries"), F.max(F.lower("handle") == F.lower("known_handle")).alias("same"))
    score = F.when(F.col("same"), 0.8).when(F.col("queries") >= 2, 0.74).otherwise(0.6)
    return x.filter("n = 1").join(known, ["person_id", "provider"], "left_anti").select("person_id", "provider", "handle", score.alias("score"))


def verified_page_matches(pages: DataFrame, persons: DataFrame) -> DataFrame:
    """(page_id, person_id, confidence): pages of a person's host that name the person; blocked on the host."""
    x = pages.join(persons, "host")
    named = F.contains(F.lower("text"), F.lower("name"))
    return x.select("page_id", "person_id", F.when(named & F.col("known_site"), 0.86).when(named, 0.68).otherwise(0.3).alias("confidence"))


def run_ledger(events: DataFrame, now: str) -> DataFrame:
    """run_id, n, failed, status: a run without an end for 15 minutes has timed out."""
    x = events.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.min("started_at").alias("started_at"), F.max("ended").alias("ended"))
    late = F.col("started_at") < F.lit(now).cast("timestamp") - F.expr("INTERVAL 15 MINUTES")
    return x.select("run_id", "n", "failed", F.when(~F.col("ended") & late, "failed").when(~F.col("ended"), "running").when(F.col("failed") == 0, "succeeded").when(F.col("failed") < F.col("n"), "partial").otherwise("failed").alias("status"), F.when(~F.col("ended") & late, "WORKER_TIMEOUT").alias("error"))

