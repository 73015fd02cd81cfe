"""Feature scores of people from their evidence, and weights learned from feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import clamp, log_share, publisher_host

#: The authoritative default weights of the eight features.
DEFAULT_WEIGHTS = {
    "achievement_quality": 0.215,
    "activity_volume": 0.14,
    "trajectory_velocity": 0.146,
    "project_originality": 0.12,
    "technical_complexity": 0.129,
    "network_proximity": 0.103,
    "evidence_diversity": 0.069,
    "earlyness": 0.078,
}
#: Event types by role.
ACHIEVEMENTS = ("competition_result", "hackathon_result", "paper_published", "fellowship_or_grant")
BUILDS = ("project_created", "project_momentum", "open_source_contribution")
PASSIVE = ("profile_observed", "social_graph_signal", "identity_observed")
LICENSED_TAGS = ("verified-provider-subject", "model-corroborated-identity")


def substantive_for_scoring(evidence: DataFrame) -> DataFrame:
    """Evidence that counts for a publisher: no graph or identity observations, confidence 0.65, accepted licences."""
    return evidence.filter(~F.col("type").isin("social_graph_signal", "identity_observed") & (F.col("confidence") >= 0.65) & accepted_licensed())


def substantive_for_queue(evidence: DataFrame) -> DataFrame:
    return substantive_for_scoring(evidence).filter("type <> 'profile_observed'")


def accepted_licensed():
    """Rows of the licensed source need confidence 0.8 and one of two tags."""
    return (F.col("source") != "people-data-labs") | ((F.col("confidence") >= 0.8) & F.col("tag").isin(*LICENSED_TAGS))


def publisher_counts(evidence: DataFrame, key: str) -> DataFrame:
    """key, publishers for every key: distinct public hosts of its substantive evidence."""
    counts = substantive_for_scoring(evidence).groupBy(key).agg(F.count_distinct(publisher_host("source_url")).alias("publishers"))
    return evidence.select(key).distinct().join(counts, key, "left").fillna(0, ["publishers"])


def features(evidence: DataFrame, key: str, now: str) -> DataFrame:
    """The eight features per key from aggregations of its evidence, of its recent distinct pages and of its tags.

    Metrics are columns: rank, citations, momentum, activity90d, followers, complexity, complexity_confidence,
    graph_weight. The largest rank counts, as the scoring rule has it. Distinct pages and hosts are counted by grouping in levels,
    by key and page, key and host, then key, each with sums that add up: no row is written more than once, and a key with much evidence is
    spread over its pages first.
    """
    at = F.lit(now).cast("timestamp")
    is_ = lambda types: F.col("type").isin(*types)
    counted = ~F.col("type").isin("social_graph_signal", "identity_observed") & (F.col("confidence") >= 0.65) & accepted_licensed()
    largest = {m: F.col(m) for m in ("rank", "citations", "momentum", "complexity", "complexity_confidence", "graph_weight")}
    largest |= {"activity": F.col("activity90d"), "x_followers": F.when(F.col("source") == "x", F.col("followers")), "code_followers": F.when(F.col("source") == "github", F.col("followers")), "latest": F.col("occurred_at")}
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    sums = {"n": F.lit(1), "n_achievements": one(is_(ACHIEVEMENTS)), "n_observed": one(~is_(PASSIVE)), "confidence_sum": clamp("confidence")}
    pages = evidence.groupBy(key, "source_url").agg(*[F.sum(e).alias(c) for c, e in sums.items()], *[F.max(e).alias(c) for c, e in largest.items()], F.max(one(is_(BUILDS) & F.col("source_url").isNotNull())).alias("n_projects"), F.max(one(counted)).alias("public"))
    up = [*[F.sum(c).alias(c) for c in [*sums, "n_projects"]], *[F.max(c).alias(c) for c in largest]]
    hosts = pages.withColumn("host_", publisher_host("source_url")).groupBy(key, "host_").agg(*up, F.max("public").alias("public"))
    main = hosts.groupBy(key).agg(*up, F.count_if(F.col("host_").isNotNull() & (F.col("public") == 1)).alias("publishers"))
    main = main.withColumns({m: F.greatest(F.lit(0.0), m) for m in largest if m != "latest"}).withColumn("mean_confidence", F.col("confidence_sum") / F.col("n")).drop("confidence_sum")
    tags = evidence.filter(is_(BUILDS) & F.col("tag").isNotNull()).groupBy(key, "tag").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("*").alias("n_project_tags"))
    main = main.join(tags, key, "left").fillna(0, ["n_project_tags"])
    recent = evidence.filter(~is_((*PASSIVE, "other")) & (F.col("occurred_at") >= at - F.expr("INTERVAL 90 DAYS")))
    seen = recent.groupBy(key, "type", "source_url").agg(F.max_by(F.date_format("occurred_at", "yyyy-MM"), "event_id").alias("month"))
    months = seen.groupBy(key).agg(F.count("*").alias("n_recent"), F.count_distinct("month").alias("n_months"))
    x = main.join(months, key, "left").fillna(0, ["n_recent", "n_months"])
    x = x.withColumns(
        {
            "achievement_quality": clamp(F.col("n_achievements") * 0.12 + F.when(F.col("rank") > 0, 0.55 / F.sqrt("rank")).otherwise(0.0) + F.log1p("citations") / 10),
            "trajectory_velocity": clamp(F.least(F.lit(0.35), F.col("n_recent") * 0.045) + F.least(F.lit(0.2), F.col("n_months") * 0.07) + F.least(F.lit(0.25), F.log1p("momentum") / 3)),
            "activity_volume": clamp(clamp(F.col("activity") / 100) * 0.72 + clamp(log_share("n_observed", 30)) * 0.28),
            "technical_complexity": clamp(F.col("complexity") * F.greatest(F.lit(0.25), F.col("complexity_confidence"))),
            "network_proximity": clamp(F.col("graph_weight") / 3),
            "evidence_diversity": clamp(F.col("publishers") / 4 + F.least(F.lit(0.25), F.col("n") / 40)),
            "public_recognition": clamp(F.greatest(log_share("x_followers", 10_000), log_share("code_followers", 5_000))),
        }
    )
    x = x.withColumn("project_originality", clamp(F.when(F.col("n_projects") > 0, 0.04).otherwise(0.0) + F.least(F.lit(0.16), F.log1p("n_projects") / 12) + F.least(F.lit(0.04), F.col("n_project_tags") * 0.005) + F.col("technical_complexity") * 0.62 + F.least(F.lit(0.14), F.col("momentum") / 2)))
    strength = clamp((F.col("achievement_quality") + F.col("project_originality") + F.col("technical_complexity") + F.col("trajectory_velocity") + F.col("activity_volume")) / 5)
    return x.withColumn("earlyness", clamp(F.lit(0.78) + strength * 0.2 - F.col("public_recognition") * 0.58))


def roster_floor(evidence: DataFrame, key: str) -> DataFrame:
    """key, floor: what official rosters warrant by medal or rank, whatever else there is."""
    title, rank = F.lower("title"), F.col("rank")
    base = F.when(title.rlike("\\bgold\\b"), 36).when(title.rlike("\\bsilver\\b"), 31).when(title.rlike("\\bbronze\\b"), 25)
    base = base.when((rank > 0) & (rank <= 10), 32).when((rank > 0) & (rank <= 50), 26).when((rank > 0) & (rank <= 100), 22).when(rank > 0, 18).otherwise(0)
    bonus = F.when(rank > 0, F.greatest(F.lit(0.0), 4 - F.log2(rank + 1))).otherwise(0.0)
    official = (F.col("confidence") >= 0.65) & (F.col("tag") == "manual-roster-deep-dive") & F.col("type").isin("competition_result", "community_recognition")
    return evidence.groupBy(key).agg(F.coalesce(F.max(F.when(official, base + bonus)), F.lit(0.0)).alias("floor"))


def score(evidence: DataFrame, key: str, now: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Features, penalties, total on 0..100 and explanations per key, over its whole history."""
    weights = weights or DEFAULT_WEIGHTS
    whole = sum(weights.values()) or 1.0
    x = features(evidence, key, now).join(roster_floor(evidence, key), key)
    weighted = sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0)) / whole
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 86400)
    x = x.withColumn("confidence_penalty", clamp(1 - F.col("mean_confidence"), 0, 0.35)).withColumn("staleness_penalty", clamp(F.greatest(F.lit(0.0), age - 30) / 365, 0, 0.25))
    general = F.round(clamp(weighted - F.col("confidence_penalty") - F.col("staleness_penalty")) * 1000) / 10
    notes = [
        F.when(F.col("achievement_quality") >= 0.5, "selective achievements"),
        F.when(F.col("activity_volume") >= 0.5, "sustained activity"),
        F.when(F.col("trajectory_velocity") >= 0.5, "recent signals"),
        F.when(F.col("project_originality") >= 0.45, "repeated building"),
        F.when(F.col("technical_complexity") >= 0.5, "technical depth"),
        F.when(F.col("network_proximity") >= 0.35, "graph proximity"),
        F.when(F.col("evidence_diversity") >= 0.5, "corroborated"),
        F.when(F.col("earlyness") >= 0.65, "little recognised yet"),
    ]
    return x.withColumn("total", F.round(F.greatest(general, "floor") * 10) / 10).withColumn("explanations", F.concat_ws("; ", *notes))


def event_priority():
    """10 confidence + logs of momentum, citations and graph weight + 4 over the root of the rank."""
    return 10 * F.col("confidence") + F.log1p("momentum") + F.log1p("citations") + F.when(F.col("rank") > 0, 4 / F.sqrt("rank")).otherwise(0.0)


#: What a reviewer's action says about a candidate.
OUTCOMES = {"pass": 0.0, "watch": 0.35, "save": 0.6, "contact": 0.75, "interview": 0.9, "accept": 1.0}


def feature_covariances(labelled: DataFrame, features_: list[str]) -> DataFrame:
    """n and the population covariance of each feature with the outcome of the action."""
    outcome = F.coalesce(*[F.when(F.col("action") == a, F.lit(o)) for a, o in OUTCOMES.items()])
    x = labelled.withColumn("outcome", outcome)
    return x.agg(F.count("*").alias("n"), *[F.covar_pop(f, "outcome").alias(f) for f in features_])


def learn_weights(covariances: DataFrame, current: dict[str, float], baseline: dict[str, float], rate: float = 0.008, least: int = 8) -> DataFrame:
    """signal, weight: current weights moved by the clipped covariance, held within 0.7 and 1.3 of the baseline, summing to 1.
    With fewer than `least` rows of feedback nothing moves."""
    moved = {f: F.when(F.col("n") < least, F.lit(w)).otherwise(clamp(F.lit(w) + clamp(F.coalesce(F.col(f), F.lit(0.0)), -rate, rate), 0.7 * baseline[f], 1.3 * baseline[f])) for f, w in current.items()}
    long = covariances.select(F.explode(F.create_map(*[x for f, e in moved.items() for x in (F.lit(f), e)])).alias("signal", "raw"))
    return normalize_weights(long.withColumn("enabled", F.lit(True)))


def normalize_weights(signals: DataFrame) -> DataFrame:
    """signal, weight: disabled signals are 0, the rest sum to 1 at four decimals; unchanged if nothing is above 0. A weight table is small."""
    raw = F.when(F.col("enabled"), F.col("raw")).otherwise(0.0)
    total = F.sum(raw).over(Window.partitionBy(F.lit(1)))
    return signals.select("signal", F.when(total > 0, F.round(raw / total, 4)).otherwise(raw).alias("weight"))


def repository_complexity(files: DataFrame) -> DataFrame:
    """repo, n_files, score: from a file inventory (repo, path, bytes) in one aggregation.

    Source surface, breadth of languages, tests, continuous integration, docs and depth of folders each add a bounded share.
    """
    path = F.lower("path")
    ext = F.regexp_extract(path, "[.]([a-z0-9]+)$", 1)
    source = ext.isin("py", "ts", "js", "go", "rs", "java", "c", "cpp", "cu", "scala", "jl")
    x = files.groupBy("repo").agg(
        F.count("*").alias("n_files"),
        F.count_if(source).alias("n_source"),
        F.count_distinct(F.when(source, ext)).alias("n_languages"),
        F.max(path.rlike("(^|/)tests?/|[._]test[.]")).alias("has_tests"),
        F.max(path.rlike("(^|/)([.]github/workflows|[.]gitlab-ci)")).alias("has_ci"),
        F.max(path.rlike("(^|/)(docs|benchmarks?)/")).alias("has_docs"),
        F.sum(F.when(source, F.col("bytes")).otherwise(0)).alias("source_bytes"),
    )
    flag = lambda name, w: F.when(F.col(name), w).otherwise(0.0)
    total = F.least(F.lit(0.3), F.log1p("n_source") / 20) + F.least(F.lit(0.15), F.col("n_languages") * 0.05) + flag("has_tests", 0.15) + flag("has_ci", 0.1) + flag("has_docs", 0.1) + F.least(F.lit(0.2), F.log1p("source_bytes") / 70)
    return x.select("repo", "n_files", "n_source", "n_languages", F.round(clamp(total), 6).alias("score"))
