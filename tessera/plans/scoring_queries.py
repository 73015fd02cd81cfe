"""Queries of feature scores and learned weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scoring as S
from tessera.plans.bindings import NOW
from tessera.plans.registry import query

HOST = "regexp_replace(lower(regexp_extract(source_url, '^https?://([^/?#:]+)', 1)), '^www[.]', '')"
PUBLIC = f"CASE WHEN {HOST} <> 'localhost' AND NOT {HOST} LIKE '%.local' THEN {HOST} END"
COUNTED = "(type NOT IN ('social_graph_signal', 'identity_observed') AND confidence >= 0.65 AND (source <> 'people-data-labs' OR (confidence >= 0.8 AND tag IN ('verified-provider-subject', 'model-corroborated-identity'))))"

FEATURES_SQL = f"""
main AS (SELECT person_id, count(*) AS n,
    count(*) FILTER (WHERE type IN ('competition_result', 'paper_published')) AS n_ach,
    count(*) FILTER (WHERE type NOT IN ('profile_observed', 'social_graph_signal')) AS n_obs,
    max(rank) AS rank, max(citations) AS citations, max(momentum) AS momentum, max(activity90d) AS activity,
    max(complexity) AS complexity, max(complexity_confidence) AS cc, max(graph_weight) AS gw,
    coalesce(max(followers) FILTER (WHERE source = 'x'), 0) AS xf, coalesce(max(followers) FILTER (WHERE source = 'github'), 0) AS gf,
    count(DISTINCT CASE WHEN type = 'project_created' THEN source_url END) AS n_projects,
    count(DISTINCT CASE WHEN type = 'project_created' THEN tag END) AS n_tags,
    count(DISTINCT CASE WHEN {COUNTED} THEN {PUBLIC} END) AS publishers,
    avg(least(1, greatest(0, confidence))) AS mean_confidence, max(occurred_at) AS latest
  FROM {{evidence}} GROUP BY person_id),
pages AS (SELECT person_id, type, source_url, arg_max(strftime(occurred_at, '%Y-%m'), event_id) AS month FROM {{evidence}}
  WHERE type NOT IN ('profile_observed', 'social_graph_signal') AND occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY GROUP BY ALL),
months AS (SELECT person_id, count(*) AS n_recent, count(DISTINCT month) AS n_months FROM pages GROUP BY person_id),
x AS (SELECT m.*, coalesce(n_recent, 0) AS n_recent, coalesce(n_months, 0) AS n_months,
    least(1, n_ach * 0.12::DOUBLE + CASE WHEN rank > 0 THEN 0.55::DOUBLE / sqrt(rank) ELSE 0 END + ln(1 + citations) / 10) AS aq,
    least(1, least(0.35::DOUBLE, coalesce(n_recent, 0) * 0.045::DOUBLE) + least(0.2::DOUBLE, coalesce(n_months, 0) * 0.07::DOUBLE) + least(0.25::DOUBLE, ln(1 + momentum) / 3)) AS tv,
    least(1, least(1, activity / 100) * 0.72::DOUBLE + least(1, ln(1 + n_obs) / ln(31)) * 0.28::DOUBLE) AS av,
    least(1, complexity * greatest(0.25::DOUBLE, cc)) AS tc,
    least(1, gw / 3) AS np, least(1, publishers / 4 + least(0.25::DOUBLE, n / 40)) AS ed,
    least(1, greatest(ln(1 + xf) / ln(10001), ln(1 + gf) / ln(5001))) AS pr
  FROM main m LEFT JOIN months USING (person_id)),
y AS (SELECT *, least(1, CASE WHEN n_projects > 0 THEN 0.04::DOUBLE ELSE 0 END + least(0.16::DOUBLE, ln(1 + n_projects) / 12) + least(0.04::DOUBLE, n_tags * 0.005::DOUBLE) + tc * 0.62::DOUBLE + least(0.14::DOUBLE, momentum / 2)) AS po FROM x),
z AS (SELECT *, greatest(0, least(1, 0.78::DOUBLE + least(1, (aq + po + tc + tv + av) / 5) * 0.2::DOUBLE - pr * 0.58::DOUBLE)) AS ea FROM y)"""

NAMES = {"achievement_quality": "aq", "trajectory_velocity": "tv", "activity_volume": "av", "technical_complexity": "tc", "project_originality": "po", "network_proximity": "np", "evidence_diversity": "ed", "public_recognition": "pr", "earlyness": "ea"}


@query("x01_x07_features", "evidence", oracle=f"WITH {FEATURES_SQL} SELECT person_id, n, " + ", ".join(f"round({b}, 6) AS {a}" for a, b in NAMES.items()) + " FROM z")
def features(evidence: DataFrame) -> DataFrame:
    x = S.features(evidence, "person_id", NOW)
    return x.select("person_id", "n", *[F.round(f, 6).alias(f) for f in NAMES])


FLOOR = "CASE WHEN rank > 0 AND rank <= 10 THEN 32 WHEN rank > 0 AND rank <= 50 THEN 26 WHEN rank > 0 AND rank <= 100 THEN 22 WHEN rank > 0 THEN 18 ELSE 0 END + CASE WHEN rank > 0 THEN greatest(0, 4 - log2(rank + 1)) ELSE 0 END"
FLOOR_SQL = f"SELECT person_id, coalesce(max({FLOOR}) FILTER (WHERE confidence >= 0.65 AND tag = 'manual-roster-deep-dive' AND type = 'competition_result'), 0) AS floor FROM {{evidence}} GROUP BY person_id"


@query("x09_roster_floor", "evidence", oracle=f"SELECT person_id, round(floor, 6) AS floor FROM ({FLOOR_SQL})")
def roster_floor(evidence: DataFrame) -> DataFrame:
    return S.roster_floor(evidence, "person_id").select("person_id", F.round("floor", 6).alias("floor"))


TOTAL_SQL = f"""WITH {FEATURES_SQL},
f AS ({FLOOR_SQL}),
t AS (SELECT z.*, floor, least(0.35::DOUBLE, greatest(0, 1 - mean_confidence)) AS cp,
    least(0.25::DOUBLE, greatest(0, greatest(0, (epoch(TIMESTAMP '{NOW}') - floor(epoch(latest))) / 86400) - 30) / 365) AS sp,
    (aq * 0.215::DOUBLE + av * 0.14::DOUBLE + tv * 0.146::DOUBLE + po * 0.12::DOUBLE + tc * 0.129::DOUBLE + np * 0.103::DOUBLE + ed * 0.069::DOUBLE + ea * 0.078::DOUBLE) AS w
  FROM z JOIN f USING (person_id))
SELECT person_id, round(cp, 6) AS confidence_penalty, round(sp, 7) AS staleness_penalty,
  round(greatest(round(least(1, greatest(0, w - cp - sp)) * 1000) / 10, floor) * 10) / 10 AS total,
  concat_ws('; ', CASE WHEN aq >= 0.5 THEN 'selective achievements' END, CASE WHEN av >= 0.5 THEN 'sustained activity' END, CASE WHEN tv >= 0.5 THEN 'recent signals' END,
    CASE WHEN po >= 0.45 THEN 'repeated building' END, CASE WHEN tc >= 0.5 THEN 'technical depth' END, CASE WHEN np >= 0.35 THEN 'graph proximity' END,
    CASE WHEN ed >= 0.5 THEN 'corroborated' END, CASE WHEN ea >= 0.65 THEN 'little recognised yet' END) AS explanations
FROM t"""


@query("x16_rescore", "evidence", oracle=TOTAL_SQL)
def rescore(evidence: DataFrame) -> DataFrame:
    x = S.score(evidence, "person_id", NOW)
    return x.select("person_id", F.round("confidence_penalty", 6).alias("confidence_penalty"), F.round("staleness_penalty", 7).alias("staleness_penalty"), "total", "explanations")


@query("a02_publisher_counts", "evidence", oracle=f"SELECT candidate_id, count(DISTINCT CASE WHEN {COUNTED} THEN {PUBLIC} END) AS publishers FROM {{evidence}} GROUP BY candidate_id")
def publisher_counts(evidence: DataFrame) -> DataFrame:
    return S.publisher_counts(evidence, "candidate_id")


@query("f02_substantive", "evidence", oracle=f"SELECT candidate_id, count(*) FILTER (WHERE {COUNTED}) AS scoring, count(*) FILTER (WHERE {COUNTED} AND type <> 'profile_observed') AS queue FROM {{evidence}} WHERE {COUNTED} GROUP BY candidate_id")
def substantive(evidence: DataFrame) -> DataFrame:
    scoring = S.substantive_for_scoring(evidence).groupBy("candidate_id").agg(F.count("*").alias("scoring"))
    queue = S.substantive_for_queue(evidence).groupBy("candidate_id").agg(F.count("*").alias("queue"))
    return scoring.join(queue, "candidate_id", "left").fillna(0, ["queue"])


FEEDBACK = "CASE action WHEN 'pass' THEN 0.0 WHEN 'watch' THEN 0.35 WHEN 'save' THEN 0.6 WHEN 'contact' THEN 0.75 WHEN 'interview' THEN 0.9 ELSE 1.0 END"
_TWO = {"achievement_quality": 0.6, "earlyness": 0.4}


def _labelled(feedback: DataFrame) -> DataFrame:
    return feedback.select("action", (F.col("total") / 500000).alias("achievement_quality"), (F.col("candidate_id") % 100 / 100).alias("earlyness"))


@query("a10_feature_covariances", "feedback", oracle=f"SELECT count(*) AS n, round(covar_pop(total / 500000, CAST({FEEDBACK} AS DOUBLE)), 9) AS achievement_quality, round(covar_pop(candidate_id % 100 / 100, CAST({FEEDBACK} AS DOUBLE)), 9) AS earlyness FROM {{feedback}}")
def covariances(feedback: DataFrame) -> DataFrame:
    x = S.feature_covariances(_labelled(feedback), list(_TWO))
    return x.select("n", *[F.round(f, 9).alias(f) for f in _TWO])


@query("x15_learn_weights", "feedback", oracle=f"""WITH v AS (SELECT covar_pop(total / 500000, CAST({FEEDBACK} AS DOUBLE)) AS a, covar_pop(candidate_id % 100 / 100, CAST({FEEDBACK} AS DOUBLE)) AS e FROM {{feedback}}),
w AS (SELECT greatest(0.42::DOUBLE, least(0.78::DOUBLE, 0.6::DOUBLE + greatest(-0.008::DOUBLE, least(0.008::DOUBLE, a)))) AS a, greatest(0.28::DOUBLE, least(0.52::DOUBLE, 0.4::DOUBLE + greatest(-0.008::DOUBLE, least(0.008::DOUBLE, e)))) AS e FROM v)
SELECT 'achievement_quality' AS signal, round(a / (a + e), 4) AS weight FROM w UNION ALL SELECT 'earlyness', round(e / (a + e), 4) FROM w""")
def learned(feedback: DataFrame) -> DataFrame:
    return S.learn_weights(S.feature_covariances(_labelled(feedback), list(_TWO)), _TWO, _TWO)


@query("x14_normalize_weights", "candidate", oracle="""WITH s AS (SELECT stage AS signal, CASE WHEN stage = 'BUILDING' THEN 0.0 ELSE sum(score) END AS raw FROM {candidate} GROUP BY stage)
SELECT signal, round(raw / sum(raw) OVER (), 4) AS weight FROM s""")
def normalized(candidate: DataFrame) -> DataFrame:
    return S.normalize_weights(candidate.groupBy(F.col("stage").alias("signal")).agg(F.sum("score").alias("raw")).withColumn("enabled", F.col("signal") != "BUILDING"))


@query("x12_repository_complexity", "part", oracle="""WITH f AS (SELECT p_brand AS repo, concat(CASE p_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN '.github/workflows/' ELSE 'src/' END, CAST(p_partkey AS VARCHAR), CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' ELSE '.ts' END) AS path, p_size * 100 AS bytes FROM part),
x AS (SELECT repo, count(*) AS n_files, count(*) FILTER (WHERE path NOT LIKE '%.md') AS n_source, count(DISTINCT CASE WHEN path NOT LIKE '%.md' THEN right(path, 2) END) AS n_languages,
  max(CAST(path LIKE 'tests/%' AS INT)) AS t, max(CAST(path LIKE '.github/workflows%' AS INT)) AS ci, max(CAST(path LIKE 'docs/%' AS INT)) AS d, sum(CASE WHEN path NOT LIKE '%.md' THEN bytes ELSE 0 END) AS b FROM f GROUP BY repo)
SELECT repo, n_files, n_source, n_languages, round(least(1, least(0.3::DOUBLE, ln(1 + n_source) / 20) + least(0.15::DOUBLE, n_languages * 0.05::DOUBLE) + t * 0.15::DOUBLE + ci * 0.1::DOUBLE + d * 0.1::DOUBLE + least(0.2::DOUBLE, ln(1 + b) / 70)), 6) AS score FROM x""")
def complexity(part: DataFrame) -> DataFrame:
    folder = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN '.github/workflows/' ELSE 'src/' END")
    end = F.expr("CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' ELSE '.ts' END")
    return S.repository_complexity(part.select(F.col("p_brand").alias("repo"), F.concat(folder, F.col("p_partkey").cast("string"), end).alias("path"), (F.col("p_size") * 100).alias("bytes")))
