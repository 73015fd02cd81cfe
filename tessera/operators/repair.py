"""Repair of wrongly attributed data: corrected tables and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import publisher_host
from tessera.operators.joins import having_any
from tessera.operators.scoring import LICENSED_TAGS


def contaminated(identities: DataFrame) -> DataFrame:
    """(candidate_id, subject) of scholarly identities that don't match the name of a candidate who has one that does."""
    anchored = having_any(identities, identities.filter("name_matches"), "candidate_id")
    return anchored.filter("NOT name_matches").select("candidate_id", "subject")


def quarantine(evidence: DataFrame, wrong: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence without that of wrong bindings, and what was taken out."""
    keys = ["candidate_id", "subject"]
    return evidence.join(wrong, keys, "left_anti"), evidence.join(wrong, keys, "left_semi")


def reattribute_shares(evidence: DataFrame) -> DataFrame:
    """Forum links to others' work become recognition, at a confidence of 0.55 at most."""
    share = (F.col("source") == "hacker-news") & ~F.lower("title").startswith("show hn") & (F.col("type") == "project_created")
    return evidence.withColumn("confidence", F.when(share, F.least(F.lit(0.55), "confidence")).otherwise(F.col("confidence"))).withColumn("type", F.when(share, "community_recognition").otherwise(F.col("type")))


def recounted(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("candidate_id").agg(F.count_distinct(F.when(F.col("confidence") >= 0.65, publisher_host("source_url"))).alias("publishers"))


def prune_forks(evidence: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence without that of forks (repos: path, fork), and the candidates that lose some."""
    path = F.regexp_extract(F.lower("source_url"), "^https?://[^/]+/([^?#]+)", 1)
    forks = repos.filter("fork").select(F.lower("path").alias("path_"))
    x = evidence.withColumn("path_", path)
    return x.join(forks, "path_", "left_anti").drop("path_"), x.join(forks, "path_", "left_semi").select("candidate_id").distinct()


def downgrade_unsupported(evidence: DataFrame) -> DataFrame:
    """Licensed rows without a strong tag fall to 0.64 and ask for review."""
    weak = (F.col("source") == "people-data-labs") & ~F.col("tag").isin(*LICENSED_TAGS)
    return evidence.withColumn("confidence", F.when(weak, F.least(F.lit(0.64), "confidence")).otherwise(F.col("confidence"))).withColumn("tag", F.when(weak, "identity-review").otherwise(F.col("tag")))


#: Review cutoffs before and after recalibration.
CUTOFFS = {75: 42, 70: 38, 65: 35, 60: 32}


def recalibrate(criteria: DataFrame) -> DataFrame:
    return criteria.withColumn("cutoff", F.coalesce(*[F.when(F.col("cutoff") == a, b) for a, b in CUTOFFS.items()], F.col("cutoff")))


def constraint_violations(df: DataFrame, rules: dict[str, str], unique: list[str] | None = None) -> DataFrame:
    """rule, violations: rows for which a rule (SQL) isn't true, and keys that repeat; one pass over the table for all rules."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(n) for n, e in rules.items()])
    out = counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))
    if unique:
        repeats = df.groupBy(*unique).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("unique").alias("rule"), "violations")
        out = out.unionByName(repeats)
    return out
