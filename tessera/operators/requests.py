"""Search requests as tables: what a text asks for, and explicit filters over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import clean_text

#: What in a request asks for which order.
INTENTS = (("earlyness", "under[- ]?discovered|early|unknown|low profile"), ("trajectory", "fast|trajectory|momentum|rising"))


def parse_queries(queries: DataFrame, most: int = 20) -> DataFrame:
    """query_id, semantic, keywords, sort_intent, asked_limit of requests (query_id, text, asked_limit).

    Keywords are the first `most` different words of two characters or more; the limit is clamped to 1..100, 20 if none is given.
    """
    x = queries.select("query_id", F.coalesce(clean_text("text", 1000), F.lit("")).alias("semantic"), F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(F.col("asked_limit").cast("int"), F.lit(20)))).alias("asked_limit"))
    low = F.lower("semantic")
    words = F.slice(F.array_distinct(F.filter(F.split(low, "[^a-z0-9+#.-]+"), lambda w: F.length(w) >= 2)), 1, most)
    intent = F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in INTENTS], F.lit("relevance"))
    return x.select("query_id", "semantic", words.alias("keywords"), intent.alias("sort_intent"), "asked_limit")


def merge_filters(parsed: DataFrame, explicit: DataFrame, key: str = "query_id") -> DataFrame:
    """parsed with every filter that `explicit` (the same columns, some of the keys) names; nulls name none."""
    own = [c for c in parsed.columns if c != key]
    e = explicit.select(key, *[F.col(c).alias(f"{c}_") for c in own if c in explicit.columns])
    return parsed.join(e, key, "left").select(key, *[F.coalesce(f"{c}_", c).alias(c) if c in explicit.columns else F.col(c) for c in own])
