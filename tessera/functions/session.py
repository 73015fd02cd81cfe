"""What SQL users of a session get: views of the tables, functions, and a table function for links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.store import ship
from tessera.operators.search import TextIndex


def _folded(names: pd.Series) -> pd.Series:
    import re
    import unicodedata

    def fold(x: str | None) -> str | None:
        if x is None:
            return None
        bare = "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).lower()
        return re.sub(r"[\W_]+", " ", bare).strip()

    return names.map(fold)


def fold_unicode(name: Column | str) -> Column:
    """Compatibility forms taken apart, marks off, lower case; what is no letter or digit, of any script, becomes single spaces. Works
    on Arrow batches; expr.fold_name is the built-in form for Latin names."""
    ship(SparkSession.active())
    return F.pandas_udf(_folded, "string")(name)


class ExtractLinks:
    """extract_links(html): href and proof of every anchor, as a row each."""

    def eval(self, html: str):
        from tessera.sources.html import parse

        for href, proof in parse(html).anchors:
            yield href, proof


_PRODUCT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_RANKED = """SELECT doc_id, x / (x + 1) AS text_rank FROM (
  SELECT p.doc_id, sum(ln(1 + (c.docs - d.df + 0.5D) / (d.df + 0.5D)) * p.tf * 2.2D / (p.tf + 1.2D * (0.25D + 0.75D * p.n / c.mean))) AS x
  FROM postings p JOIN (SELECT term, count(*) AS df FROM postings WHERE array_contains(query_terms(asked), term) AND array_contains(query_buckets(asked), bucket) GROUP BY term) d ON p.term = d.term CROSS JOIN corpus c
  WHERE array_contains(query_terms(asked), p.term) AND array_contains(query_buckets(asked), p.bucket) GROUP BY p.doc_id)"""
#: SQL functions: signature, the views they read, and the body. Tops are cut to 100 rows first, as a limit takes constants only; k then counts within those.
_FUNCTIONS = [
    ("cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE", (), f"{_PRODUCT.format('a', 'b')} / sqrt({_PRODUCT.format('a', 'a')} * {_PRODUCT.format('b', 'b')})"),
    ("query_terms(asked STRING) RETURNS ARRAY<STRING>", (), "slice(array_distinct(filter(split(lower(asked), '[^a-z]+'), t -> t <> '')), 1, 20)"),
    ("query_buckets(asked STRING) RETURNS ARRAY<INT>", (), "transform(query_terms(asked), t -> CAST(crc32(t) % 256 AS INT))"),
    ("search_vectors(asked ARRAY<FLOAT>, least DOUBLE) RETURNS TABLE(vec_id BIGINT, similarity DOUBLE)", ("embeddings",), "SELECT e.vec_id, cosine(e.embedding, asked) FROM embeddings e WHERE cosine(e.embedding, asked) >= least"),
    ("lexical_rank(asked STRING) RETURNS TABLE(doc_id BIGINT, text_rank DOUBLE)", ("postings", "corpus"), _RANKED),
    (
        "hybrid_search(asked STRING, near ARRAY<FLOAT>, k INT) RETURNS TABLE(doc_id BIGINT, fused DOUBLE, place INT)",
        ("postings", "corpus", "embeddings", "scores"),
        f"""SELECT doc_id, fused, place FROM (SELECT doc_id, fused, CAST(row_number() OVER (ORDER BY round(fused, 6) DESC, score DESC, doc_id) AS INT) AS place FROM (
  SELECT doc_id, score, 0.65D * similarity + 0.35D * least(1D, 4 * text_rank) + least(0.08D, 0.08D * score / 100) AS fused FROM (
    SELECT b.doc_id, coalesce(s.score, 0D) AS score, b.similarity, b.text_rank FROM (
      SELECT coalesce(v.vec_id, l.doc_id) AS doc_id, coalesce(v.similarity, 0D) AS similarity, coalesce(l.text_rank, 0D) AS text_rank
      FROM (SELECT vec_id, cosine(embedding, near) AS similarity FROM embeddings) v FULL OUTER JOIN ({_RANKED}) l ON v.vec_id = l.doc_id) b
    LEFT JOIN scores s ON b.doc_id = s.doc_id WHERE b.similarity > 0 OR b.text_rank > 0)
  ORDER BY round(fused, 6) DESC, score DESC, doc_id LIMIT 100)) WHERE place <= greatest(1, least(100, k))""",
    ),
    (
        "rank_for_digest(at TIMESTAMP, min_score DOUBLE, k INT, exclude_days INT) RETURNS TABLE(candidate_id BIGINT, status STRING, digest_rank_score DOUBLE, discovered_at TIMESTAMP, place INT)",
        ("candidates", "evidence", "digest_items"),
        """SELECT candidate_id, status, digest_rank_score, discovered_at, place FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY digest_rank_score DESC, discovered_at DESC NULLS LAST, candidate_id) AS INT) AS place FROM (
    SELECT c.candidate_id, c.status, c.score * 0.62D + greatest(0D, c.momentum) * 0.18D + c.confidence * 100 * 0.12D + least(100D, coalesce(e.r.novelty, 0D)) * 0.08D AS digest_rank_score, e.r.discovered_at AS discovered_at
    FROM (SELECT * FROM candidates WHERE status IN ('new', 'watching', 'saved') AND score >= greatest(0D, least(100D, min_score))) c
    LEFT ANTI JOIN (SELECT candidate_id FROM digest_items WHERE status <> 'failed' AND scheduled_for >= at - make_dt_interval(greatest(0, least(365, exclude_days)))) i ON c.candidate_id = i.candidate_id
    LEFT JOIN (SELECT candidate_id, max_by(struct(discovered_at, novelty), struct(discovered_at, event_id)) AS r FROM evidence GROUP BY candidate_id) e ON c.candidate_id = e.candidate_id
    ORDER BY digest_rank_score DESC, discovered_at DESC NULLS LAST, c.candidate_id LIMIT 100)) WHERE place <= greatest(1, least(100, k))""",
    ),
]


def register(spark: SparkSession, views: dict[str, DataFrame], text_index: TextIndex | None = None) -> None:
    """Makes the views and functions known by name in this session.

    Always: fold_unicode(name), cosine(a, b), query_terms(asked), and extract_links(html) as a lateral table. Over the view `embeddings`:
    search_vectors(asked, least), with every row that is at least so similar. Over `text_index`: lexical_rank(asked). Over both and
    `scores` (doc_id, score): hybrid_search(asked, near, k). Over `candidates`, `evidence` and `digest_items`: rank_for_digest(at, min_score, k,
    exclude_days). k is held within 1 to 100.
    """
    ship(spark)
    views = dict(views)
    if text_index is not None:
        views |= {"postings": text_index.postings(), "corpus": text_index.stats()}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.udf.register("fold_unicode", F.pandas_udf(_folded, "string"))
    spark.udtf.register("extract_links", F.udtf(ExtractLinks, returnType="href string, proof string"))
    for signature, needs, body in _FUNCTIONS:
        if all(v in views for v in needs):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
