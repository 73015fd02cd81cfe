"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest,
sort-merge anti-joined with the index, and what is new is appended, so a batch costs its own size plus
a bucket-aligned merge; the index is never shuffled again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, delete, join_hot, keep_rows, new_folder, row_key, stash, table


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as the empty text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """Digests seen so far, one row each, with the id that stands for them, kept by path: any later session opens it again.

    The rows are a bucketed and sorted table, which each session registers over its own location. `buckets` is fixed for the life of an
    index (take so many that a bucket has a few hundred MB at most). A cluster needs a path that driver and executors share. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        meta = f"{self.path}/buckets"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{meta}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.range(buckets, buckets + 1).coalesce(1).write.mode("overwrite").parquet(meta)
        self.buckets = spark.read.schema("id long").parquet(meta).first()[0]
        if not spark.catalog.tableExists(self.name):
            location = f"{self.path}/rows".replace("'", "\\'")
            spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Appends the digests of `groups` (digest, keep_id; one row a digest) that the index lacks."""
        new = groups.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts in this batch the row with the largest id stands for all; a digest that an earlier
    batch brought keeps the id it has in the index, and then nothing of this batch is kept. Null and
    empty texts are one group. Rows that repeat an id with an equal text all carry the same verdict; a
    null id is kept only where its group has no other. Very long texts are digested whole. An empty table gives an empty result.
    Columns besides the two named are not read. Without an index the batch gets one of its own, which goes again.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark, new_folder(spark, "digest-index"))
    d = stash(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    groups = d.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    own.add(groups)
    found = stash(groups.drop("keep_id").join(own.rows().hint("merge"), "digest"), "groups")
    if index is None:
        own.drop()
    return join_hot(d, found, "digest", "group_size", d.count()).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact deduplication keeps, with all their columns; of rows that repeat id and text, one."""
    verdicts = deduplicate(docs).select(row_key(F.col("doc_id"), F.unhex("text_sha256")).alias("key"), "kept")
    return keep_rows(docs, row_key(F.col("doc_id"), F.unhex(text_digest(F.col("text")))), verdicts)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
