"""Helpers shared by the training-data operators: reading, stashing, hot-key joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: No more than this many keys can each hold over 1/HOT_KEYS of all rows, so a table of such keys has a proven bound.
HOT_KEYS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Unset, it is a new one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the application's part of the shared folder that nothing uses yet."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the application's part of the shared folder and reads it back: cuts the lineage, survives lost executors.
    What a result still reads stays until drop_stashes."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stash(df: DataFrame) -> None:
    """Deletes the files behind a stash that nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in folder:
            delete(df.sparkSession, folder)


def drop_stashes(spark: SparkSession) -> None:
    """Deletes all of this application's stashes; call it when its results are written."""
    delete(spark, _home(spark))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII bytes alone takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of many rows (left) with one row per key (right, stored); the key is no null and fits a literal.

    `weight` is the key's row count in left and `total` the count of all: keys that hold over
    1/HOT_KEYS of the rows are at most HOT_KEYS, so they are named and broadcast and their rows stay where they
    are; only the others shuffle, and none of those keys is large.
    """
    hot = [r[0] for r in right.filter(F.col(weight) * HOT_KEYS > total).select(key).collect()]
    if not hot:
        return left.join(right, key)
    named = F.col(key).isin(hot)
    return left.filter(named).join(F.broadcast(right.filter(named)), key).unionByName(left.filter(~named).join(right.filter(~named), key))


#: Bits of a row filter: so many for each marked row, and never more than MOST_BITS (64 MB), whatever the input.
BITS_EACH, MOST_BITS = 64, 1 << 29
_BITMAP = 1 << 15


def may_match(rows: DataFrame, key: str, marked: DataFrame) -> DataFrame:
    """rows (without columns of the names used here) with a boolean column maybe_: false only where no row of marked (stored: `key` alone) has the row's key.

    The keys of `marked` are hashed into a bitmap of bounded size, which is broadcast, so rows stay where they are. What is
    true goes on to an exact join; some 2 % of the other rows are true as well while the filter has BITS_EACH bits a key,
    and more of them the fuller it is, so the join takes over by and by where there are too many keys for a filter.
    """
    bits = min(MOST_BITS, -(-max(1, marked.count()) * BITS_EACH // _BITMAP) * _BITMAP)
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    maps = marked.select(place(key).alias("h")).groupBy(F.floor(F.col("h") / _BITMAP).alias("map_")).agg(F.bitmap_construct_agg(F.col("h") % _BITMAP).alias("bits_"))
    at = F.col("h_") % _BITMAP
    byte = F.conv(F.hex(F.substr("bits_", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("h_", place(key)).withColumn("map_", F.floor(F.col("h_") / _BITMAP)).join(F.broadcast(maps), "map_", "left")
    # The bit of a byte by division: shifts take constants only.
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    return found.withColumn("maybe_", F.coalesce(bit, F.lit(False))).drop("h_", "map_", "bits_")


def row_key(doc_id: Column, digest: Column) -> Column:
    """One value for id and text digest (binary, of fixed length); null ids are equal."""
    return F.concat(digest, F.coalesce(F.encode(doc_id.cast("string"), "UTF-8"), F.lit(b"")))


def keep_rows(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose key has a kept row in verdicts (key, kept); of rows that repeat a key, one.

    `key` (see row_key) is worked out from a row of docs and tells texts apart, so an id that several texts carry is judged text
    by text. Texts stay where they are but for those that a filter of bounded size can't clear: rows to drop, repeated ones and
    a few more are brought together by key and judged exactly.
    """
    pairs = stash(verdicts.groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "keys")
    # The user's columns travel in one struct, so none of them can clash with a name in here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    rows = may_match(own, "key", pairs.filter("NOT kept OR n > 1").select("key"))
    once = rows.filter("maybe_").dropDuplicates(["key"]).join(pairs.filter("NOT kept").select("key"), "key", "left_anti")
    return rows.filter("NOT maybe_").select("row.*").unionByName(once.select("row.*"))
