"""Sharding by fixed virtual slots.

Records hash by id into a fixed number of virtual slots. Bytes are summed per slot, and a small
versioned table maps slots to shards. Rebalancing edits that map: a shard keeps the slots that fit its
share and only the rest move, each to the shard with the fewest bytes so far. A MapStore keeps every version, so a later run starts
from the latest map and moves little. Work on records is one
hash, one partial aggregation and one window within slots; the map has SLOTS rows whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import new_folder, stash, table

#: Virtual slots. Fixed for the life of a corpus; shards can be at most as many.
SLOTS = 4096


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot. A null id is placed by its text, a null text has size 1 and checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(key, F.lit(SLOTS)).cast("long").alias("virtual_slot"))


def slot_weights(rows: DataFrame) -> DataFrame:
    """virtual_slot, n_rows, bytes for every slot, empty ones too: SLOTS rows."""
    got = rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))
    return rows.sparkSession.range(SLOTS).withColumnRenamed("id", "virtual_slot").join(F.broadcast(got), "virtual_slot", "left").fillna(0)


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """Version 0: slots dealt round-robin."""
    return spark.range(SLOTS).select(F.col("id").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


class MapStore:
    """All versions of a corpus's slot map, a folder of SLOTS rows each (version=N), kept by path: any later session opens it again. A version that was
    not written whole has no success mark and doesn't count. A cluster needs a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._Path(self.path)
        names = [f.getPath().getName() for f in self._files.listStatus(root)] if self._files.exists(root) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and self._files.exists(self._Path(f"{self.path}/{n}/_SUCCESS")))

    def load(self, version: int | None = None) -> DataFrame | None:
        """The map of a version, of the latest if none is named; None if there is none yet."""
        known = self.versions()
        if version is not None and version not in known:
            raise KeyError(f"{self.path} has no version {version}")
        if not known:
            return None
        at = known[-1] if version is None else version
        return self.spark.read.schema("virtual_slot long, shard int").parquet(f"{self.path}/version={at}").withColumn("version", F.lit(at))

    def append(self, slot_map: DataFrame) -> DataFrame:
        """Adds a version, higher than those before; gives it back as stored."""
        version = slot_map.agg(F.max("version")).first()[0]
        if version in self.versions():
            raise ValueError(f"{self.path} has version {version} already")
        slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.load(version)


def rebalance(slot_map: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, for `shards` shards, with near-equal bytes.

    Slots of a shard, largest first, stay while they fit an equal share; the others (and those of shards
    that no longer exist) go, largest first, to the shard with the least. Both inputs have SLOTS rows, so
    the fold below runs over a bounded array.
    """
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    share = weights.agg((F.sum("bytes") / shards).alias("share"))
    placed = slot_map.join(F.broadcast(weights), "virtual_slot").crossJoin(F.broadcast(share)).withColumn("upto", F.sum("bytes").over(w)).withColumn("stays", (F.col("upto") <= F.col("share")) & (F.col("shard") < shards))
    version = F.max("version").alias("version")
    gathered = placed.agg(
        version,
        F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard", "bytes"))).alias("fixed"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct(F.col("bytes"), F.col("virtual_slot")))), asc=False).alias("moving"),
    )
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("fixed", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))

    def put(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == least, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["moves"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard")))).alias("moves"),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:bigint,shard:int>>").alias("moves"))
    moves = gathered.select("version", "fixed", F.aggregate("moving", start, put)["moves"].alias("moves"))
    both = moves.select((F.col("version") + 1).alias("version"), F.explode(F.concat(F.transform("fixed", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard"))), "moves")).alias("m"))
    return both.select("m.virtual_slot", "m.shard", "version")


def shard_rows(rows: DataFrame, slot_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds shard and the row's place in it (gapless from 0): places count within a virtual slot and start at the shard's earlier slots."""
    w = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(F.broadcast(weights.select("virtual_slot", "n_rows")), "virtual_slot").withColumn("first", F.coalesce(F.sum("n_rows").over(w), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("first") + F.col("place")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8, store: MapStore | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is `bytes`: shard sizes are near equal, to within a virtual slot. The map of `store` is edited and kept there as its next
    version; without a store slots are dealt anew. Rows that repeat an id share a slot and each keep their place; null ids go by
    their text, null texts have size 1. Very long texts are measured whole, none is moved. An empty table gives no rows. Other
    columns of docs are not read.
    """
    rows = stash(records(docs), "slots")
    weights = stash(slot_weights(rows), "weights")
    before = store.load() if store else None
    after = rebalance(first_map(docs.sparkSession, shards) if before is None else before, weights, shards)
    slot_map = store.append(stash(after, "slot-map")) if store else stash(after, "slot-map")
    return shard_rows(rows, slot_map, weights).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), store=MapStore(spark, new_folder(spark, "slot-maps")))
