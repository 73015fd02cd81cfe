"""Tables between jobs: written to the folder that all executors share, and upserts as new snapshots."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, it is a new folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-plans/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: later jobs don't work it out again, and lost executors don't matter."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task groups or sorts at once; more rows are dealt to more tasks.
ROWS = 500_000


def tasks(spark: SparkSession, rows: float | None) -> int:
    """How many tasks so many rows ask for: no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-int(rows or 0) // ROWS))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """old and new by key: `replace` columns come from new where it has the key, others stay; `first` never moves forward, `last` never back.

    One grouping over the union of both, so either side may be the larger one.
    """
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    newest = lambda c: F.max_by(c, "new_").alias(c)
    oldest = lambda c: F.min_by(c, "new_").alias(c)
    out = [F.min(c).alias(c) if c == first else F.max(c).alias(c) if c == last else newest(c) if c in replace else oldest(c) for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(*out)


def drop_stored(spark: SparkSession) -> None:
    """Deletes what this application's queries stored; call it when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class BucketTable:
    """A table kept by path in hash buckets of its key, of which a batch rewrites only those that it touches.

    A version is a manifest that names the folder of every bucket; the success mark of the manifest commits it, so readers see a batch whole or
    not at all. A batch that was committed is not applied again, whatever a restart repeats. Readers of one of the last `keep`
    versions are safe, folders that none of these names go. One writer at a time: of two that add the same version the second fails.
    `buckets` is fixed for the life of the table; a batch rewrites its share of it, so take some thousands for tables of many TB.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 512, keep: int = 10):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), keys, buckets, keep
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self) -> list[int]:
        """The committed versions that are still there."""
        return sorted(int(n[2:]) for n in self._names("manifest") if n.startswith("v=") and self._files.exists(self._Path(f"{self.path}/manifest/{n}/_SUCCESS")))

    def _manifest(self, version: int) -> dict[str, dict[str, str]]:
        rows = self.spark.read.schema("kind string, name string, value string").parquet(f"{self.path}/manifest/v={version}").collect()  # a row a bucket
        out: dict[str, dict[str, str]] = {"bucket": {}, "source": {}, "table": {}}
        for r in rows:
            out[r["kind"]][r["name"]] = r["value"]
        if int(out["table"]["buckets"]) != self.buckets:
            raise ValueError(f"{self.path} has {out['table']['buckets']} buckets, not {self.buckets}")
        return out

    def _read(self, manifest: dict[str, dict[str, str]], buckets: list[str] | None = None) -> DataFrame:
        named = manifest["bucket"]
        folders = [f"{self.path}/data/v={named[b]}/bucket={b}" for b in (named if buckets is None else buckets) if b in named]
        schema = StructType.fromJson(json.loads(manifest["table"]["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"{self.path} has no version {'yet' if version is None else version}")
        return self._read(self._manifest(known[-1] if version is None else version))

    def apply(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame], source: str = "") -> int:
        """Adds a version in which merge(old, batch) stands for the rows of the touched buckets (which `old` holds); gives its number back.
        `number` counts the batches of a source: one that is not over the last committed of its source has been applied."""
        known = self.versions()
        base = self._manifest(known[-1]) if known else None
        if base and number <= int(base["source"].get(source, -1)):
            return known[-1]
        version = known[-1] + 1 if known else 0
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = [str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
            new = merge(self._read(base, touched) if base else batch.limit(0), batch)
            mark = next(n for n in ("bucket", *(f"bucket{i}" for i in range(len(new.columns) + 1))) if n not in new.columns)
            new.withColumn(mark, bucket).repartition(mark).write.partitionBy(mark).mode("overwrite").parquet(f"{self.path}/data/v={version}")
        finally:
            batch.unpersist()
        written = {n.split("=")[1]: n for n in self._names(f"data/v={version}") if n.startswith(f"{mark}=")}
        if mark != "bucket":
            for b, n in written.items():
                self._files.rename(self._Path(f"{self.path}/data/v={version}/{n}"), self._Path(f"{self.path}/data/v={version}/bucket={b}"))
        named = {b: v for b, v in base["bucket"].items() if b not in touched} if base else {}
        named |= dict.fromkeys(written, str(version))
        sources = (base["source"] if base else {}) | {source: str(number)}
        lines = [("bucket", b, v) for b, v in named.items()] + [("source", k, v) for k, v in sources.items()] + [("table", "buckets", str(self.buckets)), ("table", "schema", new.schema.json())]
        manifest = f"{self.path}/manifest/v={version}"
        if not self._files.exists(self._Path(f"{manifest}/_SUCCESS")):
            self._files.delete(self._Path(manifest), True)  # of a writer that didn't get there
        self.spark.createDataFrame(lines, "kind string, name string, value string").coalesce(1).write.parquet(manifest)
        self._clean([*known, version], named)
        return version

    def _clean(self, known: list[int], named: dict[str, str]) -> None:
        """Deletes manifests but the last `keep`, and the folders that only the deleted ones name."""
        kept = known[-self.keep :]
        if kept == known:
            return
        used = {(v, b) for k in kept for b, v in (named if k == known[-1] else self._manifest(k)["bucket"]).items()}
        for k in known[: -self.keep]:
            gone = {(v, b) for b, v in self._manifest(k)["bucket"].items()} - used
            self._files.delete(self._Path(f"{self.path}/manifest/v={k}"), True)
            for v, b in gone:
                self._files.delete(self._Path(f"{self.path}/data/v={v}/bucket={b}"), True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context; they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tessera_shipped = True
