"""Hard negatives by slot-decomposed selection.

An anchor's positives each allow negatives in a window of scores. The windows overlap, so they are not searched one by one:
the positives' upper limits, in descending order, cut the scores into disjoint slots, and a window is the slots from its own
limit down, as far as its lower limit. Tasks keep the best few rows of each slot and the best of all tasks are ranked once;
then a window's rows are the first of its slot followed by those of the slots below.

Anchors are a query set against all rows, in blocks: a block is a matrix of bounded size that every task holds, rows come by
in Arrow batches and stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.batches import map_arrow
from tessera.llm.common import stash, table

#: Anchors of a block; scores worked out at once; rows that are gathered for it.
ANCHORS, CELLS, ROWS = 8192, 1_000_000, 4096
#: Scores must stay below, so that their multiples by a percentage fit 64 bits.
LARGEST = 1 << 56
#: Percentages of a positive's score between which its negatives lie.
LOW, HIGH = 30, 90


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of `dims` components as a matrix, and which of the array's rows they are."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    own = np.flatnonzero(sizes == dims)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(own) == len(vectors):
        return flat.reshape(len(own), dims), own
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[own]
    return flat[(starts[:, None] + np.arange(dims)).ravel()].reshape(len(own), dims), own


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors; an error where they might not fit."""
    bound = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if bound >= LARGEST:
        raise ValueError("components are so large that an inner product may not fit 56 bits")
    if bound < 1 << 53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    return rows @ anchors.T


class Best:
    """The first k of each group among what was offered: highest score, then smallest id; a row that comes again counts once."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, np.iinfo(np.int64).min)
        self.held = tuple(np.empty(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.most, self.waiting = 4 * groups * k + CELLS, 0

    def offer(self, group: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        good = score >= self.least[group]
        self.new.append((group[good], score[good], who[good]))
        self.waiting += int(good.sum())
        if self.waiting > self.most or len(self.new) == 1:
            self.settle()

    def settle(self) -> None:
        group, score, who = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((who, -score, group))
        group, score, who = group[order], score[order], who[order]
        again = np.zeros(len(group), bool)
        again[1:] = (group[1:] == group[:-1]) & (score[1:] == score[:-1]) & (who[1:] == who[:-1])
        group, score, who = group[~again], score[~again], who[~again]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
        place = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
        last = place == self.k - 1
        self.least[group[last]] = score[last]
        keep = place < self.k
        self.held, self.new, self.waiting = (group[keep], score[keep], who[keep]), [], 0

    def found(self) -> tuple[np.ndarray, ...]:
        if self.new:
            self.settle()
        return self.held


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scan(vectors: DataFrame, block: pa.Table, groups: int, k: int, cells: Callable, schema: str, names: list[str]) -> DataFrame:
    """(names: anchor_id, slot, id, score) that each task finds best. cells(scores, ids, labels, anchors) says which cells of the scores count:
    row, anchor and slot of each."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        ids = asked.column("vec_id").to_numpy()
        top = Best(len(ids) * groups, k)
        sizes = np.diff(asked.column("vector").combine_chunks().offsets.to_numpy())
        sides = []
        for dims in np.unique(sizes).tolist():
            anchors, own = matrix(asked.column("vector"), dims)
            sides.append((dims, anchors, own, {c: asked.column(c).take(pa.array(own)) for c in asked.column_names if c != "vector"}))
        for part in gathered(batches, ROWS):
            for dims, anchors, own, facts in sides:
                rows, at = matrix(part.column("vector"), dims)
                who, label = part.column("vec_id").to_numpy()[at], part.column("label").to_numpy()[at]
                step = max(1, CELLS // len(own))
                for i in range(0, len(at), step):
                    score = products(rows[i : i + step], anchors)
                    for r, a, slot in cells(score, who[i : i + step], label[i : i + step], facts):
                        top.offer(own[a] * groups + slot, score[r, a], who[i : i + step][r])
        group, score, who = top.found()
        yield pa.RecordBatch.from_arrays([pa.array(ids[group // groups]), pa.array((group % groups).astype(np.int32)), pa.array(who), pa.array(score)], names)

    return map_arrow(vectors.select("vec_id", "label", "vector"), best, schema)


def _same_label(score, who, label, facts):
    own, ids = facts["label"].to_numpy(), facts["vec_id"].to_numpy()
    for x in np.intersect1d(label, own):
        rows, cols = np.flatnonzero(label == x), np.flatnonzero(own == x)
        r, a = (y.ravel() for y in np.meshgrid(rows, cols, indexing="ij"))
        other = who[r] != ids[a]
        yield r[other], a[other], 0


def _in_slots(score, who, label, facts):
    """Cells of another label under an anchor's highest limit and not under its lowest; the slot counts the limits that a score keeps."""
    own, ids = facts["label"].to_numpy(), facts["vec_id"].to_numpy()
    sizes = np.diff(facts["highs"].combine_chunks().offsets.to_numpy())
    highs = np.full((len(own), max(1, int(sizes.max(initial=0)))), np.iinfo(np.int64).min)
    for i, x in enumerate(facts["highs"].to_pylist()):
        highs[i, : len(x)] = x
    least = facts["least"].to_numpy()
    r, a = np.nonzero((score <= highs[:, 0]) & (score >= least) & (label[:, None] != own) & (who[:, None] != ids))
    yield r, a, (highs[a] >= score[r, a][:, None]).sum(axis=1) - 1


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label (integers) and vector (array of integers); anchors are the rows where `anchor` holds. An anchor's positives are the
    first other rows of its label by inner product, then id; each gets the first rows of other labels whose score lies between LOW and HIGH
    percent of its own. A positive below 0, or with none in its window, gives no row.

    Rows with a null id, label, vector or component take no part. A row of the anchor's own id is neither positive nor negative. Rows that
    repeat an id with the same label and vector count once; others of one id count each with its own score, but as an anchor only the one with the
    least label and vector. Vectors are compared with those of their own length only; components so large that a product might not fit
    56 bits are an error. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists(F.coalesce("vector", F.array().cast("array<bigint>")), lambda x: x.isNull())
    rows = vectors.filter(whole).select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))
    asked = stash(vectors.filter(whole & anchor).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>").alias("vector")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.*"), "anchors")
    n = asked.count()
    blocks = 1 if n <= ANCHORS else -(-2 * n // ANCHORS)
    found = [_block(rows, asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), positives, negatives) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found if blocks == 1 else [stash(x, "negatives") for x in found])


def _block(rows: DataFrame, asked: DataFrame, positives: int, negatives: int) -> DataFrame:
    """hard_negatives of one block of anchors."""
    block = asked.select("vec_id", "label", "vector").toArrow()  # ANCHORS at most
    near = _scan(rows, block, 1, positives, _same_label, "anchor_id long, slot int, positive_id long, positive_score long", ["anchor_id", "slot", "positive_id", "positive_score"])
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.asc("positive_id"))
    ranked = near.drop("slot").distinct().withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives)
    # 100 s <= HIGH p and LOW p <= 100 s, in integers: limits are rounded down and up.
    low, high = f"-((-positive_score * {LOW} - pmod(-positive_score * {LOW}, 100)) div 100)", f"(positive_score * {HIGH} - pmod(positive_score * {HIGH}, 100)) div 100"
    near = stash(ranked.withColumn("low", F.expr(low)).withColumn("high", F.expr(high)), "positives")
    limits = near.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "high"))), lambda x: x["high"]).alias("highs"), F.min("low").alias("least"))
    limited = asked.join(limits, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", "highs", "least").toArrow()
    far = _scan(rows, limited, positives, negatives, _in_slots, "anchor_id long, slot int, negative_id long, negative_score long", ["anchor_id", "slot", "negative_id", "negative_score"])
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    best = far.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= negatives)
    # Slots of an anchor one below the other: positives * negatives rows at most, in order of score.
    column = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "negative_id", "negative_score"))).alias("column"))
    window = F.slice(F.filter("column", lambda x: (x["slot"] >= F.col("place")) & (x["negative_score"] >= F.col("low"))), 1, negatives)
    answers = near.join(column, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "x"))
    return answers.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.negative_id").alias("negative_id"), "positive_score", F.col("x.negative_score").alias("negative_score"))


def quantised(embedding: Column, by: int = 256) -> Column:
    """floor(by * x) of every component, x as double; null if the vector or a component is null or not finite."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(embedding, lambda x: F.floor(x.cast("double") * by)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector")), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
