"""Vector, lexical and hybrid search."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.store import ship, stored

#: Queries searched at once, and components of theirs; every task holds them as a matrix, so more are searched in blocks. Similarities worked out
#: at once, and components of the rows compared.
MAX_QUERIES, MAX_VALUES, CELLS = 10_000, 2_000_000, 500_000
#: Texts whose postings make a batch.
TEXTS = 100
#: Okapi BM25 parameters.
K1, B = 1.2, 0.75


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_topk(vectors: DataFrame, asked: list[float], threshold: float = 0.55, k: int = 20) -> DataFrame:
    """The k most similar rows above the threshold, by similarity then id: one scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in asked])
    return vectors.withColumn("similarity", cosine(F.col("embedding"), q)).filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "vec_id").limit(max(1, min(100, k)))


def query_terms(asked: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[a-z]+", asked.lower())))[:20]


def _counted(rows: DataFrame) -> DataFrame:
    """doc_id, term, tf, n of every row (doc_id, text in lower case): how often it has a term, and how many terms it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile("[a-z]+")
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), TEXTS):
                own, terms, tf, n = [], [], [], []
                for i, text in zip(ids[at : at + TEXTS], texts.slice(at, TEXTS), strict=True):
                    c = Counter(word.findall(text.as_py()))
                    own += [i] * len(c)
                    n += [c.total()] * len(c)
                    terms += c.keys()
                    tf += c.values()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "term", "tf", "n"])

    ship(rows.sparkSession)
    return rows.mapInArrow(count, "doc_id long, term string, tf long, n long")


class TextIndex:
    """Postings of a corpus by path: term, doc_id, tf and n (the document's terms) in hash buckets of the term, and one row of statistics.

    Built once; a request reads the buckets of its terms and nothing of the texts. Terms are runs of a-z after lower-casing. Texts of rows
    that share an id count as one document; null ids are left out; null texts have no terms. A term that many documents have is
    spread over several files of its bucket.
    The terms of a text are counted where it is read, so postings shuffle once, to their buckets. Only rows that share an id are grouped.
    """

    BUCKETS = 256

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> TextIndex:
        index, rows = cls(docs.sparkSession, path), docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        ids = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
        shared = stored(ids.filter("rows > 1").select("doc_id"), "shared-ids")
        whole = _counted(rows)
        if shared.take(1):
            apart = _counted(rows.join(shared, "doc_id", "left_semi")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
            sizes = apart.groupBy("doc_id").agg(F.sum("tf").alias("n"))
            whole = _counted(rows.join(shared, "doc_id", "left_anti")).unionByName(apart.join(sizes, "doc_id"))
        whole = whole.select((F.crc32(F.col("term").cast("binary")) % cls.BUCKETS).cast("int").alias("bucket"), "term", "doc_id", "tf", "n")
        whole.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{index.path}/postings")
        found, documents = index.postings().agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms")), rows.agg(F.count_distinct("doc_id").alias("docs"))
        mean = F.coalesce(F.col("terms").cast("double") / F.nullif("docs", F.lit(0)), F.lit(0.0))
        documents.crossJoin(F.broadcast(found)).select("docs", mean.alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/stats")  # one row
        return index

    def stats(self) -> DataFrame:
        return self.spark.read.schema("docs long, mean double").parquet(f"{self.path}/stats")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("term string, doc_id long, tf long, n long, bucket int").parquet(f"{self.path}/postings")

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: only their buckets are read."""
        return self.postings().filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.BUCKETS for t in terms})) & F.col("term").isin(terms))


def lexical_rank(index: TextIndex, asked: str) -> DataFrame:
    """doc_id, text_rank in [0, 1): BM25 over the asked terms, x / (x + 1), from their postings and one row of statistics."""
    found = index.of(query_terms(asked))
    weights = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a term asked
    x = found.join(F.broadcast(weights), "term").crossJoin(F.broadcast(index.stats()))  # one row
    tf, df = F.col("tf"), F.col("df")
    idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
    bm25 = F.sum(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean"))))
    return x.groupBy("doc_id").agg(bm25.alias("x")).select("doc_id", (F.col("x") / (F.col("x") + 1)).alias("text_rank"))


def hybrid_search(index: TextIndex, vectors: DataFrame, scores: DataFrame, asked: str, vector: list[float], weight: float = 0.65, k: int = 20) -> DataFrame:
    """Fusion of cosine and lexical rank with a small prior from the score; either signal is enough."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    near = vectors.select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), q).alias("cosine"))
    both = near.join(lexical_rank(index, asked), "doc_id", "full_outer").fillna(0.0, ["cosine", "text_rank"]).filter("cosine > 0 OR text_rank > 0")
    x = both.join(scores, "doc_id", "left").fillna(0.0, ["score"])
    fused = weight * F.col("cosine") + (1 - weight) * F.least(F.lit(1.0), 4 * F.col("text_rank")) + F.least(F.lit(0.08), 0.08 * F.col("score") / 100)
    return x.withColumn("fused", fused).orderBy(F.desc(F.round("fused", 6)), F.desc("score"), "doc_id").limit(max(1, min(100, k)))


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries (query_id, asked) whole, if they are within MAX_QUERIES rows and MAX_VALUES components, else dealt by hash into parts of about half of that."""
    n, wide = queries.agg(F.count("*"), F.max(F.size("asked"))).first()
    most = max(1, min(MAX_QUERIES, MAX_VALUES // max(1, wide or 1)))
    if n <= most:
        return [queries]
    blocks = -(-2 * n // most)
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]


def batch_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, similarity, place: the k nearest of every query (query_id, asked), all of them against all vectors, in blocks.

    A block of queries is one matrix of bounded size that every task holds; vectors come by in Arrow batches, and a task keeps the best k
    of each query so far, so the last ranking sees k rows a query and task. Queries beyond one block are searched block by block, and stored.
    """
    blocks = _blocks(queries)
    found = (_search_block(asked, vectors, k) for asked in blocks)
    return next(found) if len(blocks) == 1 else reduce(DataFrame.unionByName, [stored(x, "found") for x in found])


def _search_block(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    rows = queries.select("query_id", "asked").collect()  # a block at most
    ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64) if rows else np.zeros((0, 1))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        asked, who, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # by query, similarity and id: k a query at most
        low = np.full((len(ids), 1), -np.inf)  # nothing at or under it is among the k, however it is rounded
        step = max(1, CELLS // max(1, *matrix.shape))
        for batch in batches:
            some = batch.filter(batch.column("embedding").is_valid())
            for at in range(0, some.num_rows if len(ids) else 0, step):
                part = some.slice(at, step)
                own, v = part.column("vec_id").to_numpy(), part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                near = matrix @ v.T
                near[(ids[:, None] == own) | np.isnan(near)] = -np.inf
                if len(own) > k:
                    low = np.maximum(low, np.partition(near, -k, axis=1)[:, -k, None] - 2e-6)
                q, i = np.nonzero(near > low)
                asked, who, best = np.concatenate([asked, q]), np.concatenate([who, own[i]]), np.concatenate([best, near[q, i]])
                order = np.lexsort((who, asked * 4_000_000 - np.rint(best * 1e6).astype(np.int64)))
                asked = asked[order]
                first = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
                asked, who, best = asked[first], who[order[first]], best[order[first]]
                last = np.flatnonzero(np.bincount(asked, minlength=len(ids)) == k)
                low[last, 0] = np.maximum(low[last, 0], best[np.searchsorted(asked, last, "right") - 1] - 2e-6)
        yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(who), pa.array(best)], ["query_id", "vec_id", "similarity"])

    found = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(nearest, "query_id long, vec_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), F.asc("vec_id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _centres(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a seeded start; an empty cluster keeps its centre."""
    centres = rows[np.random.default_rng(7).choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        some = sizes > 0
        centres[some] = sums[some] / sizes[some, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of each row, by CELLS distances at a time."""
    step, half = max(1, CELLS // max(1, len(centres))), (centres**2).sum(axis=1) / 2
    own = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), step):
        own[at : at + step] = (rows[at : at + step] @ centres.T - half).argmax(axis=1)
    return own


class VectorIndex:
    """A vector index by path: inverted lists of residual product codes, and the vectors beside them.

    Vectors are taken as directions. k-means centres give the lists; what a vector differs from its centre is cut into parts of PART
    dimensions, and each part is coded by one of 256 centres in a byte. Centres and codes are fitted on at most `sample` rows, all others are
    coded by them. A search compares the whole query with the coded vectors of the lists that it probes (a sixteenth of the
    vectors' bytes), keeps a shortlist, and ranks that by the vectors themselves.
    """

    PART, CODES = 4, 256

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, sample: int = 50_000) -> VectorIndex:
        """Fits the index and files all rows (vec_id, embedding). Null vectors and those without a direction are left out; vectors have one length."""
        index, n = cls(vectors.sparkSession, path), vectors.count()
        ship(vectors.sparkSession)
        lists = lists or max(1, min(1024, round(n**0.5 / 2)))
        some = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1_000_000 * sample / n)
        parts, codes = cls.PART, cls.CODES

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = _units(np.array(pdf["embedding"].tolist(), np.float64))
            rows = rows[(rows != 0).any(axis=1)]
            if not len(rows):
                return pd.DataFrame({"kind": [], "place": [], "centre": []})
            centres = _centres(rows, lists)
            rest = rows - centres[_nearest(rows, centres)]
            found = [(-1, i, c) for i, c in enumerate(centres)]
            for p in range(0, rest.shape[1], parts):
                found += [(p // parts, i, c) for i, c in enumerate(_centres(rest[:, p : p + parts], codes))]
            return pd.DataFrame(found, columns=["kind", "place", "centre"])

        whole = some.filter("embedding IS NOT NULL").select(F.lit(1).alias("g"), F.col("embedding").cast("array<double>").alias("embedding"))
        whole.groupBy("g").applyInPandas(lambda pdf: fit(pdf.head(2 * sample)), "kind int, place int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/model")
        for folder in ("codes", "vectors"):
            index._file(vectors, folder, "overwrite")
        return index

    def append(self, vectors: DataFrame) -> None:
        """Files more rows by the centres there are."""
        for folder in ("codes", "vectors"):
            self._file(vectors, folder, "append")

    def model(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Centres of the lists, and of each part: some thousand rows."""
        rows = self.spark.read.schema("kind int, place int, centre array<double>").parquet(f"{self.path}/model").orderBy("kind", "place").collect()
        kinds = sorted({r["kind"] for r in rows})
        by = [np.array([r["centre"] for r in rows if r["kind"] == k]) for k in kinds]
        return (by[0], by[1:]) if by else (np.zeros((1, 0)), [])

    def _file(self, vectors: DataFrame, folder: str, mode: str) -> None:
        shared, part, keep = self.spark.sparkContext.broadcast(self.model()), self.PART, folder == "vectors"

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = shared.value
            for batch in batches:
                if not batch.num_rows or not books:
                    continue
                rows = _units(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64))
                real = np.flatnonzero((rows != 0).any(axis=1))
                own = _nearest(rows[real], centres)
                rest = rows[real] - centres[own]
                if keep:
                    last = batch.column("embedding").take(pa.array(real))
                else:
                    codes = np.stack([_nearest(rest[:, p * part : (p + 1) * part], b) for p, b in enumerate(books)], axis=1).astype(np.uint8)
                    last = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(real)), pa.array(own.astype(np.int32)), last], ["vec_id", "list", "value"])

        ship(self.spark)
        rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
        out = rows.mapInArrow(coded, f"vec_id long, list int, value {'array<float>' if keep else 'binary'}")
        out.hint("rebalance", "list").write.partitionBy("list").mode(mode).parquet(f"{self.path}/{folder}")

    def search(self, queries: DataFrame, k: int = 10, probed: int = 80, shortlist: int = 100) -> DataFrame:
        """query_id, vec_id, similarity, place: the k nearest of each query (query_id, asked), itself left out. `probed` percent of the lists are looked
        up, `shortlist` vectors a query are compared exactly. Queries go in blocks."""
        blocks = _blocks(queries)
        found = (self._search(asked, k, probed, shortlist) for asked in blocks)
        return next(found) if len(blocks) == 1 else reduce(DataFrame.unionByName, [stored(x, "found") for x in found])

    def candidates(self, queries: DataFrame, probed: int, shortlist: int) -> DataFrame:
        """query_id, vec_id, list of each query's shortlist, by coded vectors."""
        rows = queries.select("query_id", "asked").collect()  # a block at most
        centres, books = self.model()
        ids, matrix = np.array([r[0] for r in rows], np.int64), _units(np.array([r[1] for r in rows], np.float64)) if rows else np.zeros((0, centres.shape[1]))
        near = matrix @ centres.T if len(rows) and books else np.zeros((len(rows), len(centres)))
        most = max(1, -(-len(centres) * probed // 100))
        open_ = np.zeros(near.shape, bool)
        np.put_along_axis(open_, np.argsort(-near, axis=1, kind="stable")[:, :most], True, axis=1)
        shared, part = self.spark.sparkContext.broadcast((ids, matrix, open_, centres, books)), self.PART

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, open_, centres, books = shared.value
            top, who, at = np.full((len(ids), 0), 0.0), np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0), np.int32)
            step = max(1, CELLS // max(1, len(ids)))
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("value").to_pylist()), np.uint8).reshape(batch.num_rows, len(books)) if batch.num_rows else np.empty((0, 0))
                own, lists = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy(zero_copy_only=False)
                for i in range(0, len(own) if len(ids) else 0, step):
                    c, mine, part_lists = codes[i : i + step], own[i : i + step], lists[i : i + step]
                    rows = centres[part_lists] + np.concatenate([b[c[:, p]] for p, b in enumerate(books)], axis=1)
                    score = np.where(open_[:, part_lists] & (ids[:, None] != mine), matrix @ rows.T, -np.inf)
                    top, who, at = np.hstack([top, score]), np.hstack([who, np.broadcast_to(mine, score.shape)]), np.hstack([at, np.broadcast_to(part_lists, score.shape)])
                    if top.shape[1] > shortlist:
                        first = np.argpartition(-top, shortlist, axis=1)[:, :shortlist]
                        top, who, at = (np.take_along_axis(x, first, 1) for x in (top, who, at))
            real = np.isfinite(top)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], top.shape)[real]), pa.array(who[real]), pa.array(at[real]), pa.array(top[real])], ["query_id", "vec_id", "list", "near"])

        ship(self.spark)
        wanted = [int(x) for x in np.flatnonzero(open_.any(axis=0))]
        coded = self.spark.read.schema("vec_id long, value binary, list int").parquet(f"{self.path}/codes").filter(F.col("list").isin(wanted))
        found = coded.select("vec_id", "list", "value").mapInArrow(best, "query_id long, vec_id long, list int, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), F.asc("vec_id"))
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= shortlist).select("query_id", "vec_id", "list")

    def _search(self, queries: DataFrame, k: int, probed: int, shortlist: int) -> DataFrame:
        few = self.candidates(queries, probed, shortlist).join(queries, "query_id")
        whole = self.spark.read.schema("vec_id long, value array<float>, list int").parquet(f"{self.path}/vectors")
        x = whole.join(few, ["list", "vec_id"]).select("query_id", "vec_id", cosine(F.col("value"), F.col("asked")).alias("similarity"))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), F.asc("vec_id"))
        return x.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
