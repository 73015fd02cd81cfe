"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training reads text and language of rows that are not held out. Document frequencies of n-gram buckets come
from all such rows, added up in Spark. The classifier itself is fitted on a bounded sample of them (SAMPLE rows, as many of each
language as there are) by follow-the-regularised-leader with elastic-net penalties, which leaves most
weights at zero; a fifth of the sample is kept for a temperature that calibrates the probabilities. A
model is one table of fixed size, broadcast to the tasks that predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.batches import map_arrow, runs, texts_of
from tessera.llm.common import stash, table

#: n-grams of 1 to ORDERS characters hash into 2 ** BITS buckets.
ORDERS, BITS = 3, 17
BUCKETS = 1 << BITS
#: Rows, all languages together, that the classifier is fitted on at most; a row a language where there are more languages.
SAMPLE = 4000
#: Up to so many languages each bucket has weights of its own; with twice as many two buckets share theirs, and so on, so a model's size is bounded.
LANGUAGES = 64
EPOCHS = 3
#: Characters worked on at once.
STRETCH = 1 << 19
#: Follow-the-regularised-leader: learning rate and its damping, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Relative frequencies are small; this brings features near 1.
SCALE = 100.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets (one row an order) of the n-grams that begin at each of the codes."""
    out, h = np.empty((ORDERS, len(codes)), np.int32), np.full(len(codes), 2166136261, np.uint32)
    after = codes
    for n in range(ORDERS):
        h = (h ^ after) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        out[n] = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        after = np.append(after[1:], np.uint32(32))
    return out


def gram_buckets(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """From, to, and for the texts between: buckets (one row an order) of the n-grams that begin at each place; where each text begins;
    whether it has a letter. A text longer than STRETCH comes by itself in several parts, so memory is bounded.

    Each text is padded by itself, so its n-grams don't depend on its neighbours.
    """
    letters = _letters()
    for a, b in runs(texts, STRETCH):
        padded = "".join([f" {t}  " for t in texts[a:b]])
        starts = np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts[a:b]])))[:-1] if b - a > 1 else np.zeros(1, np.int64)
        step = len(padded) if b - a > 1 else STRETCH
        for at in range(0, len(padded), step):
            codes = letters[np.frombuffer(padded[at : at + step + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)]
            buckets = _buckets(codes)[:, :step]
            yield a, b, buckets, starts, np.add.reduceat((codes[:step] != 32).astype(np.int64), starts) > 0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Model:
    """Languages, weights per bucket (IDF included), biases and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    shift: int = 0

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        n = len(texts)
        logits, sizes, some = np.zeros((n, len(self.languages))), np.zeros((n, 1)), np.zeros(n, bool)
        for a, b, buckets, starts, letter in gram_buckets(texts):
            for row in buckets:
                logits[a:b] += np.add.reduceat(self.weights[row >> self.shift], starts, axis=0, dtype=np.float64)
            sizes[a:b, 0] += np.diff(np.append(starts, buckets.shape[1])) * ORDERS
            some[a:b] |= letter
        best, score = self.decide(logits * SCALE / np.maximum(sizes, 1) + self.bias)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0).tolist()

    def decide(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(logits / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """How many of rows (text) hold an n-gram of each bucket. Tasks add up their rows first; the driver gets BUCKETS sums."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in batches:
            last = -1
            for a, _, buckets, starts, _ in gram_buckets(texts_of(batch)):
                if a != last:
                    df += seen
                    seen[:] = False
                for i, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), buckets.shape[1]], strict=True)):
                    if i:
                        df += seen
                        seen[:] = False
                    seen[buckets[:, s:e]] = True
                last = a
            df += seen
            seen[:] = False
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["bucket", "df"])

    sums = map_arrow(rows.select("text"), counts, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"]] = sums["df"]
    return out


def sample(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Up to `most` distinct rows (lang, pick, text), as many of each language and one at least; which ones hangs on the texts alone."""
    pick = F.xxhash64("text", F.lit(7))
    sizes = stash(rows.groupBy("lang").agg(F.approx_count_distinct(pick, 0.02).alias("n")), "languages")
    each = max(1, most // max(1, sizes.count()))
    share = F.lit(1.5 * each + 50) / F.col("n")  # far more than `each` texts pass only with small chance; the window cuts them
    near = rows.join(sizes, "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", pick.alias("pick"), "text")
    near = stash(near.groupBy("lang", "pick").agg(F.min("text").alias("text")), "language-sample")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))).filter(F.col("place") <= each)


def shift_of(languages: int) -> int:
    """By how many bits buckets are shortened for so many languages."""
    return min(BITS - 8, max(0, -(-languages // LANGUAGES) - 1).bit_length())


def _sparse(rows: DataFrame) -> DataFrame:
    """lang, pick, buckets and counts: bounded by BUCKETS entries whatever the text's length."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for t in texts_of(batch):
                c = sum(np.bincount(part.ravel(), minlength=BUCKETS) for _, _, part, _, _ in gram_buckets([t]))
                u = np.flatnonzero(c)
                at.append(u.astype(np.int32))
                n.append((c[u] / c.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pick"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["lang", "pick", "at", "tf"])

    return map_arrow(rows.select("lang", "pick", "text"), features, "lang string, pick long, at array<int>, tf array<float>")


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by per-coordinate FTRL-proximal; an example is buckets, values and class."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in examples:
            at, x = np.append(at, buckets), np.append(x, 1.0)  # the last row is the bias
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax((x @ w)[None, :])[0]
            p[y] -= 1.0
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search; 1 if there is nothing to judge by."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(rows: DataFrame) -> Model:
    """A model from rows (text, lang); rows with a null text or language are left out. No rows: a model that knows no language.

    The sample's features, bounded by SAMPLE rows of BUCKETS entries, meet in one task, which fits and calibrates; the driver gets the model.
    """
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    df, total = document_frequencies(rows), rows.count()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(lang, at.astype(np.int64), tf) for b in batches for lang, at, tf in zip(b.column("lang").to_pylist(), *([x.values.to_numpy() for x in b.column(c)] for c in ("at", "tf")), strict=True)]
        if not got:
            return
        languages = {x: i for i, x in enumerate(sorted({lang for lang, *_ in got}))}
        shift = shift_of(len(languages))
        # Buckets that share weights count as frequent as the most frequent of them.
        idf = np.log((1 + total) / (1 + df.reshape(-1, 1 << shift).max(axis=1))) + 1

        def example(lang: str, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
            short, place = np.unique(at >> shift, return_inverse=True)
            return short, np.bincount(place, tf, len(short)) * idf[short] * SCALE, languages[lang]

        examples = [example(*g) for g in got]
        judged = len(examples) >= 50
        weights, bias = follow_the_leader([e for i, e in enumerate(examples) if i % 5 or not judged], len(languages), buckets=len(idf))
        judge = examples[::5] if judged else []
        logits = np.array([x @ weights[at] + bias for at, x, _ in judge]).reshape(len(judge), len(languages))
        temperature = calibrate(logits, np.array([y for *_, y in judge], int))
        columns = [pa.array([list(languages)]), pa.array([(weights * idf[:, None]).astype(np.float32).tobytes()]), pa.array([bias.tobytes()]), pa.array([temperature]), pa.array([shift], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["languages", "weights", "bias", "temperature", "shift"])

    one = _sparse(sample(rows)).repartition(1).sortWithinPartitions("pick", "lang")
    model = map_arrow(one, fitted, "languages array<string>, weights binary, bias binary, temperature double, shift int").first()
    if model is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    return Model(model["languages"], np.frombuffer(model["weights"], np.float32).reshape(BUCKETS >> model["shift"], -1), np.frombuffer(model["bias"]), model["temperature"], model["shift"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, from the text alone.

    Null texts and texts without a letter are `und` with score 0. Equal texts get equal answers, so rows that repeat an id are judged
    text by text. Very long texts are read whole. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, unchanged, whose text is in a known language with a probability of at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(texts_of(batch))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return map_arrow(docs, rows, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.filter(~held_out(F.col("doc_id")))))
