"""Personal data by base patterns and bootstrapped contextual extraction.

One scan of each text finds the base entities and, beside them, every other token that could be an
identifier, each with its lexical context (the two words before and the one after). Patterns (a context
for a kind of entity) and instances (what stands there) form a graph. A second scan counts how often anything at all stands in
the contexts that meet enough seeds, so a context of everyday words is never sure. Spark scores the graph in rounds: a pattern
is as sure as the instances it meets, an instance as sure as its surest pattern. Patterns that end up sure
extract the tokens no base pattern saw.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_arrow, texts_of
from tessera.llm.common import stash, table
from tessera.llm.minhash import mix, word_hashes

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: What a pattern needs to extract: so many different base instances, and such a score.
MIN_SEEDS, MIN_SCORE = 5, 0.8
#: Patterns are broadcast up to so many and shuffled beyond.
BROADCAST_PATTERNS = 100_000
BITMAP = 1 << 20

# An e-mail is found from its @: the longest run of local characters before it, then the domain.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits never begins inside another: what fails at its start fails further on as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_BLANK = re.compile(r"[\x09-\x0D ]")
_EDGE = "\"'`.,;:!?()[]{}<>|=*"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base entities by kind as listed, then start; leftmost and non-overlapping within a kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _ANY_DIGIT(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


_ANY_DIGIT = re.compile("[0-9]").search


def shape_fits(kind: str, token: str) -> bool:
    """Whether a token could be an entity of that kind at all."""
    n = len(_digits(token))
    if kind == "email":
        return "@" in token[1:-1]
    if kind == "ip":
        return token.count(".") == 3 and n >= 4
    return 12 <= n <= 19 if kind == "card" else 7 <= n <= 15


def _key(before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before2 * np.uint64(0x9E3779B97F4A7C15) + before * np.uint64(0xC2B2AE3D27D4EB4F) + after).view(np.int64)


def _hashes(text: str) -> np.ndarray:
    """Hashes of the text's words (A-Z lower-cased), with two marks before and one behind."""
    return word_hashes(np.frombuffer(b"\0^ \0^ " + text.encode("utf-8", "surrogatepass").lower() + b" \0$", np.uint8))[0]


def context_keys(text: str) -> np.ndarray:
    """The context of each word: a hash of the two words before and the one after."""
    h = _hashes(text)
    return _key(h[:-3], h[1:-2], h[3:])


def context(text: str, start: int, end: int) -> int:
    """The context of the words that hold text[start:end]."""
    while start > 0 and not _BLANK.match(text[start - 1]):
        start -= 1
    m = _BLANK.search(text, end)
    end = m.start() if m else len(text)
    # Words next to the span, found in a widening window that never cuts one.
    before, after = _words_before(text, start), _word_after(text, end)
    h = word_hashes(np.frombuffer(" ".join([*before, after]).encode("utf-8", "surrogatepass").lower(), np.uint8))[0]
    return int(_key(h[0:1], h[1:2], h[2:3])[0])


def _words_before(text: str, start: int) -> list[str]:
    words, end = [], start
    while len(words) < 2:
        while end > 0 and _BLANK.match(text[end - 1]):
            end -= 1
        if end == 0:
            return ["\0^"] * (2 - len(words)) + words[::-1]
        at = end
        while at > 0 and not _BLANK.match(text[at - 1]):
            at -= 1
        words.append(text[at:end])
        end = at
    return words[::-1]


def _word_after(text: str, end: int) -> str:
    m = _NEXT.match(text, end)
    return m[1] if m else "\0$"


_NEXT = re.compile(r"[\x09-\x0D ]*([^\x09-\x0D ]+)")


def loose_tokens(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or @, bare of edge punctuation, that overlap no span."""
    taken = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    out, last = [], 0
    while m := _MARK.search(text, last):
        a = m.start()
        while a > last and not text[a - 1].isspace():
            a -= 1
        stop = _BLANK.search(text, m.end())
        last = stop.start() if stop else len(text)
        whole = text[a:last]
        bare = whole.strip(_EDGE)
        if len(bare) < 5:
            continue
        a += whole.index(bare)
        b = a + len(bare)
        i = bisect_right(starts, b - 1) - 1
        if i < 0 or reach[i] <= a:
            out.append((a, b))
    return out


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, spans (kind, start, end) and mentions: context, instance (a hash), start, end, and the kinds it is or could be."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        mention = pa.struct([("context", pa.int64()), ("instance", pa.string()), ("kind", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans, mentions = [], []
            for t in texts_of(batch):
                own = base_spans(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                seen = [(k, True, a, b) for k, a, b in own]
                if "@" in t or _ANY_DIGIT(t):
                    seen += [(k, False, a, b) for a, b in loose_tokens(t, own) for k in KINDS if shape_fits(k, t[a:b])]
                mentions.append([{"context": context(t, a, b), "instance": hashlib.md5(t[a:b].lower().encode()).hexdigest()[:16], "kind": k, "seed": s, "start": a, "end": b} for k, s, a, b in seen])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(spans, pa.list_(span)), pa.array(mentions, pa.list_(mention))], [key, "spans", "mentions"])

    return map_arrow(docs.select(key, "text"), rows, f"{key} long, spans array<struct<kind:string,start:long,end:long>>, mentions array<struct<context:long,instance:string,kind:string,seed:boolean,start:long,end:long>>")


def count_contexts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, total): how many words of all texts stand in each of `contexts`.

    Tasks pass on what a bitmap of fixed size, broadcast, lets through; a join settles the rest.
    """
    marks = contexts.select(F.pmod("context", F.lit(BITMAP)).cast("int").alias("bit")).distinct().toPandas()["bit"]
    bitmap = np.zeros(BITMAP, bool)
    bitmap[marks] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            found = [k[some[k % BITMAP]] for k in map(context_keys, texts_of(batch))]
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["context", "n"])

    counts = map_arrow(docs.select("text"), rows, "context long, n long").groupBy("context").agg(F.sum("n").alias("total"))
    return counts.join(contexts, "context", "left_semi")


def score_patterns(docs: DataFrame, mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, score, seeds) of the patterns that extract. mentions: context, instance, kind, seed.

    A pattern's score is the sum of its mentions' confidence over all that stands in its context, held back by one more; a base
    instance has confidence 1, another the best score of a pattern that met it in the round before. Only patterns
    with enough different base instances take part, so the graph is cut down before it is walked.
    """
    edges = mentions.groupBy("context", "instance", "kind").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    seeds = edges.groupBy("context", "kind").agg(F.sum(F.col("seed").cast("long")).alias("seeds"), F.sum("n").alias("met")).filter(F.col("seeds") >= MIN_SEEDS)
    seeds = stash(seeds, "seeds")
    totals = count_contexts(docs, seeds.select("context").distinct())
    patterns = stash(seeds.join(totals, "context", "left").select("context", "kind", "seeds", F.greatest("met", F.coalesce("total", F.lit(0))).alias("total")), "patterns")
    small = patterns.count() <= BROADCAST_PATTERNS
    graph = stash(edges.join(F.broadcast(patterns) if small else patterns, ["context", "kind"]), "pattern-graph")
    base = graph.groupBy("instance", "kind").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    belief = base
    for step in range(rounds):
        scored = graph.join(belief, ["instance", "kind"]).groupBy("context", "kind").agg((F.sum(F.col("n") * F.col("belief")) / (F.max("total") + 1)).alias("score"), F.max("seeds").alias("seeds"))
        scored = stash(scored, f"scores-{step}")
        sure = scored.select("context", "kind", F.col("score").alias("belief"))
        again = graph.join(F.broadcast(sure) if small else sure, ["context", "kind"]).select("instance", "kind", "belief")
        belief = base.unionByName(again).groupBy("instance", "kind").agg(F.max("belief").alias("belief"))
    return stash(scored.filter(F.col("score") >= MIN_SCORE), "sure-patterns")


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def extract(docs: DataFrame, key: str) -> DataFrame:
    """key, spans, added for docs (key: long, need not be unique; text)."""
    found = stash(scan(docs, key), "scanned").withColumn("row_", F.monotonically_increasing_id())
    mentions = found.select("row_", F.explode("mentions").alias("m")).select("row_", "m.*")
    patterns = score_patterns(docs, mentions)
    patterns = F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns
    hits = mentions.filter("NOT seed").join(patterns, ["context", "kind"])
    best = hits.groupBy("row_", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    added = best.groupBy("row_").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return found.select("row_", key, "spans").join(added, "row_", "left").select(key, "spans", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans and added: all base spans of each row, and those that patterns add (kind, start, end; code points).

    Added spans are free of base spans and of each other: of several kinds at one place the surest pattern's.
    Null texts are empty. Rows that repeat an id are texts of their own. Very long texts are searched whole. An empty table gives no rows. Other columns are not read.
    """
    return extract(docs, "doc_id")


def _joined(spans) -> object:
    """kind:start:end by kind as listed, then start."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_spans(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with each span in text replaced by its kind in brackets; all columns stay.

    Overlapping spans are one, named by the kind of the first; a null text stays null. Patterns go to the tasks while
    they are few; beyond, rows get an id and the spans are joined to them.
    """
    mentions = stash(scan(docs.select("text", F.lit(0).cast("long").alias("k")), "k").select(F.explode("mentions").alias("m")).select("m.*"), "mentions")
    patterns = score_patterns(docs, mentions)
    if patterns.count() > BROADCAST_PATTERNS:
        return _redact_joined(docs)
    shared = docs.sparkSession.sparkContext.broadcast({(r["context"], r["kind"]): r["score"] for r in patterns.collect()})
    names, at = docs.columns, docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else replace_spans(t, all_spans(t, shared.value)) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, rows, docs.schema)


def all_spans(text: str, patterns: dict[tuple[int, str], float]) -> list[dict]:
    """Base spans, and those that the patterns add: of several kinds at one place the surest pattern's."""
    spans = base_spans(text)
    if patterns and ("@" in text or _ANY_DIGIT(text)):
        for a, b in loose_tokens(text, spans):
            kinds = [k for k in KINDS if shape_fits(k, text[a:b])]
            if kinds:
                c = context(text, a, b)
                sure = [(patterns[c, k], k) for k in kinds if (c, k) in patterns]
                spans += [(max(sure)[1], a, b)] if sure else []
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def _redact_joined(docs: DataFrame) -> DataFrame:
    row = "row_" + "_" * max(map(len, docs.columns))  # longer than any column's name
    rows_ = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marked = extract(rows_, row).filter("size(spans) + size(added) > 0").select(row, F.concat("spans", "added").alias(row + "spans"))
    both = rows_.join(marked, row, "left").drop(row)
    names, at = docs.columns, docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array([replace_spans(t, s) for t, s in zip(columns[at].to_pylist(), batch.columns[-1].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(both, rows, docs.schema)


def replace_spans(text: str | None, spans: list[dict] | None) -> str | None:
    if not spans or text is None:
        return text
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind']}]"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_spans(find_personal_data(table(spark, sf_dir, "documents")))
