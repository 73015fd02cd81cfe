"""Near-duplicate groups by a chosen-path set similarity join.

1. Each document's word shingles become a set of 64-bit hashes; equal sets (by 128 bits) are one class, and only
   classes go on. A class has minwise tokens, by which it branches, and a sketch, by which it is compared.
2. Independent trees branch the classes by chosen minwise tokens: a node's classes share the tokens on
   its path, two of them to begin with. Nodes of one class end; small nodes compare their sketches exhaustively; large
   nodes branch again. Classes whose sketches agree enough hang together as candidates.
3. Candidate groups compare full sets exactly. Pairs already connected through others are passed over,
   which loses no connection.

A last node or a candidate group too large for a task is dealt into blocks with shared pivots, and every class that this
leaves apart from its main part meets all of it, in blocks: nothing in it goes uncompared.

A pair at the threshold shares a path in a tree with probability 0.8 a token, so TREES trees miss it with probability
0.36 ** TREES (8e-8) where nodes are small from the start and 0.49 ** TREES (1e-5) at the last level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_arrow, runs, texts_of, whole_groups
from tessera.llm.common import drop_stash, join_hot, keep_rows, may_match, row_key, stash, table
from tessera.llm.components import components, extended
from tessera.llm.exact_dedup import text_digest

#: Trees and tokens of their longest paths; a path begins with FIRST tokens.
TREES, LEVELS, FIRST = 16, 3, 2
TOKENS = TREES * LEVELS
#: Nodes of more classes branch; blocks of a last node or of a candidate group have at most so many classes and, with full sets, about so many shingles.
NODE, NODE_BLOCK, BLOCK, BLOCK_SHINGLES = 400, 2000, 1000, 4_000_000
PIVOTS = 16
#: Bins of a sketch, each with a value of 4 bits.
BINS = 256
#: Sketches of sets that are 0.8 alike agree in a lower share of their bins with probability under 1e-5.
AGREE = 0.7

_RNG = np.random.default_rng(20260701)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A, _B = _RNG.integers(0, 2**64, TOKENS, np.uint64) | np.uint64(1), _RNG.integers(0, 2**64, TOKENS, np.uint64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_STRETCH = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of raw bytes, worked through in stretches that end between words."""
    hashes, firsts, at = [], [], 0
    while at < len(raw):
        end = at + _STRETCH
        if end < len(raw):
            gap = np.flatnonzero(_SEPARATOR[raw[end : end + _STRETCH]])
            while not len(gap) and end + _STRETCH < len(raw):
                end += _STRETCH
                gap = np.flatnonzero(_SEPARATOR[raw[end : end + _STRETCH]])
            end = end + int(gap[0]) if len(gap) else len(raw)
        part = raw[at:end]
        inside = np.concatenate(([False], ~_SEPARATOR[part], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edges[::2], edges[1::2]
        if len(s):
            powers = np.empty(len(part), np.uint64)
            powers[0] = 1
            powers[1:] = _BASE
            np.cumprod(powers, out=powers)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[part] * powers, dtype=np.uint64)))
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            back = np.full(len(part), inverse, np.uint64)
            back[0] = 1
            np.cumprod(back, out=back)
            hashes.append(mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)))
            firsts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(firsts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, A-Z lower-cased. Fewer words: the whole sequence as one; none: empty."""
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raws])
    words, firsts = word_hashes(np.frombuffer(b" ".join(raws), np.uint8))
    edges = np.searchsorted(firsts, starts)
    n = max(0, len(words) - k + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n] * np.uint64((2 * j + 1) * 0xD6E8FEB86659FD93 % 2**64)
    grams = mix(grams)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = words[a:b] * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1))
            out.append(mix(np.array([whole.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def tokens(s: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: for each of TOKENS hash functions, the least value."""
    least = np.full(TOKENS, 2**32 - 1, np.uint32)
    for i in range(0, len(s), 4096):
        part = (s[i : i + 4096, None] * _A + _B) >> np.uint64(32)
        np.minimum(least, part.min(axis=0).astype(np.uint32), out=least)
    return least


def bins(s: np.ndarray) -> np.ndarray:
    """The sketch of a set (sorted): the least hash of each of BINS ranges as a value from 1 to 15, 0 for an empty range."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    at = np.searchsorted(s, edges)
    some = at < np.append(at[1:], len(s))
    least = mix(s[np.minimum(at, len(s) - 1)]) % np.uint64(15) + np.uint64(1)
    return np.where(some, least, 0).astype(np.uint8)


def packed(sketch: np.ndarray) -> bytes:
    return ((sketch[::2] << 4) | sketch[1::2]).tobytes()


def unpacked(raws: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), BINS // 2)
    out = np.empty((len(raws), BINS), np.uint8)
    out[:, ::2], out[:, 1::2] = both >> 4, both & 15
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that either sketch fills in which both have the same value."""
    either = np.maximum(a, b) > 0
    return ((a == b) & either).sum(axis=-1) / np.maximum(either.sum(axis=-1), 1)


#: Salts of a set's class and of the check that tells sets of one class apart.
_CLASS, _CHECK = np.uint64(0x632BE59BD9B4E019), np.uint64(0xA0761D6478BD642F)


def _bits_of(s: np.ndarray, salt: np.uint64) -> int:
    """64 bits that tell sets apart, as a signed long."""
    m = mix(s + salt)
    return int(mix(np.array([m.sum(dtype=np.uint64) ^ mix(np.array([np.bitwise_xor.reduce(m) + np.uint64(len(s))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, n_shingles, and class, check, tokens (4 bytes each) and bins (null for an empty set) of rows (doc_id, key, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, cls, checks, minwise, sketches = texts_of(batch), [], [], [], [], []
            for a, b in runs(texts):
                for s in shingle_sets(texts[a:b], k):
                    some = len(s) > 0
                    n.append(len(s))
                    cls.append(_bits_of(s, _CLASS) if some else None)
                    checks.append(_bits_of(s, _CHECK) if some else None)
                    minwise.append(tokens(s).astype(">u4").tobytes() if some else None)
                    sketches.append(packed(bins(s)) if some else None)
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(checks, pa.int64()), pa.array(minwise, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "class", "check", "tokens", "bins"])

    return map_arrow(docs.select("doc_id", "key", "text"), rows, "doc_id long, key binary, n_shingles long, class long, check long, tokens binary, bins binary")


def full_sets(wanted: DataFrame, k: int) -> DataFrame:
    """node, label, asks, class, shingles (8 bytes each) from rows (text, class, check, nodes); a text of another check gives none."""
    nodes = "array<struct<node:long,label:long,asks:boolean>>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in runs(texts):
                part, sets = batch.slice(a, b - a), shingle_sets(texts[a:b], k)
                keep = pa.array([len(s) > 0 and _bits_of(s, _CHECK) == c for s, c in zip(sets, part.column("check").to_pylist(), strict=True)], pa.bool_())
                both = pa.RecordBatch.from_arrays([part.column("nodes"), part.column("class"), pa.array([s.tobytes() for s in sets], pa.binary())], ["nodes", "class", "shingles"])
                yield both.filter(keep)

    return map_arrow(wanted.select("text", "class", "check", "nodes"), rows, f"nodes {nodes}, class long, shingles binary").select(F.explode("nodes").alias("n"), "class", "shingles").select("n.*", "class", "shingles")


def _token(tree: int, level: int) -> Column:
    return F.substring("tokens", 4 * (tree * LEVELS + level) + 1, 4)


def _linked(assigned: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes of one node whose sketches agree enough; a node is compared in one task. assigned: node, class,
    label, asks; pairs of one label, and pairs in which none asks, are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node, cls = t.column("node").to_numpy(), t.column("class").to_numpy()
            label, asks = t.column("label").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
            sketches = unpacked(t.column("bins").to_pylist())
            heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            sizes = np.diff(np.append(heads, len(node)))
            left, right = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]).tolist():
                h = heads[sizes == size]
                for q in range(1, size):
                    for p in range(q):
                        ok = (agreement(sketches[h + p], sketches[h + q]) >= AGREE) & (label[h + p] != label[h + q]) & (asks[h + p] | asks[h + q])
                        left.append(cls[h[ok] + p])
                        right.append(cls[h[ok] + q])
            for h, size in zip(heads[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                own = slice(h, h + size)
                a, b = stars(cls[own], spanning(sketches[own], None, label[own].tolist(), asks[own]))
                left.append(a)
                right.append(b)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows_in = assigned.join(classes.select("class", "bins"), "class").select("node", "class", "label", "asks", "bins").repartition("node").sortWithinPartitions("node")
    return map_arrow(rows_in, rows, "a long, b long")


def spanning(sketches: np.ndarray, sets: list[np.ndarray] | None, labels: list[int], asks: np.ndarray) -> np.ndarray:
    """Edges that connect what exhaustive comparison would connect, and no more of them than that takes.

    Sketches decide alone, or let full sets decide if those are given. labels: what has the same one is connected already.
    asks: only pairs with one of these at least are compared.
    """
    n = len(sketches)
    first: dict[int, int] = {}
    roots = np.array([first.setdefault(x, i) for i, x in enumerate(labels)])
    sizes = np.array([len(s) for s in sets]) if sets is not None else None
    edges = []
    for i in range(1, n):
        open_ = roots[:i] != roots[i]
        if not asks[i]:
            open_ &= asks[:i]
        if sizes is not None:
            open_ &= np.minimum(sizes[:i], sizes[i]) >= 0.8 * np.maximum(sizes[:i], sizes[i]) - 1e-6
        js = np.flatnonzero(open_)
        if not len(js):
            continue
        agree = agreement(sketches[js], sketches[i])
        js = js[agree >= AGREE][np.argsort(-agree[agree >= AGREE], kind="stable")]
        while len(js):
            j = int(js[0])
            if sets is None or alike(sets[i], sets[j]):
                edges.append((j, i))
                old, new = roots[i], roots[j]
                roots[roots == old] = new
                js = js[roots[js] != new]
            else:
                js = js[1:]
    return np.array(edges, np.int64).reshape(-1, 2)


def stars(names: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with every name under the least of its component: paths of one step, and the same ones from all trees."""
    root = np.arange(len(names))
    for a, b in edges.tolist():
        x, y = root[a], root[b]
        if x != y:
            root[root == x] = y
    linked = np.unique(edges)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, root[linked], names[linked])
    return least[root[linked]], names[linked]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def _every(nodes: DataFrame) -> DataFrame:
    """node, class with label, asks of classes that are each compared with all of their node."""
    return nodes.select("node", "class", F.col("class").alias("label"), F.lit(True).alias("asks"))


def candidates(classes: DataFrame) -> DataFrame:
    """(node, root), stored: components of the classes by sketches, from all trees."""
    paths = F.explode(F.array(*[F.array(*[F.xxhash64(F.lit(r), *[_token(r, i) for i in range(n)]) for n in range(FIRST, LEVELS + 1)]) for r in range(TREES)]))
    level, found, last, rows = FIRST, [], None, classes.select("class", paths.alias("path"))
    total = TREES * classes.count()
    while True:
        rows = rows.select("class", F.col("path")[0].alias("node"), F.slice("path", 2, LEVELS).alias("path"))
        sizes = stash(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        shared = stash(join_hot(rows, sizes, "node", "size", total), "nodes")
        drop_stash(sizes)
        found.append(_every(shared.filter(F.col("size") <= NODE)))
        large = shared.filter(F.col("size") > NODE)
        total = large.count()
        if not total:
            break
        if level == LEVELS:
            last = large.select(F.col("node").alias("key"), "class", F.col("size").alias("n"), "size")
            found.append(_blocks(last, NODE_BLOCK))
            break
        level, rows = level + 1, large
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    roots = components(_linked(out, classes))
    apart = None if last is None else _apart(last, roots, NODE_BLOCK)
    return roots if apart is None else extended(roots, stash(_linked(apart, classes), "apart"))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """node, class, label, asks: rows (key, class, size) of each key dealt into blocks of about `most`, each block with the key's pivots."""
    pivots = rows.groupBy("key").agg(F.max("size").alias("size"), F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("class", F.lit(j)), F.col("class")))["class"] for j in range(PIVOTS)])).alias("pivots"))
    count = F.ceil(F.col("size") / most).cast("int")
    block = lambda i: F.xxhash64(F.col("key"), F.lit(1), i.cast("long"))
    dealt = rows.select(block(F.pmod(F.xxhash64("class", "key"), count)).alias("node"), "class")
    shared = pivots.select("key", "size", F.explode("pivots").alias("class")).select("key", "class", F.explode(F.sequence(F.lit(0), count - 1)).alias("i")).select(block(F.col("i")).alias("node"), "class")
    return _every(dealt.unionByName(shared).distinct())


def _apart(rows: DataFrame, roots: DataFrame, most: int) -> DataFrame | None:
    """node, class, label, asks: every class that the components `roots` leave outside the main part of its key meets all of the key,
    in blocks of both. None if there is no such class. rows (stored): key, class, n (rows of the key), size."""
    found = roots.select(F.col("node").alias("class"), "root")
    labelled = stash(rows.join(found, "class", "left").select("key", "class", "n", "size", F.coalesce("root", "class").alias("label")), "labelled")
    parts = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("rest"), F.sum("c").alias("n")).filter("rest > 0")
    parts = stash(parts, "parts")
    if not parts.take(1):
        return None
    sides = join_hot(labelled.drop("n"), parts, "key", "n", labelled.count()).withColumn("asks", F.col("label") != F.col("main"))
    sides = sides.withColumn("blocks", F.ceil(F.col("size") / most).cast("int")).withColumn("parts", F.ceil(F.col("rest") / most).cast("int"))
    own, part = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int")
    node = lambda b, p: F.xxhash64(F.col("key"), F.lit(3), b, p)
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: node(own, p))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: node(b, part))
    return sides.select("class", "label", "asks", F.explode(F.array_distinct(F.concat(meets, F.when(F.col("asks"), asked).otherwise(F.array().cast("array<long>"))))).alias("node"))


def _compared(docs: DataFrame, k: int, classes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges (a, b) between classes of a node whose full sets are alike, as far as they connect something new. assigned as in _linked.

    Of the texts (docs: key, text), those that a bounded filter on their keys passes are brought to the classes they stand for.
    """
    nodes = assigned.groupBy("class").agg(F.collect_set(F.struct("node", "label", "asks")).alias("nodes"))
    wanted = stash(nodes.join(classes.select("class", "check", "key"), "class"), "wanted")
    texts = may_match(docs.select("key", "text"), "key", wanted.select("key")).filter("maybe_").select("key", "text").dropDuplicates(["key"])
    sets = full_sets(texts.join(wanted, "key").select("text", "class", "check", "nodes"), k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node, cls, raw = t.column("node").to_numpy(), t.column("class").to_numpy(), t.column("shingles")
            label, asks = t.column("label").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))).tolist()
            left, right = [], []
            for a, b in zip(heads, [*heads[1:], len(node)], strict=True):
                at = a + np.unique(cls[a:b], return_index=True)[1]
                if len(at) < 2:
                    continue
                sets_ = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in at]
                x, y = stars(cls[at], spanning(np.stack([bins(s) for s in sets_]), sets_, label[at].tolist(), asks[at]))
                left += x.tolist()
                right += y.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return map_arrow(sets.repartition("node").sortWithinPartitions("node"), rows, "a long, b long")


def _verified(docs: DataFrame, k: int, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, root): components of the classes by full sets. groups: (node, root) by sketches."""
    members = stash(groups.select(F.col("node").alias("class"), F.col("root").alias("key")).join(classes.select("class", "n_shingles"), "class"), "members")
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") * (BLOCK / BLOCK_SHINGLES)))
    sizes = stash(members.groupBy("key").agg(F.count("*").alias("n"), weight.alias("size")), "sizes")
    sized = stash(join_hot(members, sizes, "key", "n", members.count()).select("key", "class", "n", "size"), "groups")
    for done in (members, sizes):
        drop_stash(done)
    small, huge = sized.filter(F.col("size") <= BLOCK), sized.filter(F.col("size") > BLOCK)
    nodes = _every(small.select(F.col("key").alias("node"), "class"))
    if not huge.take(1):
        return components(_compared(docs, k, classes, nodes))
    roots = components(_compared(docs, k, classes, nodes.unionByName(_blocks(huge, BLOCK))))
    apart = _apart(huge, roots, BLOCK)
    return roots if apart is None else extended(roots, stash(_compared(docs, k, classes, apart), "apart"))


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents whose sets of k-word shingles are 0.8 alike or more are linked; component_id is the smallest
    doc_id reachable, and the document with that id is kept. Words part at ASCII white space and A-Z is
    lower-cased. A text of fewer than k words is one shingle; one without words, or null, is linked with
    nothing. Very long texts are worked through in stretches. Rows that repeat an id are texts of their own with one verdict by
    id; null ids yield to others of their component. An empty table gives no rows. Other columns are not read.
    """
    key = F.encode(F.concat_ws(" ", F.xxhash64("text").cast("string"), F.col("doc_id").cast("string")), "UTF-8")
    return _verdicts(docs.select("doc_id", "text", key.alias("key")), k).select("doc_id", "n_shingles", "component_id", "kept")


def _classes(some: DataFrame) -> DataFrame:
    """One row a class; check < last_check if it has several sets."""
    first = [F.first(c).alias(c) for c in ("n_shingles", "tokens", "bins")]
    return some.groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.min("key").alias("key"), F.count("*").alias("n_docs"), F.min("check").alias("check"), F.max("check").alias("last_check"), *first)


def told_apart(sketches: DataFrame, shared: DataFrame) -> DataFrame:
    """sketches in which different sets of the classes in `shared` have classes of their own."""
    several = sketches.join(shared.withColumn("several", F.lit(True)), "class", "left")
    return several.withColumn("class", F.when(F.col("several"), F.xxhash64("class", "check")).otherwise(F.col("class"))).select(*sketches.columns)


def _verdicts(docs: DataFrame, k: int) -> DataFrame:
    """near_duplicates of docs (doc_id, text, and a key that tells their rows' texts apart) with each row's key and group (root, null for a text without words)."""
    sketches = stash(sketch(docs, k), "sketches")
    some = sketches.filter("class IS NOT NULL")
    classes = stash(_classes(some), "classes")
    shared = classes.filter("check < last_check").select("class")
    if shared.take(1):
        sketches = stash(told_apart(sketches, shared), "sketches-apart")
        some = sketches.filter("class IS NOT NULL")
        classes = stash(_classes(some), "classes")
    groups = candidates(classes.select("class", "tokens", "bins"))
    roots = _verified(docs, k, classes.select("class", "check", "key", "n_shingles"), groups).withColumnRenamed("node", "class")
    labels = stash(classes.select("class", "first_doc", "n_docs").join(roots, "class", "left").select("class", "first_doc", "n_docs", F.coalesce("root", "class").alias("root")), "labels")
    for done in (groups, classes):
        drop_stash(done)
    least = stash(labels.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n")), "roots")
    by_class = stash(join_hot(labels, least, "root", "n", labels.count()).select("class", "root", "component_id", "n_docs"), "by-class")
    linked = join_hot(some.select("doc_id", "key", "n_shingles", "class"), by_class, "class", "n_docs", sketches.count()).select("doc_id", "key", "n_shingles", "component_id", "root")
    alone = sketches.filter("class IS NULL").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns: one of each group. Texts without words are in no
    group; of such rows that repeat id and text, one. Null ids, repeated ids and an empty table are as in near_duplicates."""
    key = row_key(F.col("doc_id"), F.unhex(text_digest(F.col("text"))))
    found = stash(_verdicts(docs.select("doc_id", "text", key.alias("key")), k).select("doc_id", "key", "root", "kept"), "kept")
    # An id, or null where a group has no id, may be on several texts of its group.
    several = found.filter("kept AND root IS NOT NULL").groupBy("doc_id", "root").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    same = F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.root") == F.col("s.root"))
    judged = found.alias("f").join(several.alias("s"), same, "left").select("f.key", (F.col("f.kept") & F.coalesce(F.col("f.key") == F.col("s.first"), F.lit(True))).alias("kept"))
    return keep_rows(docs, key, judged)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


#: All pairs that share a shingle, then the least id reachable; for tables of a few thousand documents.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                                    WHEN len(words) = 1 THEN words ELSE [] END) AS shingles FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM s),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT s.doc_id, CAST(len(any_value(s.shingles)) AS BIGINT) AS n_shingles, min(r.reached) AS component_id, s.doc_id = min(r.reached) AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""
