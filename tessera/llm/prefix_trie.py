"""The trie of conversation prefixes.

Conversations, as sequences of turn keys, are dealt by range into shards. A shard gives its turns dense numbers and builds a ternary
search tree over them: sequences go in median first, so siblings are balanced. One iterative walk lists the nodes, and going back
along it adds up members, leaves and savings.

As shards are ranges, a node lies in one shard alone unless it is on the path of the shard's first or last sequence. Such boundary
nodes come out as shares, and are merged by relational steps: shares add up, and sums over subtrees run along the boundary paths,
where a node is counted on the first path that holds it. (The nodes that a path is the first to hold are its deepest ones.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.batches import map_arrow
from tessera.llm.common import stash, table

#: Turns are first collected and sorted in stretches of so many turn numbers, so many tasks share a long conversation.
STRETCH = 512
#: Turns of a shard, about: bounds a task's memory but for a longer conversation, which is a path of its own.
SHARD_TURNS = 100_000

ROOT = hashlib.md5(b"").digest()
_NODES = "shard int, edge int, pid binary, parent_pid binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, ends binary"


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of key and words): turns in order (null first; ties by role, then text). The key is a digest of role and text, words the
    text's number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    row = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), key.alias("key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    part = turns.filter("conv_id IS NOT NULL").groupBy("conv_id", F.floor(F.col("turn") / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    short = part.select("conv_id", "stretch", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("t"))
    whole = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("stretch"), F.col("t")))).alias("s"))
    return whole.select("conv_id", F.flatten(F.transform("s", lambda x: x["t"])).alias("turns"))


def with_shared_heads(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Sequences rebuilt: the first h turns of conversation c - c % every in place of c's own first h, h = crc32(decimal c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = sequences.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    x = sequences.withColumn("h", h).withColumn("base", base).join(heads, "base", "left")
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.lit(1), F.size("turns")))).otherwise(F.slice("turns", 1, 0))
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    return x.select("conv_id", F.concat(head, own).alias("turns"))


class TernaryTree:
    """A ternary search tree over sequences of numbers. Each of its nodes is a node of the trie: `down` leads to its children's search tree, `low` and
    `high` to siblings. Node 0 is the root."""

    def __init__(self):
        self.code, self.low, self.high, self.down, self.up = [-1], [0], [0], [0], [-1]

    def insert(self, sequence: list[int]) -> int:
        """The node where the sequence ends."""
        code, low, high, down = self.code, self.low, self.high, self.down
        node = 0
        for c in sequence:
            at = down[node]
            if not at:
                at = down[node] = self._add(c, node)
            else:
                while code[at] != c:
                    side = low if c < code[at] else high
                    if not side[at]:
                        side[at] = self._add(c, node)
                    at = side[at]
            node = at
        return node

    def _add(self, c: int, up: int) -> int:
        self.code.append(c)
        self.low.append(0)
        self.high.append(0)
        self.down.append(0)
        self.up.append(up)
        return len(self.code) - 1

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """Inserts sorted distinct sequences, the median first, then the medians of both halves; the node where each ends."""
        ends, spans = [0] * len(sequences), [(0, len(sequences))]
        while spans:
            a, b = spans.pop()
            if a < b:
                m = (a + b) // 2
                ends[m] = self.insert(sequences[m])
                spans += [(m + 1, b), (a, m)]
        return ends

    def walk(self) -> list[int]:
        """The trie's nodes in order of their sequences, each before its children."""
        out, stack = [0], [(self.down[0], False)] if self.down[0] else []
        while stack:
            node, mine = stack.pop()
            if mine:
                out.append(node)
                if self.down[node]:
                    stack.append((self.down[node], False))
            else:
                if self.high[node]:
                    stack.append((self.high[node], False))
                stack.append((node, True))
                if self.low[node]:
                    stack.append((self.low[node], False))
        return out


def _shard(rows: list[tuple[int, list[bytes], list[int]]], shard: int) -> Iterator[tuple]:
    """The nodes (_NODES) of a shard's rows (conv_id, keys, words), sorted by keys, then conv_id. Boundary nodes have an edge (0: on the first path, 1: on
    the last), and the second path of a node that is on both brings no share."""
    codes = {k: i for i, k in enumerate(sorted({k for _, keys, _ in rows for k in keys}))}
    words_of = [0] * len(codes)
    distinct: list[list[int]] = []
    members: list[list[int]] = []
    for conv, keys, words in rows:
        own = [codes[k] for k in keys]
        for c, w in zip(own, words, strict=True):
            words_of[c] = w
        if not distinct or distinct[-1] != own:
            distinct.append(own)
            members.append([])
        members[-1].append(conv)
    tree = TernaryTree()
    ends = dict(zip(tree.insert_sorted(distinct), members, strict=True))
    n = len(tree.code)
    code, up = tree.code, tree.up
    count, least, children, leaves, saved, depth = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, convs in ends.items():
        count[node], least[node] = len(convs), min(convs)
    order = tree.walk()
    for node in order[1:]:
        depth[node] = depth[up[node]] + 1
    edges: list[list[int]] = []
    names = {0: ROOT}
    by_code = {i: k for k, i in codes.items()}
    for sequence in (distinct[0], distinct[-1]):
        path = [0]
        for c in sequence:
            at = tree.down[path[-1]]
            while code[at] != c:
                at = tree.low[at] if c < code[at] else tree.high[at]
            if at not in names:
                names[at] = hashlib.md5(names[path[-1]] + by_code[c]).digest()
            path.append(at)
        edges.append(path)
    for node in reversed(order):
        if not children[node] and node not in names:
            leaves[node] = 1
        saved[node] += (count[node] - 1) * words_of[code[node]] if node and node not in names else 0
        if node:
            parent = up[node]
            count[parent] += count[node]
            least[parent] = least[node] if least[parent] is None else min(least[parent], least[node])
            if node not in names:
                children[parent] += 1
                leaves[parent] += leaves[node]
                saved[parent] += saved[node]
    text = lambda node: ",".join(map(str, sorted(ends.get(node, ())))).encode()  # noqa: E731
    for node in order:
        if node not in names:
            parent = up[node]
            inner = parent not in names
            yield shard, None, None, None if inner else names[parent], least[node], depth[node], least[parent] if inner else None, count[node], children[node], leaves[node], saved[node], hashlib.sha256(text(node)).hexdigest(), None, None
    seen = set()
    for edge, path in enumerate(edges):
        for node in path:
            mine = node not in seen
            seen.add(node)
            share = (count[node], children[node], leaves[node], saved[node]) if mine else (0, 0, 0, 0)
            yield shard, edge, names[node], names[up[node]] if node else None, least[node], depth[node], None, *share, None, words_of[code[node]] if node else 0, text(node) if mine and node in ends else None


def shards(sequences: DataFrame, count: int) -> DataFrame:
    """The nodes (_NODES) of each range shard."""
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _NODES.split(", ")]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "keys", "words")), strict=True)]
        out: list[tuple] = []
        for node in _shard(rows, TaskContext.get().partitionId()) if rows else ():
            out.append(node)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    dealt = sequences.repartitionByRange(count, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return map_arrow(dealt, nodes, _NODES)


def _joined_ends(shares: DataFrame) -> DataFrame:
    """pid, ends_sha256 of boundary nodes where conversations end: the shares' texts, in order of the shards, run through one digest each; none is held whole."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for b in batches:
            done = []
            for pid, ends in zip(b.column("pid").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if pid != at:
                    if at is not None:
                        done.append((at, running.hexdigest()))
                    at, running = pid, hashlib.sha256(ends)
                else:
                    running.update(b"," + ends)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["pid", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["pid", "ends_sha256"])

    texts = shares.filter("ends IS NOT NULL").select("pid", "shard", "ends").repartition("pid").sortWithinPartitions("pid", "shard")
    return map_arrow(texts, digests, "pid binary, ends_sha256 string")


def merge_boundaries(nodes: DataFrame) -> DataFrame:
    """The trie's nodes from the shards' (stored)."""
    shares = nodes.filter("edge IS NOT NULL").withColumn("path", F.col("shard") * 2 + F.col("edge"))
    merged = shares.groupBy("pid").agg(
        F.min("path").alias("first"),
        F.first("parent_pid").alias("parent_pid"),
        F.first("depth").alias("depth"),
        F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    inner = merged.filter("parent_pid IS NOT NULL").groupBy(F.col("parent_pid").alias("pid")).agg(F.count("*").alias("more"))
    known = stash(
        merged.join(inner, "pid", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
        .withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
        .drop("more"),
        "boundary-nodes",
    )
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = lambda c: F.when(F.col("path") == F.col("first"), F.col(c)).otherwise(0)  # noqa: E731
    along = shares.select("path", "pid").join(known.select("pid", "first", "depth", "n_leaves", "saved_tokens"), "pid")
    sums = along.select("pid", F.sum(mine("n_leaves")).over(below).alias("n_leaves"), F.sum(mine("saved_tokens")).over(below).alias("saved_tokens")).groupBy("pid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    names = known.select(F.col("pid").alias("parent_pid"), F.col("conv_id").alias("above"))
    edge = known.drop("n_leaves", "saved_tokens").join(sums, "pid").join(_joined_ends(shares), "pid", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    # The root has more children than any other node: its own go by a literal row and not through a join.
    top = F.broadcast(known.filter("depth = 0").select(F.col("conv_id").alias("least")))  # one row
    both = edge.select("parent_pid", F.lit(None).cast("long").alias("parent_conv_id"), *_REST).unionByName(nodes.filter("edge IS NULL").select("parent_pid", "parent_conv_id", *_REST))
    first = both.filter("depth = 1").crossJoin(top).withColumn("parent_conv_id", F.col("least"))
    deeper = both.filter("depth > 1 AND parent_conv_id IS NULL").join(names, "parent_pid").withColumn("parent_conv_id", F.col("above"))
    parts = [both.filter("depth = 0"), first, deeper, both.filter("depth > 1 AND parent_conv_id IS NOT NULL")]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = parts[0].select(columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(columns))
    return out


_REST = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the trie of sequences (conv_id,
    turns: array of key and words).

    A node is a distinct sequence of first turns, the root the empty one; its members are the conversations that start with it. conv_id is
    the smallest of them. saved_tokens is what keeping each turn of the subtree once saves, in words, and ends_sha256 a digest of the
    ids that end at the node. Ids are distinct; a conversation may have no turns. Long conversations are paths, whose turn keys
    a task holds (24 bytes a turn). An empty table has no nodes, not even a root. Other columns are not read.
    """
    rows = stash(sequences.select("conv_id", F.transform("turns", lambda x: x["key"]).alias("keys"), F.transform("turns", lambda x: x["words"]).alias("words")), "sequences")
    total, turns = rows.agg(F.count("*"), F.sum(F.size("keys"))).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return merge_boundaries(stash(shards(rows, 1 + (turns + total) // shard_turns), "trie-shards"))


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """prefix_trie of the conversations in turns (conv_id, turn, role, text), heads shared as in with_shared_heads.

    Null roles and texts are empty; rows without a conv_id belong to no conversation and are left out; turns that repeat are
    turns of their own. Very long texts count by a digest. Other columns are not read.
    """
    return prefix_trie(with_shared_heads(sequences(turns)), shard_turns)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: The checksum is a fold over bytes and bits, as DuckDB has none.
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda v, z: xor(v >> 1, 3988292384 * (v % 2)))), 4294967295)"
OP13_SQL = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c, p, 0 AS own, role, text FROM i JOIN o ON o.conv_id = base AND p <= h UNION ALL SELECT c, p, 1, role, text FROM i JOIN o ON o.conv_id = c AND p > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, md5(concat(length(role), ':', role, text)) AS k, len(regexp_extract_all(text, '[^ 	-]+')) AS w FROM r),
m AS (SELECT c, d, w, string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM s UNION ALL SELECT c, 0, 0, '' FROM i),
e AS (SELECT c, max(d) AS last FROM m GROUP BY c),
n AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends_sha256 FROM m JOIN e USING (c) GROUP BY path, d),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
z AS (SELECT left(path, 32 * j) AS path, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM b) GROUP BY 1)
SELECT b.conv_id, b.depth, p.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, b.ends_sha256
FROM b JOIN z USING (path) LEFT JOIN b p ON b.depth > 0 AND p.path = left(b.path, 32 * (b.depth - 1))
"""
