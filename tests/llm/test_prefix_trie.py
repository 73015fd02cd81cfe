"""The prefix trie against a plain dictionary of prefixes, over one shard and many, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, words long, shard int, edge int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in rebuilt(rows).items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, convs in members.items():
        own = (len(convs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(v), len(p), min(members[p[:-1]]) if p else None, len(v), children[p], leaves[p], saved[p], sha(p)) for p, v in members.items()), key=str)


def found(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "k", 5, 6, 1) for r in rows], SCHEMA)
    got = prefix_trie.conversation_trie(turns, **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def chats(seed, n=260):
    """Few texts, so prefixes are shared; a third are copies of one; ids below 0 too."""
    r = random.Random(seed)
    text = lambda: r.choice(["yes", "no no", " \t", "", "so  it is", None])
    rows = []
    for c in range(-60, n):
        turns = ["hot", "very hot", "hot"] if r.random() < 0.33 else [text() for _ in range(r.choice([1, 2, 2, 3, 5, 9]))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [100_000, 60, 8])
def test_equals_a_dictionary_of_prefixes(spark, shard_turns):
    rows = chats(5)
    want = brute(rows)
    assert len(want) > 100 and found(spark, rows, shard_turns=shard_turns) == want


def test_awkward_tables(spark):
    """Null ids, turns, roles and texts, ties and repeated rows, turns beyond a stretch, a lone conversation, an empty table."""
    rows = [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, "a", "z"), (7, 0, "a", "b"), (7, 3, "user", "x"), (7, 3, "user", "x"), (0, 0, "user", ""), (20, 5, "user", "long " * 50_000)]
    rows += [(40, t, "user", f"t{t % 3}") for t in range(1500)] + [(41, t, "user", f"t{t % 3}") for t in range(1490)]
    for part in (rows, rows[-1:], rows[1:2], []):
        assert found(spark, part, shard_turns=500) == brute(part) if part else found(spark, part) == []


def test_search_trees_are_balanced():
    """A thousand sorted siblings: no search goes further than a balanced tree's."""
    tree = prefix_trie.TernaryTree()
    ends = tree.insert_sorted([[i] for i in range(1000)])
    assert len(set(ends)) == 1000 and [tree.code[n] for n in tree.walk()[1:]] == list(range(1000))

    def depth(node):
        return 1 + max((depth(x) for x in (tree.low[node], tree.high[node]) if x), default=0)

    assert depth(tree.down[0]) == 10
