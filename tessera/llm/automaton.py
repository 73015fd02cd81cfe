"""Byte-level BPE by a tokenization automaton.

The automaton's arcs are tokens, and it accepts just the token sequences that merging would give. It starts with one state
that all bytes lead back to. Each merge (u, v), in order, is one gadget: arcs labelled u are led to a new state, a copy of the
one that they led to without its arc v; and wherever u may go, an arc uv may go as well, to where v leads.

A copy is kept as its original and what it lacks. Tokens are numbered in a tree in which a token is the child of its left half
and later children come first, so what a gadget takes away (v, and all that would later have grown out of v) is one interval of
numbers, and a state of the finished automaton is a sorted list of intervals that its arcs leave out.

A word is encoded from its first byte on: among the tokens that end at a place just one has an arc from the state of the place
where it begins. All words of a stretch take that step at once, by table look-ups in flat arrays. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_arrow, runs, texts_of
from tessera.llm.common import table
from tessera.llm.packing import PATTERN

#: Segments in a worker's cache; beyond, a new one starts, and the full one serves once more for what is looked up again.
CACHE_SEGMENTS = 300_000
#: Longer segments (in characters) are not cached; longer words (in bytes) are encoded one by one.
LONG_SEGMENT, LONG_WORD = 256, 64
#: Ranges of code points in which letters, digits and white space are those of the library; words with others are parted by the library.
PLAIN = "\x00-ԯ -⁯぀-ゖ゠-ヿ一-鿿가-힣\U0001f300-\U0001f64f"
#: A space beside other white space.
BESIDE = [x for w in map(chr, range(0x3001)) if w.isspace() for x in (f" {w}", f"{w} ")]


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in such a vocabulary: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)}.difference(visible)))}


class Automaton:
    """The compiled automaton of a tokenizer file: `state` a token leads to, and per state the token numbers without an arc."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if model["type"] != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("the automaton needs a byte-level BPE tokenizer without normalizer, dropout or added spaces")
        extra = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in extra):
            raise ValueError("added tokens must be found as they are")
        byte_of, self.vocab = byte_letters(), model["vocab"]
        added = {t["content"]: t["id"] for t in extra}
        size = max([*self.vocab.values(), *added.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in self.vocab.items():
            self.labels[i] = bytes(byte_of[ch] if ch in byte_of else 0 for ch in text)
        for text, i in added.items():
            self.labels[i] = text.encode()
        self.added = added
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._compile([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], [i for t, i in self.vocab.items() if len(t) == 1], size)

    def _compile(self, merges: list[tuple[int, int, int]], single: list[int], size: int) -> None:
        """Applies one gadget a merge, then lists the intervals of every state that a token leads to."""
        after: list[list[int]] = [[] for _ in range(size)]
        left = [-1] * size
        for a, _, m in merges:
            after[a].append(m)
            left[m] = a
        number, many, order, stack = [0] * size, [1] * size, [], single[::-1]
        while stack:
            x = stack.pop()
            number[x] = len(order)
            order.append(x)
            stack.extend(after[x])
        for x in reversed(order):
            if left[x] >= 0:
                many[left[x]] += many[x]
        # State 0 is the start. A state is the one it was copied from and the interval that it lacks besides.
        origin, low, high, lead, made = [-1], [0], [0], [-1] * size, [0] * size
        for x in single:
            lead[x] = 0
        for a, b, m in merges:
            s = lead[a]
            while s > 0 and not low[s] <= number[b] < high[s]:
                s = origin[s]
            end = number[b] + many[b] - made[b]
            made[a] += many[m]
            if s != 0 or lead[b] < 0:
                continue  # u has no arc v any more, or one of them is never made: the merge can't happen
            to = lead[b]
            origin.append(lead[a])
            low.append(number[b])
            high.append(end)
            lead[a] = len(origin) - 1
            lead[m] = to
        self.width = len(order) + 1
        states = {s: i for i, s in enumerate(sorted({s for s in lead if s >= 0} | {0}))}
        lows, highs = [-1], [-1]
        for s, i in states.items():
            own, t = [], s
            while t > 0:
                own.append((low[t], high[t]))
                t = origin[t]
            end = -1
            for a, b in sorted(own):
                if a <= end:
                    end = max(end, b)
                    highs[-1] = i * self.width + end
                else:
                    lows.append(i * self.width + a)
                    highs.append(i * self.width + b)
                    end = b
        self.lows, self.highs = np.array(lows, np.int64), np.array(highs, np.int64)
        self.number = np.array(number, np.int64)
        self.state = np.array([states.get(s, -1) for s in lead], np.int64)
        self._tree([(self.labels[i], i) for i in range(size) if lead[i] >= 0])

    def _tree(self, tokens: list[tuple[bytes, int]]) -> None:
        """The tree of the tokens' bytes, for finding all tokens that begin at a place: keys (node, byte) in order."""
        steps: dict[int, int] = {}
        ends = [-1]
        for label, i in tokens:
            node = 0
            for b in label:
                key = node << 8 | b
                nxt = steps.get(key)
                if nxt is None:
                    nxt = steps[key] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = i
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(keys)
        self.steps, self.step_keys, self.step_to = steps, keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.ends = np.array(ends, np.int64)
        self.roots = np.array([steps.get(b, -1) for b in range(256)], np.int64)
        self.pairs = np.array([steps.get(a << 8 | b, -1) if a >= 0 else -1 for a in self.roots.tolist() for b in range(256)], np.int64)

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states have arcs of the tokens."""
        key = state * self.width + self.number[token]
        return self.highs[np.searchsorted(self.lows, key, "right") - 1] <= key

    def encode_long(self, word: bytes) -> list[int]:
        """The ids of one word, byte by byte."""
        state, token, came = [0] + [-1] * len(word), [-1] * (len(word) + 1), [0] * (len(word) + 1)
        steps, ends, lows, highs = self.steps, self.ends, self.lows, self.highs
        for i in range(len(word)):
            node, j, base = 0, i, state[i] * self.width
            while j < len(word):
                node = steps.get(node << 8 | word[j])
                if node is None:
                    break
                j += 1
                t = ends[node]
                if t >= 0 and highs[np.searchsorted(lows, base + self.number[t], "right") - 1] <= base + self.number[t]:
                    state[j], token[j], came[j] = int(self.state[t]), int(t), i
        out, j = [], len(word)
        while j:
            out.append(token[j])
            j = came[j]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = [w for w, x in enumerate(words) if len(x) <= LONG_WORD]
        for w in set(range(len(words))).difference(short):
            out[w] = array("I", self.encode_long(words[w])).tobytes()
        raw = np.frombuffer(b"".join([words[w] for w in short]), np.uint8).astype(np.int64)
        if not len(raw):
            return out
        sizes = np.fromiter((len(words[w]) for w in short), np.int64, len(short))
        word = np.repeat(np.arange(len(short)), sizes)
        stops = np.cumsum(sizes)
        first = (stops - sizes)[word]
        stop = stops[word]
        # All tokens at all places: a step down the tree for every place at once, as long as there is one. A place between
        # two bytes is the byte's index plus the word's, as words share none.
        begin, token, until = [], [], []
        live, node, far = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        while len(live):
            key = node << 8 | raw[live + far]
            if far < 2:  # the first two steps have tables of their own
                to = self.roots[key] if far == 0 else self.pairs[raw[live] << 8 | raw[live + 1]]
                hit = to >= 0
            else:
                at = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                hit = self.step_keys[at] == key
                to = self.step_to[at]
            live, node, far = live[hit], to[hit], far + 1
            some = self.ends[node] >= 0
            begin.append(live[some])
            token.append(self.ends[node[some]])
            until.append(live[some] + far)
            more = live + far < stop[live]
            live, node = live[more], node[more]
        begin, token, until = np.concatenate(begin), np.concatenate(token), np.concatenate(until)
        own = word[begin]
        place = until - first[begin]
        order = np.argsort(place, kind="stable")
        begin, token, until, own, place = begin[order], token[order], until[order], own[order], place[order]
        begin, until = begin + own, until + own
        n = len(raw) + len(short)
        state, arc, came = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        edges = np.searchsorted(place, np.arange(1, int(place[-1]) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            go = np.flatnonzero(self.allows(state[begin[a:b]], token[a:b])) + a
            state[until[go]], arc[until[go]], came[until[go]] = self.state[token[go]], token[go], begin[go]
        heads = stops - sizes + np.arange(len(short))
        used, at, start = np.zeros(n, bool), stops + np.arange(len(short)), heads
        at, start = at[sizes > 0], start[sizes > 0]
        while len(at):
            used[at] = True
            at = came[at]
            more = at > start
            at, start = at[more], start[more]
        on = np.flatnonzero(used)
        ids = arc[on].astype("<u4").tobytes()
        cuts = (np.searchsorted(on, np.append(heads, n)) * 4).tolist()
        for w, a, b in zip(short, cuts, cuts[1:], strict=False):
            out[w] = ids[a:b]
        return out

    def decode(self, ids: bytes) -> str:
        """The text that the arcs' labels spell; ids that no token has spell nothing, broken characters become U+FFFD."""
        n, labels = len(self.labels), self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts segment by segment through a bounded cache.

    A segment is what lies between two single spaces that have other characters on both sides, with the space before it: no word
    of a text reaches across such a place. The words of new segments are encoded together.
    """

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        self.automaton = Automaton(path)
        self.words_of, self.other = regex.compile(PATTERN).findall, re.compile(f"[^{PLAIN}]").search
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.added = self.automaton.added
        names = sorted(self.added, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, segment: str) -> list[str]:
        if segment.isascii() and segment[1:].isalpha() and (segment[0] == " " or segment[0].isalpha()):
            return [segment]
        if self.other(segment):
            return [segment[a:b] for _, (a, b) in self.library.pre_tokenize_str(segment)]
        return self.words_of(segment)

    @staticmethod
    def segments(text: str) -> list[str]:
        """The segments of a text, the space before each but the first left out."""
        out = text.split(" ")
        if out[0] and out[-1] and not any(x in text for x in BESIDE):
            return out
        joined: list[str] = []
        open_ = False
        for c in out:
            if joined and (open_ or not c or c[0].isspace()):
                joined[-1] += " " + c
            else:
                joined.append(c)
            open_ = not c or c[-1].isspace()
        return joined

    def load(self, segments: set[str]) -> None:
        """Sees to it that the cache has these segments, each with a space before it."""
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache, self.old = {}, self.cache
        need = segments.difference(self.cache)
        self.cache |= {c: self.old[c] for c in need if c in self.old}
        self.cache |= self.encode_segments([c for c in need if c not in self.cache], " ")

    def encode_segments(self, segments: list[str], before: str) -> dict[str, bytes]:
        split = [self.words(before + c) for c in segments]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.automaton.encode_words([w.encode() for w in words]), strict=True))
        return {c: b"".join([ids[w] for w in ws]) for c, ws in zip(segments, split, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parted = [self.parts(t) if self.parts and any(x in t for x in self.added) else [t] for t in texts]
        split = [self.segments(p) for ps in parted for p in ps[::2]]
        firsts = [s.pop(0) for s in split]
        first = self.encode_segments(list(set(firsts)), "")
        rest = set().union(*split)
        self.load(rest)
        get = self.cache.__getitem__
        pieces = iter([first[f] + b"".join(map(get, s)) for f, s in zip(firsts, split, strict=True)])
        out = []
        for names in parted:
            ids = next(pieces)
            for name in names[1::2]:
                ids += array("I", [self.added[name]]).tobytes() + next(pieces)
            out.append(ids)
        for c in rest:
            if len(c) > LONG_SEGMENT:
                del self.cache[c]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row of docs, rows that repeat an id each for itself.

    Null and empty texts have no ids. Texts are encoded whole, however long: a stretch of about two million characters at a time, a
    longer text by itself, so a task holds one such text and its ids. The strings of added tokens are those tokens, as in the
    library. An empty table gives no rows. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts, ids = texts_of(batch), []
            for a, b in runs(texts):
                ids += enc.encode(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (doc_id, ids) with the text that the ids spell; null ids spell the empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = encoder(tokenizer_path).automaton.decode
        for batch in batches:
            texts = [spell(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), rows, "doc_id long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows (doc_id, ids, text)."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digest(decode(encode(table(spark, sf_dir, "documents"), path), path))
