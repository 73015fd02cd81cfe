"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of such a model has a space mark after another character, so a text falls into words (space
marks, then other characters) that merge on their own. The distinct new words of a stretch of texts are
encoded together: symbols of all words in flat numpy arrays; in each round the best pair rank of each
word (a segmented minimum), all its leftmost non-overlapping occurrences merged at once, and the arrays
compacted, until no pair remains. Where a merge makes a pair that is as good as the one being merged, the order of single
merges matters; such rare words are merged one pair at a time from a heap. Encoded words are kept in a
bounded cache per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.batches import map_arrow, runs, texts_of
from tessera.llm.common import table

SPACE = "▁"
#: Words in a worker's cache; beyond, a new one starts, and the full one serves once more for what is looked up again.
CACHE_WORDS = 300_000

_NONE = np.iinfo(np.int64).max
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceModel:
    """Tables of one model: symbols of characters, merged symbol and rank of symbol pairs, texts of ids."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        plain = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.raw = [bytes((byte_of[i],)) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        if any(SPACE in p.lstrip(SPACE) for p in plain) or sp.is_unknown(self.byte_ids[0]):
            raise ValueError("the model needs byte pieces and pieces without inner spaces")
        symbols = dict(plain)
        for ch in sorted({c for p in plain for c in p} - plain.keys()):
            symbols[ch] = len(names) + len(symbols)
        self.span = max(symbols.values()) + 1
        self.symbol = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        _, dense = np.unique(-scores, return_inverse=True)
        pairs = {symbols[p[:k]] * self.span + symbols[p[k:]]: i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.pairs = {k: (int(dense[m]), m) for k, m in pairs.items()}
        self._fill(np.array(list(pairs), np.int64), np.array([r for r, _ in self.pairs.values()], np.int64), np.array(list(pairs.values()), np.int64))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """A hash table with linear probing, at most a quarter full; each round places one key a slot."""
        self.bits = max(10, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64), np.zeros(size, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            at = slot[first]
            self.keys[at], self.ranks[at], self.merged[at] = keys[left[first]], ranks[left[first]], merged[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; _NONE where they don't merge. Symbol -1 merges with nothing."""
        keys = np.where((left >= 0) & (right >= 0), left * self.span + right, -2)
        at = self._slot(keys)
        there = self.keys[at]
        go = np.flatnonzero((there != keys) & (there >= 0))
        while len(go):
            at[go] = (at[go] + 1) % len(self.keys)
            there = self.keys[at[go]]
            go = go[(there != keys[go]) & (there >= 0)]
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE), self.merged[at]

    def one_by_one(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(symbol, first character) after single merges, best rank first, leftmost on ties."""
        n = len(symbols)
        sym, after, before, alive = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0 and (hit := self.pairs.get(sym[i] * self.span + sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = m, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [(sym[i], i) for i in range(n) if alive[i]]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (space marks included)."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        out: list[list[int]] = [[] for _ in words]
        sym, word, at = self.symbol[chars], np.repeat(np.arange(len(words)), lengths), np.arange(len(chars))

        def finish(mask: np.ndarray) -> None:
            for w, s, c in zip(word[mask].tolist(), sym[mask].tolist(), at[mask].tolist(), strict=True):
                out[w] += [s] if 0 <= s < self.size else [self.byte_ids[b] for b in chr(chars[c]).encode("utf-8", "surrogatepass")]

        def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and merged symbol of the pairs that begin at i."""
            j = np.minimum(i + 1, len(sym) - 1)
            return self.look_up(sym[i], np.where((j > i) & (word[j] == word[i]), sym[j], -1))

        rank, merged = ranked(np.arange(len(sym)))
        while len(sym):
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
            done = best == _NONE
            if done.any():
                finish(done)
                go = ~done
                sym, word, at, rank, merged, best = (x[go] for x in (sym, word, at, rank, merged, best))
                if not len(sym):
                    break
            n = len(sym)
            hit, idx = rank == best, np.arange(n)
            pick = hit & ((idx - np.maximum.accumulate(np.where(hit, -1, idx))) % 2 == 1)
            i = np.flatnonzero(pick)
            # A merge beside another: the pair that the first makes with the second's left half is passed over below.
            twin = i[np.append(i[1:] == i[:-1] + 2, False)]
            odd = word[twin[self.look_up(merged[twin], np.where(word[twin] == word[np.minimum(twin + 2, n - 1)], sym[np.minimum(twin + 2, n - 1)], -1))[0] <= best[twin]]]
            sym[i] = merged[i]
            keep = np.ones(n, bool)
            keep[i + 1] = False
            sym, word, at, rank, merged, best, pick = (x[keep] for x in (sym, word, at, rank, merged, best, pick))
            changed = np.flatnonzero(pick | np.append(pick[1:], False))
            rank[changed], merged[changed] = ranked(changed)
            odd = np.union1d(odd, word[changed[rank[changed] <= best[changed]]])
            if len(odd):
                for w in odd.tolist():
                    a, b = starts[w], starts[w + 1]
                    out[w] = [x for s, c in self.one_by_one(self.symbol[chars[a:b]].tolist()) for x in ([s] if 0 <= s < self.size else [self.byte_ids[y] for y in chr(chars[a + c]).encode("utf-8", "surrogatepass")])]
                go = ~np.isin(word, odd)
                sym, word, at, rank, merged = (x[go] for x in (sym, word, at, rank, merged))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with space marks as spaces; byte pieces join to characters."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes and decodes texts word by word through a bounded cache of (ids, ids as text, decoded text)."""

    def __init__(self, path: str):
        self.model, self.cache, self.old = model(path), {}, {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without their first space mark."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return [w[1:] for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def load(self, split: list[list[str]]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        need = {w for ws in split for w in ws if w not in self.cache}
        self.cache |= {w: self.old[w] for w in need if w in self.old}
        need = [w for w in need if w not in self.cache]
        for w, ids in zip(need, self.model.encode_words([SPACE + w for w in need]), strict=True):
            self.cache[w] = (len(ids), ",".join(map(str, ids)), self.model.decode(ids))

    def encode(self, text: str) -> list[int]:
        split = self.words(text)
        self.load([split])
        return [int(x) for w in split for x in self.cache[w][1].split(",")]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (null text: empty; no ids), rows that repeat an id each for itself.
    Texts are encoded whole: a stretch of about two million characters at a time, a longer text by itself. An empty table gives no rows. Other columns are not read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            texts, n, ids_sha, text_sha = texts_of(batch), [], [], []
            for a, b in runs(texts):
                split = [enc.words(t) for t in texts[a:b]]
                enc.load(split)
                get = enc.cache.__getitem__
                for ws in split:
                    got = [get(w) for w in ws]
                    n.append(sum([g[0] for g in got]))
                    ids_sha.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256("".join([g[2] for g in got])[1:].encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
