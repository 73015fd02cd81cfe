"""Packing of tokenised documents into sequences, by swap-based local search.

Documents are tokenised and cut in one pass. Full pieces are sequences of their own and never move. All
other pieces are dealt at random into groups of bounded size; in each, a best-fit start is improved by
moving and exchanging pieces between underfull sequences, always increasing the sum of squared fills,
until sequences empty out. The sequences still underfull after that meet in new groups of the same bounded size and
are searched again, round after round, until they fit one group or a round hardly saves a sequence any more.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.store import ship
from tessera.llm.batches import map_arrow, runs, texts_of
from tessera.llm.common import stash, table

CAPACITY = 1024
END_ID = 2
#: Pieces of a group.
GROUP = 16_000
#: Rounds end when one saves less than one in so many of the sequences that it searched.
LEAST_SAVED = 1000
#: Words kept in the cache of a worker; beyond, it starts anew, and the full one serves once more for what is looked up again.
CACHE_WORDS = 500_000
#: Bins with more pieces offer no pairs of pieces: their single pieces are small enough.
PAIRS_OF = 12

#: Fixed value: how this kind of vocabulary parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tokenizer:
    """Ids of texts, as little-endian bytes, put together from cached chunks between single spaces.

    The pre-tokens of this kind of vocabulary never reach across a single space between other characters, so the ids
    of such chunks (with their space) are those of the text. Texts with other white space beside a space are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The same vocabulary as ranks, for the fast encoder of many rare chunks; ids of such vocabularies are in order of merging.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)}.difference(visible)))}
        ranks = {bytes(byte_of[ch] for ch in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if all(ch in byte_of for ch in t)}
        ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in self.special}
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        self.cache: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> None:
        """Caches chunks, each with a space before it: encoded as one text and parted where the bytes of one end. None
        for those that begin or end with white space."""
        plain = [c for c in chunks if c and not (c[0].isspace() or c[-1].isspace())]
        self.cache |= dict.fromkeys(chunks)
        if not plain:
            return
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(plain)), "<u4")
        sizes = np.fromiter((len(c.encode()) + 1 for c in plain), np.int64, len(plain))
        edges = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
        raw = ids.tobytes()
        at = [0, *(edges * 4).tolist()]
        self.cache |= zip(plain, map(raw.__getitem__, map(slice, at, at[1:])), strict=False)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Chunks go by the text between spaces; a text's first one, which has no space before it, is encoded by itself."""
        whole = [any(s in t for s in self.special) for t in texts]
        split = [[t] if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        firsts = self._encode([cs.pop(0) for cs in split])
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        need = set().union(*split).difference(self.cache)
        self.cache |= {c: self.old[c] for c in need if c in self.old}
        if need := list(need.difference(self.cache)):
            self._encode_chunks(need)
        get, out = self.cache.__getitem__, []
        for t, first, cs in zip(texts, firsts, split, strict=True):
            try:
                out.append(first + b"".join(map(get, cs)) if not (cs and t[:1].isspace()) else self._encode([t])[0])
            except TypeError:  # a chunk that is None
                out.append(self._encode([t])[0])
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(path)


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces (PIECES) of every document: its ids and the end id, cut where there are over `capacity`; the first piece takes the remainder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts, out = batch.column("doc_id").to_pylist(), texts_of(batch), ([], [], [], [], [])
            for a, b in runs(texts):
                for doc, raw in zip(ids[a:b], tok.encode(texts[a:b]), strict=True):
                    view, n = memoryview(raw + end), len(raw) // 4 + 1
                    first = (n - 1) % capacity + 1
                    edges = [0, *range(first, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                        for column, value in zip(out, (doc, k, s, e - s, zlib.crc32(view[4 * s : 4 * e])), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select("doc_id", "text"), rows, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: largest first, into the fullest bin that takes it."""
    where, open_bins, mask, n = [0] * len(sizes), defaultdict(list), 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        above = mask >> s
        if above:
            gap = s + (above & -above).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b, n = capacity, n, n + 1
        where[i] = b
        if gap > s:
            open_bins[gap - s].append(b)
            mask |= 1 << (gap - s)
    return where


def local_search(sizes: list[int], where: list[int], capacity: int) -> list[int]:
    """Improves the bins: the fullest underfull bins take from emptier ones, by a move or an exchange of one for one, two
    for one or one for two. Each step takes from a bin that is no fuller, so the sum of squared fills grows until none is left."""
    where, bins, fill = list(where), defaultdict(list), defaultdict(int)
    for i, b in enumerate(where):
        bins[b].append(i)
        fill[b] += sizes[i]
    improved = True
    while improved:
        improved = False
        order = sorted((b for b in bins if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
        donors, singles, pairs = set(order), defaultdict(list), defaultdict(list)
        ones = twos = 0  # bit s: some donor may have one piece, or two pieces, of size s in all

        def offer(b: int) -> None:
            nonlocal ones, twos
            own = bins[b]
            for i in own:
                singles[sizes[i]].append(i)
                ones |= 1 << sizes[i]
            if len(own) <= PAIRS_OF:
                for x in range(len(own)):
                    for y in range(x):
                        pairs[sizes[own[x]] + sizes[own[y]]].append((own[x], own[y]))
                        twos |= 1 << (sizes[own[x]] + sizes[own[y]])

        def take(size: int, two: bool, floor: int) -> tuple[int, ...] | None:
            """A donor's piece or pair of that size, from a bin no fuller than `floor`; stale offers are dropped."""
            nonlocal ones, twos
            stack = pairs[size] if two else singles[size]
            while stack:
                got = stack[-1] if two else (stack[-1],)
                b = where[got[0]]
                if b in donors and fill[b] <= floor and where[got[-1]] == b:
                    return got
                stack.pop()
            if two:
                twos &= ~(1 << size)
            else:
                ones &= ~(1 << size)
            return None

        for b in order:
            offer(b)
        for b in order:
            donors.discard(b)
            while 0 < fill[b] < capacity:
                gap, own, best = capacity - fill[b], bins[b], None
                gone = [((), 0)] + [((i,), sizes[i]) for i in own]
                if len(own) <= PAIRS_OF:
                    gone += [((own[x], own[y]), sizes[own[x]] + sizes[own[y]]) for x in range(len(own)) for y in range(x)]
                for out, size in gone:
                    for two in (False, True) if len(out) == 1 else (False,):
                        lo = best[0] if best else 0
                        while True:
                            span = ((twos if two else ones) & ((1 << (size + gap + 1)) - 1)) >> (size + lo + 1)
                            if not span:
                                break
                            want = size + lo + span.bit_length()
                            if got := take(want, two, fill[b]):
                                best = (want - size, out, got)
                                break
                    if best and best[0] == gap:
                        break
                if not best:
                    break
                gain, out, got = best
                a = where[got[0]]
                for i in got:
                    bins[a].remove(i)
                    bins[b].append(i)
                    where[i] = b
                for i in out:
                    bins[b].remove(i)
                    bins[a].append(i)
                    where[i] = a
                fill[b] += gain
                fill[a] -= gain
                if out:
                    offer(a)
                improved = True
    return where


def _search(capacity: int, start: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one group's pieces: gives them bins, from a best-fit start or from the bins they have."""

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable", ignore_index=True)
        sizes = pdf["length"].tolist()
        where = best_fit(sizes, capacity) if start else pd.factorize(pdf["bin"])[0].tolist()
        where = np.array(local_search(sizes, where, capacity))
        order = np.argsort(where, kind="stable")
        lengths, bins = np.array(sizes)[order], where[order]
        before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        heads = np.concatenate(([True], bins[1:] != bins[:-1]))
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(heads, before, 0))
        return pdf.assign(bin=(int(pdf["grp"].iloc[0]) << 24) + where, offset=offset, fill=np.bincount(where, np.array(sizes))[where].astype(np.int64))

    return searched


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. Groups are dealt by a hash of the row or of the sequence, and every round has as many as its
    pieces need, so none is much over `group` whatever the data."""
    ship(pieces.sparkSession)
    rows = stash(pieces, "pieces")
    schema = f"{PIECES}, grp long, bin long, offset long, fill long"
    done = [rows.filter(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = rows.filter(F.col("length") < capacity).select("*", F.monotonically_increasing_id().alias("uid"))
    n, level, met = rest.count(), 0, None
    if n == 0:
        return done[0]
    groups = -(-n // group)
    rest = rest.select(*pieces.columns, F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"), F.lit(0).cast("long").alias("bin"))
    while True:
        level += 1
        found = stash(rest.groupBy("grp").applyInPandas(_search(capacity, start=level == 1), schema), f"packed-{level}")
        underfull = F.col("fill") < capacity
        bins, underfull_bins, underfull_pieces = found.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & underfull), F.count_if(underfull)).first()
        # A round searches the `met` bins that the one before left underfull; the first has none to compare with.
        if groups == 1 or not underfull_bins or (met is not None and (met - bins) * LEAST_SAVED < met):
            break
        # Bins stay whole.
        met, groups = underfull_bins, max(1, -(-underfull_pieces // group))
        done.append(_numbered(found.filter(F.col("fill") == capacity), level))
        rest = found.filter(underfull).select(*pieces.columns, F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("grp"), "bin")
    done.append(_numbered(found, level))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _numbered(found: DataFrame, level: int) -> DataFrame:
    """Sequence ids below 0 and apart from those of other rounds."""
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (-(F.col("bin") * 65536 + level)).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    A null or empty text is its end id alone. Rows that repeat an id are packed each for itself. A very long text
    is encoded whole and cut into as many pieces as it needs. An empty table gives no rows. Other columns are not read.
    """
    return pack(cut(docs, tokenizer_path, capacity), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
