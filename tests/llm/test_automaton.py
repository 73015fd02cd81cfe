"""The tokenization automaton against the library and against merging one pair at a time."""

import hashlib
import json
import random

import numpy as np

import public_tokenizers
from tessera.llm import automaton

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, ids string, text string, n_tokens long"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def odd_texts(n, seed):
    r = random.Random(seed)
    parts = ["in", "er", "the", "▁", "s", " ", "ing", "'s", "\n", "  ", "<|endoftext|>", "👍🏽", "　", "\x85", "\x1c", "日本", "\t"]
    wild = lambda: chr(r.choice([r.randint(0, 0x52F), r.randint(0x530, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    return ["".join(r.choice("ab  \n-=.e▁tħ日'1") for _ in range(r.randint(0, 60))) for _ in range(n)] + ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(n)] + ["".join(wild() for _ in range(40)) for _ in range(n)]


def test_equal_to_the_library(spark, data):
    lib, enc = library(), automaton.encoder(BPE)
    real = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts = odd_texts(700, 4) + [t or "" for t in real] + ["", " ", "x" * 3000, "ab " * 400, " lead", "trail ", "\x00a", "<|endoftext|>", "x" * 65 + " y"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = enc.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [enc.automaton.decode(g) for g in got] == [lib.decode(w, skip_special_tokens=False) for w in want]


def small(tmp_path, merges):
    letters = automaton.byte_letters()
    vocab = {ch: i for i, ch in enumerate(letters)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    path = tmp_path / f"{abs(hash(tuple(merges)))}.json"
    path.write_text(json.dumps(spec))
    return str(path), vocab


def merged(word, ranks):
    """Merging by rank, leftmost first, one pair at a time."""
    parts = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = ["".join(parts[i : i + 2])]


def test_small_automata_equal_merging(tmp_path):
    """Vocabularies full of overlaps and of merges that can never happen."""
    r = random.Random(8)
    for _ in range(30):
        known, merges = ["a", "b", "c"], []
        for _ in range(12):
            pair = (r.choice(known), r.choice(known))
            if pair not in merges and "".join(pair) not in known:
                merges.append(pair)
                known.append("".join(pair))
        path, vocab = small(tmp_path, merges)
        a, ranks = automaton.Automaton(path), {m: i for i, m in enumerate(merges)}
        words = ["".join(r.choice("aabc") for _ in range(r.randint(1, 25))) for _ in range(60)] + ["a" * 9, "ab" * 40]
        want = [[vocab[p] for p in merged(w, ranks)] for w in words]
        raw = [w.encode() for w in words]
        assert [np.frombuffer(x, "<u4").tolist() for x in a.encode_words(raw)] == want
        assert [a.encode_long(x) for x in raw] == want


def test_ranges_taken_as_plain_are_those_of_the_library():
    """White space, letters and digits of all code points that don't go to the library's own parting."""
    import re

    lib, enc = library().pre_tokenizer, automaton.encoder(BPE)
    plain = re.compile(f"[{automaton.PLAIN}]")
    for c in filter(plain.match, map(chr, [*range(0xD800), *range(0xE000, 0x1F700)])):
        text = f"a{c}1 {c}. {c}{c} x"
        assert enc.words_of(text) == [text[a:b] for _, (a, b) in lib.pre_tokenize_str(text)], hex(ord(c))


def test_awkward_tables(spark):
    """Nulls, repeated rows, clashing names, a text longer than a stretch, an empty table."""
    long = "word " * 500_000 + "y" * 3000
    rows = [(1, "d", "Hello there", 1), (1, "d", "Hello there", 1), (2, None, None, None), (3, "", "", 0), (None, "x", "été 日本 <|endoftext|>", 2), (4, "l", long, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = automaton.digest(automaton.decode(automaton.encode(docs, BPE), BPE)).collect()
    lib = library()

    def row(i, text):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((row(i, t) for i, _, t, _ in rows), key=str)
    assert automaton.decode(automaton.encode(docs.limit(0), BPE), BPE).count() == 0
