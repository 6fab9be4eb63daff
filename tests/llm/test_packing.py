"""Packing: tokens against the library, bounds against the optimum, and what the rounds keep."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sluice.llm import packing, tokens
from sluice.llm.queries import tokenizer
from sluice.llm.tokens import Encoder

ODD = ["a", "é", "É", "Σ", "ς", " ", "  ", "\n", "\t", "'s", "'S", "don't", "1", "23", "!!", ".", ",", "é", "́", " ", "　", "\x1c", "\x01", "<|endoftext|>", "<|startoftext|>", "<|endof", "word.", "Straße,", "ß", "İ", "日本", "\0", "‍", "😀", "x" * 60, "\r\n"]


def library(name, texts):
    """The ids by the tokenizer as it is loaded."""
    own = Tokenizer.from_file(tokenizer(name))
    return [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_remembered_pieces_give_the_same_ids():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for name, rule in (("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")):
        memo = Encoder(tokenizer(name), rule)
        want = library(name, texts)
        assert memo.encode(texts) == want == memo.encode(texts)
        assert memo.encode(["", *texts[::-1], "x" * 70000]) == [b"", *want[::-1], *library(name, ["x" * 70000])]


def test_the_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST", 50)
    rng = random.Random(4)
    memo = Encoder(tokenizer("word_bpe_49k.json"), "dropped")
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("abcé.,1") for _ in range(rng.randrange(1, 60))) for _ in range(20)) for _ in range(4)]
        column = pa.array(["cut off", *texts]).slice(1)
        ids, ends = memo.encode_all(column)
        assert [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == library("word_bpe_49k.json", texts)
        assert len(memo.known) < 800 and max(map(len, memo.known.to_pylist())) <= tokens.LONGEST


def optimum(items, capacity):
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= items[i] and r not in rooms[:k]:
                rooms[k] -= items[i]
                place(i + 1, rooms)
                rooms[k] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_bounds_hold():
    rng, tight = random.Random(0), 0
    for _ in range(300):
        capacity = rng.choice([9, 10, 20, 31])
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        best = optimum(items, capacity)
        bins, offsets, held = packing.best_fit_decreasing(np.array(items), capacity)
        low = packing.lower_bound(np.array(items), capacity)
        assert low <= best <= len(held) and held.max() <= capacity and held.sum() == sum(items)
        tight += low == best
    assert tight > 250


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_partitions_exchange_documents(spark):
    rng = random.Random(5)
    lengths = [rng.randrange(30, 70) for _ in range(600)]
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "id long, piece int, length long")
    alone = packing.pack(df, capacity=100, part_size=50, max_rounds=1).collect()
    rounds = packing.pack(df, capacity=100, part_size=50).collect()
    low = packing.lower_bound(np.array(lengths), 100)
    assert low <= check(rounds, 100) <= check(alone, 100) and len(rounds) == 600


def test_documents(spark):
    whole = Encoder(tokenizer("word_bpe_49k.json"), None)
    data = [(1, None), (2, ""), (3, "Hello, World"), (3, "Hello, World"), (None, "x"), (4, "word " * 5000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as length")
    rows = packing.pack(packing.pieces(df, tokenizer("word_bpe_49k.json"))).collect()
    check(rows, packing.CAPACITY)
    for i, ids in zip([d[0] for d in data], whole.encode([d[1] or "" for d in data]), strict=True):
        ids += bytes(4)
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["id"] == i)
        cuts = [(k, 2048 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[a : a + 8192] for a in range(0, len(ids), 8192))]
        assert own == sorted(cuts * (2 if i == 3 else 1))
    assert packing.pack(packing.pieces(df.limit(0), tokenizer("word_bpe_49k.json"))).collect() == []
