"""The range coder and its files: exact round trips, checksums, order."""

import io
import lzma
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from sluice.llm import idfiles, mixcoder
from sluice.llm.queries import tokenizer
from sluice.llm.tokens import Encoder
from tests.llm.test_packing import library

DATA = "/root/testdata/sf0.001"
SQUASH_CRC = 2358140822


def cases():
    rng = np.random.default_rng(0)
    yield np.zeros(0, np.uint32)
    yield np.array([5])
    yield np.arange(3000) % 7
    yield np.repeat([0, 50256, 1], 900)
    yield rng.integers(0, 65535, 4000)
    yield (rng.pareto(0.4, 5000) * 3).astype(np.int64) % 50257
    yield np.concatenate([np.full(200, 65534), rng.integers(0, 3, 5000)])


def coded(ids, **options):
    return list(mixcoder.encode(ids, **options))


def back(panels, **options):
    return np.concatenate([np.zeros(0, "<u4"), *(mixcoder.decode(m, blocks, **options) for m, blocks in panels)])


def bits(panels, ids):
    return sum(len(m) + sum(len(b[2]) for b in blocks) for m, blocks in panels) * 8 / len(ids)


@pytest.mark.parametrize("k", range(7))
@pytest.mark.parametrize("block", [64, 2048])
def test_round_trips(k, block):
    ids = list(cases())[k]
    panels = coded(ids, block=block)
    assert sum(b[0] for _, blocks in panels for b in blocks) == len(ids) and (back(panels, block=block) == ids).all()
    if panels and len(panels[0][1]) > 1:  # any block alone
        model, blocks = panels[0]
        assert (mixcoder.decode(model, blocks[1:2], block=block) == ids[block : 2 * block]).all()


def test_large_ids_and_many_panels(monkeypatch):
    ids = np.array([0, 1, 2**32 - 1, 70000, 65535])
    assert (back(coded(ids)) == ids).all()
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 2**32, 5000)
    panels = coded(ids, block=100, distinct=700)  # halved until no panel has more distinct ids
    assert len(panels) > 7 and (back(panels, block=100) == ids).all()
    ids = np.arange(40_000)  # shares of 2^18
    assert (back(coded(ids)) == ids).all()
    monkeypatch.setattr(mixcoder, "LANES", 3)
    ids = np.arange(1000) % 90
    assert len(panels := coded(ids, block=64)) == 6 and (back(panels, block=64) == ids).all()
    with pytest.raises(ValueError):
        coded(ids, block=100, distinct=99)


def test_predictions_pay():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 50000, 3) for _ in range(40)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 40, 4000)])
    order0 = np.log2(120)
    assert bits(coded(ids), ids) < 0.6 * order0  # a word's second and third id follow from the ones before


def test_each_order_pays():
    rng = np.random.default_rng(8)
    after = rng.integers(0, 500, (500, 2))
    walk, state = [], 0
    for coin in rng.integers(0, 10, 40_000):
        state = after[state, 0] if coin else after[state, 1]
        walk.append(state)
    skewed = rng.geometric(0.05, 40_000)  # only order 0 knows
    assert bits(coded(np.array(walk)), walk) < 0.75 * np.log2(len(set(walk)))
    counts = np.bincount(skewed)
    share = counts[counts > 0] / len(skewed)
    assert bits(coded(skewed), skewed) < 1.03 * -(share * np.log2(share)).sum()


def test_fewer_bits_than_a_general_compressor():
    table = f"{DATA}/documents.parquet"
    texts = pq.read_table(table, columns=["text"]).column(0).combine_chunks().fill_null("")
    ids, _ = Encoder(tokenizer("byte_bpe_50k.json"), "kept").encode_all(texts)
    filters = [{"id": lzma.FILTER_LZMA2, "preset": 9, "lc": 0, "lp": 1, "pb": 1}]
    blocks = [ids[k : k + mixcoder.BLOCK].astype("<u2").tobytes() for k in range(0, len(ids), mixcoder.BLOCK)]
    lzma_bits = sum(len(lzma.compress(b, lzma.FORMAT_RAW, filters=filters)) for b in blocks) * 8 / len(ids)
    zlib_bits = len(zlib.compress(ids.astype("<u2").tobytes(), 9)) * 8 / len(ids)
    assert bits(coded(ids), ids) < 0.9 * min(lzma_bits, zlib_bits)


def test_tables_do_not_depend_on_the_machine():
    squash, stretch = mixcoder.logistic()
    assert zlib.crc32(squash.astype("<i4").tobytes() + stretch.astype("<i4").tobytes()) == SQUASH_CRC
    assert (np.diff(squash) >= 0).all() and (abs(stretch[squash] - (np.arange(4096) - 2048)) < 200).mean() > 0.8
    for r in (1, 2, 3, 100, 4095, 4096):
        x = np.concatenate([np.arange(r), np.arange(r * (1 << 18) - 9, r * (1 << 18)), r * np.arange(1, 1 << 18, 999) - 1])
        inverse = -(-(1 << 42) // r)
        assert (x[x >= 0] * inverse >> 42 == x[x >= 0] // r).all()


def test_broken_blocks_are_found():
    ids = np.arange(5000) % 300
    (model, blocks), = coded(ids)
    n, crc, data = blocks[1]
    blocks[1] = n, crc, data[:20] + bytes([data[20] ^ 1]) + data[21:]
    with pytest.raises(mixcoder.BrokenBlock, match="block 1"):
        mixcoder.decode(model, blocks)
    blocks[1] = n, crc, b"\xff" + data[1:]
    for bad in (model, model[:-3], b""):
        with pytest.raises(mixcoder.BrokenBlock):
            mixcoder.decode(bad, blocks)


def test_broken_files_are_found():
    group = idfiles.group_bytes([1, None], [2, 1], np.array([7, 8, 9]))
    end = b'{"end":[2,3]}'
    whole = idfiles.MAGIC + group + len(end).to_bytes(4, "little") + zlib.crc32(end).to_bytes(4, "little") + end
    assert [(d, s, i.tolist()) for d, s, i in idfiles.read_groups(io.BytesIO(whole))] == [([1, None], [2, 1], [7, 8, 9])]
    for bad in (b"", whole[:-1], whole[: len(idfiles.MAGIC) + len(group)], whole.replace(b"[2,3]", b"[2,4]"), whole[:20] + b"?" + whole[21:]):
        with pytest.raises((idfiles.BrokenFile, mixcoder.BrokenBlock)):
            list(idfiles.read_groups(io.BytesIO(bad)))


def test_documents_in_order(spark, monkeypatch):
    data = [(None, None), (5, "b"), (5, "a"), (5, "a"), (1, ""), (-3, "x y"), (7, "é" * 9000), *((i, f"text {i} \n here") for i in range(100, 160))]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as h")
    path = tokenizer("byte_bpe_50k.json")
    got = idfiles.read(idfiles.write(df, path, parts=5), ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in data), key=lambda x: (x is not None, x or 0))
    at = 0
    end = (2).to_bytes(4, "little")
    for r in got:
        texts = [t or "" for i, t in data if i == r["doc_id"]]
        assert bytes(r["ids"]) in [x + end for x in library("byte_bpe_50k.json", texts)]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"])))
        at += r["n_tokens"]
    assert idfiles.read(idfiles.write(df.limit(0), path)).collect() == []


def test_state_of_a_step_is_narrow():
    model = mixcoder.Model(np.arange(4, dtype=np.uint32), np.full((1, 4), 1 << 14), 16)
    coder = mixcoder.Coder(model, np.zeros(3, np.int64))
    assert all(x.dtype.itemsize == 4 for x in (coder.squash, coder.stretch, coder.zero, coder.prob1, coder.prob2, coder.w0, coder.w1, coder.w2))
