"""Multi-index hashing against brute force."""

import os

import numpy as np
import pytest

from sluice.llm import ann, queries

DATA = "/root/testdata/sf0.01"


def brute(ids, vectors, every, k):
    u = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = u @ u[i]
            s[i] = -9
            out[int(ids[i])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    for bits in (7, 16, 40, 64):
        codes = rng.integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1) >> np.uint64(64 - bits)
        codes[:40] = codes[0]
        tables = ann.Tables(codes, bits)
        for radius in (0, 1, 3, 10, 20, 26, 64):
            for code in codes[[0, 100, 499]].tolist():
                assert tables.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ np.uint64(code)) <= radius).tolist()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_recall_and_scores(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toArrow()
    ids, vectors = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), dtype=np.float64)
    want = brute(ids, vectors, 50, 5)
    got = {}
    for r in queries.op1_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    u = dict(zip(ids.tolist(), vectors / np.sqrt((vectors * vectors).sum(1))[:, None], strict=True))
    assert all(abs(u[q] @ u[v] - s) < 1e-12 for q, own in got.items() for v, s in own)


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((200, 5))
    vectors[100:130] = vectors[100]
    data = [(i, v) for i, v in enumerate(vectors.tolist())]
    odd = [(300, None), (350, [0.0] * 5), (400, [float("nan")] * 5), (450, [None] * 5), (500, [1.0]), (550, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as code", "2 as score")
    got = {}
    for r in ann.neighbours(df, every=10, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(np.arange(200), vectors, 10, 5)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert got[100] == [101, 102, 103, 104, 105]
    few = ann.neighbours(df.filter("vec_id in (0, 1, 2)")).collect()
    assert sorted((r["rank"], r["query_id"]) for r in few) == [(1, 0), (2, 0)]
    again = df.filter("vec_id < 2").union(df.filter("vec_id = 0")).unionByName(df.filter("vec_id = 3").selectExpr("cast(null as long) as vec_id", "embedding", "code", "score"))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in ann.neighbours(again).collect()) == sorted([(False, 0), (False, 1), (True, 0)] * 2)
    assert ann.neighbours(df.limit(0)).collect() == [] and ann.neighbours(df.filter("vec_id >= 550")).collect() == []
