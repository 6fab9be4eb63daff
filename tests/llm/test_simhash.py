"""Covering hashing against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from sluice.llm import simhash
from sluice.plans.components import components


def brute_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    f = np.array(fps, dtype=np.int64).view(np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius):
            root[find(i + 1 + j)] = find(i)
    return [find(i) for i in range(len(f))]


def test_every_pair_within_the_radius_meets():
    rng = random.Random(3)
    for radius in range(5):
        m = [x & (1 << 64) - 1 for x in simhash.masks(radius)]
        assert len(m) == 2 ** (radius + 1) - 1
        for _ in range(500):
            differing = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not differing & x for x in m)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_fingerprints(width, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    rng = random.Random(5)
    for text in (None, "", " \t\n", "One", "a b", "É é\x0bA\x1fB c", " ".join(rng.choice("abcdef") for _ in range(60))):
        assert simhash.fingerprint((text or "").encode(), width) & (1 << 64) - 1 == brute_fingerprint(text, width)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_join_exactly_what_pairs_do(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(12):
        now = rng.getrandbits(64)
        for _ in range(15):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                now ^= 1 << b
            fps.add(now - (1 << 64) if now >> 63 else now)
    fps = sorted(fps)
    got = dict(components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius), "a", "b").collect())
    groups, want = {}, {}
    for x, c in zip(fps, brute_components(fps, radius), strict=True):
        groups.setdefault(c, []).append(x)
    for g in groups.values():
        want |= {x: min(g) for x in g}
    assert all(got.get(x, x) == want[x] for x in fps)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 9)


def test_documents(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(400))
    data = [(10, base), (4, base), (7, base + " tail"), (8, "other words entirely here"), (1, None), (2, ""), (None, " "), (None, "alone it stands"), (8, "other words entirely here"), (30, "OTHER words entirely HERE")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = simhash.near_duplicates(df, width=3, radius=2).select("doc_id", "fingerprint", "component_id").collect()
    assert len(got) == len(data)
    fps = [brute_fingerprint(t, 3) for _, t in data]
    ids = brute_components([f - (1 << 64) if f >> 63 else f for f in fps], 2)
    least = {}
    for (i, _), c in zip(data, ids, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i is not None, i or 0, f"{f:016x}", least.get(c) is not None, least.get(c) or 0) for (i, _), f, c in zip(data, fps, ids, strict=True))
    assert sorted((r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []
