"""Archives: round trips, revisits, and salvage of damaged files."""

import gzip
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.llm import warc


def records(n, rng, plain):
    out = []
    for i in range(n):
        p = rng.randbytes(rng.randrange(0, 60000))
        r = warc.page_record(i, "http://x/", p, warc.base32_sha1(p), None)
        out.append(r if plain else gzip.compress(r))
    return out


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_later_records_are_recovered(seed, plain):
    rng = random.Random(seed)
    parts, hit = records(30, rng, plain), set(rng.sample(range(30), 4))
    damaged = []
    for i, p in enumerate(parts):
        if i in hit:
            kind = rng.randrange(4)
            if kind == 0:
                p = p[: len(p) // 2] + bytes([p[len(p) // 2] ^ 0x55]) + p[len(p) // 2 + 1 :]
            elif kind == 1:
                p = p[: len(p) // 2]
            elif kind == 2:
                p = rng.randbytes(5000) + p
            else:
                p = b"\x1f\x8b\x08WARC/1.1\r\n" * 10 + p
        damaged.append(p)
    data = b"".join(damaged)
    got = list(warc.salvage(io.BytesIO(data), len(data)))
    ids = {int(re.search(r"(\d+)", x[3][0]["warc-record-id"])[1]) for x in got if x[0] == "record"}
    assert set(range(30)) - hit <= ids
    assert got[0][1] == 0 and got[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert sum(x[0] == "gap" for x in got) >= 1 and all(x[3] for x in got if x[0] == "gap")


def test_whole_and_empty_files():
    rng = random.Random(9)
    for plain in (False, True):
        data = b"".join(records(8, rng, plain))
        assert [x[0] for x in warc.salvage(io.BytesIO(data), len(data))] == ["record"] * 8
    assert list(warc.salvage(io.BytesIO(b""), 0)) == []
    assert [x[:3] for x in warc.salvage(io.BytesIO(b"junk" * 1000), 4000)] == [("gap", 0, 4000)]
    big = b"x" * (3 * warc.WINDOW) + b"".join(records(2, rng, False))
    assert [x[0] for x in warc.salvage(io.BytesIO(big), len(big))] == ["gap", "record", "record"]


def test_wrong_digests_are_damage():
    p = b"hello"
    good = warc.page_record(1, "u", p, warc.base32_sha1(p), None)
    assert warc.parse(good)[2] == len(good)
    for bad in (good.replace(b"hello", b"hallo"), warc.page_record(1, "u", p, warc.base32_sha1(b"other"), None), good[:-1], b"WARC/1.1\r\nno colon\r\n\r\n", b"HTTP/1.1 200"):
        with pytest.raises(warc.Damage):
            warc.parse(bad)


def test_pages(spark):
    data = [(None, None, None), (1, "u", ""), (2, "ü x", "abc"), (3, None, "abc"), (4, "\n", "abc"), (4, "\n", "abc"), (None, "x", "q"), (None, "x", "q"), (9, "v", "long " * 100000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as refers_to", "3 as payload")
    manifest = warc.write(df, archive_bytes=2000)
    got = warc.read(manifest).filter("kind not in ('warcinfo', 'gap')").select(warc.page_id("id"), "kind", warc.page_id("refers_to"), "payload_bytes", "payload", "payload_digest").collect()
    seen = sorted(((r[0] is not None, r[0] or 0, r[1], r[2], r[3]) for r in got), key=str)
    want = [(True, 1, "response", None, 0), (False, 0, "revisit", 1, 0), (True, 2, "revisit", 4, 3), (True, 3, "revisit", 4, 3), (True, 4, "response", None, 3), (True, 4, "response", None, 3), (False, 0, "response", None, 1), (False, 0, "response", None, 1), (True, 9, "response", None, 500000)]
    assert seen == sorted(want, key=str)
    assert all(r["payload"] is None if r["kind"] == "revisit" else warc.base32_sha1(bytes(r["payload"])) == r["payload_digest"] for r in got)
    assert warc.read(warc.write(df.limit(0))).collect() == []


def test_gaps_are_logged(spark, tmp_path):
    rng = random.Random(4)
    parts = records(5, rng, False)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(parts[0] + b"junk" * 50 + parts[1] + parts[2][:-9] + parts[3] + parts[4])
    got = warc.read(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert sum(r["kind"] == "response" for r in got) == 4
    gaps = sorted((r["begin"], r["end"]) for r in got if r["kind"] == "gap")
    a, b = len(parts[0]), len(parts[0]) + 200 + len(parts[1])
    assert gaps == [(a, a + 200), (b, b + len(parts[2]) - 9)]


def members(rng, n=12):
    out = []
    for i in range(n):
        p = rng.randbytes(rng.randrange(0, 3000))
        out.append(warc.page_record(i, "http://x/", p, warc.base32_sha1(p), None))
    return out


def ids(got):
    return [int(re.search(r"(\d+)", x[3][0]["warc-record-id"])[1]) for x in got if x[0] == "record"]


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_members_of_many_records(monkeypatch, held):
    monkeypatch.setattr(warc, "HELD", held)
    rng = random.Random(11)
    parts = members(rng)
    one = gzip.compress(b"".join(parts))
    read = lambda data: list(warc.salvage(io.BytesIO(data), len(data)))
    assert ids(read(one)) == list(range(12)) and len(read(one)) == 12
    # a record that does not check, between others in a whole member
    bad = parts[4][:-60] + bytes([parts[4][-60] ^ 1]) + parts[4][-59:]
    got = read(gzip.compress(b"".join([*parts[:4], bad, *parts[5:]])) + gzip.compress(parts[0]))
    assert ids(got) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 0] and [x[0] for x in got].count("gap") == 1
    # a torn member keeps the records before the tear, and what follows it is found
    torn = one[: len(one) * 2 // 3]
    got = read(torn + gzip.compress(parts[0]))
    assert 4 < len(ids(got)) < 13 and ids(got)[:-1] == list(range(len(ids(got)) - 1)) and ids(got)[-1] == 0
    assert sum(x[2] - x[1] for x in got) == len(torn) + len(gzip.compress(parts[0]))
    assert ids(read(torn)) == ids(got)[:-1]


def test_lengths_that_are_none(monkeypatch):
    rng = random.Random(12)
    parts = members(rng, 3)
    for head in (b"9" * 5000, b"-4", b"\xc2\xb2", str(warc.RECORD_BYTES + 1).encode()):
        broken = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + head + b"\r\n\r\nx\r\n\r\n"
        for pack in (bytes, gzip.compress):
            data = pack(parts[0]) + pack(broken) + pack(parts[1] + parts[2])
            assert ids(warc.salvage(io.BytesIO(data), len(data))) == [0, 1, 2]
    monkeypatch.setattr(warc, "RECORD_BYTES", 100)
    with pytest.raises(ValueError):
        warc.record("resource", {}, b"x" * 101)


def test_missing_records_are_told(spark):
    manifest = warc.write(spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1))
    assert warc.read(manifest).filter("kind = 'gap'").count() == 0
    more = manifest.withColumn("records", F.col("records") + 1)
    assert [r["reason"] for r in warc.read(more).filter("kind = 'gap'").collect()] == ["9 records where the manifest has 10"] * manifest.filter("records > 0").count()
