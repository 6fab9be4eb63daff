"""Progressive JPEG: round trips of payloads, and foreign streams by a plain encoder written here."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sluice.llm import jpeg, media


def test_zigzag_is_the_formats():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]


@pytest.mark.parametrize("mcus", [1, 2, 7, 100, 8191, 8192, 9000])
def test_payloads_come_back(mcus):
    data = random.Random(mcus).randbytes(jpeg.MCU * mcus)
    stored = jpeg.encode(data)
    picture = jpeg.decode(stored)
    assert jpeg.payload(picture) == data and len(stored) < 1.16 * len(data) + 600
    assert jpeg.rgb(picture).shape == (picture.height, picture.width, 3)


def test_plain_payloads_and_bad_ones():
    for data in (b" " * 192, b"\xff" * 384, b"\0" * 192, bytes(range(256)) * 3):
        assert jpeg.payload(jpeg.decode(jpeg.encode(data))) == data
    for data in (b"", b"x" * 191):
        with pytest.raises(ValueError):
            jpeg.encode(data)
    good = jpeg.encode(b"a" * 1920)
    for bad in (b"", b"nothing", good[:-2], good[: len(good) // 2], good.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode(bad)


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> n - 1 - i & 1 for i in range(n)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        data = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return data.replace(b"\xff", b"\xff\x00")


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def plain_encoder(shape, factors, coefficients, restart):
    """A progressive stream symbol by symbol, with eight-bit codes for all symbols, and what each point transform keeps."""
    height, width = shape
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    table = jpeg._segment(0xC4, b"\x00" + bytes(7 * [0] + [16] + 8 * [0]) + bytes(range(16)))
    table += jpeg._segment(0xC4, b"\x10" + bytes(7 * [0] + [0, 255] + 7 * [0]) + bytes(range(255)))
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes([2] * 64)), table]
    if restart:
        out.append(jpeg._segment(0xDD, struct.pack(">H", restart)))
    out.append(jpeg._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))))

    def scan(parts, band, high, low, units, write):
        out.append(jpeg._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([*band, high << 4 | low])))
        step = restart or units
        for k, a in enumerate(range(0, units, step)):
            if k:
                out.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            bits = Bits()
            write(bits, range(a, min(units, a + step)))
            out.append(bits.bytes())

    def mcu_blocks(m):
        for c, (h, v) in enumerate(factors):
            for y in range(v):
                for x in range(h):
                    yield c, (m // across * v + y) * across * h + m % across * h + x

    def dc_first(bits, span):
        last = [0] * len(factors)
        for m in span:
            for c, i in mcu_blocks(m):
                v = int(coefficients[c][i][0]) >> 1
                n, extra = magnitude(v - last[c])
                last[c] = v
                bits.put(n, 8)
                bits.put(extra, n)

    def dc_next(bits, span):
        for m in span:
            for c, i in mcu_blocks(m):
                bits.put(int(coefficients[c][i][0]) & 1, 1)

    def cut(v, low):
        return int(np.sign(v)) * (abs(int(v)) >> low)

    def own_blocks(c):
        h, v = factors[c]
        w, t = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        return [y * across * h + x for y in range(t) for x in range(w)]

    def ac_first(c, band, low):
        def write(bits, span):
            run = 0

            def close():
                nonlocal run
                if run:
                    n = run.bit_length() - 1
                    bits.put(n << 4, 9)
                    bits.put(run - (1 << n), n)
                    run = 0

            for u in span:
                zeros, block = 0, coefficients[c][own_blocks(c)[u]]
                for k in range(band[0], band[1] + 1):
                    v = cut(block[k], low)
                    if not v:
                        zeros += 1
                        continue
                    close()
                    while zeros > 15:
                        bits.put(0xF0, 9)
                        zeros -= 16
                    n, extra = magnitude(v)
                    bits.put(zeros << 4 | n, 9)
                    bits.put(extra, n)
                    zeros = 0
                if zeros:
                    run += 1
            close()

        scan([c], band, 0, low, len(own_blocks(c)), write)

    def ac_next(c, band, high, low):
        def write(bits, span):
            run, kept = 0, []

            def close():
                nonlocal run, kept
                if run:
                    n = run.bit_length() - 1
                    bits.put(n << 4, 9)
                    bits.put(run - (1 << n), n)
                    for b in kept:
                        bits.put(b, 1)
                    run, kept = 0, []

            for u in span:
                block = coefficients[c][own_blocks(c)[u]]
                now = [abs(int(block[k])) >> low for k in range(64)]
                last = max((k for k in range(band[0], band[1] + 1) if now[k] == 1), default=-1)
                zeros, fresh = 0, []
                for k in range(band[0], band[1] + 1):
                    if now[k] == 0:
                        zeros += 1
                        continue
                    while zeros > 15 and k <= last:
                        close()
                        bits.put(0xF0, 9)
                        for b in fresh:
                            bits.put(b, 1)
                        zeros, fresh = zeros - 16, []
                    if now[k] > 1:
                        fresh.append(now[k] & 1)
                        continue
                    close()
                    bits.put(zeros << 4 | 1, 9)
                    bits.put(int(block[k] > 0), 1)
                    for b in fresh:
                        bits.put(b, 1)
                    zeros, fresh = 0, []
                if zeros or fresh:
                    run += 1
                    kept += fresh
            close()

        scan([c], band, high, low, len(own_blocks(c)), write)

    everyone = list(range(len(factors)))
    units = across * down if len(factors) > 1 else len(own_blocks(0))
    scan(everyone, (0, 0), 0, 1, units, dc_first)
    for c in everyone:
        ac_first(c, (1, 9), 0)
        ac_first(c, (10, 63), 2)
    scan(everyone, (0, 0), 1, 0, units, dc_next)
    for c in everyone:
        ac_next(c, (10, 63), 2, 1)
        ac_next(c, (10, 63), 1, 0)
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_foreign_streams(factors, restart):
    rng = np.random.default_rng(len(factors) + restart + factors[0][0])
    shape = (21, 38)
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-shape[1] // (8 * hmax)), -(-shape[0] // (8 * vmax))
    coefficients = []
    for h, v in factors:
        c = np.where(rng.random((across * h * down * v, 64)) < 0.25, rng.integers(-40, 41, (across * h * down * v, 64)), 0)
        c[::5, 1:] = 0
        if len(factors) == 1:  # blocks that only fill an MCU have no place in a scan of one component
            c = c[: -(-shape[1] // 8) * -(-shape[0] // 8)]
        coefficients.append(c)
    picture = jpeg.decode(plain_encoder(shape, factors, coefficients, restart))
    for c, (h, v), part in zip(coefficients, factors, picture.components, strict=True):
        w, t = -(-(-(-shape[1] * h // hmax)) // 8), -(-(-(-shape[0] * v // vmax)) // 8)
        own = [y * part.wide + x for y in range(t) for x in range(w)]
        assert (part.coefficients[own] == c[own]).all()
    # the inverse transform, by its definition, for one block of each component
    for c, part in zip(coefficients, picture.components, strict=True):
        f = np.zeros((8, 8))
        f.reshape(-1)[jpeg.ZIGZAG] = c[0] * 2
        cos = [[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
        want = np.array(cos).T @ f @ np.array(cos) + 128
        assert np.abs(jpeg.samples(picture, part)[:8, :8] - want).max() < 1e-2
    assert jpeg.rgb(picture).shape == (*shape, 3)


def test_stored_column(spark):
    data = [(None, None), (1, ""), (1, ""), (2, "é" * 3000), (3, "plain text " * 30), (4, "plain text " * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes")
    stored = media.store(df)
    got = media.payloads(stored).collect()
    assert len(got) == 6 and all(r["error"] is None for r in got)
    for i, text in data:
        raw = (text or "").encode()
        full = media.padded(raw)
        assert len(full) % 192 == 0 and full
        assert (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])) in {tuple(r)[1:5] for r in got if r["id"] == i}
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["id"] in (3, 4)}) == 1
    assert media.payloads(media.store(df.limit(0))).collect() == []
    pixels = {r["id"]: r for r in media.tensors(stored).collect()}
    assert len(pixels[3]["rgb"]) == pixels[3]["height"] * pixels[3]["width"] * 3
    foreign = spark.createDataFrame([(1, None), (2, bytearray(b"no picture"))], "id long, media binary")
    assert all(r["rgb"] is None and r["error"] for r in media.tensors(foreign).collect())


def test_foreign_bytes_are_errors_not_crashes(spark):
    good = jpeg.encode(media.padded(b"a text"))
    frame = good.index(b"\xff\xc2")
    wide = good[: frame + 5] + b"\xff\xff\xff\xff" + good[frame + 9 :]  # 65,535 x 65,535 pixels in a few bytes
    flat = good[: frame + 11] + b"\x00" + good[frame + 12 :]  # a sampling factor of zero
    data = [b"", b"\xff\xd8\xff\xc2", b"\xff\xd8\xff\xc2\x00", b"\xff\xd8\xff\xdd\x00\x03\x00\xff\xd9", wide, flat, good.replace(b"\xff\xfe", b"\xff\xef", 1), *(good[:k] for k in range(2, len(good), 9))]
    rng = np.random.default_rng(6)
    for _ in range(60):
        spoilt = bytearray(good)
        spoilt[int(rng.integers(2, len(good)))] = int(rng.integers(256))
        data.append(bytes(spoilt))
    df = spark.createDataFrame([(i, len(d), bytearray(d)) for i, d in enumerate(data)], "id long, n_bytes long, media binary")
    tensors = media.tensors(df).collect()
    assert len(tensors) == len(data) and all(r["error"] for r in tensors[:6])
    assert all((r["rgb"] is None) == (r["error"] is not None) for r in tensors)
    assert all((r["payload_sha256"] is None) == (r["error"] is not None) for r in media.payloads(df).collect())
    assert media.store_tensors(df).filter("rgb is not null").count() == sum(r["rgb"] is not None for r in tensors)
