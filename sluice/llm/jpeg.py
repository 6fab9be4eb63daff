"""Progressive JPEG: scans of spectral selection and successive approximation, decoded in numpy.

The decoder accumulates the scans of a progressive (SOF2) Huffman stream in coefficient arrays, dequantises, inverts the
cosine transform of all blocks at once, upsamples chroma and gives full-resolution RGB. It reads any such stream of one
to three components with restart intervals or without. Two kinds of scan go without a loop over symbols, after a
check of the whole scan: first AC scans all of whose symbols are the same size without runs, and refinements of blocks
that have no zero left. Everything else is decoded symbol by symbol.

The encoder stores bytes losslessly in the unit of the format, the quantised coefficient: a transform of samples would
round. 64 bytes make a block in zigzag order, three blocks (Y, Cb, Cr, unsampled) an MCU of 192 bytes. A byte b is the
coefficient that JPEG's magnitude code writes with the eight bits b: b from 128 up, b - 255 below. A comment segment
holds the number of payload bytes; MCUs that fill the last row hold zero bytes.

Scans: DC, then each component's AC 1-5 and 6-63, all but the lowest bit; then that bit of DC and of each component.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

MCU = 192
#: MCUs in a row of the picture at most: the format's width has 16 bits.
ROW = 8191
#: The order of a block's coefficients, as the format has it.
ZIGZAG = np.array(sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i // 8 if s % 2 else i % 8)))
BANDS = ((1, 5), (6, 63))
#: The encoder's own code lengths: of DC sizes, and of the AC symbols (seven bits without a run) and end-of-band runs.
DC_LENGTHS = tuple(enumerate((2, 3, 3, 3, 3, 3, 4, 5, 6, 7)))
AC_LENGTHS = ((0x07, 1), *((n << 4, 5) for n in range(15)))


class JpegError(ValueError):
    """A stream that can't be decoded."""


# Encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=8)
def _dht(kind: int, pairs: tuple[tuple[int, int], ...]) -> bytes:
    """A table from symbols and their code lengths."""
    lengths = dict(pairs)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return _segment(0xC4, bytes([kind]) + bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order))


def _sos(components: list[int], table: int, band: tuple[int, int], high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, table]) for c in components) + bytes([*band, high << 4 | low]))


def _stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of so many bits each, high bits first, filled up with ones."""
    total = int(widths.sum())
    ends = np.cumsum(widths)
    place = np.arange(total) - np.repeat(ends - widths, widths)
    bits = np.repeat(values, widths) >> (np.repeat(widths, widths) - 1 - place) & 1
    return np.packbits(np.concatenate([bits.astype(np.uint8), np.ones(-total % 8, np.uint8)])).tobytes()


def _eob(blocks: int) -> list[tuple[int, int]]:
    """(size, extra) of the end-of-band runs that cover so many blocks."""
    runs = [0x7FFF] * (blocks // 0x7FFF) + [blocks % 0x7FFF] * (blocks % 0x7FFF > 0)
    return [(n.bit_length() - 1, n - (1 << n.bit_length() - 1)) for n in runs]


def encode(payload: bytes) -> bytes:
    """A picture of a payload whose length is a positive multiple of MCU bytes."""
    if not payload or len(payload) % MCU:
        raise ValueError(f"the payload is a positive multiple of {MCU} bytes")
    mcus = len(payload) // MCU
    high = -(-mcus // ROW)
    wide = -(-mcus // high)
    data = np.zeros((wide * high, 3, 64), dtype=np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    value = data[:, :, 0].astype(np.int64)
    value = np.where(value >= 128, value, value - 255)
    # DC, all but the lowest bit: differences from the block before, by size and magnitude
    diff = np.diff(value >> 1, axis=0, prepend=0).reshape(-1)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1)
    codes = np.array([0, 2, 3, 4, 5, 6, 14, 30, 62, 126])  # lengths 2 3 3 3 3 3 4 5 6 7, canonical
    lengths = np.array([2, 3, 3, 3, 3, 3, 4, 5, 6, 7])
    dc = _bits(codes[size] << size | extra, lengths[size] + size)
    low_dc = np.packbits(np.concatenate([(value & 1).reshape(-1).astype(np.uint8), np.ones(-value.size % 8, np.uint8)])).tobytes()
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))))
    out += [_dht(0x00, DC_LENGTHS), _dht(0x10, AC_LENGTHS)]
    out += [_sos([1, 2, 3], 0, (0, 0), 0, 1), _stuff(dc)]
    # AC: the symbol (no run, seven bits) is one zero bit, and the seven bits are those of the byte but its last
    for c in (0, 1, 2):
        for first, last in BANDS:
            out += [_sos([c + 1], 0, (first, last), 0, 1), (data[:, c, first : last + 1] >> 1).tobytes()]
    out += [_sos([1, 2, 3], 0, (0, 0), 1, 0), _stuff(low_dc)]
    # the lowest bit of the magnitude: one end-of-band run, then a bit for each coefficient
    low = np.where(data[:, :, 1:] >= 128, data[:, :, 1:], ~data[:, :, 1:]) & 1
    for c in (0, 1, 2):
        parts, at = [], 0
        for n, x in _eob(len(data)):
            blocks = (1 << n) + x
            head = (16 + n) << n | x  # the codes of five bits are 10000 and up, in the order of n
            parts += [np.array([head >> 4 + n - k & 1 for k in range(5 + n)], np.uint8), low[at : at + blocks, c].reshape(-1)]
            at += blocks
        bits = np.concatenate(parts)
        out += [_sos([c + 1], 0, (1, 63), 1, 0), _stuff(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes())]
    return b"".join([*out, b"\xff\xd9"])


# Decoding


@dataclass
class _Component:
    h: int
    v: int
    table: int
    wide: int = 0  # in blocks, filled up to whole MCUs
    high: int = 0
    own_wide: int = 0  # in blocks, without the filling
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    components: list[_Component]
    quant: dict[int, np.ndarray]
    comment: bytes


@lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]]]:
    """From (length, code) to symbol, and back."""
    table, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for _ in range(k):
            table[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table, {s: key for key, s in table.items()}


class _Reader:
    """Bits of one entropy-coded interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            self.acc = self.acc << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            if self.at > len(self.data) + 8:
                raise JpegError("the scan ends early")
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits(1)
            if (n, code) in table:
                return table[n, code]
        raise JpegError("no such code")


def _extend(v: int, n: int) -> int:
    return v if n == 0 or v >> n - 1 else v - (1 << n) + 1


def _refine(reader: _Reader, c: np.ndarray, k: int, bit: int) -> None:
    if reader.bits(1) and not abs(int(c[k])) & bit:
        c[k] += bit if c[k] > 0 else -bit


def _scan_dc(data: bytes, which: list[int], tables: dict[int, list[int]]) -> list[int]:
    """The values of a first DC scan; which: each block's component, in the order of the stream."""
    # Read through a window of 32 bits at each symbol.
    most, at, last, out = 8 * len(data), 0, dict.fromkeys(tables, 0), []
    data, load = data + b"\xff" * 8, int.from_bytes
    for c in which:
        begin = at >> 3
        window = load(data[begin : begin + 6], "big") >> 16 - (at & 7) & 0xFFFFFFFF
        look = tables[c][window >> 16]
        if look < 0:
            raise JpegError("no such code")
        length, n = look >> 8, look & 255
        at += length + n
        if at > most:
            raise JpegError("the scan ends early")
        if n:
            v = window >> 32 - length - n & (1 << n) - 1
            last[c] += v if v >> n - 1 else v - (1 << n) + 1
        out.append(last[c])
    return out


@lru_cache(maxsize=64)
def _window_table(counts: bytes, symbols: bytes) -> list[int]:
    """From 16 bits to length << 8 | symbol, -1 where no code begins them."""
    out = np.full(1 << 16, -1, np.int64)
    for (n, code), s in _huffman(counts, symbols)[0].items():
        out[code << 16 - n : (code + 1) << 16 - n] = n << 8 | s
    return out.tolist()


def _scan_ac(reader: _Reader, array: np.ndarray, blocks: np.ndarray | None, table: dict, back: dict, band: tuple[int, int], high: int, low: int) -> None:
    """blocks: the scan's rows of the array, in order; None if they are all of its rows."""
    first, last = band
    at_rows = slice(None) if blocks is None else blocks
    if blocks is None:
        blocks = np.arange(len(array))
    width, bit = last - first + 1, 1 << low
    if not high:
        # Only one symbol without a run, and it fills every block: fixed places for all.
        for s, (length, code) in back.items():
            if s >> 4 == 0 and s & 15:
                step = length + (s & 15)
                need = step * width * len(blocks)
                if -(-need // 8) == len(reader.data):
                    raw = np.frombuffer(reader.data, np.uint8)
                    if step == 8:
                        cells = raw.astype(np.int32)
                    elif step < 31:
                        cells = np.unpackbits(raw)[:need].reshape(-1, step) @ (1 << np.arange(step)[::-1]).astype(np.int32)
                    else:
                        continue
                    if (cells >> (s & 15) == code).all():
                        v = cells & (1 << (s & 15)) - 1
                        v = np.where(v >> (s & 15) - 1, v, v - (1 << (s & 15)) + 1)
                        array[at_rows, first : last + 1] = (v << low if low == 0 else v * bit).reshape(len(blocks), width)
                        return
        run = 0
        for i in blocks.tolist():
            if run:
                run -= 1
                continue
            k, c = first, array[i]
            while k <= last:
                r, n = divmod(reader.symbol(table), 16)
                if n:
                    k += r
                    if k > last:
                        raise JpegError("a run leaves its band")
                    c[k] = _extend(reader.bits(n), n) * bit
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + reader.bits(r) - 1
                    break
        return
    full = (array[at_rows, first : last + 1] != 0).all()
    flags = np.unpackbits(np.frombuffer(reader.data, np.uint8)) if full else None
    run, at, bits_at = 0, 0, 0
    while at < len(blocks):
        if flags is not None:
            # no zero left: an end-of-band run, then one bit for each coefficient of its blocks
            code, r = 0, None
            for n in range(1, 17):
                code = code << 1 | int(flags[bits_at]) if bits_at < len(flags) else -1
                bits_at += 1
                if (n, code) in table:
                    r = table[n, code]
                    break
            if r is None or r & 15 or r >> 4 == 15:
                raise JpegError("a symbol that a block without zeros can't have")
            r >>= 4
            run = (1 << r) + (int("".join(map(str, flags[bits_at : bits_at + r])), 2) if r else 0)
            bits_at += r
            n = min(run, len(blocks) - at)
            own = slice(at, at + n) if isinstance(at_rows, slice) else blocks[at : at + n]
            got = flags[bits_at : bits_at + n * width]
            if len(got) < n * width:
                raise JpegError("the scan ends early")
            now = array[own, first : last + 1]
            step = got.reshape(n, width).astype(np.int32) << low
            array[own, first : last + 1] = now + np.where(now > 0, step, -step)
            bits_at += n * width
            at += run
            continue
        c, k = array[blocks[at]], first
        at += 1
        if not run:
            while k <= last:
                r, n = divmod(reader.symbol(table), 16)
                fresh = 0
                if n:
                    fresh = bit if reader.bits(1) else -bit
                elif r < 15:
                    run = (1 << r) + reader.bits(r)
                    break
                while k <= last:
                    if c[k]:
                        _refine(reader, c, k, bit)
                    elif r == 0:
                        if n:
                            c[k] = fresh
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if run:
            for j in range(k, last + 1):
                if c[j]:
                    _refine(reader, c, j, bit)
            run -= 1


def _segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Marker, body, and where the entropy-coded data behind it begin."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no picture begins here")
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            at = data.find(b"\xff", at)
            if at < 0:
                break
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            return
        if marker in (0x00, 0xFF) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n
    raise JpegError("the picture has no end")


_MARK = re.compile(rb"\xff+[^\x00\xff]")


def _intervals(data: bytes, at: int) -> list[bytes]:
    """The entropy-coded data from here, cut at restart markers, without stuffing."""
    out, begin = [], at
    for m in _MARK.finditer(data, at):
        out.append(data[begin : m.start()].replace(b"\xff\x00", b"\xff"))
        begin = m.end()
        if not 0xD0 <= m[0][-1] <= 0xD7:
            return out
    raise JpegError("the scan has no end")


def decode(data: bytes) -> Picture:
    """The picture with all scans accumulated in each component's coefficients, in zigzag order."""
    tables: dict[int, tuple] = {}
    quant: dict[int, np.ndarray] = {}
    picture, ids, restart, comment, hmax, vmax = None, {}, 0, b"", 1, 1
    for marker, body, after in _segments(data):
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [_Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            ids = {body[6 + 3 * i]: i for i in range(n)}
            if not parts or not width or not height or any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
                raise JpegError("a frame without pixels")
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            # A block's DC value takes a bit at least.
            if -(-width // (8 * hmax)) * -(-height // (8 * vmax)) * sum(c.h * c.v for c in parts) > 8 * len(data):
                raise JpegError("more blocks than its bytes can tell")
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in parts:
                c.wide, c.high = across * c.h, down * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int32)
            picture = Picture(width, height, parts, quant, b"")
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
            raise JpegError("only progressive Huffman streams are read")
        elif marker == 0xDA:
            if picture is None:
                raise JpegError("a scan before its frame")
            n = body[0]
            try:
                own = [(ids[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
                first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
                if n == 1:
                    c = picture.components[own[0][0]]
                    order = (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).reshape(-1)
                    units = len(order)
                else:
                    units = -(-picture.width // (8 * hmax)) * -(-picture.height // (8 * vmax))
                step = restart or units
                for k, part in enumerate(_intervals(data, after)):
                    span = range(k * step, min(units, (k + 1) * step))
                    if first:
                        table, back = _huffman(*tables[0x10 | own[0][1] & 15])
                        if c.own_wide == c.wide:  # the scan's blocks lie together
                            _scan_ac(_Reader(part), c.coefficients[span.start : span.stop], None, table, back, (first, last), high, low)
                        else:
                            _scan_ac(_Reader(part), c.coefficients, order[span.start : span.stop], table, back, (first, last), high, low)
                        continue
                    if n == 1:
                        which, places = np.full(len(span), own[0][0]), order[span.start : span.stop]
                    else:
                        across, m = -(-picture.width // (8 * hmax)), np.arange(span.start, span.stop)
                        cells = [(i, (m // across * p.v + y) * p.wide + m % across * p.h + x) for i, _ in own for p in (picture.components[i],) for y in range(p.v) for x in range(p.h)]
                        which, places = np.tile([i for i, _ in cells], len(m)), np.stack([at for _, at in cells], 1).reshape(-1)
                    if high:
                        values = np.unpackbits(np.frombuffer(part, np.uint8))[: len(which)].astype(np.int32)
                        if len(values) < len(which):
                            raise JpegError("the scan ends early")
                    else:
                        values = np.array(_scan_dc(part, which.tolist(), {i: _window_table(*tables[t >> 4]) for i, t in own}), np.int32)
                    for i, _ in own:
                        mine = which == i
                        if high:
                            picture.components[i].coefficients[places[mine], 0] |= values[mine] << low
                        else:
                            picture.components[i].coefficients[places[mine], 0] = values[mine] << low
            except (KeyError, IndexError) as e:
                raise JpegError(f"a broken scan: {e!r}") from e
    if picture is None:
        raise JpegError("no frame")
    picture.comment = comment
    return picture


_COS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: From a block's coefficients in zigzag order to its samples.
INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def samples(picture: Picture, c: _Component) -> np.ndarray:
    """One component's plane, unclipped, 128 at the middle."""
    flat = (c.coefficients * picture.quant[c.table]).astype(np.float32) @ INVERSE
    return flat.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide) + np.float32(128)


def rgb(picture: Picture) -> np.ndarray:
    """Height x width x 3 bytes; chroma is repeated to full resolution."""
    hmax, vmax = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = [samples(picture, c).repeat(vmax // c.v, 0).repeat(hmax // c.h, 1)[: picture.height, : picture.width] for c in picture.components]
    if len(planes) == 1:
        planes = planes * 3
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    return np.rint(np.clip(np.stack(planes, -1), 0, 255)).astype(np.uint8)


def payload(picture: Picture) -> bytes:
    """The bytes that encode() stored."""
    n = struct.unpack(">Q", picture.comment)[0]
    parts = np.stack([c.coefficients for c in picture.components], 1)
    return np.where(parts > 0, parts, parts + 255).astype(np.uint8).tobytes()[:n]
