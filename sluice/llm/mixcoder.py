"""An adaptive context-mixing range coder for token ids, in blocks that stand alone.

Ids are cut into blocks of BLOCK and blocks into panels. A panel's model, stored once before its blocks, names its
distinct ids and gives a few order-0 distributions over them; blocks are grouped by the distribution that codes them
best. Each block starts from its distribution alone, with empty memories, so any block can be read without the others
and is checked by its checksum. Blocks are coded side by side: a step codes one id of each block, in numpy, with one
lane for each.

Three orders predict an id. Order 0 gives every id a probability. Orders 1 and 2 remember, for the one or two ids before,
which id came next and how surely; the surer of the two names the guess. How probable the guess is, is mixed from what
orders 2 and 1 (adaptive probabilities by sureness and by whether they agree with the guess) and order 0 (its
probability of the guess) say: in the logistic domain, by weights that learn from every outcome. The interval of an id
is the guess's share if it is the guess, else its order-0 share of the rest: one step of the range coder.

All arithmetic is in integers, and its tables come from exact decimals: decoding repeats encoding on any machine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import cache

import numpy as np

#: Ids in a block, and blocks side by side at most.
BLOCK, LANES = 2048, 4096
#: Places that orders 1 and 2 have in a block, as bits.
SLOT_BITS = 10
#: Distributions of a panel, and distinct ids it may have.
TABLES, DISTINCT = 4, 1 << 16
#: Bits of a guess's probability.
P = 12
_TOP, _NARROW, _WORD, _ONE = np.uint64((1 << 32) - 1), np.uint64(1 << 30), np.uint64(32), np.uint64(1)
_SHARE = (1 << 32) - 1


class BrokenBlock(ValueError):
    """A block whose ids do not have its checksum, or a model that does not check."""


@cache
def logistic() -> tuple[np.ndarray, np.ndarray]:
    """squash, from 256ths of the logit (-2047 to 2047, at index + 2048) to P bits, and stretch, its inverse."""
    with localcontext() as context:
        context.prec = 30
        step, power = (Decimal(1) / 256).exp(), Decimal(1)
        up = []
        for _ in range(2048):
            up.append(int(4096 * power / (1 + power)))
            power *= step
    half = np.clip(np.array(up), 1, 4095)
    squash = np.concatenate([[1], 4096 - half[:0:-1], half]).astype(np.int32)
    stretch = np.clip(np.searchsorted(squash, np.arange(4096)), 1, 4095) - 2048
    return squash, stretch.astype(np.int32)


_HASH, _MIX1, _MIX2 = np.uint32(32 - SLOT_BITS), np.uint32(2654435761), np.uint32(2246822519)


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at]. No index is outside, and numpy is faster where it need not raise."""
    return table.take(at, mode="clip")


@dataclass
class Model:
    """Distinct ids in ascending order, and distributions over them: shares of 2^bits, rows of them."""

    ids: np.ndarray
    shares: np.ndarray
    bits: int

    def to_bytes(self) -> bytes:
        numbers = np.concatenate([[self.bits, *self.shares.shape], np.diff(self.ids.astype(np.int64), prepend=0), self.shares.reshape(-1)])
        return zlib.compress(_varints(numbers), 6)

    @classmethod
    def of_bytes(cls, data: bytes) -> Model:
        try:
            numbers = _numbers(zlib.decompress(data))
            bits, rows, n = numbers[:3].tolist()
            return cls(np.cumsum(numbers[3 : 3 + n]).astype(np.uint32), numbers[3 + n :].reshape(rows, n), bits)
        except (zlib.error, ValueError) as e:
            raise BrokenBlock("a model does not check") from e


def _varints(numbers: np.ndarray) -> bytes:
    """Numbers below 2^35 by seven bits a byte, the low ones first; the highest bit says that more follow."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 5):
        size += numbers >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(5):
        own = size > k
        out[ends[own] - size[own] + k] = numbers[own] >> 7 * k & 127 | np.where(size[own] > k + 1, 128, 0)
    return out.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw[: last[-1] + 1] & 127) << 7 * place, first)


def shares(counts: np.ndarray, bits: int) -> np.ndarray:
    """Shares of 2^bits in proportion to the counts, none of what occurs being zero."""
    total = int(counts.sum())
    out = np.where(counts > 0, np.maximum(1, (counts << bits) // max(1, total)), 0)
    if not total:
        return out
    short = (1 << bits) - int(out.sum())
    if short > 0:
        out[out.argmax()] += short
    for i in np.argsort(-out, kind="stable").tolist() if short < 0 else ():
        give = min(int(out[i]) // 2, -short)
        out[i] -= give
        short += give
        if not short:
            break
    return out


def fit(ranks: np.ndarray, used: np.ndarray, distinct: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts for each distribution, and each block's distribution. ranks: blocks x ids, of which so many are used.

    The blocks are grouped by a few rounds on every fourth id, each going to the distribution of least code length.
    """
    blocks, width = ranks.shape
    count = lambda rows, n: np.bincount(rows.reshape(-1) if n is None else rows[np.arange(width) < n[:, None]], minlength=distinct)
    if blocks < 8 * tables or tables == 1:
        return count(ranks, used)[None, :], np.zeros(blocks, np.int64)
    thin = np.ascontiguousarray(ranks[:, ::4])
    whole = count(thin, None) + 0.5
    cost = lambda c: (np.log2(c.sum()) - np.log2(c)).astype(np.float32).take(thin).sum(1)
    smooth = lambda c: c + whole * (64 / whole.sum())
    # Each first distribution is that of the block which the ones before suit worst.
    costs = [cost(smooth(np.bincount(thin[0], minlength=distinct)))]
    while len(costs) < tables:
        worst = int((np.min(costs, axis=0) - cost(whole)).argmax())
        costs.append(cost(smooth(np.bincount(thin[worst], minlength=distinct))))
    for _ in range(3):
        own = np.argmin(costs, axis=0)
        costs = [cost(smooth(count(thin[own == k], None))) for k in range(tables)]
    own = np.argmin(costs, axis=0)
    full = [count(ranks[own == k], used[own == k]) for k in range(tables)]
    kept = [k for k in range(tables) if full[k].any()]
    return np.stack([full[k] for k in kept]), np.searchsorted(kept, own)


class Coder:
    """Codes columns of ranks, one lane for each block; decodes them if the ranks are None."""

    def __init__(self, model: Model, table: np.ndarray):
        n, self.bits = len(table), model.bits
        distinct = model.shares.shape[1]
        self.n, self.lane = n, np.arange(n)
        self.low, self.high = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.squash, self.stretch = logistic()
        # order 0: shares, where they begin, their stretched probability, and which id has a place
        self.base, self.cut, self.last = (table * distinct).astype(np.int64), np.uint64(self.bits + P), (1 << self.bits) - 1
        share = model.shares.reshape(-1).astype(np.int64)
        begin = (np.cumsum(model.shares, axis=1) - model.shares).reshape(-1).astype(np.int64)
        self.both = begin << 32 | share
        self.zero = self.stretch[np.maximum(share >> self.bits - P, 1).clip(max=4095)]
        self.place = (table << self.bits).astype(np.int64)
        self.owner = np.concatenate([np.repeat(np.arange(distinct, dtype=np.uint16), s) for s in model.shares])
        # x // r is x * inverse[r] >> 42 for x below r * 2^bits: the error stays below 2^42
        self.inverse = np.array([0, *(-(-(1 << 42) // r) for r in range(1, 4097))], np.int64)
        # orders 1 and 2: rank and sureness by context, and adaptive probabilities by sureness and agreement
        self.slot = self.lane << SLOT_BITS
        kind = np.uint16 if distinct <= 1 << 12 else np.uint32  # a rank and four bits of sureness
        self.told1, self.told2 = np.zeros(n << SLOT_BITS, kind), np.zeros(n << SLOT_BITS, kind)
        # A prediction's sureness is halved by a miss and rises by one with a hit; below two, a miss replaces the prediction.
        self.kind, self.sure, self.four, self.one, self.two = kind, kind(15), kind(4), kind(1), kind(2)
        sure = np.arange(16)
        start = np.stack([np.full(16, 3000), np.minimum(60000, 65536 * (2 * sure + 1) // (2 * sure + 5))], axis=1).reshape(-1)
        start[:2] = 1500  # nothing told yet
        self.prob1, self.prob2 = np.tile(start.astype(np.int32), n), np.tile(start.astype(np.int32), n)
        self.row = self.lane * 32
        self.w0, self.w1, self.w2 = (np.full(n, w, np.int32) for w in (16000, 26000, 30000))
        self.before, self.hash2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)

    # The range coder: [low, high] in 64 bits, of which the upper 32 leave once they are settled.

    def start_encoding(self, most: int) -> None:
        self.words, self.used = np.zeros((self.n, most), np.uint32), np.zeros(self.n, np.int64)

    def start_decoding(self, data: np.ndarray, starts: np.ndarray) -> None:
        """data: all blocks' 32-bit words, with enough behind them to read on; starts: where each block's begin."""
        self.data, self.next = data, starts + 2
        self.value = data[starts].astype(np.uint64) << _WORD | data[starts + 1]

    def _settled(self, decoding: bool) -> tuple[np.ndarray, np.ndarray]:
        """Moves out what is settled and gives the intervals' beginnings and spans. A narrow one that straddles is cut to its larger side."""
        low, high = self.low, self.high
        span = high - low
        out = ((low ^ high <= _TOP) | (span < _NARROW)).nonzero()[0]
        if len(out):
            lo, hi = low.take(out), high.take(out)
            cut = (lo ^ hi > _TOP).nonzero()[0]
            if len(cut):
                a, b = lo[cut], hi[cut]
                left = (a | _TOP) - a >= b - (b & ~_TOP)
                lo[cut], hi[cut] = np.where(left, a, b & ~_TOP), np.where(left, a | _TOP, b)
            if decoding:
                place = self.next.take(out)
                self.value[out] = self.value.take(out) << _WORD | self.data.take(place)
                self.next[out] = place + 1
            else:
                place = self.used.take(out)
                if place.max() + 3 >= self.words.shape[1]:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
                self.words[out, place] = hi >> _WORD
                self.used[out] = place + 1
            lo, hi = lo << _WORD, hi << _WORD | _TOP
            low[out], span[out] = lo, hi - lo
        return low, span

    def step(self, got: np.ndarray | None) -> np.ndarray:
        """Codes one rank in each lane."""
        bits, one = self.bits, self.before
        mixed = one * _MIX1
        at1, at2 = self.slot + (mixed >> _HASH), self.slot + (mixed + self.hash2 >> _HASH)
        told1, told2 = _take(self.told1, at1), _take(self.told2, at2)
        sure1, sure2, rank1, rank2 = told1 & self.sure, told2 & self.sure, told1 >> self.four, told2 >> self.four
        guess = np.where(sure2 + sure2 >= sure1, rank2, rank1)
        cell1, cell2 = self.row + (sure1 + sure1 + (rank1 == guess)), self.row + (sure2 + sure2 + (rank2 == guess))
        prob1, prob2 = _take(self.prob1, cell1), _take(self.prob2, cell2)
        s0, s1, s2 = _take(self.zero, self.base + guess), _take(self.stretch, prob1 >> 4), _take(self.stretch, prob2 >> 4)
        logit = self.w0 * s0 + self.w1 * s1 + self.w2 * s2 >> 16
        logit += 2048
        mixed_p = _take(self.squash, np.minimum(np.maximum(logit, 1), 4095))
        p = mixed_p.astype(np.int64)
        rest, head = 4096 - p, p << bits
        low, span = self._settled(got is None)
        part = span >> self.cut
        if got is None:
            at = ((self.value - low) // part).astype(np.int64)
            hit = at < head
            place = np.minimum(np.maximum(at - head, 0) * _take(self.inverse, rest) >> 42, self.last)
            got = _take(self.owner, self.place + place).astype(guess.dtype)
            got = np.where(hit, guess, got)
        else:
            hit = got == guess
        both = _take(self.both, self.base + got)
        size, start = np.where(hit, head, (both & _SHARE) * rest), ((both >> 32) * rest + head) * ~hit
        self.low = low + part * start.view(np.uint64)
        self.high = self.low + part * size.view(np.uint64) - _ONE
        # Everything learns from the outcome. Weights may wrap, which costs bits only.
        one_hit = hit.astype(np.int32)
        off = (one_hit << P) - mixed_p
        self.w0 += s0 * off >> 10
        self.w1 += s1 * off >> 10
        self.w2 += s2 * off >> 10
        goal = one_hit * 65535
        self.prob1[cell1] = prob1 + (goal - prob1 >> 4)
        self.prob2[cell2] = prob2 + (goal - prob2 >> 4)
        fresh = (got << self.four) + self.one
        for told, at, old, rank, sure in ((self.told1, at1, told1, rank1, sure1), (self.told2, at2, told2, rank2, sure2)):
            missed = np.where(sure < self.two, fresh, old - (sure - (sure >> self.one)))
            told[at] = np.where(rank == got, old + (sure < self.sure), missed)
        self.hash2, self.before = mixed * _MIX2, got.astype(np.uint32)
        return got

    def finish(self) -> list[bytes]:
        """Each block's words: what left, and the last interval's lower end."""
        self._settled(False)
        self.words[self.lane, self.used] = self.low >> _WORD
        self.words[self.lane, self.used + 1] = self.low & _TOP
        return [w[: k + 2].astype("<u4").tobytes() for w, k in zip(self.words, self.used.tolist(), strict=True)]


#: What is stored of a block: its number of ids, their CRC-32 as little-endian 32-bit integers, and its bytes.
Block = tuple[int, int, bytes]


def encode(ids: np.ndarray, block: int = BLOCK, *, tables: int = TABLES, distinct: int = DISTINCT) -> Iterator[tuple[bytes, list[Block]]]:
    """Panels (model, blocks) of an array of 32-bit ids, in order. A panel of too many distinct ids is halved."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if not 0 < block <= distinct:
        raise ValueError("a block has an id, and no more than a panel may have distinct ones")
    for at in range(0, len(ids), LANES * block):
        todo = [ids[at : at + LANES * block]]
        while todo:
            part = todo.pop()
            own, ranks = _ranked(part)
            if len(own) > distinct:
                half = (len(part) // block + 1) // 2 * block
                todo += [part[half:], part[:half]]
            else:
                yield _panel(part, own, ranks, block, tables)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, and which of them each is."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.bincount(ids) > 0
    return np.flatnonzero(there).astype(np.uint32), (np.cumsum(there) - 1)[ids]


def _panel(part: np.ndarray, own: np.ndarray, ranks: np.ndarray, block: int, tables: int) -> tuple[bytes, list[Block]]:
    lanes = -(-len(part) // block)
    rows = np.full(lanes * block, ranks[-1], np.uint32)  # the last block is filled up by its last id
    rows[: len(ranks)] = ranks
    rows = rows.reshape(lanes, block)
    used = np.full(lanes, block)
    used[-1] = len(part) - (lanes - 1) * block
    counts, table = fit(rows, used, len(own), tables)
    bits = 16 if len(own) <= 1 << 14 else 18
    model = Model(own, np.stack([shares(c, bits) for c in counts]), bits)
    coder = Coder(model, table)
    coder.start_encoding(block // 2 + 16)
    for column in np.ascontiguousarray(rows.T).astype(coder.told1.dtype):
        coder.step(column)
    told = table.astype("<u4")
    data = [told[k : k + 1].tobytes() + d for k, d in enumerate(coder.finish())]
    return model.to_bytes(), [(int(n), zlib.crc32(part[k * block : k * block + n]), data[k]) for k, n in enumerate(used.tolist())]


def decode(model: bytes, blocks: list[Block], block: int = BLOCK) -> np.ndarray:
    """The ids of any of a panel's blocks."""
    if not blocks:
        return np.zeros(0, "<u4")
    model = Model.of_bytes(model)
    data = np.frombuffer(b"".join(b[2] for b in blocks), "<u4")
    data = np.concatenate([data, np.zeros(2 * block + 16, np.uint32)])  # a block that is broken may read on
    starts = np.cumsum([0, *(len(b[2]) // 4 for b in blocks[:-1])])
    table = data[starts].astype(np.int64)
    if table.max() >= len(model.shares):
        raise BrokenBlock("a block of no distribution")
    coder = Coder(model, table)
    coder.start_decoding(data, starts + 1)
    rows = np.empty((max(b[0] for b in blocks), len(blocks)), np.uint32)
    for k in range(len(rows)):
        rows[k] = coder.step(None)
    rows = model.ids.astype("<u4")[np.ascontiguousarray(rows.T)]
    out = []
    for k, (n, crc, _) in enumerate(blocks):
        if zlib.crc32(own := rows[k, :n]) != crc:
            raise BrokenBlock(f"block {k}")
        out.append(own)
    return np.concatenate(out)
