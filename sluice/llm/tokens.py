"""Token ids of whole texts by the tokenizers library, with a memory of pieces between blanks.

A tokenizer that splits at blanks before it merges gives a text the ids of its pieces, one after the other. A batch of
texts is cut into pieces and each distinct piece looked up once; the library encodes those not seen lately, many at a
time, and the batch's ids are gathered by place. ``kept`` is for byte-level tokenizers whose pieces begin with their
blank, ``dropped`` for those that throw blanks away. A text in which blanks could join (runs of them, or any but a space
or line end), or that holds the string of a special token, is encoded whole; so is every text with ``rule=None``. All
give the ids that the library gives the whole text.

The memory holds about MOST pieces in a Python worker, and no piece of over LONGEST characters.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered, about; those of the last two batches stay when there are more.
MOST = 400_000
LONGEST = 48
#: Blanks that must be seen together with their neighbours, and what marks pieces here.
_STRANGE = r"\x00\x01\x0b\x0c\x1c\x1d\x1e\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JOINED = {"kept": rf"[ \n][ \n]|[\t\r{_STRANGE}]|[ \n]\z", "dropped": rf"[{_STRANGE}]"}
#: Letters without marks apart. A run of them, with or without a blank before it, is one word to every tokenizer here,
#: and where it ends at one of these signs a word ends.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ENDS = rf"([{_LETTERS}])([.,;:!?*#%$&])"
SIMPLE = {"kept": rf"\A ?[{_LETTERS}]+\z", "dropped": r"\A[a-zß-öø-ÿ]+\z"}
#: What stands between pieces that are encoded in one go; it is in no piece and always a single token of its own.
BETWEEN = {"kept": "\r", "dropped": " \x01 "}
_ID = attrgetter("id")
_LOADED: dict[tuple[str, str | None], Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The sign that a byte-level tokenizer writes for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str, rule: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder().values()
        if any(t.normalized for t in special):
            rule = None  # such strings are looked for in the normalised text
        self.rule = rule
        self.whole = "|".join([JOINED[rule], *(re.escape(t.content) for t in special)]) if rule else ""
        self.mark = self.library.encode(f"a{BETWEEN[rule]}a", add_special_tokens=False).ids[1:-1] if rule else []
        self.word = self.library.model.tokenize
        letters = byte_letters()
        self.signs = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.starts = self.sizes = self.used = np.zeros(0, np.int64)
        self.turn = 0

    @classmethod
    def of(cls, path: str, rule: str | None) -> Encoder:
        """This worker's own, with what it remembers."""
        if (path, rule) not in _LOADED:
            _LOADED[path, rule] = cls(path, rule)
        return _LOADED[path, rule]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Short pieces' ids: encoded as one text and cut at the marks."""
        if len(self.mark) == 1:
            ids = np.array(self.library.encode_batch_fast([BETWEEN[self.rule].join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(cuts) == len(pieces) - 1:
                data = ids.tobytes()
                return [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]
        return self._whole(pieces)

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if self.rule == "dropped":
            return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _ENDS, r"\1 \2"))
        texts = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        return pc.split_pattern(pc.replace_substring_regex(texts, _ENDS, "\\1\0\\2"), "\0")

    def _encode(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces, of words by the tokenizer's own model."""
        simple = pc.match_substring_regex(pieces, SIMPLE[self.rule]).to_pylist()
        pieces, signs, word = pieces.to_pylist(), self.signs, self.word
        out = [array("I", map(_ID, word(p.translate(signs)))).tobytes() if s else b"" for p, s in zip(pieces, simple, strict=True)]
        rest = [k for k, s in enumerate(simple) if not s and pieces[k]]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, ids in zip(part, self._many([pieces[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _keep(self, pieces: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        if len(self.known) > MOST:
            stay = np.flatnonzero(self.used >= self.turn - 1)
            n = self.sizes[stay]
            ends = np.cumsum(n)
            self.flat = self.flat[np.repeat(self.starts[stay] - (ends - n), n) + np.arange(n.sum())]
            self.known, self.starts, self.sizes, self.used = self.known.take(pa.array(stay)), ends - n, n, self.used[stay]
        short = pc.less_equal(pc.utf8_length(pieces), LONGEST)
        keep = short.to_numpy(zero_copy_only=False)
        self.known = pa.concat_arrays([self.known, pieces.filter(short)])
        self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(sizes) - sizes)[keep]])
        self.sizes = np.concatenate([self.sizes, sizes[keep]])
        self.used = np.concatenate([self.used, np.full(int(keep.sum()), self.turn)])
        self.flat = np.concatenate([self.flat, flat])

    def _look_up(self, distinct: pa.Array, named: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in which array the ids of each distinct piece stand, and how many. named: those of texts encoded whole."""
        self.turn += 1
        place = pc.index_in(distinct, value_set=self.known)
        lost = place.is_null()
        fresh, at = distinct.filter(lost), np.flatnonzero(lost.to_numpy(zero_copy_only=False))
        place = place.fill_null(0).to_numpy()
        if named:
            own = pc.is_in(fresh, value_set=pa.array(list(named), pa.large_string())).to_numpy(zero_copy_only=False)
            usual = iter(self._encode(fresh.filter(pa.array(~own))))
            values = [named[p] if o else next(usual) for p, o in zip(fresh.to_pylist(), own.tolist(), strict=True)]
        else:
            values = self._encode(fresh)
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        starts, every = (self.starts[place], self.sizes[place]) if len(self.known) else (np.zeros(len(distinct), np.int64),) * 2
        if len(self.known):
            self.used[place] = self.turn
        starts[at], every = len(self.flat) + np.cumsum(sizes) - sizes, every.copy()
        every[at] = sizes
        both = np.concatenate([self.flat, flat])
        if named:
            usual = pa.array(~own)
            self._keep(fresh.filter(usual), sizes[~own], flat[np.repeat(~own, sizes)])
        else:
            self._keep(fresh, sizes, flat)
        return both, starts, every

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, 32 bits each, and where each text's end. No text is null."""
        texts = texts.cast(pa.large_string())
        if texts.offset or len(texts) and texts.buffers()[1][:8].to_pybytes() != bytes(8):  # ascii_lower breaks slices
            texts = texts.take(pa.array(np.arange(len(texts))))
        if self.rule is None:
            each = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(x) // 4 for x in each], dtype=np.int64)
        odd = pc.match_substring_regex(texts, self.whole)
        apart = texts.filter(odd).to_pylist()
        if apart:  # a name for each, of one piece that no other text has, in its place
            names = [f"\x01{k}" for k in range(len(apart))]
            texts = pc.replace_with_mask(texts, odd, pa.array(names, pa.large_string()))
        lists = self._pieces(texts)
        coded = lists.flatten().dictionary_encode()
        flat, starts, sizes = self._look_up(coded.dictionary, dict(zip(names, self._whole(apart), strict=True)) if apart else {})
        codes = coded.indices.to_numpy()
        own = sizes[codes]
        ends = np.cumsum(own)
        ids = flat[np.repeat(starts[codes] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = lists.offsets.to_numpy()
        return ids, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit little-endian integers."""
        ids, ends = self.encode_all(pa.array(texts, pa.large_string()))
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id behind each text's."""
    return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
