"""A bounded memo of token ids by unit, in NumPy arrays, for tokenizers that never merge across units.

Words are runs without ASCII white space; a word is cut into *units* where letters and punctuation meet, as
far as that is plain to see from its bytes.  Units are found, hashed and looked up for a whole group of
texts at a time; only units that the worker has not met go through the tokenizer.
"""

from __future__ import annotations

import numpy as np

from .common import lower_bytes, mix64, span_hashes

SLOT_BITS = 21  # slots of the table: 12 bytes each, and 10 for each unit
MAX_UNITS, MAX_IDS = 1_300_000, 12_000_000  # the memo starts anew beyond these
MAX_UNIT_BYTES = 64  # longer units, and those beyond MAX_UNITS in one text, are encoded once per group of texts

_WHITE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _MARK  # an apostrophe may start a contraction
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the multiplication and division signs

#: Which kinds may follow a run that is a unit of its own.
_CLEAN = np.zeros((5, 5), bool)
_CLEAN[_LETTER, [_WHITE, _MARK, _DIGIT]] = True
_CLEAN[_MARK, [_WHITE, _LETTER]] = True


def plain_bytes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, but for rows that hold a combining mark (U+0300 to U+036F).

    Lower case may compose with such a mark where upper case does not.
    """
    low = lower_bytes(data)
    marked = np.flatnonzero((data == 0xCC) | (data == 0xCD))
    for i in np.unique(np.searchsorted(off, marked, "right") - 1).tolist():
        low[off[i] : off[i + 1]] = data[off[i] : off[i + 1]]
    return low


def unit_spans(low: np.ndarray, off: np.ndarray, cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and each row's first unit (with the total last).

    A word's leading runs of letters (a-z and the Latin-1 letters) and of ASCII punctuation are units as long
    as a run is followed by the other kind, by the word's end or, after letters, by a digit; what is left of the
    word is one unit.  Without ``cut`` every word is one unit.
    """
    kind = _KIND[low]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    lead = lead[_LATIN[low[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[off[:-1][off[:-1] < len(kind)]] = _WHITE
    runs = np.flatnonzero((kind != before) & (kind != _WHITE))
    begins = before[runs] == _WHITE  # the first run of its word
    after = np.full(len(runs), _WHITE, np.uint8)
    after[:-1] = np.where(begins[1:], _WHITE, kind[runs[1:]])
    word = np.cumsum(begins) - 1
    stop = np.empty(len(low), bool)  # the last byte of its word
    stop[:-1] = (kind[:-1] != _WHITE) & (kind[1:] == _WHITE)
    stop[-1:] = kind[-1:] != _WHITE
    ends = off[1:][off[1:] > 0] - 1
    stop[ends] = kind[ends] != _WHITE
    word_end = np.flatnonzero(stop) + 1
    if cut:
        odd = np.cumsum(~_CLEAN[kind[runs], after]) - ~_CLEAN[kind[runs], after]  # unclean runs before each
        keep = odd == odd[np.flatnonzero(begins)][word] if len(runs) else begins
    else:
        keep = begins
    s, word = runs[keep], word[keep]
    e = word_end[word]
    same = np.flatnonzero(word[1:] == word[:-1])
    e[same] = s[same + 1]
    return s, e, np.searchsorted(s, off)


class Slots:
    """An open-addressing table from 64-bit hashes (not 0) to numbers, looked up in bulk; never filled beyond its slots."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: a free slot
        self.value = np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 where it is not known."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.value[slot], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        """Distinct new hashes with their numbers."""
        slot, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]  # of several for one slot the last stays
            mine = free & (self.keys[at] == h[todo])
            self.value[at[mine]] = value[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & self.mask


def edge_checks(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 32-bit check of each unit's length and its first and last eight bytes, independent of the hashes it is found by."""
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    out = (e - s).astype(np.uint64)
    for at in (s, np.maximum(s, e - 8)):
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
        eight = eight * (np.arange(8) < (e - at)[:, None])
        out = mix64(out ^ np.ascontiguousarray(eight.astype(np.uint8)).view(np.uint64).ravel(), 21)
    return (out >> np.uint64(32)).astype(np.uint32)


class UnitMemo:
    """Ids of units; ``encode`` gives the ids of many units as one array, with their lengths."""

    def __init__(self, encode, id_type=np.uint32, cut: bool = True):
        self.encode, self.id_type, self.cut = encode, id_type, cut
        self.clear()

    def clear(self) -> None:
        self.slots = Slots(SLOT_BITS)
        self.start = np.zeros(MAX_UNITS, np.int32)
        self.length = np.zeros(MAX_UNITS, np.int16)
        self.check = np.zeros(MAX_UNITS, np.uint32)
        self.flat = np.zeros(1 << 16, self.id_type)
        self.count = self.used = 0

    def _hold(self, ids: np.ndarray) -> int:
        """Put ids behind those in use; returns where they begin."""
        if self.used + len(ids) > len(self.flat):
            more = np.zeros(max(len(self.flat), len(ids)), self.id_type)
            self.flat = np.concatenate((self.flat, more))
        self.flat[self.used : self.used + len(ids)] = ids
        return self.used

    def _add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct new hashes, their units' checks and ids."""
        at = np.arange(self.count, self.count + len(h))
        self.slots.add(h, at.astype(np.int32))
        self.start[at] = self._hold(ids) + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.check[at] = check
        self.used += len(ids)
        self.count += len(h)

    def ids(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids in one array, with each row's bounds; ``end_id`` ends each row."""
        low = plain_bytes(data, off)
        s, e, first = unit_spans(low, off, self.cut)
        h = np.maximum(span_hashes(low, s, e), np.uint64(1))
        check, short = edge_checks(low, s, e), e - s <= MAX_UNIT_BYTES
        slot = self.slots.find(h)
        new = np.flatnonzero((slot < 0) & short)
        if len(new):
            pick = new[np.unique(h[new], return_index=True)[1]]
            if self.count + len(pick) > MAX_UNITS or self.used > MAX_IDS:
                self.clear()
                new = np.flatnonzero(short)
                pick = new[np.unique(h[new], return_index=True)[1]][:MAX_UNITS]
            self._add(h[pick], check[pick], *self.encode([low[a:b].tobytes() for a, b in zip(s[pick].tolist(), e[pick].tolist(), strict=True)]))
            slot = self.slots.find(h)
        slot[~short | (self.check[slot] != check)] = -1  # a unit under another one's hash is encoded like a long one
        start, n = self.start[slot].astype(np.int64), self.length[slot].astype(np.int64)
        large = np.flatnonzero(slot < 0)
        if len(large):  # encoded for this group alone: their ids lie behind those in use
            raw = [low[a:b].tobytes() for a, b in zip(s[large].tolist(), e[large].tolist(), strict=True)]
            names = {x: i for i, x in enumerate(dict.fromkeys(raw))}
            ids, lengths = self.encode(list(names))
            which = np.array([names[x] for x in raw])
            start[large], n[large] = (self._hold(ids) + np.cumsum(lengths) - lengths)[which], lengths[which]
        end = np.cumsum(n)
        flat = self.flat[np.repeat(start - end + n, n) + np.arange(int(end[-1]) if len(n) else 0)]
        bounds = np.concatenate(([0], end))[first]
        if len(self.flat) > 2 * MAX_IDS:
            self.flat = self.flat[: self.used].copy()
        if end_id is not None:
            flat = np.insert(flat, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return flat.astype("<u4", copy=False), bounds
