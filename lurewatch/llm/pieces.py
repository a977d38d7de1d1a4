"""Texts cut into the pieces that byte-level BPE merges, and the ids of known pieces.

Everything is done for many texts at once, on arrays: pieces are found from classes
of characters, looked up by their bytes in a hash table, and replaced by their ids.
Only pieces that are not in the table are encoded one by one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from lurewatch.llm.common import once

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Characters of texts that are cut together.
TOGETHER = 1 << 20
#: Pieces looked up together, and pieces a table keeps before it starts anew.
AT_ONCE = 1 << 19
KEPT = 300_000
SLOTS = 21
#: Longer pieces are kept in a dict.
INLINE = 16
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for code in range(0x110000):
        table[code] = kinds.get(unicodedata.category(chr(code))[0], OTHER)
    #: The property White_Space.
    for code in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[code] = SPACE
    return table


def starts_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, its code points, where pieces start, and where texts begin and the last ends.

    Pieces are the matches of public_tokenizers.PATTERN in each text: a piece starts
    where the class changes; a single space (U+0020) before a piece belongs to it;
    of more white space all but the last character is a piece; an English
    contraction that starts a piece is a piece.
    """
    joined = "".join(texts)
    begins = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if not n:
        return joined, codes, np.zeros(0, np.int64), begins
    kind = once("classes", 0, _classes)[codes]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first = first[:n]
    space = kind == SPACE
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a run of white space before something else in its text: its last character stands alone, or leads the next piece
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    blank = codes[last] == 32
    start[last] = True
    start[last[blank] + 1] = False
    quotes = np.flatnonzero((codes == 39) & start)
    if len(quotes):
        ends = begins[np.searchsorted(begins, quotes, side="right")]
        for at, end in zip(quotes.tolist(), ends.tolist()):
            pair = joined[at + 1 : min(at + 3, end)]
            size = 2 if pair[:1] in ("s", "t", "m", "d") else 3 if pair in ("re", "ve", "ll") else 0
            if size:
                if at + size < n:
                    start[at + size] = True
                start[at + 1 : at + size] = False
    return joined, codes, np.flatnonzero(start), begins


def word_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Like `starts_of`, for texts that are empty or begin with a space: a word starts with all spaces before it."""
    joined = "".join(texts)
    begins = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    start = codes == 32
    start[1:] &= codes[:-1] != 32
    start[begins[begins < len(codes)]] = True
    return joined, codes, np.flatnonzero(start), begins


def cut(text: str) -> list[str]:
    """The pieces of one text."""
    joined, _, starts, begins = starts_of([text])
    places = [*starts.tolist(), int(begins[-1])]
    return [joined[a:b] for a, b in zip(places[:-1], places[1:])]


def grouped(texts: list[str | None], characters: int = TOGETHER) -> Iterator[list[str]]:
    """Texts in groups of bounded length, one text at least; null counts as empty."""
    some: list[str] = []
    held = 0
    for text in texts:
        some.append(text or "")
        held += len(some[-1])
        if held >= characters:
            yield some
            some, held = [], 0
    if some:
        yield some


class PieceTable:
    """Ids of pieces, by their bytes.

    An open hash table: a piece of up to 16 bytes is compared as two words and its
    length, so no hash decides. When it holds KEPT pieces it starts anew, which
    bounds it and changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], starts: Callable = starts_of):
        self.encode, self.starts = encode, starts
        self.clear()

    def clear(self) -> None:
        size = 1 << SLOTS
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length, self.entry = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _slots(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ length.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 where it is not known."""
        slot = self._slots(low, high, length)
        found = self.entry[slot]
        other = np.flatnonzero((found >= 0) & ((self.low[slot] != low) | (self.high[slot] != high) | (self.length[slot] != length)))
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << SLOTS) - 1)
            s = slot[other]
            found[other] = self.entry[s]
            wrong = (self.low[s] != low[other]) | (self.high[s] != high[other]) | (self.length[s] != length[other])
            other = other[(self.entry[s] >= 0) & wrong]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, entry: np.ndarray) -> None:
        """Enters distinct new pieces."""
        slot = self._slots(low, high, length)
        left = np.arange(len(slot))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            s = slot[placed]
            self.low[s], self.high[s], self.length[s], self.entry[s] = low[placed], high[placed], length[placed], entry[placed]
            rest = np.ones(len(slot), bool)
            rest[placed] = False
            left = left[rest[left]]
            # what is free now may be taken by now
            slot[left] = np.where(self.entry[slot[left]] >= 0, (slot[left] + 1) & ((1 << SLOTS) - 1), slot[left])

    def entries(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(self.begin) > KEPT:
            self.clear()
        length = (ends - starts).astype(np.int32)
        found = self.find(low, high, length)
        for i in np.flatnonzero(length > INLINE).tolist():
            found[i] = self.long.get(raw[starts[i] : ends[i]], -1)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        place: dict[bytes, int] = {}
        which = [place.setdefault(raw[a:b], len(place)) for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
        lists = self.encode(list(place))
        known = len(self.begin)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))))
        entry = known + np.array(which)
        found[missing] = entry
        # one row of each new piece
        _, one = np.unique(entry, return_index=True)
        one = missing[one]
        short = one[length[one] <= INLINE]
        self.add(low[short], high[short], length[short], found[short])
        for i in one[length[one] > INLINE].tolist():
            self.long[raw[starts[i] : ends[i]]] = int(found[i])
        return found

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        joined, codes, starts, begins = self.starts(texts)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        raw = joined.encode("utf-8", "surrogatepass")
        first = np.searchsorted(starts, begins)
        if len(raw) > len(codes):
            sizes = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
            starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[starts]
        return self.look_up(raw, starts, first)

    def look_up(self, raw: bytes, starts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The ids of pieces that fill `raw`, by text: first says which piece a text begins with, and where the last one ends."""
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in first[1:]]
        ends = np.append(starts[1:], len(raw))
        padded = np.frombuffer(raw + bytes(INLINE), np.uint8)
        # the eight bytes from each place on
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        counts, parts = [], []
        for at in range(0, len(starts), AT_ONCE):
            a, b = starts[at : at + AT_ONCE], ends[at : at + AT_ONCE]
            size = b - a
            low = words[a] & MASKS[np.minimum(size, 8)]
            high = words[a + 8] & MASKS[np.clip(size - 8, 0, 8)]
            entry = self.entries(raw, a, b, low, high)
            count = self.count[entry]
            ends_ = np.cumsum(count)
            flat = np.arange(int(ends_[-1])) + np.repeat(self.begin[entry] - (ends_ - count), count)
            parts.append(self.ids[flat])
            counts.append(count)
        ids = np.concatenate(parts)
        places = np.concatenate(([0], np.cumsum(np.concatenate(counts))))[first]
        return [ids[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
