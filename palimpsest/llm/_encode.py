"""Token ids of many texts by way of their distinct pieces of text.

A tokenizer whose pre-tokens never cross white space encodes a text as its white-space
separated parts, one after the other, and a part of ASCII letters next to digits or
punctuation as those pieces. Each distinct piece is encoded once by the tokenizers library and
kept; texts are put together from the kept ids by array operations.
"""

from __future__ import annotations

import numpy as np

from . import _text as T

#: Pieces that a process keeps; beyond it the store starts anew.
MOST_PIECES = 1_500_000
#: 0 letter, 1 digit, 2 other ASCII, 3 apostrophe, 4 part of a character beyond ASCII, 5 white space
KIND = np.full(256, 4, np.uint8)
KIND[:128] = 2
KIND[ord("0") : ord("9") + 1] = 1
for _a in ("A", "a"):
    KIND[ord(_a) : ord(_a) + 26] = 0
KIND[ord("'")] = 3
KIND[~T.SPACED] = 5
#: Whether a piece may end between a byte of the first and one of the second kind: by 6 * first + second.
CUTS = np.zeros(36, bool)
for _x, _y in ((0, 2), (2, 0), (0, 1), (1, 0), (1, 2), (2, 1), (1, 4), (4, 1), (1, 1)):
    CUTS[6 * _x + _y] = True
_CUTS = np.append(CUTS, np.zeros(220, bool))


class KeyTable:
    """Numbers 0, 1, 2, ... for keys in the order in which they were added; 16 bytes a key."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, T.U64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that aren't there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def add(self, keys: np.ndarray) -> None:
        """Distinct sorted keys, none of them there yet."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.numbers = np.insert(self.keys, at, keys), np.insert(self.numbers, at, np.arange(len(self), len(self) + len(keys)))


class Ragged:
    """Rows of unequal sizes in one growing array."""

    def __init__(self, kind):
        self.start, self.size, self.pool, self.used, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1 << 16, kind), 0, 0

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(values) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.pool[self.used : self.used + len(values)] = values
        self.n, self.used = self.n + len(sizes), self.used + len(values)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows, one after the other, and their sizes."""
        sizes = self.size[which].astype(np.int64)
        return self.pool[T.ragged(self.start[which], sizes)], sizes


#: Pieces of so many bytes are their own key, longer ones have a hash with the highest bit set.
SHORT = 7
_LONG = T.U64(1 << 63)


def short_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of pieces of up to SHORT bytes as a number, and their size above that."""
    words = np.zeros(len(data) // 8 + 2, T.U64)
    words.view(np.uint8)[: len(data)] = data
    at, shift = starts >> 3, ((starts & 7) << 3).astype(T.U64)
    # of two words what begins at the piece; a shift by 64 has no defined result, so the second is shifted twice
    value = (words[at] >> shift) | ((words[at + 1] << T.U64(1)) << (T.U64(63) - shift))
    wide = sizes.astype(T.U64)
    return (value & ((T.U64(1) << (wide << T.U64(3))) - T.U64(1))) | (wide << T.U64(56))


class PieceStore:
    """Ids by a piece; encode gives the ids of a list of pieces, one after the other, and how many each has. Of pieces that go by a hash the bytes are kept too and compared on every hit, so that equal hashes of different pieces do no harm."""

    def __init__(self, encode, most: int = MOST_PIECES):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.table, self.ids, self.bytes = KeyTable(), Ragged(np.int32), Ragged(np.uint8)

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None) -> None:
        self.table.add(keys)
        raw = data.tobytes()
        for a in range(0, len(starts), 20_000):
            ids, sizes = self.encode([raw[x:y].decode() for x, y in zip(starts[a : a + 20_000].tolist(), ends[a : a + 20_000].tolist())])
            self.ids.add(sizes, ids)
        sizes = np.where(ends - starts > SHORT, ends - starts, 0)
        held = data[T.ragged(starts, sizes)]
        self.bytes.add(sizes, held if fold is None else fold[held])

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each piece has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = ends - starts
        far = np.flatnonzero(sizes > SHORT)
        keys = short_keys(data if fold is None else T.mapped(data, fold), starts, np.minimum(sizes, SHORT))
        hashes, own = T.hash_ranges(data, starts[far], ends[far], fold)
        keys[far] = hashes | _LONG
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first, distinct = order[new], ordered[new]
        if len(self.table) + len(distinct) > self.most:
            self.clear()
        found = self.table.find(distinct)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self.add(distinct[missing], data, starts[first[missing]], ends[first[missing]], fold)
            found = self.table.find(distinct)
        which = np.empty(len(keys), np.int64)
        which[order] = found[np.cumsum(new) - 1]
        odd = self.bytes.size[which[far]] != sizes[far]
        if not odd.any():
            unequal = np.flatnonzero(self.bytes.rows(which[far])[0] != own)
            odd[np.searchsorted(np.cumsum(sizes[far]), unequal, "right")] = True
        if odd.any():
            odd = np.isin(np.arange(len(keys)), far[odd])
            return self.apart(data, starts, ends, fold, odd)
        return self.ids.rows(which)

    def apart(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of(), where some hits are of other pieces: those are encoded without the store."""
        raw, out = data.tobytes(), []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            out.append(self.encode([raw[a:b].decode()])[0].tolist() if odd[i] else self.of(data, starts[i : i + 1], ends[i : i + 1], fold)[0].tolist())
        return np.fromiter((x for ids in out for x in ids), np.int32), np.fromiter(map(len, out), np.int64, len(out))


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their sizes."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum())), sizes


def fine_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts (between white space, or between texts) cut where a letter, a digit and other ASCII meet, nowhere next to an apostrophe."""
    if len(data) < 2:
        return starts, ends
    begin = np.zeros(len(data) + 1, bool)
    kind = T.mapped(data, KIND)
    begin[1:-1] = T.mapped(kind[:-1] * np.uint8(6) + kind[1:], _CUTS)
    end = begin.copy()
    begin[starts] = end[ends] = True
    return np.flatnonzero(begin), np.flatnonzero(end)
