"""Vectorised word splitting and hashing over Arrow string columns.

Texts stay in their UTF-8 buffers. A word class is a table of 256 booleans, which
is enough for classes that only single out ASCII characters: every byte of a
multi-byte character is then a word byte. All hashes are 64-bit and the same in
every process.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

# Arrays of some MB that were freed go back to the system, and Arrow's buffers too; workers live long.
def keep_freed(array: int, in_all: int) -> None:
    """This process keeps freed arrays of less than so many bytes for the next ones, about so many bytes in all."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, array)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, in_all)  # M_TRIM_THRESHOLD


FREED = 1 << 20, 1 << 20
keep_freed(*FREED)
pa.set_memory_pool(pa.system_memory_pool())

#: What this process keeps for later tasks, by module.
_KEPT: list[dict] = []


def kept() -> dict:
    """For what later tasks of the same work need again (a tokenizer and the pieces it met); other work calls let_go()."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go() -> None:
    """Drops what was kept and gives its memory back, as a worker goes from one stage of a job to the next and a tokenizer takes more than the other stages' own work."""
    if any(_KEPT):
        for held in _KEPT:
            held.clear()
        gc.collect()
        keep_freed(*FREED)
        rest()


def rest() -> None:
    """Gives back what was freed in pieces, at a task's end: its worker then waits beside a JVM that needs the memory."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


U64 = np.uint64
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit murmur hash; uint64 in and out."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class _Factors:
    """A fixed random odd number for each place, as many as were needed so far. Powers of one number would not do: modulo 2**64 texts whose hashes are equal can be written down for any of them."""

    def __init__(self, seed: int):
        self.seed, self.held = U64(seed), np.zeros(0, U64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.held):
            m = 1 << max(12, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.held = mix(np.arange(1, m + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + self.seed) | U64(1)
        return self.held[:n]


_BYTE_FACTORS, _WORD_FACTORS = _Factors(0xD6E8FEB86659FD93), _Factors(0x2545F4914F6CDD1D)


def word_table(outside: str) -> np.ndarray:
    """True for every byte but the ASCII characters given."""
    table = np.ones(256, bool)
    table[[ord(c) for c in outside]] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = word_table(" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased
ALNUM = word_table("".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len+1 int64 offsets from 0; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    ends = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


#: Bytes of text that are worked on at once: temporaries take some 50 times as much.
SLICE = (1 << 20) - 64


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of rows of so many bytes at most; a longer text is alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 of one byte each, without an index of eight bytes for each."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and len+1 offsets of the rows' words. data must begin at offsets[0] = 0."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = mapped(data, table)
    edge = np.empty(n + 1, bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    # a word that goes on over a row's end is two words
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut - 1]]
    places = np.flatnonzero(edge)
    if len(cut):
        cut = np.unique(cut)
        places = np.sort(np.concatenate([places, cut, cut]))
    starts, ends = places[0::2], places[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A hash of each range of bytes: the sum of each byte's number times its place's; fold maps bytes first."""
    return hash_ranges(data, starts, ends, fold)[0]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As hash_words(), with the ranges' bytes (mapped by fold) one after the other."""
    sizes = ends - starts
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    if not total:
        return np.zeros(len(starts), U64), data[:0]
    begin = after - sizes
    at = np.arange(total, dtype=np.int32)
    place = at - np.repeat(begin.astype(np.int32), sizes)
    at += np.repeat((starts - begin).astype(np.int32), sizes)
    held = data[at] if fold is None else fold[data[at]]
    with np.errstate(over="ignore"):
        values = _BYTE[held]
        values *= _BYTE_FACTORS(int(sizes.max()))[place]
        out = np.add.reduceat(values, np.minimum(begin, total - 1))
        if (sizes == 0).any():
            out[sizes == 0] = 0
        out += sizes.astype(U64) * U64(0x2545F4914F6CDD1D)
        return mix(out), held


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of that many words, rows' ends ignored; len(words) - size + 1 of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.full(n, U64(size) * U64(0x9FB21C651E98DF25))
        for i, factor in enumerate(_WORD_FACTORS(size)):
            out += words[i : i + n] * factor
        return mix(out)


def hash_run(words: np.ndarray, start: int, end: int) -> int:
    """As hash_windows(), of one run."""
    return int(hash_windows(words[start:end], end - start)[0])


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices into hash_windows() of the windows that lie in one row each; bounds are the rows' offsets."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return ragged(bounds[:-1], counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1] and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def covered(n: int, starts: np.ndarray, size) -> np.ndarray:
    """Of n places, whether a run of that size (one, or one for each start) from one of the starts covers it."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1) if len(starts) else None
    np.add.at(step, np.minimum(np.asarray(starts) + size, n), -1) if len(starts) else None
    return np.cumsum(step[:n]) > 0
