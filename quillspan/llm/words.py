"""Words of whole Arrow batches as numpy arrays: places, 64-bit hashes, and hashes of runs of words.

Everything works on UTF-8 bytes. A word is a longest run of bytes of one class, so the classes of the
contracts, which split at ASCII characters only, become tables of 256 entries. Hashes depend on
the bytes alone: they are equal in every process, on every machine and at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_VALUES = _mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

#: Bytes of a word: all but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word once A-Z are lower case: digits, a-z and all that is not ASCII. Upper case counts, to be used with lower().
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd number modulo 2**64, and their inverses, as far as they were needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            both = []
            for x in (self.base, self.inverse):
                a = np.full(size, x, U64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
            self.up, self.down = both
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[buf]


class Chunk:
    """Words of some texts that lie together in ``buf``.

    ``starts`` and ``ends`` are the words' byte places, ``first[i]:first[i + 1]`` the words of text ``i``,
    ``rows`` the texts' rows in the batch, ``offsets`` the texts' byte places.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, rows: np.ndarray, table: np.ndarray) -> None:
        self.buf, self.offsets, self.rows = buf, offsets, rows
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = table[buf]
        begins = inside[1:-1] & ~inside[:-2]
        stops = inside[1:-1] & ~inside[2:]
        filled = offsets[:-1] < offsets[1:]  # a word never goes on from one text into the next
        head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
        begins[head] = inside[1:-1][head]
        stops[tail] = inside[1:-1][tail]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text, counted from 0, of each word."""
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), U64)
        step = 1 << 16
        for a in range(0, len(out), step):
            s, e = self.starts[a : a + step], self.ends[a : a + step]
            lo, hi = s[0], e[-1]
            up, down = _BYTES.upto(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTE_VALUES[self.buf[lo:hi]] * up[: hi - lo], out=sums[1:])
            out[a : a + step] = _mix((sums[e - lo] - sums[s - lo]) * down[s - lo] + (e - s).astype(U64) * U64(0x9FB21C651E98DF25))
        return out


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of words ``i`` to ``i + n - 1`` for each ``i`` where so many follow; runs may cross texts."""
    total = len(hashes)
    if total < n:
        return np.empty(0, U64)
    up, down = _WORDS.upto(total + 1)
    sums = np.zeros(total + 1, U64)
    np.cumsum(hashes * up[:total], out=sums[1:])
    return _mix((sums[n:] - sums[:-n]) * down[: total - n + 1] + U64(n))


def whole_runs(chunk: Chunk, n: int) -> np.ndarray:
    """For each word, whether ``n`` words of its own text begin there."""
    last = np.repeat(chunk.first[1:], chunk.counts)
    return np.arange(len(chunk.starts)) + n <= last


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of ``length`` places, whether one of the ranges [start, end) holds it."""
    edges = np.zeros(length + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def sums_by_text(chunk: Chunk, flags: np.ndarray) -> np.ndarray:
    """For each text, the sum of its words' flags."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[chunk.first[1:]] - total[chunk.first[:-1]]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the places of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if places else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, table: np.ndarray, lowered: bool = False, size: int = 4 << 20) -> Iterator[Chunk]:
    """The rows of a batch in chunks of about ``size`` bytes; no text is cut, so a longer one is a chunk of its own."""
    buf, offsets = texts(column)
    n = len(offsets) - 1
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        part = buf[offsets[a] : offsets[b]]
        yield Chunk(lower(part) if lowered else part, offsets[a : b + 1] - offsets[a], np.arange(a, b), table)
        a = b


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from all values and the number in each row."""
    places = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=places[1:])
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values))
