"""Words of whole Arrow text columns as 64-bit keys, without a Python object a word; and tables of such keys.

A word is a run of bytes other than U+0009-U+000D and U+0020. Its key is a
polynomial hash of its bytes and length, odd multipliers modulo 2^64, mixed. Two
of n words share a key with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = np.full(size, _R, _U), np.full(size, pow(_R, -1, 1 << 64), _U)
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, dtype=_U, out=powers)
        return self.up, self.down


_POWERS = _Powers()


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys; 0 is kept free for empty places in tables."""
    keys = keys ^ (keys >> _U(32))
    keys = keys * _U(0xD6E8FEB86659FD93)
    keys = keys ^ (keys >> _U(29))
    return np.where(keys == 0, _U(1), keys)


class Words:
    """The words of some texts: keys, places in ``data``, and for text i the words bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = _SPACE[data]
        inside = ~gap
        first, last = inside.copy(), inside.copy()
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        up, down = _POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(data * up[: len(data)], dtype=_U, out=sums[1:])
        sizes = (self.ends - self.starts).astype(_U)
        self.keys = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + sizes * _U(0xC2B2AE3D27D4EB4F))

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def texts(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def key_of(word: bytes) -> int:
    return int(Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).keys[0])


def slices(column: pa.Array, lower: bool = False, change=None, together: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, row behind the last, their words) over a binary or string column; null texts are empty.

    ``lower``: A-Z in lower case; ``change``: another function of the bytes, one for one.
    """
    if lower:
        change = LOWER.__getitem__
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + together, "right")) - 1)
        part = data[at[k] : at[stop]]
        yield k, stop, Words(part if change is None else change(part), at[k : stop + 1] - at[k])
        k = stop


class KeyTable:
    """Numbers 0, 1, ... for 64-bit keys in order of arrival; open addressing, at most half full."""

    def __init__(self, room: int = 1 << 12):
        self.n = 0
        self._make(room)

    def _make(self, room: int) -> None:
        self.keys, self.numbers, self.mask = np.zeros(room, _U), np.zeros(room, np.int32), _U(room - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is not known."""
        out = np.full(len(keys), -1, np.int32)
        place = keys & self.mask
        there = self.keys[place]
        hit = there == keys
        out[hit] = self.numbers[place[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            place[left] = (place[left] + _U(1)) & self.mask
            there = self.keys[place[left]]
            hit = there == keys[left]
            out[left[hit]] = self.numbers[place[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            full = self.keys != 0
            keys, numbers = np.concatenate([self.keys[full], keys]), np.concatenate([self.numbers[full], numbers])
            self._make(1 << (4 * self.n - 1).bit_length())
        place = keys & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] == 0]
            spots, who = np.unique(place[free], return_index=True)
            self.keys[spots], self.numbers[spots] = keys[free[who]], numbers[free[who]]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + _U(1)) & self.mask


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    full = sizes > 0
    if not len(out):
        return out
    first = (ends - sizes)[full]
    out[first] = starts[full]
    out[first[1:]] -= (starts[full] + sizes[full] - 1)[:-1]
    return np.cumsum(out)


class WordRows:
    """Remembers a short array for each word; ``make`` gives those of new words."""

    def __init__(self, make: Callable[[list[bytes]], list[np.ndarray]], dtype, limit: int = 1_500_000):
        self.make, self.limit, self.dtype = make, limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.table, self.starts, self.sizes = KeyTable(1 << 16), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def numbers(self, words: Words) -> np.ndarray:
        """Entry of each word. When the memory is full, all is forgotten and learned again as it is met."""
        found = self.table.find(words.keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.table.n > self.limit:
                self._clear()
                missing = np.arange(len(found))
            keys, first = np.unique(words.keys[missing], return_index=True)
            rows = self.make(words.texts(missing[first]))
            sizes = np.fromiter(map(len, rows), np.int32, len(rows))
            new = np.concatenate([*rows, np.zeros(0, self.dtype)])
            if self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], new, np.zeros(self.used + len(new), self.dtype)])
            else:
                self.flat[self.used : self.used + len(new)] = new
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used += len(new)
            self.table.add(keys)
            found[missing] = self.table.find(words.keys[missing])
        return found

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The words' arrays one after another, and each word's size."""
        at = self.numbers(words)
        sizes = self.sizes[at]
        return self.flat[ragged(self.starts[at], sizes)], sizes
