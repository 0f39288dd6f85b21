"""Words of many texts as 64-bit hashes, exact forms of them, and tables of such hashes, in whole-array operations."""

from __future__ import annotations

import hashlib

import numpy as np

_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one by BLAKE2b.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each bit over all (finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Spans data[start:end] of bytes: ``low`` and ``high`` hold the first 16 bytes, ``size`` the length, ``hash`` all.

    Two spans of up to 16 bytes are equal if and only if low, high and size are; ``same`` compares longer ones byte by byte.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.size = data, start, end - start
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        self.low, self.high = self._chunk(0, slice(None)), self._chunk(1, slice(None))
        h = mix((self.size.astype(np.uint64) + np.uint64(1)) * _SPREAD[0] ^ self.low)
        h = mix(h * _SPREAD[1] + self.high)
        more, k = np.flatnonzero((self.size > 16) & (self.size <= _LONG)), 2
        while len(more):
            h[more] = mix(h[more] * _SPREAD[1] + self._chunk(k, more))
            k += 1
            more = more[self.size[more] > 8 * k]
        for i in np.flatnonzero(self.size > _LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes(i), digest_size=8).digest(), "little")
        self.hash = h

    def _chunk(self, k: int, of: slice | np.ndarray) -> np.ndarray:
        """Bytes 8k to 8k + 8 of spans, zeros past their ends."""
        at = np.minimum(self.start[of] + 8 * k, len(self._eight) - 1)
        return self._eight[at] & _FIRST[np.clip(self.size[of] - 8 * k, 0, 8)]

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()


class HashTable:
    """64-bit keys to numbers 0, 1, ... in order of arrival; open addressing in arrays."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        last = np.uint64(len(self.keys) - 1)
        slot = keys & last
        value = self.values[slot]
        at = np.flatnonzero((value >= 0) & (self.keys[slot] != keys))
        slot = slot[at]
        while len(at):  # on to the next slot, where another key stands
            slot = (slot + np.uint64(1)) & last
            value[at] = self.values[slot]
            again = (self.values[slot] >= 0) & (self.keys[slot] != keys[at])
            at, slot = at[again], slot[again]
        return value

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that the table lacks."""
        while 2 * (self.size + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.values >= 0)
            held, numbers = self.keys[old], self.values[old]
            self.keys, self.values = np.zeros(2 * len(self.keys), np.uint64), np.full(2 * len(self.keys), -1, np.int32)
            self._place(held, numbers)
        self._place(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        last = np.uint64(len(self.keys) - 1)
        slot = keys & last
        while len(keys):
            free = self.values[slot] < 0
            self.values[slot[free]] = numbers[free]
            won = free & (self.values[slot] == numbers)
            self.keys[slot[won]] = keys[won]
            rest = ~won
            keys, numbers, slot = keys[rest], numbers[rest], (slot[rest] + np.uint64(1)) & last


def words(data: np.ndarray, is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't breaks. ``is_break``: 256 booleans."""
    inside = np.concatenate([[False], ~is_break[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


#: Space, \t, \n, \v, \f, \r.
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
