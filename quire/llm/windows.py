"""Runs of word windows that share a minimizer, and exact names of word sequences."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from quire.llm.wordhash import WHITE, Spans, mix, words

#: Separates the texts of a batch; UTF-8 never holds this byte.
_EDGE = 0xFF
_TO_SPACE = bytes(0x20 if white else k for k, white in enumerate(WHITE.tolist()))
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def normal(text: bytes | None) -> bytes:
    """The words of a text joined by one space."""
    flat = (text or b"").translate(_TO_SPACE)
    return b" ".join(flat.split()) if b"  " in flat or flat[:1] == b" " or flat[-1:] == b" " else flat


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word hashes h[start:end], equal for equal sequences wherever they stand; sequences may share one."""
    up, down = _powers_to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """The words of a batch of texts: their bytes and hashes, and where each text's words begin and end."""

    raw: bytes
    spans: Spans
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        """``texts``: words joined by one space, see ``normal``."""
        raw = b"\xff".join(texts)
        data = np.frombuffer(raw, np.uint8)
        breaks = np.zeros(256, bool)
        breaks[[0x20, _EDGE]] = True
        start, end = words(data, breaks)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.searchsorted(start, begin)
        return cls(raw, Spans(data, start, end), at[:-1], at[1:])

    def __len__(self) -> int:
        return len(self.spans.start)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space each."""
        return self.raw[self.spans.start[a] : self.spans.start[b - 1] + self.spans.size[b - 1]]

    def names(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """128 bits of BLAKE2b of each sequence of words a to b: as good as its bytes."""
        start, last = self.spans.start, b - 1
        cuts = zip(start[a].tolist(), (start[last] + self.spans.size[last]).tolist(), strict=True)
        return [hashlib.blake2b(self.raw[x:y], digest_size=16).digest() for x, y in cuts]

    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal bytes only, from 1."""
        s = self.spans
        _, first, number = np.unique(s.hash, return_index=True, return_inverse=True)
        rep = first[number]
        unlike = (s.size != s.size[rep]) | (s.low != s.low[rep]) | (s.high != s.high[rep])
        for i in np.flatnonzero((s.size > 16) & ~unlike).tolist():
            unlike[i] = s.bytes(i) != s.bytes(rep[i])
        if unlike.any():  # two words of one hash
            known: dict[bytes, int] = {}
            return np.array([known.setdefault(s.bytes(i), len(known) + 1) for i in range(len(self))], np.int64)
        return number + 1


def minimizer_runs(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, end of windows, minimizer) of each run of successive windows with the same minimizer.

    A window is ``width`` words of one text, named by its first word's place in ``w``; its minimizer is the smallest hash
    of its grams of ``gram`` words. Equal windows have equal minimizers, whatever stands around them.
    """
    n = len(w)
    owner = np.repeat(np.arange(len(w.first)), w.last - w.first)
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(n - gram + 1)
    low, span, want = spans_hash(w.spans.hash, at, at + gram), 1, width - gram + 1
    while 2 * span <= want:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    valid = np.arange(len(low)) + width <= w.last[owner[: len(low)]]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (owner[1 : len(low)] != owner[: len(low) - 1])
    first = np.flatnonzero(begin)
    stop = np.flatnonzero(valid & np.concatenate([~valid[1:] | begin[1:], [True]])) + 1
    return owner[first], first, stop, low[first]
