"""Whole texts to token ids by a byte-level BPE file of the tokenizers library, word by word."""

from __future__ import annotations

import json
import os

import numpy as np

from quire.llm.wordhash import HashTable, Spans


class WordTokens:
    """The ids that the library gives for whole texts, each distinct word encoded by the library once.

    The file's pre-tokenizer cuts a text between words: a space goes with what follows it, a single line feed between
    other characters stands alone, and merges stay inside a pre-token. So a text whose lines are words separated by
    single spaces is the encodings of its words in turn, ``" word"`` inside a line, ``"word"`` at its start, a line feed
    between lines. Texts with other runs of white space, and files with another normalizer or pre-tokenizer, are encoded
    whole. Up to ``most`` words are kept, found by a hash and compared by their bytes: a text with a word whose hash
    another word holds is encoded whole.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not set(t["content"]) & set(" \n") for t in spec["added_tokens"])
        self.splits = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.table = HashTable(20)
        feed = self._library("\n")
        self.feed = feed
        #: By word number: where its ids start and how many they are; -1 for words around which white space isn't single.
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: By word number: its first 16 bytes and its size; by number of longer words: their bytes.
        self.low, self.high, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.longer: dict[int, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, with the space before them if any, and their numbers."""
        ids = self._library("\n".join(words))
        cut = np.flatnonzero(ids == self.feed[0])
        if len(self.feed) == 1 and len(cut) == len(words) - 1:
            return np.delete(ids, cut), np.diff(np.r_[-1, cut, len(ids)]) - 1
        each = [self._library(w) for w in words]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, spans: Spans, at: np.ndarray) -> None:
        """New words, a space before those inside a line; one learned without its full stop is encoded without it."""
        number, words = self.table.size, [spans.bytes(i) for i in at.tolist()]
        self.low, self.high, self.size = (np.concatenate([old, new[at]]) for old, new in ((self.low, spans.low), (self.high, spans.high), (self.size, spans.size)))
        self.longer.update((number + k, x) for k, x in enumerate(words) if len(x) > 16)
        words = [x.decode() for x in words]
        stems: dict[str, int] = {}
        stem, stop = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for k, w in enumerate(words):
            bare = w[1:] if w[:1] == " " else w
            if not bare or bare[0].isspace() or bare[-1].isspace():
                stem[k] = -1
                continue
            if len(bare) > 1 and bare[-1] in self.STOPS and bare[-2].isalpha():
                stop[k] = self.STOPS.index(bare[-1])
                w = w[:-1]
            stem[k] = stems.setdefault(w, len(stems))
        ids, size = self._words(list(stems)) if stems else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        tails = [self._library(c) for c in self.STOPS]
        tail = np.array([len(t) for t in tails] + [0])[stop]
        begin = np.cumsum(size) - size
        length = np.where(stem < 0, 0, size[stem]) + tail
        out = np.zeros(length.sum(), np.uint32)
        place = np.cumsum(length) - length
        own = length - tail
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(place, own) + inside] = ids[np.repeat(begin[stem], own) + inside]
        for c, ids_of in enumerate(tails):
            for i, x in enumerate(ids_of):
                out[(place + own)[stop == c] + i] = x
        self.start = np.concatenate([self.start, len(self.ids) + place])
        self.length = np.concatenate([self.length, np.where(stem < 0, -1, length)])
        self.ids = np.concatenate([self.ids, out])
        self.table.add(spans.hash[at])

    #: Marks that a merge never joins to the letter before them: the pre-tokenizer cuts there.
    STOPS = ".,!"

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after another, and how many each text has."""
        texts = [t or b"" for t in texts]
        if not self.splits or not any(texts):
            return self._whole(texts)
        if self.table.size > self.most:
            self._reset()
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        cut = np.flatnonzero((data == 32) | (data == 10))
        start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(data)]])
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])  # of each text
        spaced = np.concatenate([[False], data[cut] == 32])
        head = np.zeros(len(start), bool)
        opening = np.searchsorted(start, first)
        head[opening] = True
        spans = Spans(data, start - spaced, end)
        number = self.table.find(spans.hash)
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn(spans, new[np.unique(spans.hash[new], return_index=True)[1]])
            number[new] = self.table.find(spans.hash[new])
        unlike = (self.low[number] != spans.low) | (self.high[number] != spans.high) | (self.size[number] != spans.size)
        for i in np.flatnonzero((spans.size > 16) & ~unlike).tolist():
            unlike[i] = self.longer[int(number[i])] != spans.bytes(i)
        size = np.where(unlike, -1, self.length[number])
        odd = np.add.reduceat(size < 0, opening) > 0
        odd &= np.array([len(t) > 0 for t in texts])
        feeds = ~head & ~spaced  # words after a line feed of their text
        size = np.maximum(size, 0)
        room = size + feeds * len(self.feed)
        stop = np.cumsum(room)
        ids = np.empty(stop[-1], np.uint32)
        put = stop - size  # where each word's own ids go
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(put, size) + inside] = self.ids[np.repeat(self.start[number], size) + inside]
        for i, x in enumerate(self.feed):
            ids[(stop - room)[feeds] + i] = x
        counts = np.add.reduceat(room, opening)
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = self._library(texts[k].decode())
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


_loaded: dict[str, WordTokens] = {}


def tokenizer(path: str) -> WordTokens:
    """One for each file and worker."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
