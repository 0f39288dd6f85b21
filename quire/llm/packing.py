"""Packing token sequences by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import binaries, slices
from quire.llm.tokens import tokenizer


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments and loss-bearing tokens, all at once."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class VectorPacker:
    """Places items (tokens, loss-bearing tokens) into bins under three limits.

    A bin takes, one after another, the item with the largest dot product of its demand with the room left, each as a
    share of the limits, among those that fit; items of equal demand are one class, so a choice is one product over
    classes. With ``cut``, room that no whole item fills gets the start of a longer one, as far as both limits allow.
    """

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut

    def pack(self, tokens: list[int], loss: list[int], last: bool, bearing: list[np.ndarray] | None = None) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
        """Bins of (item, start, length), and what is left: (item, start); nothing if ``last``.

        ``bearing``: for each item the loss-bearing tokens before each of its places and its end; without it, where items
        are cut, every token bears loss.
        """
        most = self.limits
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, demand in enumerate(zip(tokens, loss, strict=True)):
            if not self.cut and (demand[0] > most.tokens or demand[1] > most.loss):
                raise ValueError("an item exceeds the limits")
            if demand[0]:
                groups.setdefault(demand, []).append((k, 0))
        classes = sorted(groups)
        index = {c: k for k, c in enumerate(classes)}
        size = np.array([c[0] for c in classes], np.int64)
        weight = np.array([c[1] for c in classes], np.int64)
        many = np.array([len(groups[c]) for c in classes], np.int64)
        total, bins = int((size * many).sum()), []

        def take(k: int) -> tuple[int, int]:
            many[k] -= 1
            return groups[classes[k]].pop()

        def put(item: int, start: int, n: int, w: int) -> None:
            nonlocal size, weight, many
            c = (n, w)
            if c not in index:
                index[c] = len(classes)
                classes.append(c)
                groups[c] = []
                size, weight, many = np.append(size, n), np.append(weight, w), np.append(many, 0)
            groups[c].append((item, start))
            many[index[c]] += 1

        def head(item: int, start: int, n: int, w: int) -> tuple[int, int]:
            """The longest start of an item that takes up to n tokens and w loss-bearing ones."""
            if bearing is None:
                return min(n, w), min(n, w)
            before = bearing[item]
            n = min(n, int(np.searchsorted(before[start + 1 : start + n + 1], before[start] + w, side="right")))
            return n, int(before[start + n] - before[start])

        while total and (last or total >= most.tokens):
            room = [most.tokens, most.segments, most.loss]
            if self.cut and total < most.tokens:  # the rest of all: a sequence of a power of two needs no padding
                room[0] = 1 << (total.bit_length() - 1)
            bin_: list[tuple[int, int, int]] = []
            while room[0] and room[1]:
                fits = (many > 0) & (size <= room[0]) & (weight <= room[2])
                if room[1] == 1 and self.cut:
                    fits &= size == room[0]
                if fits.any():
                    dot = size * (room[0] / most.tokens**2) + room[1] / most.segments**2 + weight * (room[2] / most.loss**2)
                    k = int(np.where(fits, dot, -1.0).argmax())
                    item, start = take(k)
                    n, w = int(size[k]), int(weight[k])
                elif self.cut and (many > 0).any():
                    longer = np.flatnonzero(many > 0)
                    k = int(longer[size[longer].argmax()])
                    item, start = take(k)
                    all_ = int(size[k]), int(weight[k])
                    n, w = head(item, start, min(room[0], all_[0]), room[2])
                    if all_[0] > n:
                        put(item, start + n, all_[0] - n, all_[1] - w)
                    if not n:
                        break
                else:
                    break
                bin_.append((item, start, n))
                room = [room[0] - n, room[1] - 1, room[2] - w]
                total -= n
            bins.append(bin_)
        return bins, [x for c in groups.values() for x in c]


def chunks(bearing: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """(start, length) of successive parts of an item that each keep the limits alone."""
    out, at, end = [], 0, len(bearing) - 1
    while at < end:
        n = min(limits.tokens, end - at)
        n = min(n, max(1, int(np.searchsorted(bearing[at + 1 : at + n + 1], bearing[at] + limits.loss, side="right"))))
        out.append((at, n))
        at += n
    return out


def pack_documents(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits(), end: int = 0, with_ids: bool = False, pool: int = 4096, text: str = "text", key: str = "doc_id", parts: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``limits.tokens`` ids: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens (ids of the piece that bear loss), and ``ids`` if asked for.

    A document is its ids, ``end`` added. ``parts`` names a column of array<struct<text, loss>> instead of ``text``: the
    turns of a conversation, encoded one by one, and which of them bear loss. Of a plain text all ids bear loss but the
    end, which says nothing of the document. Full sequences are cut off the front; what remains is packed with what remains
    of the others under all three limits, in pools of ``pool`` within a task, and cut where it fills a sequence up. What a
    task has left at last goes to sequences of powers of two, so padding to ``limits.tokens``, powers of two excepted, is
    needed only if the limit on segments or on loss closes a sequence. ``sequence_id``: the task's number, then a number
    in the task; a task run again packs its rows by itself, so losing one mixes no sequences.

    Null text or part: empty; without any text one id. Null keys and repeated rows: each row is a document of its own. Other
    columns aren't read, so their names can't clash. Empty table: no rows. No shuffle; a task holds the ids of one pool, of
    1 MB of text and of one longer text, which is held whole.
    """
    kind = dict(docs.dtypes)[key]
    most = limits.tokens

    def encoded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each document, and how many of them before each place bear loss."""
        encoder = tokenizer(tokenizer_file)
        if parts:
            column = column.fill_null([]) if column.null_count else column
            turns = column.flatten()
            rows = np.diff(column.offsets.to_numpy())
            ids, counts = encoder.encode(binaries(turns.field("text")))
            bears = np.repeat(turns.field("loss").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int32), counts)
            counts = np.add.reduceat(np.append(counts, 0), np.cumsum(rows) - rows) * (rows > 0) if len(rows) else counts
        else:
            ids, counts = encoder.encode(binaries(column))
            bears = np.ones(len(ids), np.int32)
        stop, zero = np.cumsum(counts), np.zeros(1, np.int32)
        for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True):
            last = bears[b - 1] if parts and b > a else 0
            yield np.append(ids[a:b], np.uint32(end)).astype("<u4"), np.concatenate([zero, np.cumsum(np.append(bears[a:b], last), dtype=np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(limits, True)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # key, ids of a part, loss before each place, place of the part, ids in the document

        def rows(bins: list[list[tuple[int, int, int]]], items: list[tuple]) -> tuple[list, ...]:
            nonlocal number
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for pieces in bins:
                offset = 0
                for item, start, n in pieces:
                    name, ids, bears, place, whole = items[item]
                    raw = ids[start : start + n]
                    for to, x in zip(out, (name, place + start, n, zlib.crc32(raw.tobytes()), whole, number, offset, int(bears[start + n] - bears[start]), raw if with_ids else None), strict=True):
                        to.append(x)
                    offset += n
                number += bool(pieces)
            return out

        def batch_of(cols: tuple[list, ...], like: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(cols[0], like), *[pa.array(c, pa.int64()) for c in cols[1:8]]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in cols[8]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids)

        def packed(last: bool) -> tuple[list, list]:
            return packer.pack([len(x[1]) for x in held], [int(x[2][-1] - x[2][0]) for x in held], last, [x[2] for x in held])

        like = pa.int64()
        for batch in slices(batches):
            like = batch.schema.field(0).type
            full: list[list[tuple[int, int, int]]] = []
            items = []
            for name, (own, bears) in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                for at, n in chunks(bears, limits):
                    if n == most:
                        full.append([(len(items), at, n)])
                    else:
                        held.append((name, own[at : at + n].copy(), bears[at : at + n + 1].copy(), at, len(own)))
                if len(own) >= most:
                    items.append((name, own, bears, 0, len(own)))
            if full:
                yield batch_of(rows(full, items), like)
            if len(held) >= pool:
                bins, left = packed(False)
                yield batch_of(rows(bins, held), like)
                held = [(held[i][0], held[i][1][s:], held[i][2][s:], held[i][3] + s, held[i][4]) for i, s in sorted(left)]  # what is left runs to the part's end
        if held:
            bins, _ = packed(True)
            yield batch_of(rows(bins, held), like)

    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return docs.select(key, parts or text).mapInArrow(run, schema + ", ids array<long>" * with_ids)
