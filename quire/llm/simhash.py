"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import binaries, slices
from quire.llm.components import connected_components
from quire.storage import Scratch

BITS = 64


def fingerprint(text: bytes | None, width: int) -> int:
    """Bit by bit the majority of the XXH64 (seed 42) of the shingles of ``width`` words, repeats included."""
    import xxhash

    words = text.lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else [b" ".join(x) for x in zip(*(words[k:] for k in range(width)), strict=False)]
    digest = xxhash.xxh64_intdigest
    ones, at = np.zeros(BITS, np.int64), 0
    while at < len(shingles):  # in blocks: eight bytes of bits for each byte of hash
        part = np.array([digest(s, 42) for s in shingles[at : at + 65536]], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += 65536
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the 64-bit fingerprint of each text as a signed long."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in binaries(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, fp long")


class GrayIndex:
    """Fingerprints sorted by group and Gray rank; each node holds the bits that all below it share.

    A node keeps only those shared bits that its parent lacks (``mask``, ``pattern``), so a search adds up differences
    from the top and drops a whole node once they exceed the distance. No node spans two groups.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, fan: int = 8):
        self.fp = fp
        n = len(fp)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
        start, anded, ored, last = np.arange(n), fp, fp, np.arange(n)
        levels = [(start, last, np.full(n, ~np.uint64(0)), fp)]
        while n and len(start) > len(first):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
            start = np.flatnonzero(place % fan == 0)
            anded, ored = np.bitwise_and.reduceat(anded, start), np.bitwise_or.reduceat(ored, start)
            last = last[np.r_[start[1:], len(owner)] - 1]
            owner = owner[start]
            levels.append((start, last, ~(anded ^ ored), anded))
        self.levels = []
        for k, (start, last, shared, pattern) in enumerate(levels):
            mask = shared
            if k + 1 < len(levels):
                above = levels[k + 1]
                parent = np.repeat(np.arange(len(above[0])), np.diff(np.r_[above[0], len(shared)]))
                mask = shared & ~above[2][parent]
            self.levels.append((start, last, mask, pattern & mask))
        self.owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n])) if n else np.zeros(0, np.int64)

    def later_within(self, distance: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of one group whose fingerprints differ in at most ``distance`` bits."""
        for at in range(0, len(self.fp), block):
            query = np.arange(at, min(at + block, len(self.fp)))
            node, spent = self.owner[query], np.zeros(len(query), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                start, last, mask, pattern = self.levels[level]
                spent = spent + np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node])
                keep = (spent <= distance) & (last[node] > query)
                query, node, spent = query[keep], node[keep], spent[keep]
                if level:
                    below = len(self.levels[level - 1][0])
                    many = np.r_[start[1:], below][node] - start[node]
                    ends = np.cumsum(many)
                    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
                    node = np.repeat(start[node], many) + inside
                    query, spent = np.repeat(query, many), np.repeat(spent, many)
            yield query, node


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item that pairs connect it with."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
    return label


def gray_rank(fp: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _blocks(mask: int, count: int) -> list[int]:
    """The bits that ``mask`` lacks, in ``count`` masks of about as many bits each, each with the bits of ``mask``."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [round(k * len(free) / count) for k in range(count + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def candidate_groups(items: DataFrame, distance: int, most: int, scratch: Scratch) -> DataFrame:
    """(group, fp, rep): two fingerprints within ``distance`` bits meet in a group at least once; groups of ``most`` rows at most.

    Of distance + 1 blocks of bits one is equal in both. A group above ``most`` is dealt again by blocks of the bits that
    it doesn't share, as often as needed: distinct fingerprints that share all but b bits are 2**b at most, so this ends,
    and the bound holds however alike the fingerprints are.
    """
    def deal(rows: DataFrame, masks: list[int]) -> DataFrame:
        below = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in _blocks(m, distance + 1)]))])
        rows = rows.select("fp", "rep", F.explode(F.element_at(below, F.col("mask"))).alias("mask"))
        return rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("group"), "fp", "rep", "mask")

    masks, level, done = [0], 0, []
    rows = deal(items.withColumn("mask", F.lit(0).cast("long")), masks)
    while True:
        level += 1
        rows = scratch.put(rows, f"dealt{level}")
        hot = scratch.put(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most).select("group"), f"hot{level}")
        masks = [b for m in masks for b in _blocks(m, distance + 1)]
        if not hot.limit(1).count() or not any(masks):
            done.append(rows)
            break
        done.append(rows.join(hot, "group", "left_anti"))
        rows = deal(rows.join(hot, "group", "left_semi"), sorted(set(masks)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("group", "fp", "rep")


def links(groups: DataFrame, distance: int, rows: int = 1_000_000) -> DataFrame:
    """(src, dst): a spanning forest, in each group, of the pairs within ``distance`` bits."""

    def solve(table: list[pa.RecordBatch]) -> pa.RecordBatch:
        group, fp, rep = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in table]) for k in range(3))
        index = GrayIndex(group, fp.view(np.uint64))
        root = forest(len(fp), index.later_within(distance))
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= rows:  # up to the last change of group
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                other = np.flatnonzero(keys != last)
                cut = int(other[0]) if len(other) else batch.num_rows
                held.append(batch.slice(0, cut))
                if len(other):
                    yield solve(held)
                    held, n, batch = [], 0, batch.slice(cut)
                else:
                    continue
            held.append(batch)
            n += batch.num_rows
        if held:
            yield solve(held)

    dealt = groups.repartition("group").sortWithinPartitions("group", gray_rank(F.col("fp")))
    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, most: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id): documents whose 64-bit SimHashes differ in at most ``distance`` bits are linked.

    Words are what ASCII white space separates, A-Z lower-cased; a shingle is ``width`` words joined by one space, or the
    whole sequence if there are fewer. ``fingerprint``: 16 lowercase hex digits. ``component_id``: the smallest key that
    links reach. Equal fingerprints are one vertex, so groups of copies cost one row. ``most``: largest group of
    distinct fingerprints that one index holds; larger ones are dealt again by more of their bits (candidate_groups).

    Null, empty and blank texts have fingerprint zero and are linked like others. Rows with a null key have a fingerprint,
    link with nothing, and have a null component. Equal keys with different texts count as one vertex by key. Each input
    row gives one row; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.put(fingerprints(docs, width, text, key), "fingerprints")
    items = marked.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("rep"))
    items = scratch.put(items, "items")
    groups = candidate_groups(items, distance, most, scratch)
    found = scratch.put(links(groups, distance), "links")
    label = connected_components(found, scratch)
    by_fp = items.join(label, items["rep"] == label["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    by_fp = scratch.put(by_fp, "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    out = marked.join(by_fp, "fp", "left").select(key, hexed.alias("fingerprint"), F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))
    scratch.drop(*[f"{name}{k}" for name in ("dealt", "hot", "edges") for k in range(64)], "links", "items")
    return out
