"""Substring dedup: a compressed FM-index per shard, against which other documents' runs are streamed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import binaries, release, slices
from quire.llm.fm_index import FMIndex
from quire.llm.windows import Words, minimizer_runs, normal
from quire.storage import Scratch

#: Bits of ``role``: a piece is in the index, a piece is streamed against it.
INDEXED, STREAMED = 1, 2
#: A document's run of windows: ``group`` is their minimizer, ``content`` names its words exactly.
RUN = "group long, content binary, key long"
#: A distinct run, with its words, by the document of the smallest key that has it; ``last``: the largest key that has it.
PIECE = "group long, content binary, key long, last long, role int, hot boolean, piece binary"
#: What a shard holds.
DEALT = "shard long, content binary, key long, last long, role int, piece binary"
FOUND = "content binary, spans array<struct<`from`:int,`to`:int,least:long>>"


def _names(spec: str) -> list[str]:
    return [c.split()[0] for c in spec.split(", ")]


def _batch(spec: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = zip(*rows, strict=True) if rows else [()] * len(_names(spec))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[x.split()[1]]) for c, x in zip(columns, spec.split(", "), strict=True)], names=_names(spec))


def document_runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """The distinct runs of each document (``RUN``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words.of([normal(t) for t in binaries(batch.column(1))])
            owner, first, stop, low = minimizer_runs(w, width, gram)
            names = w.names(first, stop + width - 1)
            once = np.array(list({x: k for k, x in enumerate(zip(owner.tolist(), names, strict=True))}.values()), np.int64)
            arrays = [pa.array(low[once].view(np.int64)), pa.array(names, pa.binary()).take(pa.array(once)), batch.column(0).take(pa.array(owner[once]))]
            yield pa.RecordBatch.from_arrays(arrays, names=_names(RUN))

    return docs.select("key", "text").mapInArrow(run, RUN)


def cut_pieces(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """The words of runs (``PIECE``); ``docs`` has ``wanted``: (content, last, role, hot) of the runs to take from a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, done = None, set()  # rows of equal keys come together: each run is given once
        for batch in slices(batches):
            w = Words.of([normal(t) for t in binaries(batch.column(1))])
            owner, first, stop, low = minimizer_runs(w, width, gram)
            names = w.names(first, stop + width - 1)
            keys, wanted = batch.column(0).to_pylist(), [{x["content"]: x for x in r} for r in batch.column(2).to_pylist()]
            rows = []
            for k, name, group, a, b in zip(owner.tolist(), names, low.view(np.int64).tolist(), first.tolist(), (stop + width - 1).tolist(), strict=True):
                x = wanted[k].get(name)
                if keys[k] != of:
                    of, done = keys[k], set()
                if x and name not in done:
                    done.add(name)
                    rows.append((group, name, of, x["last"], x["role"], x["hot"], w.text(a, b)))
            yield _batch(PIECE, rows)

    return docs.select("key", "text", "wanted").mapInArrow(run, PIECE)


def open_windows(pieces: DataFrame, width: int) -> DataFrame:
    """Windows of pieces by name: the smallest key that has each in a batch, where, and the largest ``last``."""
    spec = "group long, window binary, key long, content binary, at int, last long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[tuple[int, bytes], list] = {}
            w = Words.of(batch.column(4).to_pylist())
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for group, content, key, last, a, b in zip(*columns, w.first.tolist(), w.last.tolist(), strict=True):
                at = np.arange(a, b - width + 1)
                for k, name in enumerate(w.names(at, at + width)):
                    x = found.setdefault((group, name), [key, content, k, last])
                    if key < x[0]:
                        x[:3] = key, content, k
                    x[3] = max(x[3], last)
            yield _batch(spec, [(*g, *x) for g, x in found.items()])

    return pieces.select("group", "content", "key", "last", "piece").mapInArrow(run, spec)


def cut_segments(pieces: DataFrame, width: int) -> DataFrame:
    """Stretches of windows of a piece that go to the same bucket; ``pieces`` has ``places``: (at, bucket)."""
    spec = "group long, bucket long, key long, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for group, key, piece, places in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                words = piece.split(b" ")
                at = sorted({(x["bucket"], x["at"]) for x in places})
                begin = 0
                for k in range(1, len(at) + 1):
                    if k == len(at) or at[k] != (at[k - 1][0], at[k - 1][1] + 1):
                        rows.append((group, at[begin][0], key, b" ".join(words[at[begin][1] : at[k - 1][1] + width])))
                        begin = k
            yield _batch(spec, rows)

    return pieces.select("group", "key", "piece", "places").mapInArrow(run, spec)


def route(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces once for each bucket that their windows belong to."""
    spec = "group long, bucket long, content binary, key long, last long, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for group, buckets, content, key, last, piece in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                to = {0}
                if buckets > 1:
                    w = Words.of([piece])
                    at = np.arange(len(w) - width + 1)
                    to = {int.from_bytes(x[:4], "big") % buckets for x in w.names(at, at + width)}
                rows += [(group, b, content, key, last, piece) for b in sorted(to)]
            yield _batch(spec, rows)

    return pieces.select("group", "buckets", "content", "key", "last", "piece").mapInArrow(run, spec)


def deal_hot(hot: DataFrame, scratch: Scratch, width: int, most: int) -> DataFrame:
    """Pieces of hot groups as shards of about ``most`` pieces and ``most`` windows (``DEALT``).

    Only windows that two documents share are indexed, each from its first holder, in buckets by window name. The group's
    pieces are streamed against the buckets that their windows belong to, salted by the number of pieces there; a bucket's
    index goes to each of its salts. Rows grow with the pieces, not with their square.
    """
    windows = open_windows(hot, width).groupBy("group", "window").agg(F.min(F.struct("key", "content", "at")).alias("first"), F.max("last").alias("z"))
    windows = scratch.put(windows.where("first.key < z").select("group", "window", "first.*"), "hot_windows")
    sizes = scratch.put(windows.groupBy("group").agg(F.ceil(F.count("*") / most).alias("buckets")), "hot_sizes")
    bucket = F.conv(F.hex(F.substring("window", 1, 4)), 16, 10).cast("long") % F.col("buckets")
    places = windows.join(sizes, "group").select("content", F.struct(F.col("at"), bucket.alias("bucket")).alias("place"))
    places = scratch.put(places.groupBy("content").agg(F.collect_set("place").alias("places")), "hot_places")
    streamed = scratch.put(route(hot.join(sizes, "group"), width), "hot_streamed")
    salts = scratch.put(streamed.groupBy("group", "bucket").agg(F.ceil(F.count("*") / most).alias("salts")), "hot_salts")
    by = ["group", "bucket"]
    indexed = cut_segments(hot.join(places, "content"), width).join(salts, by).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    streamed = streamed.join(salts, by).withColumn("salt", F.pmod(F.xxhash64("content"), F.col("salts")))
    blank = {"content": F.lit(None).cast("binary"), "last": F.lit(None).cast("long")}
    both = indexed.withColumns(blank | {"role": F.lit(INDEXED)}).unionByName(streamed.withColumn("role", F.lit(STREAMED)))
    return both.withColumn("shard", F.xxhash64("group", "bucket", "salt")).select(*_names(DEALT))


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("least", pa.int64())]))


def search_shard(table: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    """Spans (``FOUND``) of the streamed pieces of a shard (``DEALT``), from an FM-index of its indexed ones."""
    part = max(1, width - 12)  # windows of one span of the search: shorter than two windows
    once = {}
    for b in table:
        for content, key, last, role, piece in zip(*[b.column(k).to_pylist() for k in range(1, 6)], strict=True):
            once[role, content or piece] = min(once.get((role, content or piece), (key, last, piece)), (key, last, piece))
    role, content = np.array([r for r, _ in once]), [c for _, c in once]
    key, last = np.array([x[0] for x in once.values()], np.int64), [x[1] for x in once.values()]
    indexed, streamed = role & INDEXED > 0, np.flatnonzero(role & STREAMED)
    if not indexed.any() or not len(streamed):
        return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], _SPANS)], names=_names("content binary, spans"))
    w = Words.of([x[2] for x in once.values()])
    size = w.last - w.first
    end = np.cumsum(size + 1) - 1
    inside = np.ones(end[-1] + 1, bool)
    inside[end] = False
    symbols = np.zeros(len(inside), np.int64)
    symbols[inside] = w.numbers()
    index = FMIndex(symbols[np.repeat(indexed, size + 1)], key[indexed], width)
    lanes = -(-(size[streamed] - width + 1) // part)  # long pieces go in parts, all at once
    place = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start, stop = np.repeat((end - size)[streamed], lanes) + part * place, np.repeat(end[streamed], lanes)
    block = index.matches(symbols, start, np.minimum(start + part + width - 1, stop))
    at = np.flatnonzero(block >= 0)
    owner = np.searchsorted(end, at)
    found = index.least[block[at]]
    useful = found < np.array([key[k] if x is None else x for k, x in enumerate(last)], np.int64)[owner]
    at, owner, found = at[useful], owner[useful], found[useful]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)]
    begin = np.flatnonzero(new)
    stops = np.concatenate([begin[1:], [len(at)]])[: len(begin)] - 1
    base = (end - size)[owner[begin]]
    fields = [(at[begin] - base).astype(np.int32), (at[stops] + 1 - base).astype(np.int32), found[begin]]
    spans = pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["from", "to", "least"])
    whose, many = np.unique(owner[begin], return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([pa.array([content[k] for k in whose.tolist()], pa.binary()), lists], names=["content", "spans"])


def search_shards(dealt: DataFrame, width: int, shard_words: int) -> DataFrame:
    """(content, spans) of streamed pieces (``FOUND``): windows (from, to), and the smallest key that the index has them of.

    Shards are taken together up to about ``shard_words`` words. Their indexed pieces make up an FM-index, against which
    the streamed ones are read by backward search; matching statistics of ``width`` words are reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= 6 * shard_words:  # bytes; up to the last change of shard
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                other = np.flatnonzero(keys != held[-1].column(0)[held[-1].num_rows - 1].as_py())
                cut = int(other[0]) if len(other) else batch.num_rows
                held.append(batch.slice(0, cut))
                if not len(other):
                    continue
                yield search_shard(held, width)
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.nbytes
        if held:
            yield search_shard(held, width)
        release()

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FOUND)


def repeated_runs(docs: DataFrame, scratch: Scratch, width: int, gram: int, most: int, shard_words: int) -> DataFrame:
    """(key, runs): of each document the runs, as (content, spans), with windows (from, to) that a smaller key has too.

    ``docs``: key, text. Only windows whose minimizer two documents share can repeat; they go to shards by minimizer, so
    equal windows meet and no document is read against all shards. Each distinct run is searched once, whatever the number
    of its copies. Groups of over ``most`` distinct runs are dealt by windows (``deal_hot``).
    """
    runs = scratch.put(document_runs(docs, width, gram), "runs")
    shared = scratch.put(runs.groupBy("group").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("group"), "shared")
    runs = scratch.put(runs.join(shared, "group"), "shared_runs")
    scratch.drop("runs", "shared")
    distinct = scratch.put(runs.groupBy("content").agg(F.min("group").alias("group"), F.min("key").alias("key"), F.max("key").alias("last")), "distinct")
    groups = scratch.put(distinct.groupBy("group").agg(F.min("key").alias("a"), F.max("last").alias("z"), (F.count("*") > most).alias("hot")), "groups")
    role = F.when(F.col("key") < F.col("z"), INDEXED).otherwise(0) + F.when((F.col("last") > F.col("key")) | (F.col("key") > F.col("a")), STREAMED).otherwise(0)
    wanted = distinct.join(groups, "group").groupBy("key").agg(F.collect_list(F.struct("content", "last", role.alias("role"), "hot")).alias("wanted"))
    wanted = scratch.put(wanted, "wanted")
    scratch.drop("distinct", "groups")
    pieces = scratch.put(cut_pieces(docs.join(wanted, "key"), width, gram), "pieces")
    scratch.drop("wanted")
    dealt = pieces.where("not hot").select(F.col("group").alias("shard"), *_names(DEALT)[1:])
    hot = pieces.where("hot")
    if hot.limit(1).count():
        dealt = dealt.unionByName(deal_hot(hot, scratch, width, most))
    found = scratch.put(search_shards(dealt, width, shard_words), "found")
    scratch.drop("pieces", "hot_windows", "hot_sizes", "hot_places", "hot_streamed", "hot_salts")
    earlier = F.transform(F.filter("spans", lambda s: s["least"] < F.col("key")), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to")))
    copies = runs.join(found, "content").where(F.exists("spans", lambda s: s["least"] < F.col("key")))
    lists = scratch.put(copies.groupBy("key").agg(F.collect_set(F.struct("content", earlier.alias("spans"))).alias("runs")), "lists")
    scratch.drop("shared_runs", "found")
    return lists


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 12, most: int = 512, shard_words: int = 750_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The input's columns, and: n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text.

    Words are what ASCII white space separates, unchanged. A word goes if it stands in a window of ``width`` words that
    also starts in a document with a smaller key; windows are judged on the input. ``kept_text`` is the text itself if
    nothing goes, else the kept words joined by one space. Input columns of these names are replaced, others kept.

    Null texts have no words, and stay null as kept_text. Rows with a null key lose nothing and take nothing from others.
    Rows with equal keys take nothing from each other. The key is a whole number. Words are compared by their bytes, runs
    by 128 bits of BLAKE2b. Every row gives one row, an empty table none. A task holds one shard of the index, or 1 MB of
    text; a longer text is held whole.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    lists = repeated_runs(source, scratch, width, gram, most, shard_words)
    names = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    rest = [c for c in docs.columns if c not in names]
    joined = docs.select(*rest).withColumn("__key", F.col(key).cast("long")).join(lists.select(F.col("key").alias("__key"), F.col("runs").alias("__runs")), "__key", "left")

    def removed(texts: list[bytes], lists: list[list[dict]]) -> list[np.ndarray]:
        """For each text which of its words go."""
        w = Words.of(texts)
        owner, first, stop, _ = minimizer_runs(w, width, gram)
        spans: list[dict[bytes, list[dict]]] = [{} for _ in texts]
        for own, runs in zip(spans, lists, strict=True):
            for x in runs:
                own.setdefault(x["content"], []).extend(x["spans"])
        gone = np.zeros(len(w) + 1, np.int64)
        for k, name, a in zip(owner.tolist(), w.names(first, stop + width - 1), first.tolist(), strict=True):
            for s in spans[k].get(name, ()):
                gone[a + s["from"]] += 1
                gone[a + s["to"] + width - 1] -= 1
        gone = np.cumsum(gone) > 0
        return [gone[a:b] for a, b in zip(w.first.tolist(), w.last.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = binaries(batch.column(rest.index(text)))
            bodies = [normal(t) for t in texts]
            lists = batch.column(len(rest)).to_pylist()
            hit = [k for k, x in enumerate(lists) if x and bodies[k]]
            gone = dict(zip(hit, removed([bodies[k] for k in hit], [lists[k] for k in hit]), strict=True)) if hit else {}
            out: tuple[list, ...] = ([], [], [], [])
            for k, (t, body) in enumerate(zip(texts, bodies, strict=True)):
                n, lost = body.count(b" ") + 1 if body else 0, 0
                if k in gone and (lost := int(gone[k].sum())):
                    body = t = b" ".join([x for x, g in zip(body.split(b" "), gone[k].tolist(), strict=True) if not g])
                for to, x in zip(out, (n, lost, hashlib.sha256(body).hexdigest(), t), strict=True):
                    to.append(x)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(rest))], *arrays], names=[*rest, *names])

    schema = docs.select(rest).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    return joined.select(*rest, "__runs").mapInArrow(run, schema)
